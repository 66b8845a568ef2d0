"""What leaves the engine: masked JSON, ground-truth tables, findings and tables as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.masking import masked
from ..operators.rules import severity_rank

# The columns of a ground-truth file, in order, with the decimals they are written with (null: as they are).
TRUTH_COLUMNS = (("site_id", None), ("lat", 7), ("lon", 7), ("elev_m", 3), ("date", None), ("up_m", 6), ("east_m", 6), ("north_m", 6), ("method", None), ("sigma_mm", 3))


def fixed(c: str, digits: int | None) -> Column:
    return F.coalesce(F.col(c).cast("string") if digits is None else F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}f", F.col(c))), F.lit("")).alias(c)


def ground_truth_rows(df: DataFrame) -> DataFrame:
    """The columns of a ground-truth file as they are written: fixed order, fixed decimals, empty where null."""
    return df.select(*[fixed(c, d) for c, d in TRUTH_COLUMNS])


def write_ground_truth(df: DataFrame, path: str) -> None:
    ground_truth_rows(df).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def masked_json(df: DataFrame) -> DataFrame:
    """(value): each row as JSON, secrets masked."""
    return df.select(masked(F.to_json(F.struct(*df.columns))).alias("value"))


def write_records(records: DataFrame, path: str) -> None:
    """Records as masked JSON lines."""
    masked_json(records).write.mode("overwrite").text(path)


def envelope(findings: DataFrame, command: str) -> DataFrame:
    """One row: {ok, command, n_findings by severity}; ok if nothing fails.  A summary of counts, never of rows."""
    n = findings.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("FAIL", "WARN", "INFO")])
    return n.select(F.to_json(F.struct((F.col("FAIL") == 0).alias("ok"), F.lit(command).alias("command"), F.struct("FAIL", "WARN", "INFO").alias("n"))).alias("value"))


def escaped(c: Column) -> Column:
    """A cell of a text table: bars escaped, line ends as blanks."""
    return F.regexp_replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*\n\s*", " ")


def table_lines(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(line): each row as a line of a text table, cells masked."""
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[masked(escaped(F.col(c))) for c in columns]), F.lit(" |")).alias("line"))


def head_lines(columns: Sequence[str]) -> list[str]:
    return ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]


def findings_lines(findings: DataFrame) -> DataFrame:
    """(level, rule, scope, line): findings as table lines, to be ordered by the columns before."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[masked(escaped(F.col(c))) for c in ("severity", "rule", "scope", "detail")]), F.lit(" |"))
    return findings.select(severity_rank(F.col("severity")).alias("level"), "rule", "scope", cells.alias("line"))


def layover_shadow_code(layover: Column, shadow: Column, valid: Column) -> Column:
    """0 none, 1 layover, 2 shadow, 3 both, 255 no data."""
    return F.when(~valid, 255).otherwise(F.when(layover, 1).otherwise(0) + F.when(shadow, 2).otherwise(0))


def spread(mean: Column, std: Column, digits: int = 3) -> Column:
    """``mean ± std`` as text."""
    return F.concat(F.format_string(f"%.{digits}f", mean), F.lit(" ± "), F.format_string(f"%.{digits}f", std))


def sweep_lines(rows: DataFrame, front: DataFrame, index: str, params: str, metrics: Sequence[str], digits: int = 3) -> DataFrame:
    """(index, line): the points of a sweep as table lines; ``*`` marks those of the front, missing metrics are empty.

    ``rows``: index, params, the metrics, ok; ``front``: the index of each
    point that none dominates.
    """
    marked = rows.join(front.select(index).distinct().withColumn("_mark", F.lit("*")), index, "left")
    said = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}f", F.col(c))), F.lit(""))
    cells = [F.col(index).cast("string"), masked(escaped(F.col(params))), *[said(c) for c in metrics], F.coalesce("_mark", F.lit("")), F.when(F.col("ok"), "ok").otherwise("failed")]
    return marked.select(index, F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def precheck_payload(candidates: DataFrame, findings: DataFrame) -> DataFrame:
    """(kind, value): candidates and findings of a precheck as masked JSON, a row each; :func:`envelope` holds the counts."""
    found = findings.select("severity", "rule", "scope", "detail")
    say = lambda df, kind: masked_json(df).select(F.lit(kind).alias("kind"), "value")
    return say(candidates, "candidate").union(say(found, "finding"))


def validation_lines(sites: DataFrame, columns: Sequence[str], digits: int = 3) -> DataFrame:
    """(site, line): one table line a site; numbers with fixed decimals, missing ones as a dash, text masked."""
    kinds = dict(sites.dtypes)
    say = lambda c: F.when(F.col(c).isNull() | F.isnan(F.col(c)), "-").otherwise(F.format_string(f"%.{digits}f", F.col(c))) if kinds[c] in ("double", "float") else masked(escaped(F.col(c)))
    return sites.select("site", F.concat(F.lit("| "), F.concat_ws(" | ", *[say(c) for c in ("site", *columns)]), F.lit(" |")).alias("line"))


def closure_dashboard(triplets: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys..., value): per network the number of triplets, their root mean square and the largest, as JSON."""
    v = F.col(value)
    n = triplets.groupBy(*keys).agg(F.count(v).alias("n_triplets"), F.sqrt(F.avg(v * v)).alias("rms"), F.max(F.abs(v)).alias("largest"))
    return n.select(*keys, F.to_json(F.struct("n_triplets", "rms", "largest")).alias("value"))
