"""Pipeline runs as data: stages of a run, which of them are due, plans, steps and jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

# The stages in their order: what each needs, may use, and makes, the setting that names its engine, and whether it may be absent.
STAGES = (
    ("search", (), (), ("candidates",), None, False),
    ("precheck", ("candidates",), (), ("stack", "precheck_report"), None, False),
    ("fetch", ("stack",), (), ("slc_manifest",), "engine.interferogram", False),
    ("coregister", ("slc_manifest",), ("stack",), ("coreg_manifest",), "engine.interferogram", False),
    ("interferogram", ("coreg_manifest",), ("stack",), ("igrams",), "engine.interferogram", False),
    ("multilook", ("igrams",), ("stack",), ("igrams",), "engine.interferogram", False),
    ("unwrap", ("igrams",), (), ("unw",), "unwrap.method", False),
    ("timeseries", ("unw", "igrams"), (), ("timeseries", "mintpy_workdir"), "timeseries.engine", False),
    ("corrections", ("timeseries",), ("mintpy_workdir",), ("timeseries", "velocity", "mintpy_workdir"), "timeseries.engine", False),
    ("geocode", ("timeseries",), ("mintpy_workdir",), ("velocity",), "timeseries.engine", False),
    ("validate", (), ("velocity", "timeseries"), ("validation_report",), None, True),
)

STAGE_SCHEMA = "position int, stage string, inputs array<string>, optional_inputs array<string>, outputs array<string>, engine_key string, optional boolean"


def registry(spark, stages: Sequence[tuple] = STAGES) -> DataFrame:
    """One row a stage, in order."""
    return spark.createDataFrame([(k, n, list(i), list(o), list(out), e, opt) for k, (n, i, o, out, e, opt) in enumerate(stages)], STAGE_SCHEMA)


def window_of(stages: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """The stages from one to another, both included; names that are no stage are refused."""
    known = {r.stage: r.position for r in stages.select("stage", "position").collect()}  # a pipeline has a dozen
    for name in (first, last):
        if name is not None and name not in known:
            raise ValueError(f"unknown stage {name!r}")
    return stages.where(F.col("position").between(known.get(first, 0), known.get(last, len(known))))


def producers(nodes: DataFrame) -> DataFrame:
    """(run, position, name, required, producer): for each input the latest earlier stage of the run that makes it and isn't skipped; null where none does.

    ``nodes``: run, position, inputs, optional_inputs, outputs, skipped.
    """
    made = nodes.where("not skipped").select("run", F.col("position").alias("by"), F.explode("outputs").alias("name"))
    asked = nodes.select("run", "position", F.explode(F.concat(F.transform("inputs", lambda n: F.struct(n.alias("name"), F.lit(True).alias("required"))), F.transform("optional_inputs", lambda n: F.struct(n.alias("name"), F.lit(False).alias("required"))))).alias("i"))
    asked = asked.select("run", "position", "i.name", "i.required")
    met = asked.join(made, ["run", "name"], "left").groupBy("run", "position", "name", "required")
    return met.agg(F.max(F.when(F.col("by") < F.col("position"), F.col("by"))).alias("producer"))


def statuses(nodes: DataFrame, n_stages: int) -> DataFrame:
    """nodes with ``status``: skipped, blocked, to_run or cached.

    ``nodes`` have besides what :func:`producers` asks for: forced, and
    fresh (a record of the same settings and inputs is there).  A stage is
    blocked if a required input has no producer or a blocked one; it is to be
    run if it isn't fresh, is forced, or a producer is to be run.  Positions
    rise along every edge, so ``n_stages`` steps of a fold over the run's
    stages, an array of that size, settle all.
    """
    edges = producers(nodes).groupBy("run", "position").agg(
        F.collect_set(F.col("producer")).alias("from"), F.bool_or(F.col("required") & F.col("producer").isNull()).alias("lacks"), F.collect_set(F.when(F.col("required"), F.col("producer"))).alias("needs")
    )
    none = F.array().cast("array<int>")
    n = nodes.join(edges, ["run", "position"], "left").withColumns({"from": F.coalesce("from", none), "needs": F.coalesce("needs", none), "lacks": F.coalesce("lacks", F.lit(False))})
    runs = n.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("position", "skipped", "forced", "fresh", "lacks", "from", "needs"))).alias("all"))
    start = F.struct(F.array().cast("array<int>").alias("due"), F.array().cast("array<int>").alias("stuck"), F.array().cast("array<struct<position:int,status:string>>").alias("out"))

    def step(acc, s):
        stuck = s["lacks"] | F.arrays_overlap(s["needs"], acc["stuck"])
        due = s["forced"] | ~s["fresh"] | F.arrays_overlap(s["from"], acc["due"])
        status = F.when(s["skipped"], "skipped").when(stuck, "blocked").when(due, "to_run").otherwise("cached")
        add = lambda a, yes: F.when(yes, F.concat(a, F.array(s["position"]))).otherwise(a)
        return F.struct(add(acc["due"], status == "to_run").alias("due"), add(acc["stuck"], status == "blocked").alias("stuck"), F.concat(acc["out"], F.array(F.struct(s["position"].alias("position"), status.alias("status")))).alias("out"))

    settled = runs.select("run", F.explode(F.aggregate("all", start, step, lambda acc: acc["out"])).alias("s")).select("run", "s.position", "s.status")
    return nodes.join(settled, ["run", "position"])


def dry_run(nodes: DataFrame) -> DataFrame:
    """Per run: stages by status, and the resources of those to be run: times, disk and credits added, memory at its largest."""
    due = lambda c: F.when(F.col("status") == "to_run", F.col(c))
    return nodes.groupBy("run").agg(
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("cached", "to_run", "blocked", "skipped")],
        F.coalesce(F.sum(due("time_s")), F.lit(0.0)).alias("time_s"), F.coalesce(F.sum(due("disk_gb")), F.lit(0.0)).alias("disk_gb"), F.coalesce(F.max(due("rss_gb")), F.lit(0.0)).alias("rss_gb"),
    )


def pair_summary(nodes: DataFrame) -> DataFrame:
    """(run, stage, computed): pairs are never added over stages; the stage that computes most stands for the run, the earliest on a tie."""
    return nodes.groupBy("run").agg(F.max_by(F.struct("stage", "computed"), F.struct("computed", -F.col("position"))).alias("s")).select("run", "s.stage", "s.computed")


def pending(steps: DataFrame, completed: DataFrame) -> DataFrame:
    """Steps of a folder without a completion; ``steps``: folder, step, order; ``completed``: folder, step."""
    return steps.join(completed.select("folder", "step").distinct(), ["folder", "step"], "left_anti")


def sub_range(steps: DataFrame, first: Column, last: Column) -> DataFrame:
    """The steps of each folder from one to another, both included, in their order."""
    w = Window.partitionBy("folder")
    at = lambda name: F.min(F.when(F.col("step") == name, F.col("order"))).over(w)
    return steps.withColumn("_a", at(first)).withColumn("_b", at(last)).where((F.col("order") >= F.coalesce("_a", F.lit(0))) & (F.col("order") <= F.coalesce("_b", F.col("order")))).drop("_a", "_b")


def first_failed(jobs: DataFrame) -> DataFrame:
    """The first job of each folder, in order of step and job, that returned non-zero; ``jobs``: folder, order, job, code."""
    return jobs.where("code <> 0").groupBy("folder").agg(F.min_by(F.struct("order", "job", "code"), F.struct("order", "job")).alias("j")).select("folder", "j.*")


def inventory(expected: DataFrame, files: DataFrame, key: Sequence[str]) -> DataFrame:
    """Expected files with whether they exist and how large they are."""
    have = files.groupBy(*key).agg(F.max("bytes").alias("bytes"))
    return expected.join(have, list(key), "left").withColumn("exists", F.col("bytes").isNotNull()).withColumn("bytes", F.coalesce("bytes", F.lit(0).cast("long")))


def cleanup_targets(candidates: DataFrame, protected: DataFrame) -> DataFrame:
    """Paths that a policy would delete, without those that are protected or lie below or above a protected one.

    ``candidates``: folder, path; ``protected``: folder, path.  Paths meet by
    their ancestors, so the join has equal keys.
    """
    parts = lambda c: F.split(F.col(c), "/")
    above = lambda c: F.transform(F.sequence(F.lit(1), F.size(parts(c))), lambda n: F.array_join(F.slice(parts(c), F.lit(1), n), "/"))
    below_protected = candidates.select("folder", "path", F.explode(above("path")).alias("up")).join(protected.select("folder", F.col("path").alias("up")), ["folder", "up"]).select("folder", "path")
    holds_protected = protected.select("folder", F.explode(above("path")).alias("path"))
    return candidates.join(below_protected.union(holds_protected).distinct(), ["folder", "path"], "left_anti")


def superseded_removed(rows: DataFrame, replaced: DataFrame, key: str) -> DataFrame:
    """Rows whose id no other replaces; ``replaced``: the key column with what is superseded."""
    return rows.join(replaced.select(key).distinct(), key, "left_anti")


def in_scope(scope: Column, name: Column) -> Column:
    """Whether a finding's scope is a stack or one of its parts."""
    return (scope == name) | F.startswith(scope, F.concat(name, F.lit(":")))
