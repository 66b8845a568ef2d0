"""URL filter: a weighted vocabulary found by Aho-Corasick, with host and path rules first.

Terms are looked up in the lower-cased URL in one pass of an automaton.  A
hit counts only between boundaries: the characters beside it are neither
letters nor digits.  One strict term, or ``soft_limit`` distinct soft terms,
reject the URL.  Rules, where given, come first; the longest that fits wins.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The default vocabulary and the upper- and lower-case letters.
STRICT_TERMS = ("porn", "xxx", "escort", "hentai", "camgirl")
SOFT_TERMS = ("adult", "bet", "betting", "casino", "dating", "hot", "jackpot", "loan", "poker", "sex", "slots", "viagra")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@lru_cache(maxsize=8)
def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    import ahocorasick

    auto = ahocorasick.Automaton()
    for weight, terms in (("soft", soft), ("strict", strict)):
        for term in terms:
            if term:
                auto.add_word(term.lower(), (weight, term.lower()))
    auto.make_automaton()
    return auto


def count_terms(url: str | None, strict: tuple[str, ...], soft: tuple[str, ...]) -> tuple[int, int]:
    """Number of strict hits and of distinct soft terms, both at boundaries; (0, 0) for null."""
    text = (url or "").lower()
    auto = _automaton(strict, soft)
    if not len(auto):
        return 0, 0
    n_strict, found = 0, set()
    for last, (weight, term) in auto.iter(text):
        first = last - len(term) + 1
        if (first and text[first - 1].isalnum()) or (last + 1 < len(text) and text[last + 1].isalnum()):
            continue
        if weight == "strict":
            n_strict += 1
        else:
            found.add(term)
    return n_strict, len(found)


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def judge_urls(
    df: DataFrame,
    id_col: str,
    url_col: str,
    *,
    rules: list[tuple[str, str, str]] = (),
    strict: tuple[str, ...] = STRICT_TERMS,
    soft: tuple[str, ...] = SOFT_TERMS,
    soft_limit: int = 2,
) -> DataFrame:
    """One row per input row: (id, host, path, rule, verdict, n_strict, n_soft).

    ``rules``: (verdict, host, path prefix).  A rule fits its host and every
    subdomain, for paths that start with its prefix; the longest host and
    prefix wins.  Null URLs and those without ``://`` have empty host and
    path and fit no rule; null and empty URLs have no hits and are allowed.
    Repeated rows are each judged.  Other columns are neither read nor
    returned.  The rules and the vocabulary are parameters of bounded size.
    """

    def run(batches):
        for batch in batches:
            hits = [count_terms(u.as_py(), strict, soft) for u in batch.column(1)]
            more = [pa.array([h[k] for h in hits], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], ["id", "url", "n_strict", "n_soft"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.mapInArrow(run, f"id {kind}, url string, n_strict long, n_soft long")
    rows = rows.select("id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), "n_strict", "n_soft")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    method = F.when((F.col("n_strict") >= 1) | (F.col("n_soft") >= soft_limit), "block").otherwise("allow")
    return rows.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "n_strict", "n_soft")
