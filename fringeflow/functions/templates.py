"""Message templates, version constraints, nested settings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def formatted(template: Column, params: Column) -> Column:
    """``{name}`` filled from a string map; names that it lacks stay as they are."""
    pieces = F.split(template, r"\{")
    step = lambda piece: F.when(piece.rlike(r"^\w+\}"), F.concat(F.coalesce(params[F.regexp_extract(piece, r"^(\w+)\}", 1)], F.concat(F.lit("{"), F.substring_index(piece, "}", 1), F.lit("}"))), F.regexp_replace(piece, r"^\w+\}", ""))).otherwise(F.concat(F.lit("{"), piece))
    return F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), step), ""))


def message(catalogue: Column, key: Column, lang: Column, params: Column, fallback: str = "en") -> Column:
    """The text of a key in a language, else in the fallback, else the key itself, filled."""
    said = lambda of: catalogue[F.concat_ws("/", of, key)]
    return formatted(F.coalesce(said(lang), said(F.lit(fallback)), key), params)


def version_parts(text: Column, n: int = 3) -> Column:
    """The first dotted number in a text as ``n`` integers, zeros where it is shorter; null without one."""
    token = F.regexp_extract(text, r"(\d+(?:\.\d+)*)", 1)
    parts = F.transform(F.split(token, r"\."), lambda p: p.try_cast("int"))
    return F.when(token != "", F.slice(F.concat(parts, F.array_repeat(F.lit(0), n)), 1, n))


def satisfies(version: Column, spec: Column) -> Column:
    """Whether a version meets every clause of a specifier like ``>=2.0,<3``; true for an empty one, null for no version."""
    v = version_parts(version)

    def clause(c):
        op, bound = F.regexp_extract(c, r"^\s*(>=|<=|==|!=|>|<)", 1), version_parts(c)
        return F.when(op == ">=", v >= bound).when(op == "<=", v <= bound).when(op == "==", v == bound).when(op == "!=", v != bound).when(op == ">", v > bound).when(op == "<", v < bound)

    clauses = F.filter(F.split(spec, ","), lambda c: F.trim(c) != "")
    return F.when(v.isNotNull(), F.forall(clauses, lambda c: F.coalesce(clause(c), F.lit(False))))


def flattened(document: Column, depth: int = 4) -> Column:
    """A JSON object as a map of dotted keys to leaf values; arrays and, below ``depth``, objects stay JSON."""

    def entries(json: Column, left: int) -> Column:
        own = F.map_entries(F.from_json(json, "map<string,string>"))
        if not left:
            return own
        below = lambda e: F.transform(entries(e["value"], left - 1), lambda x: F.struct(F.concat(e["key"], F.lit("."), x["key"]).alias("key"), x["value"].alias("value")))
        leaf = lambda e: F.array(F.struct(e["key"].alias("key"), e["value"].alias("value")))
        return F.flatten(F.transform(own, lambda e: F.when(F.ltrim(e["value"]).startswith("{") & (F.size(F.from_json(e["value"], "map<string,string>")) > 0), below(e)).otherwise(leaf(e))))

    return F.map_from_entries(entries(document, depth))


def merged(documents: Sequence[Column], depth: int = 4) -> Column:
    """Right-biased union of JSON objects, leaf by leaf, as a map of dotted keys."""
    from ..operators.frames import last_wins_maps

    return last_wins_maps(*[flattened(d, depth) for d in documents])


def forbidden(document: Column, names: Sequence[str], depth: int = 4) -> Column:
    """The dotted keys of a JSON object that have a part among ``names``, sorted."""
    keys = F.map_keys(flattened(document, depth))
    return F.array_sort(F.filter(keys, lambda k: F.arrays_overlap(F.split(k, r"\."), F.array(*[F.lit(n) for n in names]))))
