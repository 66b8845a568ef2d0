r"""Personal data: patterns propose spans, checksums confirm them, context scores them.

All of it is column expressions; no Python runs on the executors.  A pattern
is applied once per kind: its matches are put between two marks, the text is
split at the first mark, and running lengths give the spans in code points.
The texts' own occurrences of the mark characters are replaced beforehand by
another character that no pattern matches, so positions don't move.

The patterns match just what the plain forms below match, leftmost and
without overlap, but with possessive repeats, and starting only where a run
starts or the last match ended: a failed run is never tried again from its
middle, so time is linear in the text and no repeat recurses.

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)          each part at most 255
    card   [0-9]([\x20-]?[0-9])+                         16 to 19 digits, Luhn
    phone  \+[0-9][\x20().0-9-]+[0-9]                    8 to 15 digits
    iban   two capitals, two digits, 11 to 31 more       mod 97 is 1
    secret [A-Za-z0-9]{32,64}, with a digit, standing alone

Spans of the first four kinds are always kept; those of the other kinds,
which the method adds, only from ``min_score`` on, which they reach by a word
that tells what they are standing near.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

OPEN, SHUT, OTHER = "\x01", "\x02", "\x03"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    may_hold: str  # a cheap condition that every text with a match meets
    base: bool
    score: float
    context: str  # words that raise the score if they stand near


# The kinds in their order, their patterns, scores and context words.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", True, 0.8, "mail|contact|write"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", True, 0.6, "ip|address|host|server"),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", "", True, 0.7, "card|credit|visa|payment"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", True, 0.6, "phone|call|tel|mobile"),
    Kind("iban", r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,6}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9_])", "", False, 0.5, "iban|account|bank|transfer"),
    Kind("secret", r"(?<![A-Za-z0-9_])[A-Za-z0-9]{32,64}(?![A-Za-z0-9_])", "", False, 0.5, "token|secret|key|password"),
)

#: Code points on either side of a span, not beyond the next match of its kind, in which context words are looked for; what they add.
NEAR, BONUS = 40, 0.25

SPAN = "struct<kind:string,start:bigint,end:bigint,score:double>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""
    n = F.length(digits)
    places = F.sequence(F.lit(1), n)

    def step(total, i):
        d = F.ascii(F.substring(digits, i, F.lit(1))) - 48
        twice = F.when(d >= 5, 2 * d - 9).otherwise(2 * d)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(places, F.lit(0), step) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number, blanks removed, leaves 1 modulo 97."""
    turned = F.concat(F.substring(iban, 5, 100), F.substring(iban, 1, 4))

    def step(rest, i):
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, rest * 100 + c - 55).otherwise(rest * 10 + c - 48) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def confirmed(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        bare = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(bare, lambda p: F.when(F.length(p) <= 3, F.concat(F.lit("0"), p).cast("int") <= 255).otherwise(False))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    if kind == "iban":
        bare = F.replace(match, F.lit(" "), F.lit(""))
        return F.when(F.length(bare).between(15, 34), mod97(bare)).otherwise(False)
    if kind == "secret":
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]")
    return F.lit(True)


def score(kind: Kind, near: Column) -> Column:
    return F.round(F.lit(kind.score) + F.when(near.rlike(rf"(?i)(?:^|[^A-Za-z])(?:{kind.context})"), F.lit(BONUS)).otherwise(F.lit(0.0)), 4)


def matches(kind: Kind, text: Column, min_score: float) -> Column:
    """Array of ``SPAN`` of the confirmed matches in ``text``, marks already out of it; of added kinds those of ``min_score``."""
    marked = F.regexp_replace(text, f"({kind.pattern})", f"{OPEN}$1{SHUT}")
    pieces = F.split(marked, OPEN)
    none = F.array().cast(f"array<{SPAN}>")
    begin = F.struct(F.length(F.get(pieces, F.lit(0))).cast("long").alias("at"), F.right(F.get(pieces, F.lit(0)), F.lit(NEAR)).alias("before"), none.alias("out"))

    def step(acc, piece):
        m, after = F.substring_index(piece, SHUT, 1), F.substring_index(piece, SHUT, -1)
        start = acc["at"]
        end = start + F.length(m)
        worth = score(kind, F.concat(acc["before"], F.lit(" "), F.substring(after, 1, NEAR)))
        one = F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), end.alias("end"), worth.alias("score"))
        good = confirmed(kind.name, m) if kind.base else confirmed(kind.name, m) & (worth >= min_score)
        more = F.when(good, F.concat(acc["out"], F.array(one))).otherwise(acc["out"])
        before = F.right(F.concat(acc["before"], m, after), F.lit(NEAR))
        return F.struct((start + F.length(piece) - 1).alias("at"), before.alias("before"), more.alias("out"))

    found = F.aggregate(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), begin, step, lambda acc: acc["out"])
    if kind.name in MAY:
        may = text.rlike(MAY[kind.name])
    else:
        may = F.contains(text, F.lit(kind.may_hold))
        if kind.name == "ip":
            may = may & text.rlike(r"[0-9]\.[0-9]++\.[0-9]")
    return F.when(may, found).otherwise(none)


#: What every text with a match of these kinds holds.
MAY = {"card": r"[0-9](?:[ -]?[0-9]){15}", "iban": "[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", "secret": "[A-Za-z0-9]{32}"}


def personal_data(df: DataFrame, text_col: str, *, min_score: float = 0.7, name: str = "pii") -> DataFrame:
    """``df`` with an array more: structs (kind, start, end, score), by kind as listed, then start.

    Positions are code points, the end exclusive.  A span scores what its
    kind does, and more where a context word stands near; spans of added
    kinds are kept from ``min_score`` on.  Null and empty texts have an empty
    array; texts are taken whole.  Repeated rows are each looked at; an empty
    table gives an empty result.  The array is called ``name``, with
    underscores in front where ``df`` has such a column.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    safe = F.translate(text, OPEN + SHUT, OTHER + OTHER)
    return df.withColumn(free_name(df, name), F.concat(*[matches(k, safe, min_score) for k in KINDS]))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        gap = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        put = F.concat(gap, F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(
            F.greatest(acc["at"], -s["minus"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(put))).otherwise(acc["out"]).alias("out"),
        )

    whole = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(ordered, begin, step, whole)).otherwise(text)


def joined(spans: Column, base_only: bool = False) -> Column:
    """kind:start:end of the spans, comma-joined."""
    names = [k.name for k in KINDS if k.base]
    kept = F.filter(spans, lambda s: s["kind"].isin(names)) if base_only else spans
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def scores(spans: Column) -> Column:
    """kind:score of the spans, in hundredths, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], F.rint(s["score"] * 100).cast("int").cast("string"))), ",")
