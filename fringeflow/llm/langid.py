"""Language identification by interpolated Kneser-Ney character models.

One model per language, of character 4-grams: the highest order from counts,
the lower ones from continuation counts, each interpolated with the next.
Every order is stored as a sorted array of 64-bit gram hashes with, per
language, the log probability already interpolated down, and a sorted array
of context hashes with the weights for grams not seen.  Languages are held in
groups of ``TOGETHER``, each with arrays of its own.  A document gets the language of
the lowest cross-entropy per character.  It is accepted if that lies below
the middle between the upper tail of labelled documents of this language and
the lower tails of strange text that would come here: labelled documents of
other languages, by the best model but their own, and labelled documents read
backwards.  Short texts have the range that their length brings, if wider.

Characters that are not letters count as one blank; texts are lower-cased.

Scale: every labelled document is counted, each task sending one row per
distinct gram and language to a grouped sum.  The models hold every gram that
occurs: they grow with the distinct 4-grams of the corpus, not with its text,
and reach the driver one group of languages at a time.  The rejection range
comes from all labelled documents: each is scored as it is and backwards, copies are
told once, and tails are exact quantiles, found from grouped counts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import durable, free_name

ORDER = 4

#: Characters worked on at once, about.
AT_ONCE = 1 << 19

UNDETERMINED = "und"

#: Texts of so many characters or more set the limit of rejection, where there are any.
LONG = 100

#: Distinct texts of each language at least where a sample is asked for.
LEAST = 500


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts as one array of code points, with where each starts in it, and each one's letters.

    Before each text stand three boundaries (code 0); runs of other
    characters than letters are one blank (32).
    """
    edge = "\0" * (ORDER - 1)
    joined = edge + edge.join((t or "").replace("\0", " ").lower() for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    blank = ~letter & (codes != 0)
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    codes = np.where(blank, np.uint32(32), codes)[keep]
    letter = letter[keep]
    edges = np.flatnonzero(codes == 0)
    starts = edges[ORDER - 2 :: ORDER - 1][: len(texts)] + 1
    n = np.add.reduceat(letter, starts - 1) if len(starts) else np.zeros(0, int)
    return codes, starts, n


def gram_hashes(codes: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For orders 1 to ORDER the 64-bit hashes of the grams that end at each place from ORDER - 1 on, and of those that end one place earlier.

    A boundary is taken to stand before the first place.
    """
    c = np.concatenate([np.zeros(1, np.uint32), codes])
    c = np.where(c == 0, np.uint32(32), c).astype(np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    h, power, out = np.zeros(max(0, len(c) - ORDER + 1), np.uint64), np.uint64(1), []
    for k in range(ORDER):
        h += c[ORDER - 1 - k : len(c) - k] * power
        power = np.uint64(int(power) * int(base) & 0xFFFFFFFFFFFFFFFF)
        m = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        m ^= m >> np.uint64(30)
        out.append(m)
    return [m[1:] for m in out], [m[:-1] for m in out]


#: Hashes that Kneser-Ney counts of a 4-gram abcd derive from: contexts and suffixes.
AUX = ("abc", "bcd", "bc", "cd", "c", "d")

#: Distinct grams that a task holds before it sends them, about.
HELD = 1 << 20


def gram_counts(df: DataFrame, text: Column, label: Column) -> DataFrame:
    """(lang, gram, n, abc, bcd, bc, cd, c, d): 4-gram counts of all labelled documents."""

    def run(batches):
        totals: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def send():
            for lang, (gram, n, aux) in totals.items():
                columns = [pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n), *(pa.array(a.view(np.int64)) for a in aux)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n", *AUX])
            totals.clear()

        def count(lang, texts):
            codes, _, _ = code_points(texts)
            if len(codes) < ORDER:
                return
            own, before = gram_hashes(codes)
            real = np.flatnonzero(codes[ORDER - 1 :] != 0)
            gram, at, n = np.unique(own[3][real], return_index=True, return_counts=True)
            at = real[at]
            aux = np.stack([h[at] for h in (before[2], own[2], before[1], own[1], before[0], own[0])])
            if lang in totals:
                old, m, more = totals[lang]
                gram, at, to = np.unique(np.concatenate([old, gram]), return_index=True, return_inverse=True)
                n = np.bincount(to, np.concatenate([m, n]), len(gram)).astype(np.int64)
                aux = np.concatenate([more, aux], axis=1)[:, at]
            totals[lang] = (gram, n.astype(np.int64), aux)

        for batch in batches:
            held: dict[str, tuple[list, int]] = {}
            for t, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                texts, chars = held.get(lang, ([], 0))
                texts.append(t.as_py())
                chars += len(texts[-1])
                if chars > AT_ONCE:
                    count(lang, texts)
                    texts, chars = [], 0
                held[lang] = (texts, chars)
            for lang, (texts, _) in held.items():
                if texts:
                    count(lang, texts)
            if sum(len(g) for g, _, _ in totals.values()) > HELD:
                yield from send()
        yield from send()

    rows = df.select(text.cast("string").alias("text"), label.cast("string").alias("lang")).where("text is not null and lang is not null")
    sent = rows.mapInArrow(run, "lang string, gram long, n long, " + ", ".join(f"{a} long" for a in AUX))
    return sent.groupBy("lang", "gram").agg(F.sum("n").alias("n"), *[F.min(a).alias(a) for a in AUX])


class Sorted:
    """A sorted array of distinct 64-bit hashes, with a directory of where each value of the first bits begins."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = min(22, max(1, len(keys).bit_length() + 1))
        self.first = None

    def __getstate__(self):
        return self.__dict__ | {"first": None}

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 where it isn't there."""
        if not len(self.keys):
            return np.full(len(h), -1)
        shift = np.uint64(64 - self.bits)
        if self.first is None:
            self.first = np.searchsorted(self.keys >> shift, np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)
        part = (h >> shift).astype(np.int64)
        at = self.first[part]
        end = self.first[part + 1]
        many = np.flatnonzero(end - at > 1)
        if len(many):
            at[many] = np.searchsorted(self.keys, h[many])
        at = np.minimum(at, len(self.keys) - 1)
        return np.where(self.keys[at] == h, at, -1)


@dataclass
class Group:
    """Models of a few languages.  Per order k (index k - 1): sorted grams with their log probabilities by language; sorted contexts with weights."""

    langs: list[str]
    grams: list[Sorted]
    logp: list[np.ndarray]
    contexts: list[Sorted]
    logw: list[np.ndarray]
    unknown: np.ndarray

    def logs(self, grams: list[np.ndarray], before: list[np.ndarray]) -> np.ndarray:
        """Log probability, by language, of each place from ORDER - 1 on."""
        at = self.grams[ORDER - 1].find(grams[ORDER - 1])
        out = self.logp[ORDER - 1][at] if len(self.logp[ORDER - 1]) else np.zeros((len(at), len(self.langs)), np.float32)
        todo = np.flatnonzero(at < 0)
        out[todo] = 0
        for k in range(ORDER, 0, -1):
            if k < ORDER:
                at = self.grams[k - 1].find(grams[k - 1][todo])
                hit = at >= 0
                out[todo[hit]] += self.logp[k - 1][at[hit]]
                todo = todo[~hit]
            if k > 1 and len(todo):
                c = self.contexts[k - 1].find(before[k - 2][todo])
                seen = c >= 0
                out[todo[seen]] += self.logw[k - 1][c[seen]]
        out[todo] += self.unknown
        return out


@dataclass
class Models:
    """All languages, and what their accepted texts look like."""

    groups: list[Group]
    mean: np.ndarray | None = None
    between: np.ndarray | None = None
    within: np.ndarray | None = None
    limit: np.ndarray | None = None

    @property
    def langs(self) -> list[str]:
        return [x for g in self.groups for x in g.langs]

    def logs(self, codes: np.ndarray) -> np.ndarray:
        grams, before = gram_hashes(codes)
        return np.concatenate([g.logs(grams, before) for g in self.groups], axis=1)


def _discount(n: np.ndarray) -> float:
    one, two = (n == 1).sum(), (n == 2).sum()
    return float(one / (one + 2 * two)) if one and two else 0.5


def _levels(rows: dict[str, np.ndarray]) -> list[tuple]:
    """(gram, context, suffix, count) of one language's orders from 1 up, from its counted 4-grams; lower orders count the grams above that end in theirs."""
    levels = [(rows["gram"], rows["abc"], rows["bcd"], rows["n"].astype(np.float64))]
    source = np.arange(len(rows["gram"]))  # a counted 4-gram that each gram of the level ends
    for context, suffix in (("bc", "cd"), ("c", "d"), (None, None)):
        gram, first, n = np.unique(levels[-1][2], return_index=True, return_counts=True)
        source = source[first]
        levels.append((gram, *[rows[c][source] if c else None for c in (context, suffix)], n.astype(np.float64)))
    return levels[::-1]


def estimate(langs: list[str], rows: list[dict[str, np.ndarray]]) -> Group:
    """Interpolated Kneser-Ney from each language's counted 4-grams."""
    n_lang, levels = len(langs), [_levels(r) for r in rows]
    # order 1: continuation counts over the total, the discount spread evenly over all characters
    grams = [np.unique(np.concatenate([x[0][0] for x in levels]))]
    p, unknown = np.zeros((len(grams[0]), n_lang)), np.zeros(n_lang)
    for k, level in enumerate(levels):
        key, _, _, n = level[0]
        d, total = _discount(n), n.sum()
        unknown[k] = d * len(n) / total / 0x110000 if total else 1 / 0x110000
        p[:, k] = unknown[k]
        p[np.searchsorted(grams[0], key), k] += (n - d) / total if total else 0
    logp, contexts, logw = [p], [np.zeros(0, np.uint64)], [np.zeros((0, n_lang))]
    for order in range(1, ORDER):
        own = [x[order] for x in levels]
        keys, first = np.unique(np.concatenate([x[0] for x in own]), return_index=True)
        ctx, suf = (np.concatenate([x[c] for x in own])[first] for c in (1, 2))
        all_ctx = np.unique(ctx)
        weight, seen = np.ones((len(all_ctx), n_lang)), np.zeros((len(keys), n_lang))
        for k, (key, context, _, n) in enumerate(own):
            if not len(n):
                continue
            d, c = _discount(n), np.searchsorted(all_ctx, context)
            total, kinds = np.bincount(c, n, len(all_ctx)), np.bincount(c, minlength=len(all_ctx))
            weight[:, k] = np.where(total > 0, d * kinds / np.maximum(total, 1), 1)
            seen[np.searchsorted(keys, key), k] = np.maximum(n - d, 0) / total[c]
        place = np.minimum(np.searchsorted(grams[-1], suf), len(grams[-1]) - 1)
        lower = np.where((grams[-1][place] == suf)[:, None], logp[-1][place], unknown)
        logp.append(seen + weight[np.searchsorted(all_ctx, ctx)] * lower)
        grams.append(keys)
        contexts.append(all_ctx)
        logw.append(weight)
    log = lambda x: np.log(np.maximum(x, 1e-12)).astype(np.float32)
    return Group(langs, [Sorted(g) for g in grams], [log(x) for x in logp], [Sorted(c) for c in contexts], [log(x) for x in logw], log(unknown))


#: Languages whose models share arrays.
TOGETHER = 8


def estimated(counted: DataFrame) -> Models:
    """Models of all languages counted, one group of languages on the driver at a time."""
    names = sorted(r[0] for r in counted.select("lang").distinct().collect())
    groups = []
    for k in range(0, len(names), TOGETHER):
        some = names[k : k + TOGETHER]
        got = counted.where(F.col("lang").isin(some)).toArrow()
        lang = np.array(got.column("lang").to_pylist(), object)
        columns = {c: got.column(c).to_numpy() for c in ("gram", "n", *AUX)}
        columns = {c: x if c == "n" else x.astype(np.int64).view(np.uint64) for c, x in columns.items()}
        groups.append(estimate(some, [{c: x[lang == own] for c, x in columns.items()} for own in some]))
    return Models(groups)


def train(df: DataFrame, text: Column, label: Column, *, calibration: int | None = None) -> Models:
    """Models and the rejection range from all rows of ``df`` with a text and a label, each distinct text of a language once in the range.

    With ``calibration`` the range is fitted on about so many rows of a
    hashed sample instead.
    """
    models = estimated(durable(gram_counts(df, text, label)))
    langs = models.langs
    if not langs:
        return models
    rows = df.select(text.cast("string").alias("text"), label.cast("string").alias("lang")).where("text is not null and lang is not null")
    rows = rows.withColumn("h", F.xxhash64("text"))
    if calibration is not None:
        # of each language about as many distinct texts, however many rows and copies there are
        kinds = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("kinds"))
        each = max(LEAST, calibration // (2 * len(langs)))
        share = kinds.select("lang", F.least(F.lit(1.0), each / F.col("kinds")).alias("share"))
        rows = rows.join(F.broadcast(share), "lang").where(F.pmod("h", F.lit(1 << 40)) < F.col("share") * (1 << 40))
    facts = judged_both_ways(rows.select("text", "lang", "h"), models)
    # copies have equal facts; they meet as numbers, not as texts
    once = [F.first(c).alias(c) for c in ("best", "next", "chars", "entropy", "spread", "bits", "next_bits")]
    facts = durable(facts.groupBy("lang", "h", "turned").agg(*once))
    right = F.coalesce(F.col("lang") == F.col("best"), F.lit(False))

    w, h = F.col("chars").cast("double"), F.col("entropy")
    sums = facts.where("not turned").groupBy("lang", right.alias("right")).agg(F.sum(w), F.sum(w * h), F.sum(w * h * h), F.sum(w * F.col("spread"))).collect()
    sums = {(r[0], r[1]): r[2:] for r in sums}

    # what would come to each language: texts read backwards, and those of other languages if these had no model
    group = lambda kind, key, hit: ((key * 3 + kind) * 2 + hit.cast("int")) * 2 + (F.col("chars") >= LONG).cast("int")
    told = lambda due, g, bits: F.when(due, F.struct(g.alias("g"), F.col(bits).alias("bits")))
    no = F.lit(False)
    measures = F.array(
        told(~F.col("turned"), group(0, F.col("lang"), right), "bits"),
        told(F.col("turned"), group(1, F.col("best"), no), "bits"),
        told(~F.col("turned") & right & F.col("next_bits").isNotNull(), group(2, F.col("next"), no), "next_bits"),
    )
    measures = durable(facts.select(F.explode(F.filter(measures, lambda x: x.isNotNull())).alias("m")).select("m.*"))
    some = {r[0] for r in measures.select("g").distinct().collect()}

    def tail(keys, kind: int, hit: bool) -> tuple[int, ...]:
        """The groups of long texts, or of all if none is long."""
        for long in (1, 0):
            found = tuple(g for k in keys if (g := ((k * 3 + kind) * 2 + hit) * 2 + long) in some)
            if found:
                return found
        return ()

    own, low = {}, {}
    for k in range(len(langs)):
        own[k] = tail([k], 0, (k, True) in sums)  # if none is nearest its own language, all
        low[k] = [g for kind in (1, 2) if (g := tail([k], kind, False) or tail(range(len(langs)), kind, False))]
    wanted = {(g, 0.998) for g in own.values() if g} | {(g, 0.05) for x in low.values() for g in x}
    at = quantiles(measures, wanted)
    models.mean, models.between, models.within, models.limit = (np.zeros(len(langs)) for _ in range(4))
    for k in range(len(langs)):
        if not own[k]:  # no text of this language has a letter: nothing can be told to be of it
            models.mean[k], models.limit[k] = -np.inf, -np.inf
            continue
        total, first, second, spread = sums[k, (k, True) in sums]
        models.mean[k] = first / total
        models.within[k] = spread / total
        models.between[k] = max(0.0, second / total - models.mean[k] ** 2)
        high = at[own[k], 0.998]
        below = min((at[g, 0.05] for g in low[k]), default=high)
        models.limit[k] = max(high, (high + below) / 2)
    return models


def judged_both_ways(rows: DataFrame, models: Models) -> DataFrame:
    """(lang, h, turned, best, next, chars, entropy, spread, bits, next_bits): what the models say of each text that has a letter, and of it read backwards.

    ``rows``: text, lang, h.  Languages are told by their places; ``bits``
    are those of the entropy (of ``next``'s in ``next_bits``), which
    sort as it does.
    """
    shared = rows.sparkSession.sparkContext.broadcast(models)
    names = ["lang", "h", "turned", "best", "next", "chars", "entropy", "spread", "bits", "next_bits"]

    def run(batches):
        m = shared.value
        place = {x: k for k, x in enumerate(m.langs)}

        def judged(texts, lang, h, turned):
            got = _score([t[::-1] for t in texts] if turned else texts, m, 4.0)
            i = np.flatnonzero(got["letters"] > 0)
            no_next = np.isnan(got["next_entropy"][i])
            bits = [np.maximum(got[c][i], 0.0).view(np.int64) for c in ("entropy", "next_entropy")]
            columns = [
                pa.array(np.array(lang, np.int32)[i]), pa.array(np.array(h, np.int64)[i]), pa.array(np.full(len(i), turned)),
                *(pa.array([place.get(x) for x in got[c][i]], pa.int32()) for c in ("best", "next")),
                *(pa.array(got[c][i]) for c in ("chars", "entropy", "spread")), pa.array(bits[0]), pa.array(bits[1], mask=no_next),
            ]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            texts, lang, h, chars = [], [], [], 0
            for t, x, k in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                texts.append(t.as_py())
                lang.append(place[x])
                h.append(k)
                chars += len(texts[-1])
                if chars > AT_ONCE:
                    yield judged(texts, lang, h, False)
                    yield judged(texts, lang, h, True)
                    texts, lang, h, chars = [], [], [], 0
            if texts:
                yield judged(texts, lang, h, False)
                yield judged(texts, lang, h, True)

    return rows.mapInArrow(run, "lang int, h long, turned boolean, best int, next int, chars long, entropy double, spread double, bits long, next_bits long")


#: Bits of a double left out in each pass of the search for quantiles.
PASSES = (44, 28, 12, 0)


def quantiles(measures: DataFrame, wanted: set[tuple[tuple[int, ...], float]]) -> dict:
    """Exact quantiles, linear between neighbours, of the numbers in groups taken together; ``measures``: g, bits (of doubles from 0 up).

    Numbers are found by their leading bits, more in each pass: a pass counts
    what shares the bits found so far, so at most 65,536 counts of a group
    and number come to the driver, however many rows there are.
    """
    spark = measures.sparkSession
    todo: dict = {}  # (groups, share, which) -> [leading bits, rank among those that have them]
    part = {}
    for turn, shift in enumerate(PASSES):
        cells = measures.withColumn("cell", F.shiftright("bits", shift))
        if turn:
            known = PASSES[turn - 1]
            needed = sorted({(g, p) for (groups, _, _), (p, _) in todo.items() for g in groups})
            if not needed:
                break
            asked = spark.createDataFrame(needed, "g int, _lead long")
            cells = cells.withColumn("_lead", F.shiftright("bits", known)).join(F.broadcast(asked), ["g", "_lead"], "left_semi")
        counts: dict = {}
        for g, cell, n in cells.groupBy("g", "cell").count().collect():
            counts.setdefault(g, {})[cell] = n
        if not turn:
            for groups, share in wanted:
                n = sum(sum(counts.get(g, {}).values()) for g in groups)
                at = (n - 1) * share
                part[groups, share] = at - int(at)
                for which in (0, 1):
                    todo[groups, share, which] = [None, min(int(at) + which, n - 1)]
        for (groups, _, _), found in todo.items():
            both: dict = {}
            for g in groups:
                for cell, n in counts.get(g, {}).items():
                    if found[0] is None or cell >> (known - shift) == found[0]:
                        both[cell] = both.get(cell, 0) + n
            for cell in sorted(both):
                if found[1] < both[cell]:
                    found[0] = cell
                    break
                found[1] -= both[cell]
    number = lambda bits: float(np.array([bits], np.int64).view(np.float64)[0])
    return {k: float(np.quantile([number(todo[*k, 0][0]), number(todo[*k, 1][0])], f)) for k, f in part.items()}


SCORED = "letters long, chars long, best string, entropy double, spread double, confidence double, next string, next_entropy double, accepted boolean"


def score(df: DataFrame, text_col: str, models: Models, name: str, tolerance: float = 4.0) -> DataFrame:
    """``df`` with a struct more; columns pass through as they are, so nothing is shuffled."""
    shared = df.sparkSession.sparkContext.broadcast(models)
    at = df.columns.index(text_col)

    def run(batches):
        m = shared.value
        for batch in batches:
            texts, done, held, chars = batch.column(at), [], [], 0
            for t in texts:
                held.append(t.as_py())
                chars += len(held[-1] or "")
                if chars > AT_ONCE:
                    done.append(_score(held, m, tolerance))
                    held, chars = [], 0
            done.append(_score(held, m, tolerance))
            out = {k: np.concatenate([d[k] for d in done]) for k in done[0]}
            struct = pa.StructArray.from_arrays([pa.array(v, from_pandas=True) if v.dtype != object else pa.array(v.tolist(), pa.string()) for v in out.values()], list(out))
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], [*batch.schema.names, name])

    schema = StructType([*df.schema.fields, StructField(name, StructType.fromDDL(SCORED))])
    return df.mapInArrow(run, schema)


def _score(texts: list, m: Models, tolerance: float) -> dict[str, np.ndarray]:
    n = len(texts)
    codes, starts, letters = code_points(texts)
    best, entropy, spread, conf = np.full(n, None, object), np.full(n, np.nan), np.zeros(n), np.zeros(n)
    following, behind = np.full(n, None, object), np.full(n, np.nan)
    accepted = np.zeros(n, bool)
    ends = np.r_[starts[1:] - (ORDER - 1), len(codes)] if n else starts
    chars = (ends - starts).astype(np.int64)
    some = np.flatnonzero(letters > 0)
    if len(m.langs) and len(some):
        logs = m.logs(codes)  # row i scores place i + ORDER - 1
        sums = np.zeros((n, len(m.langs)))
        squares = np.zeros((n, len(m.langs)))
        cuts = np.stack([starts[some], ends[some]], axis=1).ravel() - (ORDER - 1)
        logs = np.concatenate([logs, np.zeros((1, logs.shape[1]), np.float32)])
        sums[some] = np.add.reduceat(logs, cuts, axis=0, dtype=np.float64)[::2]
        np.multiply(logs, logs, out=logs)
        squares[some] = np.add.reduceat(logs, cuts, axis=0, dtype=np.float64)[::2]
        h = -sums[some] / chars[some, None]
        k = h.argmin(axis=1)
        low = h[np.arange(len(some)), k]
        names = np.array(m.langs, object)
        best[some], entropy[some] = names[k], low
        if len(names) > 1:
            others = h.copy()
            others[np.arange(len(some)), k] = np.inf
            second = others.argmin(axis=1)
            following[some], behind[some] = names[second], others[np.arange(len(some)), second]
        spread[some] = squares[some, k] / chars[some] - low**2
        sharp = np.minimum(chars[some], 60)[:, None]
        conf[some] = 1 / np.exp(np.clip(-(h - low[:, None]) * sharp, -700, 0)).sum(axis=1)
        if m.mean is not None:
            own = m.mean[k] + tolerance * np.sqrt(m.between[k] + m.within[k] / chars[some])
            accepted[some] = low <= np.maximum(own, m.limit[k]) + 1e-9
    return {"letters": letters.astype(np.int64), "chars": chars, "best": best, "entropy": entropy, "spread": spread, "confidence": conf, "next": following, "next_entropy": behind, "accepted": accepted}


def held_out(id_col: Column) -> Column:
    """Whether a row is kept from training: crc32 of its id as text leaves 1 modulo 3 (null ids: never)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(df: DataFrame, id_col: str, text_col: str, label_col: str, *, calibration: int | None = None) -> DataFrame:
    """``df`` with a struct ``language`` more: lang, score (0 to 1), accepted, entropy, held_out.

    Learns from rows with a text and a label which are not held out; the
    prediction uses the text alone, whole.  Texts that are null or have no
    letter, and all texts where nothing can be learned, get ``und``, score 0
    and are not accepted.  Repeated rows get equal results; an empty table
    gives an empty result.  The struct has underscores in front of its name
    where ``df`` has such a column.
    """
    out = held_out(F.col(id_col))
    models = train(df.where(~out), F.col(text_col), F.col(label_col), calibration=calibration)
    name = free_name(df, "language")
    scored = score(df, text_col, models, name)
    s = F.col(name)
    return scored.withColumn(
        name,
        F.struct(
            F.coalesce(s["best"], F.lit(UNDETERMINED)).alias("lang"),
            s["confidence"].alias("score"),
            s["accepted"].alias("accepted"),
            s["entropy"].alias("entropy"),
            out.alias("held_out"),
        ),
    )
