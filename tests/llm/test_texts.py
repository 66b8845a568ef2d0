"""op3, op6, op7, op8, op9, op2 and the pipeline against plain versions, and their edge cases."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fringeflow.llm import chat, langid, mixing, packing, pii, queries, urlvocab
from fringeflow.llm.common import words_of

SF = "/root/testdata/sf0.001"
CLASH = "language string, mix string, pii string, words long, size long, id long, node long"


def documents(columns="doc_id, text, lang, source, n_chars"):
    return duckdb.sql(f"select {columns} from '{SF}/documents.parquet'").fetchall()


# --- language


def test_language_held_out_accuracy(spark):
    lang = {d: x for d, x in documents("doc_id, lang")}
    rows = queries.op3_language_id(spark, "/root/testdata/sf0.01").collect()
    lang = dict(duckdb.sql("select doc_id, lang from '/root/testdata/sf0.01/documents.parquet'").fetchall())
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {d for d in lang if zlib.crc32(str(d).encode()) % 3 == 1}
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.accepted for r in rows) >= 0.99 * len(rows)


def test_language_edges(spark):
    rng = random.Random(1)
    word = lambda a: "".join(rng.choice(a) for _ in range(rng.randrange(2, 8)))
    rows = [(k, " ".join(word("abcd" if k % 2 else "wxyz") for _ in range(60)), "one" if k % 2 else "two") for k in range(120)]
    rows += [(1000, None, "one"), (1001, "", "two"), (1002, " 12 !! ", "one"), (1003, "abca", None), (None, "wxyz", "one"), (None, "wxyz", "one"), (1004, "abcd " * 30000, None), (1005, "\0a\0b", "one"), (1006, "日本 語", None)]
    df = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, lang string, language string")
    out = langid.identify(df, "doc_id", "text", "lang")
    assert out.columns == [*df.columns, "_language"]
    got = collections.defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append(r._language)
    for d in (1000, 1001, 1002):
        assert (got[d][0].lang, got[d][0].score, got[d][0].accepted) == ("und", 0.0, False)
    assert all(got[k][0].lang == ("one" if k % 2 else "two") for k in range(120))
    assert got[1004][0].lang == "one" and len(got[None]) == 2 and not got[None][0].held_out
    assert langid.identify(df.limit(0), "doc_id", "text", "lang").count() == 0
    unlabelled = langid.identify(df.withColumn("lang", F.lit(None).cast("string")), "doc_id", "text", "lang").select("_language.lang").distinct().collect()
    assert [r.lang for r in unlabelled] == ["und"]


@pytest.mark.parametrize("gone", ["de", "en", "es", "fr"])
def test_language_rejects_strange_texts(spark, gone):
    """A language without labels and texts read backwards go, held-out texts of labelled languages stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    label = F.when(F.col("lang") != gone, F.col("lang"))
    rows = docs.select("doc_id", "text", label.alias("label"), F.col("lang").alias("true")).union(
        docs.select("doc_id", F.reverse("text"), F.lit(None).cast("string"), F.lit("backwards"))
    )
    got = collections.defaultdict(list)
    for r in langid.identify(rows, "doc_id", "text", "label").where("length(text) >= 100").select("true", "language.*").collect():
        got["strange" if r.true == gone else r.true if r.true == "backwards" else "own" if r.held_out else "trained"].append(r.accepted)
    share = {k: sum(v) / len(v) for k, v in got.items()}
    assert share["strange"] <= 0.02 and share["backwards"] <= 0.01 and share["own"] >= 0.99, share


def test_language_rejection_is_set_for_rare_languages_and_among_copies(spark):
    """A language of few rows has a range of its own, and a third of all rows being one text changes nothing."""
    rng = random.Random(4)
    made = lambda words: " ".join(rng.choice(words) for _ in range(60))
    vocabulary = {x: ["".join(rng.choice(a) for _ in range(rng.randrange(3, 7))) for _ in range(40)] for x, a in (("often", "abcdefgh"), ("rare", "stuvwxyz"))}
    rows = [(made(vocabulary["often"]), "often") for _ in range(400)] + [(made(vocabulary["rare"]), "rare") for _ in range(4)]
    rows += [("abc def gha " * 20, "often")] * 200
    m = langid.train(spark.createDataFrame(rows, "text string, lang string"), F.col("text"), F.col("lang"), calibration=20)
    assert all(abs(x) < 100 for x in [*m.mean, *m.limit])
    letters = "stuvwxyz"
    strange = ["".join(rng.choice(letters + " ") for _ in range(300)) for _ in range(20)]
    own = [made(vocabulary["rare"]) for _ in range(20)]
    got = langid._score(strange + own, m, 4.0)
    assert set(got["best"]) == {"rare"} and not got["accepted"][:20].any() and got["accepted"][20:].all()


def test_language_rejection_comes_from_every_text(spark):
    """The range of more distinct texts than a sample would hold, copies once, against plain quantiles of all of them."""
    import numpy as np

    rng = random.Random(8)
    made = lambda a, n: " ".join("".join(rng.choice(a) for _ in range(rng.randrange(2, 6))) for _ in range(n))
    rows = [(made(a, rng.choice((8, 40, 60))), x) for x, a in (("p", "abcdefg"), ("q", "cdefghijk"), ("r", "tuvwxyz")) for _ in range(4500 if x != "r" else 9)]
    rows += rows[:700] + [("12 34", "p"), (None, "q"), ("abc", None)]
    m = langid.train(spark.createDataFrame(rows, "text string, lang string").repartition(5), F.col("text"), F.col("lang"))
    kept = sorted({r for r in rows if None not in r and any(c.isalpha() for c in r[0])})
    texts, langs = [t for t, _ in kept], np.array([x for _, x in kept])
    own, back = langid._score(texts, m, 4.0), langid._score([t[::-1] for t in texts], m, 4.0)

    def tail(v, chars, share):
        return np.quantile(v[chars >= langid.LONG] if (chars >= langid.LONG).any() else v, share)

    hit = own["best"] == langs
    for k, x in enumerate(m.langs):
        i = hit & (langs == x)
        w, h = own["chars"][i], own["entropy"][i]
        high, low = tail(h, w, 0.998), []
        for to, v, chars in ((back["best"], back["entropy"], back["chars"]), (own["next"][hit], own["next_entropy"][hit], own["chars"][hit])):
            here = to == x if (to == x).any() else to == to
            low.append(tail(v[here], chars[here], 0.05))
        mean = np.average(h, weights=w)
        want = (mean, np.average((h - mean) ** 2, weights=w), np.average(own["spread"][i], weights=w), max(high, (high + min(low)) / 2))
        assert np.allclose((m.mean[k], m.between[k], m.within[k], m.limit[k]), want, rtol=1e-9, atol=1e-12), x


def test_quantiles_are_exact(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    groups = {0: rng.gamma(3.0, 1.0, 5000), 1: np.repeat(2.5, 700), 2: np.array([0.0]), 3: np.round(rng.random(900), 2)}
    rows = [(g, int(np.float64(v).view(np.int64))) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "g int, bits long")
    wanted = {(g, share) for g in ((0,), (1,), (2,), (3,), (0, 1, 3)) for share in (0.0, 0.05, 0.5, 0.998, 1.0)}
    got = langid.quantiles(df, wanted)
    for g, share in wanted:
        assert abs(got[g, share] - np.quantile(np.concatenate([groups[k] for k in g]), share)) < 1e-12


def test_kneser_ney_sums_to_one(spark):
    """Over all continuations of a context, the model's probabilities add up to about one."""
    import numpy as np

    df = spark.createDataFrame([("abracadabra abc cab " * 9, "x"), ("bad cab dab " * 5, "x")], "text string, lang string")
    m = langid.train(df, F.col("text"), F.col("lang"))
    letters = "abcdr "
    for context in ("abr", "cad", "b c"):
        total = 0.0
        for c in letters:
            codes, starts, _ = langid.code_points([context + c])
            total += float(np.exp(m.logs(codes)[-1, 0]))
        assert 0.97 <= total <= 1.001


def plain_kneser_ney(texts):
    """Interpolated Kneser-Ney of character 4-grams with plain dictionaries: log probability of a character after three."""
    four = collections.Counter()
    for t in texts:
        t = "   " + re.sub(r"[^a-z]+", " ", t.lower())
        four.update(t[i : i + 4] for i in range(len(t) - 3))
    orders = {4: four}
    for k in (3, 2, 1):
        orders[k] = collections.Counter(g[1:] for g in orders[k + 1])

    def discount(counts):
        one, two = (sum(v == n for v in counts.values()) for n in (1, 2))
        return one / (one + 2 * two) if one and two else 0.5

    def p(gram):
        k, counts = len(gram), orders[len(gram)]
        d = discount(counts)
        if k == 1:
            total = sum(counts.values())
            return (max(counts[gram] - d, 0) if gram in counts else 0) / total + d * len(counts) / total / 0x110000
        after = {g: n for g, n in counts.items() if g[:-1] == gram[:-1]}
        if not after:
            return p(gram[1:])
        total = sum(after.values())
        return (max(counts[gram] - d, 0) if gram in counts else 0) / total + d * len(after) / total * p(gram[1:])

    return p


def test_kneser_ney_equals_plain_counts(spark):
    """Every probability of several languages' models, hashed and joined, against dictionaries."""
    import math

    rng = random.Random(9)
    texts = {x: ["".join(rng.choice(a) for _ in range(rng.randrange(1, 90))) for _ in range(12)] for x, a in (("p", "aabcd  "), ("q", "cdeeef "), ("r", "xyz "))}
    df = spark.createDataFrame([(t, x) for x, ts in texts.items() for t in ts for _ in (1, 2)], "text string, lang string")
    m = langid.estimated(langid.gram_counts(df, F.col("text"), F.col("lang")))
    assert m.langs == ["p", "q", "r"]
    models = [plain_kneser_ney([t for t in texts[x] for _ in (1, 2)]) for x in m.langs]
    for _ in range(40):
        probe = "".join(rng.choice("abcdefxyz q") for _ in range(12))
        codes, starts, _ = langid.code_points([probe])
        seen = "   " + re.sub(" +", " ", probe)
        got = m.logs(codes)[starts[0] - 3 :]
        assert len(got) == len(seen) - 3
        for i, row in enumerate(got):
            for k, model in enumerate(models):
                assert abs(float(row[k]) - math.log(max(model(seen[i : i + 4]), 1e-12))) < 1e-3


# --- chat


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_chat_query(spark):
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{SF}/conversations.parquet'").fetchall()
    rows += [(-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok")]
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r, x or ""))
    want = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        want[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op6_chat_format(spark, SF).collect()}
    assert got == want


@pytest.mark.parametrize("text", ["", "<|im_end|>", "<\\|x", "<\\\\|", "<|<|\\<\\|", "a\nb", "é<|image:0|>"])
def test_chat_escape(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text)) == text


def test_chat_parts_and_edges(spark):
    part = "array<struct<kind:string,text:string,ref:string,tokens:long>>"
    rows = [
        (1, 1, "assistant", [("text", "see ", None, None), ("image", None, "a.png", 7), ("text", " and ", None, None), ("audio", None, "b.wav", None), None]),
        (1, 0, "user", [("document", None, "c.pdf", None), (None, "<|image:0|>", None, None)]),
        (1, None, None, None), (1, 1, "assistant", None), (None, 0, "user", [("text", None, None, None)]),
    ]
    df = spark.createDataFrame([(*r, "z") for r in rows], f"conv_id long, turn long, role string, parts {part}, conv string")
    got = {r.conv_id: r for r in chat.format_conversations(df, "conv_id", "turn", "role", parts_col="parts").collect()}
    one = got[1]
    assert chat.read_back(one.formatted) == [("", ""), ("user", "<|image:0|>"), ("assistant", ""), ("assistant", "see  and ")]
    assert [(a.kind, a.ref, a.turn, a.tokens) for a in one.attachments] == [("document", "c.pdf", 1, 512), ("image", "a.png", 3, 7), ("audio", "b.wav", 3, 128)]
    assert all(one.formatted[a.at :].startswith(f"<|{a.kind}:{a.slot}|>") for a in one.attachments)
    assert one.attachment_tokens == 647 and chat.under_mask(one.formatted, [(s.start, s.end) for s in one.loss]) == ["", "see  and "]
    assert chat.read_back(got[None].formatted) == [("user", "")]
    assert chat.format_conversations(df.limit(0), "conv_id", "turn", "role", parts_col="parts").count() == 0


# --- URLs


def plain_judge(url, strict, soft, limit, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    text = (url or "").lower()
    hit = lambda t: any((not m.start() or not text[m.start() - 1].isalnum()) and (m.end() == len(text) or not text[m.end()].isalnum()) for m in re.finditer(f"(?={re.escape(t)})", text) for m in [re.compile(re.escape(t)).match(text, m.start())])
    bad = any(hit(t) for t in strict) or sum(hit(t) for t in soft) >= limit
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best[0] if best else "block" if bad else "allow"


def test_url_query_and_edges(spark):
    rows = duckdb.sql(f"select page_id, url from '{SF}/pages.parquet'").fetchall()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in queries.op7_url_filter(spark, SF).collect()}
    assert got == {p: plain_judge(u, urlvocab.STRICT_TERMS, urlvocab.SOFT_TERMS, 2, queries.URL_RULES) for p, u in rows}
    urls = [
        None, "", "x", "http://", "http://A.Net", "http://a.net/", "http://net/x?y://z", "ftp://Example.COM/de/1#q", "http://notexample.com/de/", "http://b.org/fr/x", "http://b.org/frx", "//x.net/",
        "http://porn.com", "http://pornography.com", "http://a.com/casino-poker", "http://a.com/casino-casino", "http://a.com/xxx", "http://a.com/CASINO/Poker?x=é", "a://b://c/d", "http://ÄB.com/ß", "http://a.com/sexbet", "http://sub.example.net/en/1",
    ]
    df = spark.createDataFrame([(k % 20, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlvocab.judge_urls(df, "page_id", "url", rules=queries.URL_RULES).collect()), key=str)
    assert got == sorted(((k % 20, *plain_judge(u, urlvocab.STRICT_TERMS, urlvocab.SOFT_TERMS, 2, queries.URL_RULES)) for k, u in enumerate(urls)), key=str)
    assert urlvocab.judge_urls(df.limit(0), "page_id", "url").count() == 0


# --- mixing


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, ceiling=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, held = dict.fromkeys(order, 0.0), set()
    total = share * sum(sizes.values())
    while True:
        free = sum(w[s] for s in order if s not in held)
        left = total - sum(ceiling * sizes[s] for s in held)
        target = {s: ceiling * sizes[s] if s in held else left * w[s] / free for s in order}
        over = {s for s in order if s not in held and target[s] > ceiling * sizes[s]}
        if not over or held | over == set(order):
            return {s: min(t, ceiling * sizes[s]) for s, t in target.items()}
        held |= over


def check_mix(rows, got):
    sizes = collections.Counter()
    for _, source, size in rows:
        sizes[source] += size
    want = plain_targets(sizes)
    taken = collections.Counter()
    for (d, s, size), g in zip(sorted(rows, key=str), sorted(got, key=lambda g: str((g[0], g[1], g[2]))), strict=True):
        assert (d, size) == (g[0], g[2]) and g[3] == sizes[s]
        assert g[4] == pytest.approx(want[s], rel=1e-9) and g[5] <= 2 * size and (not size or g[5] % size == 0)
        taken[s] += g[5]
    return sizes, want, taken


def test_mix_query(spark):
    rows = [(d, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, s in duckdb.sql("select doc_id, text, source from '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    by = {d: s for d, s, _ in rows}
    out = queries.op8_mixing(spark, "/root/testdata/sf0.01").collect()
    got = [(r.doc_id, by[r.doc_id], r["size"], r.source_size, r.target, r.taken) for r in out]
    sizes, want, taken = check_mix(rows, got)
    assert abs(sum(taken.values()) / sum(want.values()) - 1) < 0.05
    again = queries.op8_mixing(spark, "/root/testdata/sf0.01").collect()
    assert sorted(again) == sorted(out)


def test_mix_edges(spark):
    rows = [(k, s, n) for k, (s, n) in enumerate([("b", 10), ("a", 1), ("Z", 500), (None, 3), ("é", 7), ("", 2), ("none", 0), ("a", 1), ("Z", 0)])] + [(2, "Z", 500), (None, "b", 4)]
    df = spark.createDataFrame([(d, s, n if n else None, "x") for d, s, n in rows], "doc_id long, source string, n long, mix string")
    out = mixing.mix_rates(df, "doc_id", "source", F.col("n"))
    got = [(r.doc_id, r.source, r._mix["size"], r._mix.source_size, r._mix.target, r._mix["size"] * r._mix.copies) for r in out.collect()]
    check_mix(rows, got)
    mixed = mixing.mix_sources(df, "doc_id", "source", F.col("n"))
    assert mixed.columns == df.columns and mixed.count() == sum(r._mix.copies for r in out.collect())
    assert mixing.mix_rates(df.limit(0), "doc_id", "source", F.col("n")).count() == 0


# --- personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                s = sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d))))
                if not 16 <= len(d) <= 19 or s % 10:
                    continue
            if kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_personal_data_query(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
        want = {}
        for d, t in rows:
            s = plain_spans(t)
            n = collections.Counter(k for k, _, _ in s)
            want[d] = (n["email"], n["ip"], n["card"], n["phone"], sha(",".join(f"{k}:{a}:{b}" for k, a, b in s)))
        got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in queries.op9_personal_data(spark, sf).collect()}
        assert got == want


TRICKY = [
    None, "", "a@b.c", "a@b.c_d@e.f", "x@y@z.w", "a@b.c.d.", "@b.c a@b a@.c", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.1.1.1 00000000000000000000255.0.0.1", "1.2.3", "999999999999999999999.1.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111112", "é4111111111111111x", "4111  1111 1111 1111", "+1 (555) 123-4567", "+1", "+12345678", "+1 555 1234567 890123456", "+49 ((((((", "\x01a@b.c\x02\x03", "😀a@b.cd😀 1.1.1.1",
    "GB82 WEST 1234 5698 7654 32 and GB82WEST12345698765433", "the IBAN: GB82 WEST 1234 5698 7654 32 and account GB82WEST12345698765433",
    "api_key = '0123456789abcdef0123456789abcdef' but 0123456789abcdef0123456789abcdee", "checksum 0123456789abcdef0123456789abcdef", "token " + "a" * 40, "call +1 (555) 123-4567 now", "..@..", "a" * 3000 + "@b.c", "1" * 4000, "1.1" * 2000, "a@b" + ".c" * 3000, "a.b@" * 500, "+1 2" * 900,
]


def test_personal_data_edges(spark):
    rng = random.Random(3)
    bits = ["a", "b.", "@", ".", "1", "23", "255", " ", "-", "+", "(", "x@y.z", "1.2.3.4", "4111111111111111", "+1 555 123 4567", "é", "_", "%", "\x01", "\x02"]
    texts = TRICKY + ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(400)]
    df = spark.createDataFrame([(k, t, "p") for k, t in enumerate(texts)], "doc_id long, text string, pii string")
    out = pii.personal_data(df, "text")
    assert out.columns[-1] == "_pii"
    added = {}
    for r in out.withColumn("clean", pii.redacted(F.coalesce("text", F.lit("")), F.col("_pii"))).collect():
        base = [(s.kind, s.start, s.end) for s in r._pii if s.kind not in ("iban", "secret")]
        assert base == plain_spans(r.text), r.text
        added[r.doc_id] = [(r.text[s.start : s.end], s.score) for s in r._pii if s.kind in ("iban", "secret")]
        clean, at = [], 0
        for s in sorted(r._pii, key=lambda s: (s.start, -s.end)):
            if s.start >= at:
                clean += [r.text[at : s.start], f"<{s.kind.upper()}>"]
            at = max(at, s.end)
        assert r.clean == "".join(clean) + (r.text or "")[at:]
    found = {TRICKY[k]: v for k, v in added.items() if v and k < len(TRICKY)}
    assert found == {  # a checksum or a form alone is not enough: a word must tell what it is
        "the IBAN: GB82 WEST 1234 5698 7654 32 and account GB82WEST12345698765433": [("GB82 WEST 1234 5698 7654 32", 0.75)],
        "api_key = '0123456789abcdef0123456789abcdef' but 0123456789abcdef0123456789abcdee": [("0123456789abcdef0123456789abcdef", 0.75)],
    }
    assert pii.personal_data(df.limit(0), "text").count() == 0


def test_context_raises_score(spark):
    df = spark.createDataFrame([(1, "+1 (555) 123-4567"), (2, "phone: +1 (555) 123-4567")], "doc_id long, text string")
    got = {r.doc_id: r.pii[0].score for r in pii.personal_data(df, "text").collect()}
    assert got == {1: 0.6, 2: 0.85}


# --- packing


def check_packing(rows, sizes, lengths):
    pieces, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r["size"]))
        seqs[r.sequence_id].append(r)
    want = collections.Counter()
    for d, n in sizes:
        for s in range(0, n, max(lengths)):
            want[d, s, min(max(lengths), n - s)] += 1
    assert collections.Counter((d, *p) for d, ps in pieces.items() for p in ps) == want
    for rs in seqs.values():
        rs.sort(key=lambda r: r.slot)
        at = 0
        for k, r in enumerate(rs):
            assert (r.slot, r.offset) == (k, at)
            at += r["size"]
        assert {(r.capacity, r.used) for r in rs} == {(min(c for c in lengths if c >= at), at)}
    return sum(rs[0].used for rs in seqs.values()) / max(1, sum(rs[0].capacity for rs in seqs.values()))


def test_packing_query(spark):
    sf = "/root/testdata/sf0.01"
    sizes = [(d, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t in duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()]
    assert check_packing(queries.op2_best_fit_packing(spark, sf).collect(), sizes, (512, 1024, 2048, 4096)) > 0.97


def test_packing_edges(spark):
    rng = random.Random(8)
    sizes = [(k, rng.choice([0, 1, 7, 99, 100, 101, 250, 1000])) for k in range(200)] + [(1, 5), (1, 5), (None, 3), (500, 1_000_00)]
    df = spark.createDataFrame([(d, n or None, 9, 9) for d, n in sizes], "doc_id long, n long, size long, words long")
    rows = packing.pack_documents(df, "doc_id", F.col("n"), lengths=(40, 100), shard_size=2000).collect()
    assert check_packing(rows, sizes, (40, 100)) > 0.9
    assert packing.pack_documents(df.limit(0), "doc_id", F.col("n")).count() == 0
    again = packing.pack_documents(df.repartition(7), "doc_id", F.col("n"), lengths=(40, 100), shard_size=2000).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))  # however the rows lie


def plain_best_fit(sizes, length):
    """One permitted length, pieces falling: into the fullest sequence that still holds them, of equals the one last filled."""
    rooms, stamp, out = [], [], []
    for n, s in enumerate(sizes):
        fits = [k for k in range(len(rooms)) if rooms[k] >= s]
        k = min(fits, key=lambda k: (rooms[k], -stamp[k])) if fits else len(rooms)
        if k == len(rooms):
            rooms.append(length)
            stamp.append(n)
        rooms[k] -= s
        stamp[k] = n
        out.append(k)
    return out


def test_best_fit_equals_plain_search():
    import numpy as np

    rng = random.Random(12)
    for _ in range(60):
        sizes = np.array(sorted((rng.randrange(1, 41) for _ in range(rng.randrange(1, 90))), reverse=True))
        seq, slot, offset, final, used = packing.best_fit(sizes, [40], 8.0)
        assert seq.tolist() == plain_best_fit(sizes.tolist(), 40)
        assert used == [int(sizes[seq == b].sum()) for b in range(len(used))] and set(final) == {40}


# --- pipeline


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "PII", "mixing sources to target weights", "best-fit packing"]
    outs = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, outs[-1], SF)
        out.write.parquet(str(tmp_path / str(k)))
        outs.append(spark.read.parquet(str(tmp_path / str(k))))
    assert all(o.columns == columns for o in outs[:-1])
    before, kept, one, clean, mixed, packed = (o.collect() for o in outs)
    assert len(kept) >= 0.98 * len(before) and {r.doc_id for r in kept} <= {r.doc_id for r in before}
    texts = collections.Counter(r.text for r in one)
    assert max(texts.values()) == 1 and {r.text for r in one} <= {r.text for r in kept}
    shingles = lambda t: {tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    sets = {r.doc_id: shingles(r.text) for r in one}
    gone = [r for r in kept if r.doc_id not in sets]
    near = lambda a, b: len(a & b) / max(1, len(a | b))
    for r in gone:  # none goes without a like one staying
        assert max(near(shingles(r.text), s) for s in sets.values()) > 0.5
    ids = sorted(sets)
    left = sum(near(sets[a], sets[b]) >= 0.85 for i, a in enumerate(ids) for b in ids[:i])
    assert left == 0
    assert all(not plain_spans(r.text) and r.n_chars == len(r.text) for r in clean)
    assert {r.doc_id for r in clean} == set(ids)
    sizes = [(r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in mixed]
    assert {d for d, _ in sizes} <= set(ids)
    check_packing(packed, sizes, (512, 1024, 2048, 4096))


def test_pipeline_stages_on_awkward_rows(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows, clashing extra columns, and an empty table."""
    long = "the cat sat on the mat and then it ran away " * 4000
    rows = [(k, f"the dog ran to the house of man {k} and then sat on the mat with number {k * 7919}", "en", "s", 10) for k in range(30)]
    rows += [(90, long, "en", "s", None), (91, long, None, None, 1), (None, long + "x", "en", None, 1), (92, None, None, None, None), (93, "", "en", "t", 0), (94, "   ", "xx", "t", 0), (95, "123 456", "en", "t", 7)]
    rows += [(96, "le chien est dans la maison de la ville", "fr", "u", 5)] * 3 + [(None, None, None, None, None)] * 2
    schema = "doc_id long, text string, lang string, source string, n_chars long, node long, rep long, language string, mix string, pii string, fp string, shard int, size long"
    docs = spark.createDataFrame([(*r, 1, 2, "a", "b", "c", "d", 3, 4) for r in rows], schema)
    for some in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, some, SF)
            assert out.columns == docs.columns, name
            got = out.collect()
            assert (len(got) > 0) == (some is docs), name
        assert (corpus_pipeline.pack(spark, some, SF).count() > 0) == (some is docs)
    kept = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    assert sorted(k for k in kept if k is not None and k >= 90) == [90, 92, 95, 96] and None not in kept
    assert sorted({r.doc_id for r in corpus_pipeline.language(spark, docs, SF).collect()} & {92, 93, 94, 95}) == []


def test_words_of(spark):
    df = spark.createDataFrame([("a b",), ("",), (None,), ("\xa0 \x1c x",)], "t string")
    assert [r[0] for r in df.select(words_of(F.col("t"))).collect()] == [2, 0, 0, 3]
