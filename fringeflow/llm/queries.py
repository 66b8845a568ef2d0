"""The operators bound to the synthetic tables: one query per operator, and its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collisions, langid, mixing, packing, pii, pivots, simhash, suffixes, urlvocab
from .common import table, words_of

URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_pivot_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicate_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", threshold=0.93)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), "doc_id", words_of(F.col("text")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id", "text", "lang")
    return judged.select("doc_id", "language.held_out", F.col("language.lang").alias("lang_pred"), "language.score", "language.accepted")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", width=4, bits=64, max_bits=4)


def op5_collision_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return collisions.nearest_neighbours(vectors, vectors.where("vec_id % 100 = 0"), "vec_id", "embedding", k=10)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests read back from the formatted conversations."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(
        "select -1L as conv_id, turn, role, '<|im_end|><|im_start|>assistant ok' as text from values (0L, 'user'), (1L, 'assistant') as t(turn, role)"
    )
    made = chat.format_conversations(turns.unionByName(probe), "conv_id", "turn", "role", text_col="text")
    return made.select("conv_id", "formatted", "loss").mapInArrow(
        _chat_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def _chat_digest(batches):
    import hashlib

    import pyarrow as pa

    sha = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()
    for batch in batches:
        out = []
        for conv, text, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            turns = chat.read_back(text)
            masked = "".join(chat.under_mask(text, [(s["start"], s["end"]) for s in loss]))
            out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(masked), sha(masked), len(text)))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlvocab.judge_urls(table(spark, sf_dir, "pages"), "page_id", "url", rules=URL_RULES)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mix = mixing.mix_rates(docs.select("doc_id", "source", "text"), "doc_id", "source", words_of(F.col("text")))
    return mix.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return found.select(
        "doc_id",
        *[pii.counted(F.col("pii"), k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
        F.sha2(pii.joined(F.col("pii"), base_only=True), 256).alias("base_sha256"),
        pii.joined(F.col("pii")).alias("spans"),
        pii.scores(F.col("pii")).alias("scores"),
    )


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"), "doc_id", "text", length=200).drop("spans")


QUERIES = {f.__name__: f for f in (op1_pivot_near_duplicates, op2_best_fit_packing, op3_language_id, op4_simhash, op5_collision_neighbours, op6_chat_format, op7_url_filter, op8_mixing, op9_personal_data, op10_repeated_passages)}
