"""The operators' registered queries: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealerflow.llm import chat, hilbert_ann, license_scan, max_sketch, mixing, ngram_join, packing, periodic_runs, quality, radix_dedup, recompression, toxicity, url_filter
from dealerflow.llm.common import read_table, saved, ship_package

KEEP_FROM = 0.7
TOXIC_FROM = 0.5
QUERY_ROWS = "id % 20 = 0"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_notices(read_table(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m["base"])
    words = F.transform("base", lambda m: m["word"])
    named = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda m: m["label"]))), ",")
    best = F.array_max(F.transform("matches", lambda m: m["similarity"]))
    return found.withColumn("base", base).select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        named("base").alias("base_labels"),
        named("matches").alias("labels"),
        F.coalesce(best, F.lit(0.0)).alias("score"),
    )


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    scored = quality.score_documents(docs, model).select("row.doc_id", "score")
    predicted = (F.col("score") >= KEEP_FROM).cast("int")
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.remove_repeats(read_table(spark, sf_dir, "documents"))


def op5_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_to_targets(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    kinds = [f"cast({c} as {chats.schema[c].dataType.simpleString()}) {c}" for c in ("conv_id", "turn")]
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digest_chats(chat.format_chats(chats.unionByName(probe.selectExpr(*kinds, "role", "text"))))


def op8_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_ann.nearest(read_table(spark, sf_dir, "embeddings"), QUERY_ROWS)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = url_filter.build_index(spark, (*url_filter.RULES, *url_filter.LISTED))
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"), index).drop("listed")


def _bent(words: Column, g: Column) -> Column:
    """The words joined by blanks, those from number ``g % n`` on in periods of a length that ``g`` gives."""
    n = F.size(words)
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    part = lambda c, first, size: F.slice(c, first.cast("int"), size.cast("int"))
    tail = F.flatten(F.array_repeat(part(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    return F.array_join(F.concat(part(words, F.lit(1), a), part(tail, F.lit(1), n - a)), " ")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    g = F.floor(h / 10)
    bent = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, _bent(w, g)))[0]  # one evaluation of ``words``
    docs = docs.withColumn("text", F.when(h % 10 == 0, bent).otherwise(F.col("text")))
    found = periodic_runs.find_runs(docs)
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    more = lambda r, best: r["length"] * best["period"] > best["length"] * r["period"]
    best = F.aggregate("runs", none, lambda best, r: F.when(best.isNull() | more(r, best), r).otherwise(best))
    listed = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    return found.withColumn("best", best).select(
        "row.doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model).select("row.doc_id", "score")
    predicted = (F.col("score") >= TOXIC_FROM).cast("int")
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


def op13_max_sketch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = saved(max_sketch.build_index(read_table(spark, sf_dir, "documents")))
    return max_sketch.search(index, read_table(spark, sf_dir, "benchmark"))


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _shipped(query) for name, query in QUERIES.items()}


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_ngram_join": op3_ngram_join,
    "op4_recompression": op4_recompression,
    "op5_radix_dedup": op5_radix_dedup,
    "op6_source_mixing": op6_source_mixing,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_hilbert_neighbours": op8_hilbert_neighbours,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_url_filter": op10_url_filter,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_toxicity": op12_toxicity,
    "op13_max_sketch_search": op13_max_sketch_search,
}
