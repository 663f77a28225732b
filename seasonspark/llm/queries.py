"""The registered queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonspark.llm import chat, embedding_dedup, minhash, mix, oracles, packing, sstable, style_tree, topk, toxicity, warc
from seasonspark.llm.scratch import Scratch

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix.mix(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), max_ratio=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_minmax_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=2, percent=80)


def op3_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), TOKENIZER, window=4096, end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op6_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = r"\### Assistant: </turn> ok"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", extra), (-7, 1, "assistant", extra)], "conv_id long, turn long, role string, text string")
    rows = rows.unionByName(added)
    # A plain conversation is the tree in which each turn answers the one before it.
    order = F.row_number().over(mix.Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = rows.withColumn("node", order)
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    made = chat.format_trees(rows, tree=F.col("conv_id"), node=F.col("node"), parent=parent, role=F.col("role"), text=F.col("text"), score=F.length("text"))
    back = chat.read_back(made)
    turns = F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))
    return back.select(
        F.expr("try_cast(tree AS bigint)").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, "").cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.col("chars").alias("formatted_chars"),
    )


def op7_sentence_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), fold != 0)
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "warc").path("archives")
    archives = warc.write_pages(_table(spark, sf_dir, "pages"), folder)
    records = warc.read_archives(archives, expected=F.col("records"))  # damage is an error, not fewer pages
    page = lambda urn: F.expr(f"try_cast(regexp_extract({urn}, '^<urn:page:(.*)>$', 1) AS bigint)")
    whole = F.col("type") == "response"
    return records.select(
        page("record_id").alias("page_id"),
        F.when(whole, F.octet_length("payload")).otherwise(F.col("entity_length")).cast("long").alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.regexp_replace("payload_digest", "^sha256:", "")).alias("payload_digest"),
        F.col("type").alias("record_type"), page("refers_to").alias("refers_to"),
    )


def op9_style_tree_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "tokens").path("sst")
    shards = sstable.write_shards(_table(spark, sf_dir, "documents"), TOKENIZER, folder, end_id=1)
    back = sstable.read_shards(shards)
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (
        op1_pareto_mix, op2_minmax_near_duplicates, op3_retrieval_packing, op4_embedding_near_duplicates, op5_exact_top_k,
        op6_reply_trees, op7_sentence_toxicity, op8_warc_salvage, op9_style_tree_text, op10_token_shards,
    )
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return oracles.sql()
