"""A training corpus from documents: drop toxic ones, near duplicates, mix the sources, pack sequences.

Every stage gets what the one before it kept, written as Parquet and read again; all but the last return
the columns of documents. Rows with null or repeated ids, null, empty or very long texts, empty tables and
further columns are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonspark.llm import minhash, mix, packing, toxicity
from seasonspark.llm.queries import TOKENIZER
from seasonspark.llm.scratch import Scratch, owned, release

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Packing draws on several stages and a tokenizer's neighbours: no SQL for the rows.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the sentence model does not reject; it learns from the labels of those at hand."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, F.lit(True))
    return toxicity.score(docs.select(*COLUMNS), model).where("score < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies on five-word shingles at 0.8: the one with the smallest id.

    Rows without an id or without words are no copies of any. Rows with equal ids stay or go together;
    of those with equal texts too, one stays.
    """
    groups = minhash.near_duplicates(docs, width=5, percent=80).where("doc_id is not null")
    ids = Scratch(spark, "groups").table(groups.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "ids")
    left = docs.select(*COLUMNS).join(ids.where("not kept").select("doc_id"), "doc_id", "left_anti")
    repeated = ids.where("kept and n > 1").select("doc_id")
    if not repeated.isEmpty():
        once = left.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        left = left.join(repeated, "doc_id", "left_anti").unionByName(once)
    return left.select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources by weights 5, 2, 1, longer texts likelier; a document that is taken several times is repeated."""
    mixed = mix.mix(docs, weights=(5, 2, 1), max_ratio=3, carry=("text", "lang", "n_chars"))
    copies = F.explode(F.expr("sequence(1, int(copies))"))
    return mixed.where("copies > 0").select("*", copies.alias("copy")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, with a checksum of their ids."""
    pieces = packing.pack(docs, TOKENIZER, window=4096, end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Once a stage's output is written, what the stage made and read goes."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        with owned() as made:
            before, docs = docs, scratch.table(stage(spark, docs, sf_dir), name)
        release(spark, made)
        if i:
            scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
