"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonspark.llm.scratch import Scratch


#: Rows at most of the broadcast list of keys that hold many rows, and rows a key has at least to be on it.
HOT_KEYS, HOT_ROWS = 100_000, 256


def join_per_key(rows: DataFrame, per_key: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` left-joined with ``per_key``, one row a key, where column ``n`` of it counts the key's rows.

    Keys of at least ``total / HOT_KEYS`` rows, of which there can be no more than ``HOT_KEYS``, are broadcast, so that
    no task gets more of one key than that share of ``total``. ``n`` is dropped.
    """
    least = max(HOT_ROWS, -(-total // HOT_KEYS))
    values = [c for c in per_key.columns if c not in (key, n)]
    hot = per_key.where(F.col(n) >= least).select(F.col(key).alias("_key"), F.struct(*values).alias("_hot"))
    rest = per_key.where(F.col(n) < least).select(F.col(key).alias("_rest_key"), F.struct(*values).alias("_rest"))
    found = rows.join(F.broadcast(hot), F.col(key) == F.col("_key"), "left")
    # Rows that are served have no partner in the second join; a number of their own keeps them apart.
    apart = F.when(F.col("_hot").isNotNull(), F.xxhash64(*rows.columns)).otherwise(F.lit(0).cast("long"))
    found = found.withColumn("_apart", apart).join(rest.withColumn("_none", F.lit(0).cast("long")), (F.col(key) == F.col("_rest_key")) & (F.col("_apart") == F.col("_none")), "left")
    return found.select(*rows.columns, *(F.coalesce(f"_hot.{c}", f"_rest.{c}").alias(c) for c in values))


def _largest_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    return join_per_key(both.where("v > u"), least, "u", "n", 2 * total).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _smallest_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``(id, component_id)`` of every id in ``links(u, v)`` that is not its component's smallest id.

    Each round hangs every node on the least node known in its neighbourhood; the table never
    holds more rows than the links. Minima are pre-aggregated before each shuffle and hubs of many
    links are broadcast. Null and equal ends are no links.
    """
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, mark = scratch.table(edges, "edges"), None
    n = now.count()
    while True:
        new = scratch.table(_smallest_star(_largest_star(now, n)), "edges")
        scratch.drop(now)
        row = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (row.n, row.s) == mark or row.n == 0:
            out = new.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
            out.scratch_path = new.scratch_path
            return out
        now, mark, n = new, (row.n, row.s), row.n
