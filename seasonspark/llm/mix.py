"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasonspark.llm.scratch import Scratch

#: Cells of one histogram level of the order statistic.
CELLS = 2048
_SPANS = "array<struct<gap:double,after:struct<order:double,doc_id:bigint,size:bigint>,over:struct<order:double,doc_id:bigint,size:bigint>>>"


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def length_odds(size: Column) -> Column:
    """Binary digits of a word count: the propensity by which longer texts are likelier to be taken. A text of 1000
    words (10 digits) has two and a half times the expected copies of one of 8 to 15 (4 digits)."""
    return F.length(F.bin(size)).cast("double")


def unit_hash(*key: Column) -> Column:
    """A number in (0, 1) from 52 bits of an MD5, the same wherever it is computed."""
    text = F.concat_ws(":", *(F.coalesce(k.cast("string"), F.lit("null")) for k in key))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def targets(sizes: DataFrame, weights: tuple[int, ...], max_ratio: float) -> DataFrame:
    """``(source, source_size, target)``: shares of all sizes by weight, none above ``max_ratio`` times its size.

    Sources by code point, null last, take the weights in turn. In the order of cap / weight the
    capped sources are a prefix, and the others share the rest at one level per weight.
    """
    by_rank = Window.orderBy(F.col("source").asc_nulls_last())
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_rank) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(max_ratio)))
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    per = per.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    per = per.withColumn("free", F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level")))
    level = F.max("free").over(everything)
    return per.select("source", "source_size", F.least("cap", F.coalesce(level * F.col("w"), F.col("cap"))).alias("target"))


def _scales(classes: DataFrame, goals: DataFrame, max_copies: int) -> DataFrame:
    """``(s, scale)``: a document's expected copies are ``scale`` times its propensity, at most ``max_copies``.

    ``classes(source, propensity, size)``. In falling order of propensity the capped classes are a prefix;
    the first that stays below the cap gives the scale. Null if all are capped.
    """
    at = classes.join(goals.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s")))
    order = Window.partitionBy("s").orderBy(F.desc("propensity"))
    capped = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    mass = F.sum(F.col("size") * F.col("propensity")).over(order.rowsBetween(0, Window.unboundedFollowing))
    at = at.withColumn("scale", F.try_divide(F.col("target") - F.lit(float(max_copies)) * capped, mass))
    free = (F.col("scale") * F.col("propensity") <= max_copies) & (F.col("target") < F.lit(float(max_copies)) * F.col("source_size"))
    return at.groupBy("s").agg(F.max_by("scale", F.when(free, F.col("propensity"))).alias("scale"))


def _cut(rest: DataFrame, scratch: Scratch) -> DataFrame:
    """Per source the cell of the order statistic in which the running size passes the residual.

    ``rest(source, residual, order, tie, size)``, order in (0, 1). Two histograms find the cell in which
    the residual runs out, whatever the source's share of the rows; only that cell is sorted.
    """
    low, width, base = F.lit(0.0), 1.0, rest.select("source", "residual").distinct().withColumn("low", F.lit(0.0)).withColumn("before", F.lit(0.0))
    for _ in range(2):
        width /= CELLS
        here = rest.drop("residual").join(base, rest.source.eqNullSafe(base.source)).drop(base.source)
        here = here.where((F.col("order") >= F.col("low")) & (F.col("order") < F.col("low") + width * CELLS))
        cell = F.least(F.floor((F.col("order") - F.col("low")) / width), F.lit(CELLS - 1))
        cells = here.groupBy("source", "residual", "low", "before", cell.alias("cell")).agg(F.sum("size").alias("size"))
        w = Window.partitionBy("source").orderBy("cell")
        run = F.col("before") + F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))
        cells = cells.withColumn("run", run).withColumn("last", F.max("cell").over(Window.partitionBy("source")))
        hit = cells.where((F.col("run") >= F.col("residual")) | (F.col("cell") == F.col("last")))
        first = hit.groupBy("source").agg(F.min(F.struct("cell", "run", "size", "residual", "low")).alias("x"))
        base = scratch.table(first.select("source", "x.residual", (F.col("x.low") + F.col("x.cell") * width).alias("low"), (F.col("x.run") - F.col("x.size")).alias("before")), "cells")
    return base.withColumn("width", F.lit(width))


def _whole_order(rest: DataFrame, scratch: Scratch) -> DataFrame:
    """``(s, spans)``: per source the parts of the order that are taken when each document that fits is.

    ``rest(source, residual, order, doc_id, size)``. A round cuts the documents not above the gap at the
    first that overruns it; the next goes on behind that one, until no document fits. Of a span, the
    documents not above ``gap`` that stand after ``after`` and before ``over`` are taken.
    """
    place = F.struct("order", "doc_id", "size")
    start = F.struct(F.lit(-1.0).alias("order"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("size"))
    state = scratch.table(rest.select(F.col("source").alias("s"), F.col("residual").cast("double").alias("gap")).distinct().select("s", "gap", start.alias("after"), F.array().cast(_SPANS).alias("spans")), "spans")
    rest = rest.drop("residual")
    while True:
        here = rest.join(state.drop("spans"), F.col("source").eqNullSafe(F.col("s"))).where((F.col("size") <= F.col("gap")) & (place > F.col("after")))
        rest = scratch.table(here.select("source", F.col("gap").alias("residual"), "order", "doc_id", "size"), "open")
        if rest.isEmpty():
            return state.select("s", "spans")
        cut = _cut(rest, scratch)
        rest = rest.drop("residual")
        marks = rest.join(cut, rest.source.eqNullSafe(cut.source)).drop(cut.source)
        marks = marks.where((F.col("order") >= F.col("low")) & (F.col("order") < F.col("low") + F.col("width")))
        run = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("order", "doc_id", "size"))
        fits = F.col("run") <= F.col("residual")
        ends = marks.withColumn("run", run).groupBy("source", "residual", "before", "low", "width").agg(F.max(F.when(fits, F.col("run"))).alias("run"), F.min(F.when(~fits, place)).alias("over"))
        # Nothing overruns the cell if it ends with an exact fit or is the last one: the span ends where it does.
        behind = F.struct((F.col("low") + F.col("width")).alias("order"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("size"))
        ends = ends.select("source", "residual", (F.col("residual") - F.coalesce("run", "before")).alias("left"), F.coalesce("over", behind).alias("over"))
        state = state.join(ends, F.col("s").eqNullSafe(F.col("source")), "left")
        span = F.array(F.struct("gap", "after", "over"))
        after = F.coalesce("over", "after")
        state = scratch.table(state.select("s", F.coalesce("left", "gap").alias("gap"), after.alias("after"), F.when(F.col("residual").isNotNull(), F.concat("spans", span)).otherwise(F.col("spans")).alias("spans")), "spans")


def mix(
    docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), max_ratio: int = 3, propensity: Callable[[Column], Column] | Column | None = length_odds, seed: int = 7,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = (),
) -> DataFrame:
    """``(doc_id, size, source_size, target, source, copies, taken)`` and the carried columns for every row of ``docs``.

    A source's target divided among its documents gives each an expected number of copies, proportional to its
    ``propensity`` (a column, or a function of the size; None: all the same) and at most ``max_ratio``. Its whole
    part is certain. The fraction is the inclusion odds of one more copy: documents are ranked by random odds over
    inclusion odds, u/(1-u) / (p/(1-p)). The sample's size is fixed in words: in this order each document is
    taken that fits into what is left of the source's residual, so no unused document fits in the end. Only
    the few documents behind the first that overruns (less than the longest text in all) are favoured for being
    short. Random numbers are hashes of seed and id: reruns agree. Propensities that are whole numbers make the
    sums exact in any order.

    Null text: size 0, nothing to take; very long texts are counted whole. Null source: a source of its own. Null or
    repeated ids are ranked as they are, ties by size; of rows equal in id and size all or none get the extra copy.
    Null or negative propensity: 0, no copies unless all are certain. Nothing is dropped: rows that are not taken have 0
    copies. An empty table gives an empty result. Carried columns may bear any names but those of the result (an error).

    Texts are read twice if columns are carried and never written between. Sources are ranked in one task
    (a row each); their documents are never sorted as a whole.
    """
    named = ("doc_id", "size", "source_size", "target", "source", "copies", "taken")
    if clash := set(carry) & set(named):
        raise ValueError(f"carried columns are named like those of the result: {sorted(clash)}")
    scratch = Scratch(docs.sparkSession, "mix")
    size = word_count(F.col(text_col))
    odds = F.lit(1.0) if propensity is None else propensity(size) if callable(propensity) and not isinstance(propensity, Column) else propensity
    odds = F.greatest(F.coalesce(odds.cast("double"), F.lit(0.0)), F.lit(0.0))
    slim = [F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), odds.alias("propensity")]
    rows = scratch.table(docs.select(*slim), "sizes")
    goals = scratch.table(targets(rows, weights, max_ratio), "targets")
    classes = rows.groupBy("source", "propensity").agg(F.sum("size").alias("size"))
    scales = _scales(classes, goals, max_ratio)
    per = scratch.table(goals.join(scales, F.col("source").eqNullSafe(F.col("s"))).select("s", "source_size", "target", "scale"), "scales")
    place = F.struct("order", "doc_id", "size")

    def ranked(some: DataFrame) -> DataFrame:
        at = some.join(per, F.col("source").eqNullSafe(F.col("s"))).drop("s")
        at = at.withColumn("e", F.coalesce(F.least(F.col("scale") * F.col("propensity"), F.lit(float(max_ratio))), F.lit(float(max_ratio))))
        at = at.withColumn("certain", F.floor("e")).withColumn("p", F.col("e") - F.col("certain"))
        u = unit_hash(F.lit(seed), F.col("doc_id"))
        at = at.withColumn("odds", F.when((F.col("p") > 0) & (F.col("size") > 0), (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))))
        # Odds beyond 2^53 would round to 1, which no cell of the histogram holds.
        order = F.least(F.col("odds") / (1 + F.col("odds")), F.lit(1 - 2.0**-53))
        return at.withColumn("order", F.when(F.col("odds").isNotNull(), order)).drop("e", "p", "odds", "scale", "propensity")

    at = ranked(rows)
    certain = at.groupBy("source").agg(F.max("target").alias("t"), F.sum(F.col("certain") * F.col("size")).alias("c"))
    residual = certain.select("source", (F.col("t") - F.col("c")).alias("residual")).where("residual > 0")
    rest = at.where("order is not null").select("source", "order", "doc_id", "size")
    rest = rest.join(residual, rest.source.eqNullSafe(residual.source)).drop(residual.source)
    spans = _whole_order(rest, scratch)
    whole = ranked(docs.select(*slim, F.struct(*carry).alias("_carried"))) if carry else at
    taken = whole.join(spans, F.col("source").eqNullSafe(F.col("s")), "left")
    fits = F.exists("spans", lambda x: (F.col("size") <= x["gap"]) & (place > x["after"]) & (place < x["over"]))
    copies = F.col("certain") + F.when(F.col("order").isNotNull() & F.coalesce(fits, F.lit(False)), 1).otherwise(0)
    out = taken.select("doc_id", "size", "source_size", "target", "source", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), *(["_carried.*"] if carry else []))
    return out
