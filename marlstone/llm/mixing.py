"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Of all document rates r >= 0 that give each source its target number of words, sum(size * r) = target, entropy balancing takes those
of least relative entropy to one copy each, with 2 as the most. The solution is r = min(2, exp(lambda * size / mean size)) with one
multiplier for each source, found by Newton's method on the convex dual. A rate depends on source and size alone, so the sums of
an iteration run over the counts of each (source, size), which are the same sums as over the documents.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import SMALL_ROWS, WORD, Stash, join_small, read

WEIGHTS, SHARE, MOST_COPIES = (5.0, 2.0, 1.0), 1.5, 2
#: More steps than bisection needs from any start; sources that are still open then are an error.
NEWTON_STEPS, TOLERANCE = 100, 1e-5
#: Rounding decides cells of a source, a size class and a bin of priority together.
BINS = 256


def source_targets(stash: Stash, sized: DataFrame, weights=WEIGHTS, share=SHARE) -> DataFrame:
    """key, source, source_size, n, target. Weights go by the source's place in code-point order, null last."""
    totals = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    # The place without one task for all: counts of the sorted partitions give each its offset.
    placed = totals.orderBy(F.col("source").asc_nulls_last()).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("nth"))
    placed = stash.keep(placed, "sources")
    offsets = placed.groupBy("part").agg(F.count("*").alias("rows")).select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))
    place = F.pmod(F.col("nth") + F.col("before"), F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int"))
    table = stash.keep(placed.join(F.broadcast(offsets), "part").select("key", "source", "source_size", "n", weight.alias("w"), (MOST_COPIES * F.col("source_size")).cast("double").alias("most")), "weighed")
    # Water filling: sources whose share is above their most get the most, the others share what is left, until none is above.
    level = float("inf")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    while total:
        capped = F.col("w") * F.lit(level) >= F.col("most") if level < float("inf") else F.col("most") <= 0
        taken, free = table.agg(F.sum(F.when(capped, F.col("most")).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("w")))).first()
        if not free:
            break
        new = (share * total - taken) / free
        if level < float("inf") and new <= level * (1 + 1e-12):
            break
        level = new
    want = F.least(F.col("most"), F.col("w") * F.lit(level)) if level < float("inf") else F.col("most")
    return stash.keep(table.select("key", "source", "source_size", "n", want.alias("target")), "targets")


def solve_rates(stash: Stash, sized: DataFrame, targets: DataFrame) -> DataFrame:
    """key, lam, mean: the multiplier of each source; null lam where the target is the most a source can give."""
    sizes = stash.keep(sized.where("size > 0").groupBy("key", "size").agg(F.count("*").alias("c")), "sizes")
    mean = F.col("source_size") / F.col("n")
    state = targets.where("source_size > 0").select("key", "target", mean.alias("mean"), F.log(F.col("target") / F.col("source_size")).alias("lam"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), (F.col("target") >= 2.0 * F.col("source_size") * (1 - 1e-12)).alias("done"))
    state = stash.keep(state, "state0")
    left = state.where("not done").count()
    few = left <= SMALL_ROWS
    for step in range(NEWTON_STEPS):
        if not left:
            break
        x = F.col("size") / F.col("mean")
        rate = F.least(F.lit(2.0), F.exp(F.least(F.col("lam") * x, F.lit(1.0))))
        words = F.col("c") * F.col("size")
        open_ = state.where("not done").select("key", "mean", "lam", "target")
        pairs = sizes.join(F.broadcast(open_), "key") if few else join_small(sizes, open_, ["key"], "inner")
        sums = pairs.groupBy("key").agg(F.sum(words * rate).alias("got"), F.sum(F.when(F.col("lam") * x < math.log(2.0), words * rate * x).otherwise(0.0)).alias("slope"))
        gap = F.col("got") - F.col("target")
        lo, hi = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - gap / F.col("slope")
        inside = (F.col("slope") > 0) & (lo.isNull() | (newton > lo)) & (hi.isNull() | (newton < hi))
        halved = F.when(lo.isNull(), F.least(hi * 2, hi - 1)).when(hi.isNull(), F.greatest(lo * 2, lo + 1)).otherwise((lo + hi) / 2)
        held = F.col("done") | F.coalesce(F.abs(gap) <= F.col("target") * TOLERANCE, F.lit(True))
        moved = state.join(F.broadcast(sums) if few else sums, "key", "left")
        state = stash.keep(moved.select("key", "target", "mean", F.when(held, F.col("lam")).when(inside, newton).otherwise(halved).alias("lam"), lo.alias("lo"), hi.alias("hi"), held.alias("done")), f"state{step + 1}")
        left = state.where("not done").count()
    if left:
        raise ArithmeticError(f"{left} sources' rates didn't reach their targets in {NEWTON_STEPS} steps")
    return state.join(targets.select("key", "source_size"), "key").select("key", "mean", F.when(F.col("target") >= 2.0 * F.col("source_size") * (1 - 1e-12), None).otherwise(F.col("lam")).alias("lam"))


def sized(docs: DataFrame) -> DataFrame:
    """docs with _key, which is never null, and _size, the number of words."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.withColumns({"_key": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")), "_size": size})


class Mix:
    """The decisions for a table of documents: a rate for each source, and the cells of the rounding that get one copy more."""

    def __init__(self, docs: DataFrame, stash: Stash | None = None):
        self.stash = stash = stash or Stash(docs.sparkSession)
        base = stash.keep(sized(docs.select("doc_id", "source", "text")).select("doc_id", "source", F.col("_key").alias("key"), F.col("_size").alias("size")), "sized")
        self.targets = source_targets(stash, base)
        rates = solve_rates(stash, base, self.targets)
        self.facts = stash.keep(self.targets.select(F.col("key").alias("_key"), "source_size", "target").join(rates.withColumnRenamed("key", "_key"), "_key", "left"), "facts")
        self.base = stash.keep(self._celled(base.select("doc_id", F.col("key").alias("_key"), F.col("size").alias("_size"))), "rated")
        self.extra = self._round()

    def _celled(self, rows: DataFrame) -> DataFrame:
        """rows (doc_id, _key, _size and others) with the facts of their source, the sure copies, and the cell of the rounding."""
        rated = join_small(rows, self.facts, ["_key"])
        size, lam = F.col("_size"), F.col("lam")
        rate = F.when(size == 0, 0.0).when(lam.isNull(), 2.0).otherwise(F.least(F.lit(2.0), F.exp(F.least(lam * size / F.col("mean"), F.lit(1.0)))))
        rated = rated.withColumn("_rate", rate).withColumn("_sure", F.floor("_rate").cast("long")).withColumn("_part", F.col("_rate") - F.col("_sure"))
        uniform = (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
        class_ = F.when(size > 0, F.floor(F.log2(size.cast("double")))).otherwise(-1).cast("int")
        # Priorities uniform / part below 1 are a document's own chance; sorted, they are sampling in proportion to part.
        bin_ = F.when(F.col("_part") <= 0, -1).otherwise(F.floor(F.least(uniform / F.col("_part") * BINS, F.lit(8.0 * BINS)))).cast("int")
        return rated.withColumns({"_class": class_, "_bin": bin_}).drop("_rate", "lam", "mean")

    def _round(self) -> DataFrame:
        cells = self.base.groupBy("_key", "_class", "_bin").agg(F.sum("_size").alias("words"), F.sum(F.col("_sure") * F.col("_size")).alias("sure"), F.sum(F.col("_part") * F.col("_size")).alias("share"))
        cells = self.stash.keep(cells, "cells")
        of_class = Window.partitionBy("_key", "_class")
        first = cells.where("_bin >= 0").withColumn("need", F.sum("share").over(of_class)).withColumn("run", F.sum("words").over(of_class.orderBy("_bin"))).withColumn("extra", F.col("run") <= F.col("need"))
        won = first.groupBy("_key").agg(F.sum(F.when(F.col("extra"), F.col("words")).otherwise(0)).alias("won"))
        gap = self.facts.select("_key", "target").join(cells.groupBy("_key").agg(F.sum("sure").alias("sure")), "_key", "left").join(won, "_key", "left")
        gap = gap.select("_key", (F.col("target") - F.coalesce("sure", F.lit(0)) - F.coalesce("won", F.lit(0))).alias("gap"))
        chosen = self.stash.keep(first.select("_key", "_class", "_bin", "words", "extra").join(gap, "_key"), "first")
        # What classes left over goes to cells not taken yet: large ones first, then small ones, as far as they fit what remains.
        for r in range(ROUNDS):
            order = Window.partitionBy("_key").orderBy(F.col("words").desc() if r % 2 == 0 else F.col("words").asc(), "_class", "_bin")
            fits = (~F.col("extra")) & (F.col("words") <= F.col("gap"))
            ran = chosen.withColumn("run", F.sum(F.when(fits, F.col("words")).otherwise(0)).over(order)).withColumn("more", fits & (F.col("run") <= F.col("gap")))
            got = F.sum(F.when(F.col("more"), F.col("words")).otherwise(0)).over(Window.partitionBy("_key"))
            chosen = self.stash.keep(ran.select("_key", "_class", "_bin", "words", (F.col("extra") | F.col("more")).alias("extra"), (F.col("gap") - got).alias("gap")), f"round{r}")
        return self.stash.keep(chosen.where("extra").select("_key", "_class", "_bin", F.lit(1).cast("long").alias("_extra")), "extra")

    def decided(self) -> DataFrame:
        """doc_id, size, source_size, target, taken, copies of the table's rows."""
        done = join_small(self.base, self.extra, ["_key", "_class", "_bin"])
        copies = F.col("_sure") + F.coalesce("_extra", F.lit(0))
        return done.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (copies * F.col("_size")).alias("taken"), copies.alias("copies"))

    def repeated(self, docs: DataFrame) -> DataFrame:
        """docs, each row as often as it has copies. The decisions are looked up by source and cell, so texts stay where they are read."""
        held = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
        held = sized(held).drop("source", "text")
        done = join_small(self._celled(held), self.extra, ["_key", "_class", "_bin"])
        copies = (F.col("_sure") + F.coalesce("_extra", F.lit(0))).cast("int")
        return done.select("_doc", F.explode(F.array_repeat(F.lit(1), copies))).select("_doc.*")


def mixture(docs: DataFrame, stash: Stash | None = None) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, copies.

    size is the number of words (null text: 0). taken = copies * size with 0, 1 or 2 copies, decided by a hash of doc_id, so that
    reruns agree and rows that repeat a doc_id fare alike. Cells of the rounding are taken whole, largest documents first, so a
    source ends within the size of a few of its smallest documents of its target. A null source is a source of its own; empty
    tables give empty results; other columns are ignored."""
    return Mix(docs, stash).decided()


#: Rounds of filling after the first; each leaves a source no further from its target.
ROUNDS = 2


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(read(spark, sf_dir, "documents"))
