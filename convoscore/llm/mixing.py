"""Mixing sources to target weights by entropy balancing.

Every document gets a rate in [0, 2], the number of copies that the mix takes of it on average.  Rates stay as close to 1
as they can (in relative entropy of the rate's share of 2) while the words of each source meet the source's target; the
solution tilts rates exponentially, with odds exp(lambda_source * size / mean size).  The convex dual in the lambdas is
solved by Newton's method: each iteration aggregates gradient and curvature over the counts of documents by (source,
size), which is all that a rate depends on, and moves all sources at once.  Rates are then rounded into copies by
systematic sampling in order of size.  Sources are rows of tables throughout; the driver holds sums over all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, free, n_shuffle, pieces, utf8

#: Ranks within one (source, size) are counted in so many slices, so that copies of one text don't meet in one task.
SLICES = 256
#: Starting points of the systematic sampling that are compared for each source.
STARTS = 64


def word_counts(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` and ``size``: the number of runs of bytes other than ASCII white space; null has 0."""
    from pyspark.sql import types as T

    picked = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))

    def count(batches):
        import pyarrow as pa

        for batch in pieces(batches):
            sizes = pa.array([len(b.split()) for b in utf8(batch.column(len(keep)))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], sizes], [*keep, "size"])

    return picked.mapInArrow(count, T.StructType([*(f for f in picked.schema.fields[: len(keep)]), T.StructField("size", T.LongType())]))


def numbered(df: DataFrame, by: list[Column], name: str) -> DataFrame:
    """``df`` with the place of each row in the order of ``by``, from 0: ranges are numbered each, the driver sums up how
    many rows each has."""
    ranged = df.repartitionByRange(n_shuffle(df.sparkSession), *by).withColumn("__range", F.spark_partition_id())
    ranged = cut(ranged)
    before, total = [], 0
    for part, rows in sorted(map(tuple, ranged.groupBy("__range").count().collect())):  # a row a partition
        before.append((part, total))
        total += rows
    sums = F.create_map(*(F.lit(x) for pair in before for x in pair)) if before else F.create_map(F.lit(0), F.lit(0))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*by)) - 1 + sums[F.col("__range")]
    return ranged.withColumn(name, place.cast("long")).drop("__range")


def targets(totals: DataFrame, weights: tuple[float, ...], share: float, limit: float) -> DataFrame:
    """``totals`` (source, words) with the target of each source: ``share`` of all words by weight, at most ``limit``
    times a source's words; what is above goes to the others by weight until none is above.  Sources in code point order,
    null last, take the weights in turn.

    The level (words for a weight of 1) only rises as sources reach their limit, so it says all about a source."""
    ranked = numbered(totals, [F.col("source").asc_nulls_last()], "place")
    every = F.array(*(F.lit(float(w)) for w in weights))
    ranked = cut(ranked.withColumn("weight", F.get(every, (F.col("place") % len(weights)).cast("int"))).drop("place"))
    whole, free_weight = ranked.agg(F.sum("words"), F.sum("weight")).first()
    left, most = share * (whole or 0), F.lit(float(limit)) * F.col("words")
    while free_weight:
        over = F.lit(left) * F.col("weight") / F.lit(free_weight) >= most
        taken, weight, n = ranked.agg(F.coalesce(F.sum(F.when(over, most)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)), F.count_if(over)).first()
        if share * whole - taken == left and weight == free_weight or not weight:
            break
        left, free_weight = share * whole - taken, weight
    level = F.lit(left) * F.col("weight") / F.lit(free_weight or 1.0)
    return ranked.withColumn("target", F.when(level >= most, most).otherwise(level)).drop("weight")


def _rate(limit: float) -> Column:
    """The rate of a size at its source's lambda; null stands for plus infinity."""
    x = F.col("size") / F.col("scale")
    tilted = F.lit(limit) / (1 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -F.col("lam") * x))))
    return F.when(F.col("lam").isNull(), F.lit(limit)).otherwise(tilted)


def _solve(hist: DataFrame, goals: DataFrame, limit: float, tolerance: float) -> DataFrame:
    """Newton on the dual: ``goals`` (source, words, scale, target) with the lambda of each source (null: all at the
    limit).

    A step that leaves the bracket in which the root must lie is replaced by the bracket's middle (or by twice as far,
    where it has no end yet), so that each iteration narrows it.  There is no limit to the iterations: a source is done
    when it meets its target, or when no number lies inside its bracket any more."""
    infinite = F.lit(float("inf"))
    full, none = (F.col("target") >= limit * F.col("words")) | (F.col("words") == 0), F.col("target") <= 0
    state = cut(goals.select(
        "source", "words", "scale", "target", F.when(none, -infinite).when(~full, 0.0).alias("lam"),
        (-infinite).alias("low"), infinite.alias("high"), (full | none).alias("done"),
    ))
    n, size = F.col("n"), F.col("size")
    while state.filter("NOT done").limit(1).count():
        todo = state.filter("NOT done").select(F.col("source").alias("t_source"), "lam", "scale")
        rate = _rate(limit)
        sums = hist.join(todo, F.col("source").eqNullSafe(F.col("t_source"))).groupBy("t_source").agg(
            F.sum(n * size * rate).alias("got"), F.sum(n * size * size / F.col("scale") * rate * (1 - rate / limit)).alias("slope")
        )
        both = state.join(sums, F.col("source").eqNullSafe(F.col("t_source")), "left")
        miss, lam = F.col("got") - F.col("target"), F.col("lam")
        both = both.withColumns({"miss": miss, "low": F.when(miss <= 0, lam).otherwise(F.col("low")), "high": F.when(miss > 0, lam).otherwise(F.col("high"))})
        newton = lam - F.col("miss") / F.when(F.col("slope") > 0, F.col("slope"))
        bounded = (F.col("low") > -infinite) & (F.col("high") < infinite)
        apart = F.when(bounded, (F.col("low") + F.col("high")) / 2).otherwise(2 * lam - F.signum("miss"))
        # sums of doubles differ in their last bits between runs
        step = F.when((newton > F.col("low")) & (newton < F.col("high")), newton).otherwise(apart)
        step = F.when(step.isNotNull(), F.format_string("%.9e", step).cast("double"))
        met = (F.abs("miss") <= tolerance * F.col("target")) | (step <= F.col("low")) | (step >= F.col("high"))
        before, moves = state, F.col("got").isNotNull()
        state = cut(both.select("source", "words", "scale", "target", F.when(moves & ~met, step).otherwise(lam).alias("lam"), "low", "high", F.when(moves, met).otherwise(F.col("done")).alias("done")))
        free(before)
    return state.select("source", "words", "scale", "target", "lam")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, limit: int = 2, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 7, tolerance: float = 1e-9) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate, copies, taken (= copies * size).

    A null text has size 0, very long ones count whole, a null source is a source of its own (the last), null ids are
    allowed, rows with the same id count as separate documents; an empty table gives an empty result.  Other columns are
    ignored.
    """
    slim = word_counts(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text")), ["doc_id", "source"], "text")
    slim = cut(slim.withColumn("slice", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(SLICES)).cast("int")))
    slices = cut(slim.groupBy("source", "size", "slice").agg(F.count("*").alias("n")))
    hist = slices.groupBy("source", "size").agg(F.sum("n").alias("n"))
    totals = hist.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("words"), F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("filled"))
    goals = targets(totals.withColumn("scale", F.coalesce(F.col("words") / F.col("filled"), F.lit(1.0))), weights, share, limit)
    plan = _solve(hist, goals, float(limit), tolerance)
    plan = plan.select(F.col("source").alias("p_source"), F.col("words").alias("source_size"), "target", "scale", "lam")
    # Systematic sampling: a running sum of rates in order of (size, slice, rank); a document takes as many copies as
    # whole numbers that its step passes.  Only the table of (source, size, slice) counts is summed in order.
    by_size = hist.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).withColumn("rate", _rate(float(limit)))
    before = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    by_size = cut(by_size.withColumn("start", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(before), F.lit(0.0))))
    # The words that each of STARTS starting points would give follow from the counts too; each source takes the best.
    tries = [(k + 0.5) / STARTS for k in range(STARTS)]
    words = [F.sum(F.col("size") * (F.floor(F.col("start") + F.col("n") * F.col("rate") + u) - F.floor(F.col("start") + u))) for u in tries]
    best = F.array_min(F.array(*(F.struct(F.abs(w - F.max("target")).alias("miss"), F.lit(u).alias("u")) for w, u in zip(words, tries, strict=True))))
    begin = by_size.groupBy(F.col("p_source").alias("b_source")).agg(best.alias("best")).select("b_source", F.col("best.u").alias("begin"))
    by_size = by_size.join(begin, F.col("p_source").eqNullSafe(F.col("b_source"))).withColumn("start", F.col("start") + F.col("begin"))
    within = Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    steps = (
        slices.withColumn("offset", F.coalesce(F.sum("n").over(within), F.lit(0)))
        .withColumnsRenamed({"source": "h_source", "size": "h_size", "slice": "h_slice"})
        .drop("n")
        .join(by_size.drop("n", "scale", "lam", "p_source", "b_source", "begin"), F.col("h_source").eqNullSafe(F.col("source")) & (F.col("h_size") == F.col("size")))
        .drop("source", "size")
    )
    rank = F.row_number().over(Window.partitionBy("source", "size", "slice").orderBy("doc_id")) - 1
    ranked = slim.withColumn("rank", rank)
    place = F.col("start") + (F.col("offset") + F.col("rank")) * F.col("rate")
    copies = F.least(F.lit(limit), F.floor(place + F.col("rate")) - F.floor(place)).cast("long")
    return (
        ranked.join(steps, ranked.source.eqNullSafe(steps.h_source) & (ranked["size"] == steps.h_size) & (ranked.slice == steps.h_slice))
        .withColumn("copies", copies)
        .select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )
