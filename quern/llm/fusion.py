"""Problem 4: one ranking per query from lists whose scores differ in range and shape.

Each list (a query and a retriever) is standardised by its own median and median absolute deviation, squashed by the
logistic function so that outliers stay below 1, and the bounded values are joined by a weighted geometric mean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.ordering import numbered

#: The weight of ``semantic`` where a query names none; ``bm25`` has the rest.
DEFAULT_ALPHA = 0.55
#: The weight of each further list.
MINOR = 0.1
#: What a chunk counts in a list that lacks it: less than any chunk of the list, but more than nothing.
ABSENT = 0.02
#: Rank error of a list's median, as a share of the list: 1 / ACCURACY.  Lists below that length have it exactly.
ACCURACY = 10_000
#: Ranks of a list that are searched together for a neighbour's score.
STRETCH = 512


LIST = ["query_id", "retriever"]
#: A query is hot if it has more rows than this and than a quarter of a task's even share; there are few of them.
HOT_ROWS = 100_000


def latest_evidence(evidence: DataFrame) -> DataFrame:
    """``(query_id, retriever, chunk_id, score, rank)``: one row per query, retriever and chunk.

    Of repeated rows the one logged last holds, of those the one with the higher score.  NaN scores become null; a row
    with neither score nor rank is dropped.
    """
    score = F.when(~F.isnan("score"), F.col("score"))
    return evidence.groupBy(*LIST, "chunk_id").agg(F.max(F.struct("logged_at", score.alias("score"), "rank")).alias("e")).select(*LIST, "chunk_id", "e.score", "e.rank").where("score is not null or rank is not null")


def _neighbours(window: Window) -> tuple[Column, Column]:
    """The scores that follow and precede a row in the order of rank and chunk_id; rows without a rank lend none."""
    lent = F.when(F.col("rank").isNotNull(), F.col("score"))
    order = window.orderBy(F.asc_nulls_last("rank"), "chunk_id")
    return F.first(lent, True).over(order.rowsBetween(0, Window.unboundedFollowing)), F.last(lent, True).over(order.rowsBetween(Window.unboundedPreceding, 0))


def _scale() -> Column:
    return F.when(F.col("_mad") > 0, 1.4826 * F.col("_mad")).when(F.col("_mean_away") > 0, 1.2533 * F.col("_mean_away"))


def _z() -> Column:
    return F.coalesce((F.col("score") - F.col("_median")) / F.col("_scale"), F.lit(0.0))


def standardised(latest: DataFrame) -> DataFrame:
    """``(query_id, retriever, chunk_id, z)``: the score in robust deviations from its list's median, list by list.

    A missing score is taken from the next chunk of the same list by rank, the following one before the preceding one; a
    list without any has 0 throughout.  A list without spread around its median is scaled by its mean absolute
    deviation, and one without any spread gives 0 throughout.
    """
    whole = Window.partitionBy(*LIST)
    below, above = _neighbours(whole)
    rows = latest.withColumn("_below", below).withColumn("_above", above).withColumn("score", F.coalesce("score", "_below", "_above", F.lit(0.0)))
    away = rows.withColumn("_median", F.percentile_approx("score", 0.5, ACCURACY).over(whole)).withColumn("_away", F.abs(F.col("score") - F.col("_median")))
    spread = away.withColumn("_mad", F.percentile_approx("_away", 0.5, ACCURACY).over(whole)).withColumn("_mean_away", F.avg("_away").over(whole)).withColumn("_scale", _scale())
    return spread.select(*LIST, "chunk_id", _z().alias("z"))


def standardised_in_stretches(latest: DataFrame) -> DataFrame:
    """The same for lists of any length: a list lies in stretches of ranks, each in one place, and what a stretch needs of the
    others, the nearest scores and the list's figures, is joined to it."""
    stretch = F.coalesce(F.floor(F.col("rank") / STRETCH), -1 - F.pmod(F.xxhash64("chunk_id"), F.lit(64)))
    rows = latest.withColumn("stretch", stretch)
    known = F.col("score").isNotNull() & F.col("rank").isNotNull()
    place = F.when(known, F.struct("rank", "chunk_id", "score"))
    along = Window.partitionBy(*LIST).orderBy("stretch")
    after = F.first("_head.score", True).over(along.rowsBetween(1, Window.unboundedFollowing))
    before = F.last("_tail.score", True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    key = [*LIST, "stretch"]
    around = rows.groupBy(*key).agg(F.min(place).alias("_head"), F.max(place).alias("_tail")).select(*key, after.alias("_after"), before.alias("_before"))
    below, above = _neighbours(Window.partitionBy(*key))
    near = rows.withColumn("_below", below).withColumn("_above", above).join(around, key)
    rows = near.select(*key, "chunk_id", F.coalesce("score", "_below", "_after", "_above", "_before", F.lit(0.0)).alias("score"))
    median = rows.groupBy(*LIST).agg(F.percentile_approx("score", 0.5, ACCURACY).alias("_median"))
    places = around.select(*key)
    away = rows.join(places.join(median, LIST), key).withColumn("_away", F.abs(F.col("score") - F.col("_median")))
    spread = away.groupBy(*LIST).agg(F.first("_median").alias("_median"), F.percentile_approx("_away", 0.5, ACCURACY).alias("_mad"), F.avg("_away").alias("_mean_away"))
    return rows.join(places.join(spread.select(*LIST, "_median", _scale().alias("_scale")), LIST), key).select(*LIST, "chunk_id", _z().alias("z"))


def log_value(z: Column, absent: float) -> Column:
    """ln of the logistic of z, raised to ``absent`` at least.  It is taken from 1 down, so that large z keep their distances."""
    return F.log1p(-(1 - absent) / (1 + F.exp(F.greatest(F.least(z, F.lit(700.0)), F.lit(-700.0)))))


def hot_queries(evidence: DataFrame, hot_rows: int = HOT_ROWS) -> list:
    """The queries that hold so much of the evidence that one task must not have all of it: fewer than four per task."""
    counts = evidence.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    tasks = int(evidence.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).collect()[0].n
    if total <= hot_rows:
        return []
    return [r.query_id for r in counts.where(F.col("n") > max(hot_rows, total // (4 * tasks))).collect()]


def fuse(evidence: DataFrame, queries: DataFrame, minor: float = MINOR, absent: float = ABSENT, default_alpha: float = DEFAULT_ALPHA, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(query_id, chunk_id, score, rank, retrievers)``: the joint ranking of every query that has evidence.

    ``semantic`` weighs alpha and ``bm25`` 1 - alpha, any other retriever ``minor``; only the lists that a query has
    count.  A null, NaN or missing alpha is ``default_alpha``.  ``retrievers`` is the number of the query's lists.  Scores
    that are equal to nine digits, as those of outliers beyond the logistic's reach, are ranked by the weighted sum of
    their standardised scores, then by chunk_id.  The evidence is shuffled once, by query; the few hot queries are
    spread over all tasks and come to the same result.
    """
    sound = evidence.where("query_id is not null and chunk_id is not null and retriever is not null").select(*LIST, "chunk_id", "score", "rank", "logged_at")
    alphas = queries.groupBy("query_id").agg(F.max(F.nanvl("alpha", F.lit(None).cast("double"))).alias("_alpha"))
    alpha = F.least(F.greatest(F.coalesce("_alpha", F.lit(default_alpha)), F.lit(0.0)), F.lit(1.0))
    weight: Column = F.when(F.col("retriever") == "semantic", alpha).when(F.col("retriever") == "bm25", 1 - alpha).otherwise(F.lit(minor))
    floor = F.log(F.lit(absent))

    def scored(values: DataFrame) -> DataFrame:
        weighed = values.join(alphas, "query_id", "left").withColumn("_w", weight)
        lists = weighed.groupBy(*LIST).agg(F.first("_w").alias("_w")).groupBy("query_id").agg(F.sum("_w").alias("_all"), F.count(F.lit(1)).alias("retrievers"))
        # A list that lacks the chunk adds its weight times the floor: sum over the present ones of w (ln v - floor), plus floor.
        lifted = weighed.groupBy("query_id", "chunk_id").agg(F.sum(F.col("_w") * (log_value(F.col("z"), absent) - floor)).alias("_lift"), F.round(F.sum(F.col("_w") * F.col("z")), 6).alias("_lean"))
        score = F.when(F.col("_all") > 0, F.round(F.exp(F.col("_lift") / F.col("_all") + floor), 9)).otherwise(F.lit(0.0))
        return lifted.join(lists, "query_id").select("query_id", "chunk_id", score.alias("score"), "_lean", "retrievers")

    order = [F.desc("score"), F.desc("_lean"), "chunk_id"]
    hot = hot_queries(sound, hot_rows)
    cold = sound.where(~F.col("query_id").isin(hot)) if hot else sound
    ranked = scored(standardised(latest_evidence(cold.repartition("query_id")))).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("bigint"))
    if hot:
        ranked = ranked.unionByName(numbered(scored(standardised_in_stretches(latest_evidence(sound.where(F.col("query_id").isin(hot))))), "query_id", order))
    return ranked.select("query_id", "chunk_id", "score", F.col("rank").cast("int").alias("rank"), "retrievers")
