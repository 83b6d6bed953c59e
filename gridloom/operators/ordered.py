"""Operators on ordered frames: runs, episodes, survival, crossings, minima, interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def local_minima(profile: DataFrame, by: list[str], order: str = "i", value: str = "r", threshold: float | None = None, most: int | None = None) -> DataFrame:
    """Points not above either neighbour; a missing neighbour is infinite, so ends and plateaus qualify.

    With ``threshold`` only those at or below it; a profile without any gives its least point. With ``most`` the least ones.
    """
    w = Window.partitionBy(*by).orderBy(order)
    inf, v = F.lit(float("inf")), F.col(value)
    found = (v <= F.coalesce(F.lag(value).over(w), inf)) & (v <= F.coalesce(F.lead(value).over(w), inf))
    if threshold is None and most is None:
        return profile.withColumn("_hit", found).where("_hit").drop("_hit")
    if threshold is not None:
        found = found & (v <= threshold)
    rank = Window.partitionBy(*by).orderBy(F.desc("_hit"), value, order)
    out = profile.withColumn("_hit", found).withColumn("_place", F.row_number().over(rank)).where(F.col("_hit") | (F.col("_place") == 1))
    return (out.where(F.col("_place") <= most) if most is not None else out).drop("_hit", "_place")


def transitions(rows: DataFrame, by: list[str], order: str, label: str) -> DataFrame:
    """Rows whose label differs from the one before: order, from, to."""
    w = Window.partitionBy(*by).orderBy(order)
    return rows.withColumn("_p", F.lag(label).over(w)).where(F.col("_p") != F.col(label)).select(*by, order, F.col("_p").alias("from_label"), F.col(label).alias("to_label"))


def dwell(rows: DataFrame, by: list[str], label: str) -> DataFrame:
    return rows.groupBy(*by, label).agg(F.count("*").alias("frames"))


def runs(rows: DataFrame, by: list[str], order: str, label: str, time: str) -> DataFrame:
    """Maximal runs of one label: first and last place, times, length, the labels before and after."""
    w = Window.partitionBy(*by).orderBy(order)
    changed = F.when(F.lag(label).over(w).eqNullSafe(F.col(label)), 0).otherwise(1)
    each = rows.withColumn("_c", changed).withColumn("_run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = each.groupBy(*by, "_run").agg(F.first(label).alias(label), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("frames"), F.min(time).alias("t_first"), F.max(time).alias("t_last"))
    v = Window.partitionBy(*by).orderBy("_run")
    return out.withColumns({"entered_from": F.lag(label).over(v), "exited_to": F.lead(label).over(v), "span": F.col("t_last") - F.col("t_first")}).drop("_run")


def episodes(sets: DataFrame) -> DataFrame:
    """Maximal runs of consecutive frames of each (grp, member), with censoring at the first and last frame of all."""
    w = Window.partitionBy("grp", "member").orderBy("frame")
    ends = F.broadcast(sets.agg(F.min("frame").alias("_lo"), F.max("frame").alias("_hi")))  # one row
    out = sets.withColumn("_run", F.col("frame") - F.row_number().over(w)).groupBy("grp", "member", "_run").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("*").alias("frames"))
    return out.crossJoin(ends).select("grp", "member", "first", "last", "frames", (F.col("first") == F.col("_lo")).alias("left_censored"), (F.col("last") == F.col("_hi")).alias("right_censored"))


def survival(sets: DataFrame, most: int = 20, times: DataFrame | None = None) -> DataFrame:
    """For each group and lag the mean, over origins with members, of the share that stays through the lag.

    ``times``: (frame, t). Where frames are not evenly spaced there is no survival, and the result is empty.
    """
    if times is not None:
        regular = regularity(times.withColumn("_all", F.lit(0)), ["_all"], "t", 1e-3).first()
        if regular and not (regular.regular and regular.increasing):
            return survival(sets, most).where(F.lit(False))
    runs_ = episodes(sets)
    last = sets.agg(F.max("frame").alias("_hi"))
    at = runs_.select("grp", "member", F.col("last"), F.explode(F.sequence("first", "last")).alias("origin"))
    lags = at.crossJoin(F.broadcast(last)).withColumn("lag", F.explode(F.sequence(F.lit(0), F.least(F.lit(most), F.col("_hi") - F.col("origin")).cast("int"))))
    each = lags.groupBy("grp", "lag", "origin").agg(F.avg((F.col("last") >= F.col("origin") + F.col("lag")).cast("double")).alias("_share"))
    return each.groupBy("grp", F.col("lag").cast("long").alias("lag")).agg(F.count("*").alias("origins"), F.avg("_share").alias("survival"))


def crossings(rows: DataFrame, by: list[str], low: float, high: float, lateral: Column | None = None, rule: str = "compartment") -> DataFrame:
    """Passages from one bulk side of a slab to the other (rows: frame, s): entry, exit, direction and status.

    ``lateral``: whether a row in the slab is in the lumen; all are without it. By the rule ``compartment`` the side last seen is
    carried forward, also where the lumen is left sideways; arrival on the other side is an event, complete if the lumen was seen on
    the way, else outside_lumen. By ``strict`` an event is a stay in the lumen that begins and ends at different sides. A step from
    one side straight to the other is unresolved by either rule: it is told, from the frame before, but not counted as complete.
    """
    if rule not in ("compartment", "strict"):
        raise ValueError("the rule is compartment or strict")
    w = Window.partitionBy(*by).orderBy("frame")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    side = F.when(F.col("s") < low, -1).when(F.col("s") > high, 1)
    inside = F.lit(True) if lateral is None else F.coalesce(lateral, F.lit(False))
    # what strict remembers: a side, or 0 (none) beside the lumen; the lumen itself changes nothing
    out = rows.withColumn("side", side).withColumn("_in", F.col("side").isNull() & inside)
    seen = F.when(F.col("side").isNotNull(), F.col("side")).when(~F.col("_in"), 0)
    at = lambda c: F.last(F.when(c, F.col("frame")), ignorenulls=True).over(past)
    out = out.withColumns(
        {
            "_last": F.last("side" if rule == "compartment" else seen, ignorenulls=True).over(past),
            "_at": at(F.col("side").isNotNull() if rule == "compartment" else ~F.col("_in")),
            "_prev": F.lag("side").over(w),
            "_before": F.lag("frame").over(w),
            "_seen": F.coalesce(F.max(F.when(F.col("_in"), F.col("frame"))).over(past), F.lit(-1)),
        }
    )
    hit = out.where((F.col("side") != F.col("_last")) & (F.col("_last") != 0))
    straight = F.col("_prev").isNotNull()
    return hit.select(
        *by,
        F.when(straight, F.col("_before")).otherwise(F.col("_at") + 1).alias("entry"),
        F.col("frame").alias("exit"),
        F.when(F.col("side") == 1, "up").otherwise("down").alias("direction"),
        F.when(straight, "unresolved_single_interval").when(F.col("_seen") > F.col("_at"), "complete").otherwise("outside_lumen").alias("status"),
    )


def crossing_summary(events: DataFrame, by: list[str]) -> DataFrame:
    """Counted events up and down, net and unresolved, for each key and, by rollup, in all."""
    done = F.col("status") == "complete"
    n = lambda c: F.sum(c.cast("long"))
    out = events.rollup(*by).agg(n(done & (F.col("direction") == "up")).alias("up"), n(done & (F.col("direction") == "down")).alias("down"), n(~done).alias("unresolved"), F.avg(F.when(done, F.col("exit") - F.col("entry"))).alias("mean_transit"))
    return out.withColumn("net", F.col("up") - F.col("down"))


def unwrapped(rows: DataFrame, by: list[str], box: float) -> DataFrame:
    """Positions in a periodic box made continuous: running sum of minimum-image steps from the first position."""
    from gridloom.functions.expr import minimum_image

    w = Window.partitionBy(*by).orderBy("frame")
    step = F.coalesce(minimum_image(F.col("s") - F.lag("s").over(w), F.lit(float(box))), F.col("s"))
    return rows.withColumn("_d", step).withColumn("unwrapped", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_d")


def net_passage(rows: DataFrame, by: list[str], low: float, high: float) -> DataFrame:
    """Running sum of displacements clipped to the slab, over its length."""
    w = Window.partitionBy(*by).orderBy("frame")
    clip = F.greatest(F.lit(low), F.least(F.lit(high), F.col("s")))
    return rows.withColumn("_c", clip).withColumn("_d", F.coalesce(F.col("_c") - F.lag("_c").over(w), F.lit(0.0))).withColumn("net", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0)) / (high - low)).drop("_c", "_d")


def regularity(rows: DataFrame, by: list[str], time: str, tolerance: float) -> DataFrame:
    """Whether all steps of time are close to the first one, and whether time always grows."""
    w = Window.partitionBy(*by).orderBy("frame")
    step = rows.withColumn("_d", F.col(time) - F.lag(time).over(w))
    first = F.first("_d", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return step.withColumn("_f", first).groupBy(*by).agg((F.coalesce(F.max(F.abs(F.col("_d") - F.col("_f")) / F.abs("_f")), F.lit(0.0)) <= tolerance).alias("regular"), F.coalesce(F.min("_d") > 0, F.lit(True)).alias("increasing"))


def arc_length(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Running length of a polyline of points x, y, z."""
    w = Window.partitionBy(*by).orderBy(order)
    d2 = sum(((F.col(a) - F.lag(a).over(w)) * (F.col(a) - F.lag(a).over(w)) for a in "xyz"), F.lit(0.0))
    return rows.withColumn("_d", F.coalesce(F.sqrt(d2), F.lit(0.0))).withColumn("arc", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_d")


def resample(profile: DataFrame, by: list[str], step: float) -> DataFrame:
    """Linear interpolation of r at multiples of ``step``, never beyond a profile's ends.

    Each interval makes its own grid points, so no join is needed.
    """
    w = Window.partitionBy(*by).orderBy("s", "i")
    seg = profile.withColumns({"_s": F.lead("s").over(w), "_r": F.lead("r").over(w)})
    last = F.col("_s").isNull()
    lo, hi = F.ceil(F.col("s") / step), F.when(last, F.floor(F.col("s") / step)).otherwise(F.ceil(F.col("_s") / step) - 1)
    g = seg.withColumn("g", F.explode(F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))))
    x = F.col("g") * step
    value = F.when(last | (F.col("_s") == F.col("s")), F.col("r")).otherwise(F.col("r") + (F.col("_r") - F.col("r")) * ((x - F.col("s")) / (F.col("_s") - F.col("s"))))
    return g.select(*by, "g", x.alias("at"), value.alias("value"))


def profile_distribution(profile: DataFrame, by: str, step: float) -> DataFrame:
    """At each grid coordinate: profiles that reach it, coverage, mean, median and a 95 % band."""
    at = resample(profile, [by], step)
    total = F.broadcast(profile.agg(F.countDistinct(by).alias("total")))  # one row
    out = at.groupBy("g").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.percentile("value", F.lit(0.5)).alias("median"), F.percentile("value", F.lit(0.025)).alias("q025"), F.percentile("value", F.lit(0.975)).alias("q975"))
    return out.crossJoin(total).withColumn("coverage", F.col("n") / F.col("total")).drop("total")


def lagged(rows: DataFrame, by: list[str], value: str, wet: float) -> DataFrame:
    """Consecutive pairs by state (wet at or above a value): pairs and mean step of those that stay and that change."""
    w = Window.partitionBy(*by).orderBy("frame")
    pair = rows.withColumn("_n", F.lead(value).over(w)).where("_n IS NOT NULL")
    a, b = F.col(value) >= wet, F.col("_n") >= wet
    kind = F.when(a & b, "wet").when(~a & ~b, "dry").otherwise("changed")
    return pair.groupBy(*by, kind.alias("kind")).agg(F.count("*").alias("pairs"), F.avg(F.abs(F.col("_n") - F.col(value))).alias("mean_step"))


def guarded_corr(rows: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Pearson correlation; null with under 3 rows or hardly any variance."""
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.corr(a, b).alias("_c"), F.least(F.stddev_pop(a), F.stddev_pop(b)).alias("_s"))
    return out.select(*by, "n", F.when((F.col("n") >= 3) & (F.col("_s") > 1e-10), F.col("_c")).alias("correlation"))


def blocks(rows: DataFrame, by: list[str], value: str, count: int) -> DataFrame:
    """Means of ``count`` contiguous blocks; the first of them have one row more when rows don't divide evenly."""
    w = Window.partitionBy(*by).orderBy("frame")
    return rows.withColumn("block", F.ntile(count).over(w) - 1).groupBy(*by, "block").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def resample_polyline(rows: DataFrame, by: list[str], order: str, step: float) -> DataFrame:
    """Points at multiples of ``step`` along a polyline of points x, y, z; each segment makes its own."""
    along = arc_length(rows, by, order)
    w = Window.partitionBy(*by).orderBy(order)
    seg = along.withColumns({"_a": F.lead("arc").over(w), **{f"_{c}": F.lead(c).over(w) for c in "xyz"}})
    last = F.col("_a").isNull()
    lo, hi = F.ceil(F.col("arc") / step), F.when(last, F.floor(F.col("arc") / step)).otherwise(F.ceil(F.col("_a") / step) - 1)
    g = seg.withColumn("g", F.explode(F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))))
    k = F.when(last | (F.col("_a") == F.col("arc")), F.lit(0.0)).otherwise((F.col("g") * step - F.col("arc")) / (F.col("_a") - F.col("arc")))
    return g.select(*by, "g", *[F.when(last, F.col(c)).otherwise(F.col(c) + (F.col(f"_{c}") - F.col(c)) * k).alias(c) for c in "xyz"])
