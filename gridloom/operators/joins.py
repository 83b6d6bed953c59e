"""Joins by distance, by surface, by overlap and by order.

Distance joins put points into cubic cells at least as wide as the reach, join each point with the 27 cells around it on
the cell's indices, and test the exact distance: an equi-join that any number of executors share, where a cross join would not. Of
the two sides the one that is repeated 27 times should be the smaller.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast.
BROADCAST_ROWS = 100_000
#: Rows from which the repeated side of a join by distance is dealt to all partitions, and rows to be met by a first search.
SPREAD_ROWS, NEAR_ROWS = 5_000, 24


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it has few rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(f"{prefix}{c}") for c in df.columns])


def _celled(df: DataFrame, prefix: str, reach: float, around: bool) -> DataFrame:
    cell = [F.floor(F.col(f"{prefix}{a}") / F.lit(float(reach))).cast("long") for a in "xyz"]
    if not around:
        return df.withColumns({f"_c{a}": c for a, c in zip("xyz", cell, strict=True)})
    steps = F.array(*[F.struct(*[F.lit(v).alias(a) for a, v in zip("xyz", d, strict=True)]) for d in product((-1, 0, 1), repeat=3)])
    return df.withColumn("_d", F.explode(steps)).withColumns({f"_c{a}": c + F.col(f"_d.{a}") for a, c in zip("xyz", cell, strict=True)}).drop("_d")


def squared(a: str = "l_", b: str = "r_") -> Column:
    return sum(((F.col(f"{a}{c}") - F.col(f"{b}{c}")) * (F.col(f"{a}{c}") - F.col(f"{b}{c}")) for c in "xyz"), F.lit(0.0))


def range_join(left: DataFrame, right: DataFrame, reach: float, keys: list[str] = ()) -> DataFrame:
    """Pairs of rows (x, y, z) no farther apart than ``reach``, as l_* and r_* columns and ``distance``.

    ``keys``: columns, such as a frame, that must be equal as well. The left rows, which are not repeated, are what a task looks up
    in: the repeated ones go by and are neither sorted nor held.
    """
    few = left.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if right.limit(SPREAD_ROWS + 1).count() > SPREAD_ROWS:
        # rows of a small file lie in few partitions, and their pairs would
        right = right.repartition(int(right.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    a = _celled(_renamed(left, "l_"), "l_", reach, False)
    b = _celled(_renamed(right, "r_"), "r_", reach, True)
    on = [F.col(f"l_{k}") == F.col(f"r_{k}") for k in keys]
    a = a.withColumnsRenamed({f"_c{c}": f"_a{c}" for c in "xyz"})
    both = (F.broadcast(a) if few else a.hint("shuffle_hash")).join(b, [F.col(f"_a{c}") == F.col(f"_c{c}") for c in "xyz"] + on)
    return both.withColumn("distance", F.sqrt(squared())).where(F.col("distance") <= reach).drop(*[f"_{p}{c}" for p in "ac" for c in "xyz"])


def finite(names: str | list[str] = "xyz") -> Column:
    """Whether all of these columns hold a finite number."""
    fine = F.lit(True)
    for c in names:
        fine = fine & F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False))
    return fine


def first_reach(left: DataFrame, right: DataFrame, most: float, keys: list[str] = (), near: float = NEAR_ROWS) -> float:
    """A reach of at most ``most`` within which left rows have about ``near`` right rows on the average, by the counts of cells.

    What is sought near each row is sought at this reach first and at twice the reach after, until it is found: where points lie
    dense, no more than a few pairs of each are looked at, however many lie within ``most``.
    """
    at, keys = float(most), list(keys)
    for _ in range(8):
        cells = [F.floor(F.col(c) / F.lit(at)).cast("long").alias(f"_c{c}") for c in "xyz"]
        count = lambda df, n: df.where(finite()).select(*keys, *cells).groupBy(*keys, "_cx", "_cy", "_cz").agg(F.count("*").alias(n))  # noqa: B023, E731
        l, r = count(left, "_l"), count(right, "_r")
        met, all_ = l.join(r, [*keys, "_cx", "_cy", "_cz"], "left").agg(F.sum(F.col("_l") * F.coalesce("_r", F.lit(0))), F.sum("_l")).first()
        mean = 4 / 3 * math.pi * (met or 0) / max(1, all_ or 0)
        if mean <= near:
            return at
        want = at * (near / mean) ** (1 / 3)
        if want > at / 3:
            return want
        at = 1.5 * want
    return at


def closest_pairs(left: DataFrame, right: DataFrame, reach: float, cutoff: float, measure: Column, base: float, where: Column, keys: list[str], ends: tuple[str, str], symmetric: bool) -> DataFrame:
    """For each two groups the pair of rows of least ``measure`` (then l_id, r_id), if within ``cutoff``: keys, ends and ``b``.

    ``measure`` is at least the distance plus ``base``, and pairs within ``cutoff`` are within ``reach``. Groups are sought at a small
    reach first; those that have met all others are done, the rest are sought at twice the reach. With ``symmetric`` both sides
    are the same rows and two groups count once.
    """
    from gridloom.functions.store import keep

    keys = list(keys)
    own = [F.col(f"l_{k}").alias(k) for k in keys]
    pair = [(F.least("l_grp", "r_grp") if symmetric else F.col("l_grp")).alias(ends[0]), (F.greatest("l_grp", "r_grp") if symmetric else F.col("r_grp")).alias(ends[1])]
    at, best = first_reach(left, right, reach, keys), None
    # of a side: its groups, and how many others each can meet
    groups = lambda df: df.where("grp IS NOT NULL").select(*keys, "grp").distinct()
    on = [*keys, "_o"] if keys else ["_o"]
    numbered = lambda df: df.withColumn("_o", F.lit(1))

    def open_groups(side, other, met):
        total = numbered(groups(other)).groupBy(*on).agg(F.count("*").alias("_all"))
        mine = numbered(groups(side)).join(groups(other).withColumn("_own", F.lit(1)), [*keys, "grp"], "left").join(total, on).join(met, [*keys, "grp"], "left")
        return mine.where(F.coalesce("_met", F.lit(0)) < F.col("_all") - F.coalesce("_own", F.lit(0))).select(*keys, "grp")

    one, two = left, right
    while True:
        last = at >= reach
        limit = cutoff if last else at + base - 1e-9 * (at + abs(base))
        pairs = range_join(one, two, (reach if last else at) * (1 + 1e-9), keys).where(where & (F.col("l_grp") != F.col("r_grp"))).withColumn("measure", measure).where(F.col("measure") <= limit)
        new = pairs.groupBy(*own, *pair).agg(F.min(F.struct("measure", "l_id", "r_id")).alias("b"))
        if best is None and last:
            return new
        new = new if best is None else best.unionByName(new).groupBy(*keys, *ends).agg(F.min("b").alias("b"))
        best = keep(new, "closest")
        if last:
            return best
        met = [best.select(*keys, F.col(e).alias("grp")) for e in ends]
        met = [met[0].unionByName(met[1])] * 2 if symmetric else met
        met = [m.groupBy(*keys, "grp").agg(F.count("*").alias("_met")) for m in met]
        rest = [keep(open_groups(s, o, m), "open") for s, o, m in ((left, right, met[0]), (right, left, met[1]))]
        if rest[0].isEmpty() or rest[1].isEmpty():
            return best
        one, two = left.join(F.broadcast(rest[0]) if small_enough(rest[0]) else rest[0], [*keys, "grp"], "left_semi"), right.join(F.broadcast(rest[1]) if small_enough(rest[1]) else rest[1], [*keys, "grp"], "left_semi")
        at = min(2 * at, reach)


def small_enough(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def closest_contacts(points: DataFrame, cutoff: float, metric: str = "center", keys: list[str] = ()) -> DataFrame:
    """For each pair of groups the closest pair of points, if within ``cutoff``: source, target, distance, weight.

    ``points``: id (input order), grp, x, y, z, r. Metric "surface" takes both radii off. Ties go to the lower ids.
    """
    largest = (points.agg(F.max("r")).first()[0] or 0.0) if metric == "surface" else 0.0
    measure = F.col("distance") - F.col("l_r") - F.col("r_r") if metric == "surface" else F.col("distance")
    points = points.select(*keys, "id", "grp", "x", "y", "z", *(["r"] if metric == "surface" else []))
    best = closest_pairs(points, points, cutoff + 2 * largest, cutoff, measure, -2 * largest, F.col("l_id") < F.col("r_id"), keys, ("source", "target"), True)
    return best.select(*keys, "source", "target", F.col("b.measure").alias("distance"), F.col("b.l_id").alias("id_a"), F.col("b.r_id").alias("id_b"), (1 / (1 + F.greatest("b.measure", F.lit(0.0)))).alias("weight"))


def nearest_surface(samples: DataFrame, spheres: DataFrame, reach: float) -> DataFrame:
    """For each sample (id, x, y, z) the sphere (id, x, y, z, r) of least distance less radius; ties to the lower id.

    The first search reaches as far as samples have some spheres around them, if that is less than ``reach`` and the largest radius.
    Samples without a sphere surface within it are searched again at twice the reach, until all have one; each round is
    written, so that none is worked out twice. Samples with a null or non-finite coordinate have a null sphere and clearance, and so
    have all if there is no sphere; spheres with such a one don't count. The reach grows no farther than the extent of all points.
    """
    from gridloom.functions.store import keep

    nothing = lambda df: df.select("id", F.lit(None).cast("long").alias("nearest"), F.lit(None).cast("double").alias("clearance"))
    spheres = spheres.where(finite() & F.col("r").isNotNull())
    ends = [f(F.col(c).cast("double")) for c in "xyz" for f in (F.min, F.max)]
    largest, *box = spheres.agg(F.max("r"), *ends).first()
    if largest is None:
        return nothing(samples)
    rest, left = samples.where(~finite()), samples.where(finite())
    own = left.agg(*ends).first()
    extent = sum(max(box[2 * i + 1], own[2 * i + 1]) - min(box[2 * i], own[2 * i]) for i in range(3)) if own[0] is not None else 0.0
    extent += abs(largest) + abs(spheres.agg(F.min("r")).first()[0])
    found = nothing(rest)
    # distances up to which spheres are looked at: clearances up to this less the largest radius are sure
    at = first_reach(left, spheres, reach + largest) if reach + largest > 0 else reach + largest
    while True:
        sure = at - largest - 1e-9 * (abs(at) + abs(largest))
        pairs = range_join(spheres, left, at)
        best = pairs.groupBy("r_id").agg(F.min(F.struct((F.col("distance") - F.col("l_r")).alias("clearance"), F.col("l_id").alias("id"))).alias("b"))
        best = best.select(F.col("r_id").alias("id"), F.col("b.id").alias("nearest"), F.col("b.clearance").alias("clearance")).where(F.col("clearance") <= sure)
        best = keep(best, "nearest")
        found = found.unionByName(best)
        left = left.join(best.select("id"), "id", "left_anti")
        if left.isEmpty():
            return found
        if at - largest > extent:
            raise ValueError("a sample has no sphere within the extent of all points")
        left = keep(left, "left")
        at *= 2


def within_surface(samples: DataFrame, spheres: DataFrame, cutoff: float) -> DataFrame:
    """Pairs (id, sphere, clearance) with a clearance of at most ``cutoff``."""
    largest = spheres.agg(F.max("r")).first()[0] or 0.0
    pairs = range_join(spheres, samples, cutoff + largest).withColumn("clearance", F.col("distance") - F.col("l_r"))
    return pairs.where(F.col("clearance") <= cutoff).select(F.col("r_id").alias("id"), F.col("l_id").alias("sphere"), "clearance")


def segment_gaps(segments: DataFrame, spheres: DataFrame, at: float) -> DataFrame:
    """Pairs of segments (id, ax..az, bx..bz) and spheres whose centre is within ``at`` of the segment, some twice: r_id, l_ columns, gap.

    A segment goes as points ``at`` apart at most, each of which meets the spheres around it: the volume looked at is that of a
    tube, not of a ball about the middle.
    """
    from gridloom.functions import expr as E

    a, b = (tuple(F.col(f"{p}{c}") for c in "xyz") for p in "ab")
    steps = F.ceil(E.distance(a, b) / F.lit(at)).cast("int")
    along = segments.select("id", *[F.col(f"{p}{c}") for p in "ab" for c in "xyz"], steps.alias("_n")).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    share = F.col("_k") / F.greatest(F.col("_n"), F.lit(1))
    along = along.withColumns({c: F.col(f"a{c}") + (F.col(f"b{c}") - F.col(f"a{c}")) * share for c in "xyz"}).drop("_k", "_n")
    # half a step to the side of a point, then as far as the reach: with the hypotenuse of both no centre is missed
    pairs = range_join(spheres, along, at * math.sqrt(1.25) * (1 + 1e-9))
    far = E.segment_distance(E.xyz("l_"), *(tuple(F.col(f"r_{p}{c}") for c in "xyz") for p in "ab"))
    return pairs.withColumn("gap", far - F.col("l_r"))


def segment_clearances(segments: DataFrame, spheres: DataFrame, most: float | None = None) -> DataFrame:
    """Least distance less radius from each segment (id, ax..az, bx..bz) to any sphere: every segment has one, however far.

    With ``most``, which a caller gives who asks for no others, only segments with a clearance of no more are sought.
    Sought as in :func:`nearest_surface`: near first, then farther for the segments that have none yet. Segments with a coordinate
    that is no finite number have a null clearance; without spheres there are no rows.
    """
    from gridloom.functions.store import keep

    names = [f"{p}{c}" for p in "ab" for c in "xyz"]
    spheres = spheres.where(finite() & F.col("r").isNotNull()).select("id", "x", "y", "z", "r")
    largest = spheres.agg(F.max("r")).first()[0]
    if largest is None:
        return segments.select("id", F.lit(None).cast("double").alias("clearance")).where("false")
    found = segments.where(~finite(names)).select("id", F.lit(None).cast("double").alias("clearance"))
    left = keep(segments.where(finite(names)).select("id", *names), "segments")
    ends = [f(F.col(c)) for c in "xyz" for f in (F.min, F.max)]
    box = spheres.agg(*ends).first()
    middle = left.select("id", *[((F.col(f"a{c}") + F.col(f"b{c}")) / 2).alias(c) for c in "xyz"])
    at = first_reach(middle, spheres, max([box[2 * i + 1] - box[2 * i] for i in range(3)] + [abs(largest), 1e-12]))
    if most is not None:
        found, farthest = found.where("false"), max((most + largest) * (1 + 1e-6), 1e-12)
        at = min(at, farthest)
    while not left.isEmpty() and (most is None or at <= farthest):
        sure = at - largest - 1e-9 * (at + abs(largest))
        best = segment_gaps(left, spheres, at).groupBy(F.col("r_id").alias("id")).agg(F.min("gap").alias("clearance")).where(F.col("clearance") <= sure)
        best = keep(best, "clearances")
        found = found.unionByName(best)
        left = keep(left.join(best.select("id"), "id", "left_anti"), "segments")
        at = 2 * at if most is None or at >= farthest else min(2 * at, farthest)
    return found if most is None else found.where(F.col("clearance") <= most)


def annotate_groups(samples: DataFrame, points: DataFrame, cutoff: float, bottleneck: Column) -> DataFrame:
    """Groups of points near samples (id, x, y, z, gap): least and mean distance, samples touched, role and influence.

    The reach of a sample is ``cutoff`` plus its own gap, if positive. ``bottleneck`` is true for samples (r_ columns) near it.
    """
    from gridloom.functions import expr as E

    widest = samples.agg(F.max(F.greatest("gap", F.lit(0.0)))).first()[0] or 0.0
    pairs = range_join(points, samples, cutoff + widest).where(F.col("distance") <= F.lit(cutoff) + F.greatest("r_gap", F.lit(0.0)))
    pairs = pairs.withColumn("own", F.col("distance") - F.greatest("r_gap", F.lit(0.0)))
    out = pairs.groupBy(F.col("l_grp").alias("grp")).agg(
        F.min("own").alias("min_gap"), F.avg("own").alias("mean_gap"), F.countDistinct("l_id").alias("points"), F.countDistinct("r_id").alias("samples"), F.max(bottleneck.cast("int")).alias("near")
    )
    out = out.withColumn("role", E.contact_role(F.col("min_gap"), F.col("near") == 1))
    return out.withColumn("influence", E.influence(F.greatest("min_gap", F.lit(0.0)), F.col("samples"), F.col("role"))).drop("near")


def overlap_links(sets: DataFrame, jaccard: float = 0.2, containment: float = 0.5, keys: list[str] = ()) -> DataFrame:
    """Links between sets (frame, grp, member) of consecutive frames that occur: overlap, jaccard, containment, and frames left out.

    ``keys``: columns whose frames and sets are their own.
    """
    keys = list(keys)
    frames = sets.select(*keys, "frame").distinct().withColumn("turn", F.dense_rank().over(Window.partitionBy(*keys).orderBy("frame")))
    ranked = sets.join(small(frames), [*keys, "frame"])
    size = sets.groupBy(*keys, "frame", "grp").agg(F.count("*").alias("size"))
    now = ranked.select(*keys, "turn", "member", F.col("frame").alias("cur_frame"), F.col("grp").alias("cur"))
    before = ranked.select(*keys, (F.col("turn") + 1).alias("turn"), "member", F.col("frame").alias("prev_frame"), F.col("grp").alias("prev"))
    shared = before.join(now, [*keys, "turn", "member"]).groupBy(*keys, "prev_frame", "cur_frame", "prev", "cur").agg(F.count("*").alias("overlap"))
    a = size.select(*keys, F.col("frame").alias("prev_frame"), F.col("grp").alias("prev"), F.col("size").alias("n_prev"))
    b = size.select(*keys, F.col("frame").alias("cur_frame"), F.col("grp").alias("cur"), F.col("size").alias("n_cur"))
    both = shared.join(a, [*keys, "prev_frame", "prev"]).join(b, [*keys, "cur_frame", "cur"])
    both = both.withColumn("jaccard", F.col("overlap") / (F.col("n_prev") + F.col("n_cur") - F.col("overlap"))).withColumn("containment", F.col("overlap") / F.least("n_prev", "n_cur"))
    return both.where((F.col("jaccard") >= jaccard) | (F.col("containment") >= containment)).select(*keys, "prev_frame", "cur_frame", "prev", "cur", "overlap", "jaccard", "containment", (F.col("cur_frame") - F.col("prev_frame") - 1).alias("gap"))


def bridges(contacts: DataFrame, site: str, via: str, keys: list[str] = ()) -> DataFrame:
    """Pairs of sites that touch the same go-between: a, b, and the number of go-betweens.

    A go-between's sites are listed once, and each site gets those after it in the list: a row for a pair is only made where both
    sites' rows are counted, so that pairs themselves are never shuffled.
    """
    one = contacts.where(F.col(via).isNotNull() & F.col(site).isNotNull()).select(*keys, F.col(via).alias("_via"), F.col(site).alias("a"))
    listed = one.groupBy(*keys, "_via").agg(F.sort_array(F.collect_set("a")).alias("_all")).where(F.size("_all") > 1)
    for k in keys:
        listed = listed.where(F.col(k).isNotNull())
    each = listed.select(*keys, "_all", F.posexplode("_all").alias("_i", "a")).where(F.col("_i") + 1 < F.size("_all"))
    later = each.select(*keys, "a", F.expr("slice(_all, _i + 2, size(_all))").alias("_later"))
    # what is dealt by the first site is counted where it lies
    dealt = later.repartition(*keys, "a").select(*keys, "a", F.explode("_later").alias("b"))
    return dealt.groupBy(*keys, "a", "b").agg(F.count("*").alias("shared"))


def as_of(left: DataFrame, right: DataFrame, order: str, keys: list[str], values: list[str]) -> DataFrame:
    """Each left row with the values of the latest right row at or before it; rows before the first get the first."""
    fill = [F.col(c).alias(f"_v_{c}") for c in values]
    none = [F.lit(None).cast(right.schema[c].dataType).alias(f"_v_{c}") for c in values]
    rest = [c for c in left.columns if c not in (order, *keys)]
    a = left.select(*keys, order, F.lit(1).alias("_side"), *rest, *none, F.lit(None).cast(right.schema[order].dataType).alias("_at"))
    b = right.select(*keys, order, F.lit(0).alias("_side"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in rest], *fill, F.col(order).alias("_at"))
    past = Window.partitionBy(*keys).orderBy(order, "_side").rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(*keys).orderBy(order, "_side").rowsBetween(0, Window.unboundedFollowing)
    got = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(past), F.first(c, ignorenulls=True).over(later))
    both = a.unionByName(b).withColumns({c: got(f"_v_{c}") for c in values} | {"as_of": got("_at")})
    return both.where("_side = 1").withColumn("held", F.col("as_of") != F.col(order)).select(*left.columns, *values, "as_of", "held")


def first_match(rows: DataFrame, lookups: list[tuple[DataFrame, list[str]]], value: str, default: Column | None = None) -> DataFrame:
    """An ordered fallback: ``value`` of the first lookup (table, keys) that has the row's keys; each table has unique keys."""
    out, found = rows, []
    for n, (table, keys) in enumerate(lookups):
        out = out.join(small(table.select(*keys, F.col(value).alias(f"_f{n}"))), keys, "left")
        found.append(F.col(f"_f{n}"))
    return out.withColumn(value, F.coalesce(*found, *([default] if default is not None else []))).drop(*[f"_f{n}" for n in range(len(lookups))])


def split_matched(rows: DataFrame, table: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with and without a match."""
    known = table.select(*keys).distinct()
    return rows.join(known, keys, "left_semi"), rows.join(known, keys, "left_anti")


def paired(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Right less left for each key; a key on one side only is an error."""
    a, b = left.select(*keys, F.col(value).alias("_a")), right.select(*keys, F.col(value).alias("_b"))
    both = a.withColumn("_l", F.lit(1)).join(b.withColumn("_r", F.lit(1)), keys, "full_outer")
    lone = F.col("_l").isNull() | F.col("_r").isNull()
    return both.select(*keys, F.col("_a").alias("left_value"), F.col("_b").alias("right_value"), F.when(lone, F.raise_error(F.lit("a key has no partner"))).otherwise(F.col("_b") - F.col("_a")).alias("difference"))


def unique_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows``; a key that occurs twice is an error."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return rows.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(F.lit("a key occurs twice")).cast("boolean")).otherwise(F.lit(True))).drop("_n")


def lattice_membership(points: DataFrame, cells: DataFrame, spacing: float) -> DataFrame:
    """``points`` with whether their lattice cell (halves up) is one of ``cells`` (i, j, k)."""
    from gridloom.functions import expr as E

    keyed = points.withColumns({n: E.half_up_index(F.col(a) / spacing) for n, a in zip("ijk", "xyz", strict=True)})
    return keyed.join(cells.select("i", "j", "k").distinct().withColumn("_in", F.lit(True)), ["i", "j", "k"], "left").withColumn("inside", F.coalesce("_in", F.lit(False))).drop("_in")


def shared_nearest(samples: DataFrame, spheres: DataFrame, reach: float, slack: float = 1e-7) -> DataFrame:
    """Each sample's weight shared equally by the groups whose nearest spheres tie within ``slack``, summed by group."""
    near = within_surface(samples, spheres, reach).join(spheres.select(F.col("id").alias("sphere"), "grp"), "sphere")
    best = F.min("clearance").over(Window.partitionBy("id"))
    tied = near.withColumn("_b", best).where(F.col("clearance") <= F.col("_b") + slack).select("id", "grp").distinct()
    share = tied.withColumn("share", 1 / F.count("*").over(Window.partitionBy("id")))
    return share.groupBy("grp").agg(F.sum("share").alias("area"), F.count("*").alias("samples"))


def periodic_range_join(left: DataFrame, right: DataFrame, reach: float, box: float) -> DataFrame:
    """:func:`range_join` in a cubic periodic box: right rows' images near the box are added, and the closest image counts.

    The reach is at most half the box, so that no pair meets more than once at its least distance.
    """
    if reach > box / 2:
        raise ValueError("the reach is more than half the box")
    wrapped = lambda df: df.withColumns({c: F.col(c) - box * F.floor(F.col(c) / box) for c in "xyz"})
    images = wrapped(right)
    for c in "xyz":
        moved = F.array_compact(F.array(F.col(c), F.when(F.col(c) <= reach, F.col(c) + box), F.when(F.col(c) >= box - reach, F.col(c) - box)))
        images = images.withColumn("_m", F.explode(moved)).withColumn(c, F.col("_m")).drop("_m")
    pairs = range_join(wrapped(left), images, reach)
    return pairs.groupBy("l_id", "r_id").agg(F.min("distance").alias("distance"))
