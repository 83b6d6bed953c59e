"""What lies around regions: lining, nearest groups, typed bridges, networks with a region, comparisons of regions and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import expr as E
from gridloom.functions.store import keep
from gridloom.operators.contacts import hydrogen_bonds
from gridloom.operators.joins import annotate_groups, first_reach, range_join, small


def contact_order(contacts: DataFrame) -> list[Column]:
    """Contacts in order: greater influence, lesser gap, group."""
    return [F.desc("influence"), F.asc("min_gap"), F.asc("grp")]


def nearest_groups(points: DataFrame, at: tuple[float, float, float], cutoff: float = 8.0, limit: int = 8) -> DataFrame:
    """The groups of most influence around one bare point, no more than ``limit``."""
    one = points.sparkSession.createDataFrame([(0, *map(float, at), 0.0)], "id long, x double, y double, z double, gap double")
    found = annotate_groups(one, points, cutoff, F.lit(False))
    return found.orderBy(*contact_order(found)).limit(limit)


def typed_bridges(donors: DataFrame, acceptors: DataFrame, water_donors: DataFrame, water_acceptors: DataFrame, keys: list[str] = (), reach: float = 3.5, nearest: float = 1.2, **rules) -> DataFrame:
    """Groups joined by a water that each of them has a directional bond with: water, a, b, distance (larger) and angle (lesser).

    Sites are those of :func:`~gridloom.operators.contacts.hydrogen_bonds`; a water's group is its own. Of several bonds of one
    group with a water the closest counts, so bonds are sought near each water first; waters that have one with every group are
    done, the rest look farther, up to ``reach``.
    """
    keys = list(keys)
    sites = donors.select(F.col("id").alias("site"), "grp").unionByName(acceptors.select(F.col("id").alias("site"), "grp")).distinct()
    groups = keep(sites.select("grp").distinct(), "groups")
    total = groups.count()
    waters = water_donors.select(*keys, F.col("id").alias("water"), "grp").unionByName(water_acceptors.select(*keys, F.col("id").alias("water"), "grp")).distinct()
    # as many groups as a water can have a bond with: its own is none
    most = waters.join(groups.withColumn("_own", F.lit(1)), "grp", "left").select(*keys, "water", (F.lit(total) - F.coalesce("_own", F.lit(0))).alias("_most"))
    at, found = first_reach(water_acceptors, donors, reach, keys, 500.0), None
    while True:
        far = min(reach, (max(0.0, nearest) ** 3 + at**3) ** (1 / 3)) if at < reach else reach
        give = hydrogen_bonds(donors, water_acceptors, reach=far, nearest=nearest, keys=keys, **rules).select(*keys, F.col("acceptor").alias("water"), F.col("donor").alias("site"), "distance", "angle")
        take = hydrogen_bonds(water_donors, acceptors, reach=far, nearest=nearest, keys=keys, **rules).select(*keys, F.col("donor").alias("water"), F.col("acceptor").alias("site"), "distance", "angle")
        owned = give.unionByName(take).join(sites, "site").groupBy(*keys, "water", "grp").agg(F.min(F.struct("distance", "angle", "site")).alias("bond"))
        owned = keep(owned, "owned")
        if far >= reach:
            found = owned if found is None else found.unionByName(owned)
            break
        done = owned.groupBy(*keys, "water").agg(F.count("*").alias("_n")).join(most, [*keys, "water"]).where(F.col("_n") >= F.col("_most")).select(*keys, "water").distinct()
        done = keep(done, "done")
        ready = owned.join(done, [*keys, "water"], "left_semi")
        found = ready if found is None else found.unionByName(ready)
        water_donors, water_acceptors = (keep(w.join(done.withColumnRenamed("water", "id"), [*keys, "id"], "left_anti"), "waters") for w in (water_donors, water_acceptors))
        if water_donors.isEmpty() and water_acceptors.isEmpty():
            break
        at = min(2 * at, reach)
    a, b = (found.select(*keys, "water", F.col("grp").alias(n), F.col("bond").alias(f"_{n}")) for n in "ab")
    both = a.join(b, [*keys, "water"]).where("a < b")
    return both.select(*keys, "water", "a", "b", F.greatest("_a.distance", "_b.distance").alias("distance"), F.least("_a.angle", "_b.angle").alias("angle"))


def shell_lining(samples: DataFrame, atoms: DataFrame, shell: float = 1.4) -> DataFrame:
    """Groups of atoms (id, grp, x, y, z, r) in the shell of samples (id, x, y, z, clearance).

    An atom is in it where its surface is no farther than ``shell`` from the sample's own sphere (a negative clearance is none). Each
    group keeps its least gap, the sample of it (of equal ones the first), and the number of its samples.
    """
    own = F.greatest("l_clearance", F.lit(0.0))
    top = samples.agg(F.max(F.greatest("clearance", F.lit(0.0)))).first()[0] or 0.0
    largest = atoms.agg(F.max("r")).first()[0] or 0.0
    pairs = range_join(samples, atoms, top + shell + largest).withColumn("gap", F.col("distance") - F.col("r_r") - own).where(F.col("gap") <= shell)
    out = pairs.groupBy(F.col("r_grp").alias("grp")).agg(F.min(F.struct("gap", "l_id")).alias("b"), F.countDistinct("l_id").alias("samples"))
    return out.select("grp", "b.gap", F.col("b.l_id").alias("sample"), "samples")


def segment_lining(voxels: DataFrame, atoms: DataFrame, cutoff: float = 3.3) -> DataFrame:
    """For each segment of voxels (segment, x, y, z) the groups with an atom (id, grp) that near: least distance, its atom, atoms."""
    pairs = range_join(voxels.select("segment", "x", "y", "z"), atoms.select("id", "grp", "x", "y", "z"), cutoff)
    each = pairs.groupBy(F.col("l_segment").alias("segment"), F.col("r_grp").alias("grp"), F.col("r_id").alias("id")).agg(F.min("distance").alias("distance"))
    out = each.groupBy("segment", "grp").agg(F.min(F.struct("distance", "id")).alias("b"), F.count("*").alias("atoms"))
    return out.select("segment", "grp", "b.distance", F.col("b.id").alias("closest"), "atoms")


def region_network(edges: DataFrame, nodes: DataFrame, contacts: DataFrame, region: str) -> DataFrame:
    """A network (source, target, interaction, distance, weight) with a region as a further node.

    Its edges go to those groups of ``contacts`` (grp, role, min_gap, influence) that are nodes, named and weighted by them.
    """
    known = nodes.select(F.col("node").cast("string").alias("target")).distinct()
    own = contacts.select(F.lit(region).alias("source"), F.col("grp").cast("string").alias("target"), F.concat(F.lit("region_"), F.col("role")).alias("interaction"), F.col("min_gap").alias("distance"), F.col("influence").alias("weight"))
    rest = edges.select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"), "interaction", "distance", "weight")
    return own.join(known, "target", "left_semi").select("source", "target", "interaction", "distance", "weight").unionByName(rest)


def adjacency(edges: DataFrame) -> DataFrame:
    """Each node (of edges source, target) with the sorted list of its different neighbours."""
    ends = edges.select(F.col("source").alias("node"), F.col("target").alias("other")).unionByName(edges.select(F.col("target").alias("node"), F.col("source").alias("other")))
    return ends.groupBy("node").agg(F.sort_array(F.collect_set("other")).alias("neighbours"))


def similarity(names: DataFrame, members: DataFrame) -> DataFrame:
    """Jaccard of each two of the named sets (grp), also of those without a common member; two empty sets are alike (1).

    ``names`` is a small table: one row for each network compared.
    """
    one = small(names.select("grp").distinct())
    size = members.select("grp", "member").distinct().groupBy("grp").agg(F.count("*").alias("n"))
    sized = one.join(size, "grp", "left").select("grp", F.coalesce("n", F.lit(0)).alias("n"))
    distinct = members.select("grp", "member").distinct()
    shared = distinct.select(F.col("grp").alias("a"), "member").join(distinct.select(F.col("grp").alias("b"), "member"), "member").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    left, right = sized.select(F.col("grp").alias("a"), F.col("n").alias("na")), sized.select(F.col("grp").alias("b"), F.col("n").alias("nb"))
    pairs = left.join(small(right), F.col("a") < F.col("b"))  # as many rows as pairs are asked for
    both = pairs.join(shared, ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    union = F.col("na") + F.col("nb") - F.col("shared")
    return both.select("a", "b", "shared", F.when(union == 0, 1.0).otherwise(F.col("shared") / union).alias("jaccard"))


def ever_members(left: DataFrame, right: DataFrame, member: str = "member") -> DataFrame:
    """Members that two regions ever had: in both, in the left one, or in the right one only."""
    a, b = (df.select(member).distinct().withColumn(n, F.lit(True)) for df, n in ((left, "_l"), (right, "_r")))
    both = a.join(b, member, "full_outer")
    return both.select(member, F.when(F.col("_l").isNull(), "right").when(F.col("_r").isNull(), "left").otherwise("both").alias("where"))


def overlapping_routes(a: DataFrame, b: DataFrame, mouth: float, tail: float) -> DataFrame:
    """Pairs (a, b) of routes (id; mouth at x, y, z; tail at tx, ty, tz) that count as one: mouths or tails that near."""
    at_tail = lambda df: df.select("id", *[F.col(f"t{c}").alias(c) for c in "xyz"])
    at_mouth = lambda df: df.select("id", "x", "y", "z")
    near = range_join(at_mouth(a), at_mouth(b), mouth).unionByName(range_join(at_tail(a), at_tail(b), tail))
    return near.select(F.col("l_id").alias("a"), F.col("r_id").alias("b")).distinct()


def left_out_routes(others: DataFrame, chosen: DataFrame, mouth: float, tail: float) -> DataFrame:
    """Routes found at other settings that overlap none of the chosen ones."""
    same = overlapping_routes(others, chosen, mouth, tail).select(F.col("a").alias("id")).distinct()
    return others.join(same, "id", "left_anti")


def hydration(atoms: DataFrame, waters: DataFrame, reach: float, frames: DataFrame) -> DataFrame:
    """For each group: frames with a water within reach, their share of all ``frames`` (frame), and mean waters a frame.

    Atoms (frame, grp, x, y, z) and waters (frame, id, x, y, z) meet frame by frame.
    """
    total = F.broadcast(frames.agg(F.countDistinct("frame").alias("_all")))  # one row
    pairs = range_join(atoms.select("frame", "grp", "x", "y", "z"), waters.select("frame", "id", "x", "y", "z"), reach, ["frame"])
    each = pairs.groupBy(F.col("l_frame").alias("frame"), F.col("l_grp").alias("grp")).agg(F.countDistinct("r_id").alias("n"))
    out = each.groupBy("grp").agg(F.count("*").alias("frames"), F.sum("n").alias("waters")).crossJoin(total)
    return out.select("grp", "frames", (F.col("frames") / F.col("_all")).alias("occupancy"), (F.col("waters") / F.col("_all")).alias("mean_waters"))


def frame_table(frames: DataFrame, scalars: dict[str, DataFrame]) -> DataFrame:
    """One row for each frame with a column for each scalar (frame, value); a frame that has none is null there."""
    out = frames.select("frame").distinct()
    for name, rows in scalars.items():
        out = out.join(rows.select("frame", F.col("value").alias(name)), "frame", "left")
    return out


def split_links(pairs: DataFrame, box: tuple[float, float, float]) -> DataFrame:
    """Bonded pairs (ax..az, bx..bz) that the periodic boundary parts: far apart as they stand, near by the minimum image."""
    d = [F.col(f"b{c}") - F.col(f"a{c}") for c in "xyz"]
    raw = E.norm(tuple(d))
    image = E.norm(tuple(E.minimum_image(v, F.lit(float(size))) for v, size in zip(d, box, strict=True)))
    return pairs.withColumns({"raw": raw, "image": image}).where((F.col("raw") > 3) & (F.col("image") < 2.5) & (F.col("raw") > F.col("image") + 0.5))


def whole_pairs(pairs: DataFrame, box: tuple[float, float, float]) -> DataFrame:
    """``pairs``; one that the boundary parts is an error."""
    n = split_links(pairs, box).count()
    if n:
        raise ValueError(f"{n} bonded pairs lie on two sides of the periodic boundary")
    return pairs


def transit_summary(events: DataFrame, by: list[str], duration: float) -> DataFrame:
    """Counted events (direction, status, entry, exit): up, down, net, outside and unresolved ones, rates, and transit times."""
    done = F.col("status") == "complete"
    n = lambda c: F.sum(c.cast("long"))
    time = F.when(done, F.col("exit") - F.col("entry"))
    out = events.groupBy(*by).agg(
        n(done & (F.col("direction") == "up")).alias("up"), n(done & (F.col("direction") == "down")).alias("down"), n(F.col("status") == "outside_lumen").alias("outside"), n(F.col("status") == "unresolved_single_interval").alias("unresolved"),
        F.avg(time).alias("mean_transit"), F.percentile(time, F.lit(0.5)).alias("median_transit"), F.min(time).alias("least_transit"), F.max(time).alias("longest_transit"),
    )
    return out.withColumns({"net": F.col("up") - F.col("down"), "rate": (F.col("up") + F.col("down")) / F.lit(float(duration))})


def dwell_times(visits: DataFrame, by: list[str]) -> DataFrame:
    """Visits (frames, censored): their number, those neither begun before nor ended after the data, and these ones' mean length."""
    whole = ~F.col("censored")
    return visits.groupBy(*by).agg(F.count("*").alias("visits"), F.sum(whole.cast("long")).alias("whole"), F.avg(F.when(whole, F.col("frames"))).alias("mean_dwell"))


def occupancy_histogram(inside: DataFrame, frames: DataFrame) -> DataFrame:
    """In how many frames how many members (frame, member) are inside, none included."""
    each = inside.groupBy("frame").agg(F.countDistinct("member").alias("n"))
    full = frames.select("frame").distinct().join(each, "frame", "left").select("frame", F.coalesce("n", F.lit(0)).alias("n"))
    return full.groupBy("n").agg(F.count("*").alias("frames"))


def boundary_shares(triangles: DataFrame, spheres: DataFrame, reach: float = 1.5, slack: float = 1e-7) -> DataFrame:
    """Area of boundary triangles (id, x, y, z, area) by group of the nearest sphere; groups that tie within ``slack`` share equally.

    Triangles whose nearest surface is farther than ``reach`` belong to none.
    """
    from gridloom.operators.joins import within_surface

    near = within_surface(triangles.select("id", "x", "y", "z"), spheres, reach).join(spheres.select(F.col("id").alias("sphere"), "grp"), "sphere")
    best = F.min("clearance").over(Window.partitionBy("id"))
    tied = near.withColumn("_b", best).where(F.col("clearance") <= F.col("_b") + slack).select("id", "grp").distinct()
    share = tied.withColumn("_n", F.count("*").over(Window.partitionBy("id"))).join(triangles.select("id", "area"), "id")
    return share.groupBy("grp").agg(F.sum(F.col("area") / F.col("_n")).alias("area"), F.count("*").alias("triangles"))
