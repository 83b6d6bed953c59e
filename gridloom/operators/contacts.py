"""Typed contacts between sites: hydrogen bonds, charges, rings, water, and what follows from them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import expr as E
from gridloom.functions.store import keep
from gridloom.operators import blocks as B
from gridloom.operators.joins import closest_pairs, first_reach, range_join, small


def angle(a: E.Vector, b: E.Vector, c: E.Vector) -> Column:
    """Angle at b in degrees; null if an arm has no length."""
    u, v = E.sub(a, b), E.sub(c, b)
    size = E.norm(u) * E.norm(v)
    return F.when(size > 0, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), E.dot(u, v) / size)))))


def hydrogen_bonds(donors: DataFrame, acceptors: DataFrame, reach: float = 3.5, nearest: float = 1.2, h_reach: float = 2.5, least_angle: float = 150.0, keys: list[str] = (), bond: tuple[float, float, float] = (0.4, 1.25, 1.65)) -> DataFrame:
    """Bonds donor (id, grp, x, y, z, hydrogen at hx, hy, hz) to acceptor (id, grp, x, y, z) of another group.

    A hydrogen counts where it is farther from its donor than the first of ``bond`` and no farther than the second, or the third if
    the donors have an element and it is sulphur.
    """
    own = E.distance(E.xyz(), tuple(F.col(f"h{a}") for a in "xyz"))
    most = F.when(F.upper("element") == "S", bond[2]).otherwise(bond[1]) if "element" in donors.columns else F.lit(bond[1])
    donors = donors.where((own > bond[0]) & (own <= most))
    pairs = range_join(donors, acceptors, reach, keys).where((F.col("distance") > nearest) & (F.col("l_grp") != F.col("r_grp")))
    h = tuple(F.col(f"l_h{a}") for a in "xyz")
    pairs = pairs.withColumn("h_distance", E.distance(h, E.xyz("r_"))).withColumn("angle", angle(E.xyz("l_"), h, E.xyz("r_")))
    return pairs.where((F.col("h_distance") <= h_reach) & (F.col("angle") >= least_angle)).select(*[F.col(f"l_{k}").alias(k) for k in keys], F.col("l_id").alias("donor"), F.col("r_id").alias("acceptor"), "distance", "h_distance", "angle")


def charge_pairs(sites: DataFrame, reach: float = 4.0, keys: list[str] = ()) -> DataFrame:
    """Closest pair of oppositely charged sites (id, grp, charge, x, y, z) of each two groups."""
    plain = [*keys, "id", "grp", "x", "y", "z"]
    best = closest_pairs(sites.where("charge > 0").select(plain), sites.where("charge < 0").select(plain), reach, reach, F.col("distance"), 0.0, F.lit(True), keys, ("positive", "negative"), False)
    return best.select(*keys, "positive", "negative", F.col("b.measure").alias("distance"), F.col("b.l_id").alias("id_a"), F.col("b.r_id").alias("id_b"))


def stacked_rings(rings: DataFrame, near: float = 2.5, far: float = 5.5, keys: list[str] = (), flat: float = 0.15) -> DataFrame:
    """Ring pairs (id, grp, centre x, y, z, unit normal nx, ny, nz) that lie parallel or edge to face.

    Parallel: planes within 30 degrees and both offsets at most 2; edge to face: at least 60 degrees and the lesser offset at most 2.
    Rings that have an ``rms``, their atoms' distance from the plane, count only where it is at most ``flat``. Rings meet in blocks:
    where most are within ``far`` of each other a row is made only for the pairs that are given.
    """
    near_, keys = near, list(keys)
    if "rms" in rings.columns:
        rings = rings.where(F.col("rms") <= flat).drop("rms")
    rings = B.cells_of(rings.select(*keys, "id", "grp", *[f"{n}{c}" for n in ("", "n") for c in "xyz"]), far).where(F.col("id").isNotNull() & F.col("grp").isNotNull())
    kinds = {f.name: f.dataType.simpleString() for f in rings.schema.fields}
    cell = ["_cx", "_cy", "_cz"]

    def kernel(a, b, same):
        ia, ib, ga, gb = B.column(a, "id"), B.column(b, "id"), B.column(a, "grp"), B.column(b, "grp")
        n, m = ([B.column(t, f"n{c}") for c in "xyz"] for t in (a, b))
        for rows in B.strips(len(ia), len(ib)):
            d2, d = B.squares(a, b, rows)
            distance = np.sqrt(d2)
            size = np.abs(sum(n[k][rows, None] * m[k][None, :] for k in range(3)))
            near = (distance <= far) & (distance >= near_) & (ga[rows, None] != gb[None, :]) & (ia[rows, None] < ib[None, :] if same else ia[rows, None] != ib[None, :])
            # the exact tilt is worked out where it may count
            near &= (size >= 0.86) | (size <= 0.51)
            i, j = np.nonzero(near)
            if not len(i):
                continue
            dot = lambda normal: sum(d[k][i, j] * normal[k] for k in range(3))  # noqa: B023, E731
            tilt = np.degrees(np.arccos(np.minimum(1.0, size[i, j])))
            # what is d . d less the square of its part along a normal
            d2 = d2[i, j]
            one, two = (np.sqrt(np.maximum(0.0, d2 - p * p)) for p in (dot([c[rows][i] for c in n]), dot([c[j] for c in m])))
            flat_, edge = (tilt <= 30) & (np.maximum(one, two) <= 2), (tilt >= 60) & (np.minimum(one, two) <= 2)
            got = flat_ | edge
            i, j, tilt, flat_ = i[got], j[got], tilt[got], flat_[got]
            p, q = ia[rows][i], ib[j]
            own = [a.column(k)[0].as_py() for k in keys]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([v] * len(i), a.schema.field(k).type) for k, v in zip(keys, own, strict=True)], pa.array(np.minimum(p, q), a.schema.field("id").type), pa.array(np.maximum(p, q), a.schema.field("id").type), pa.DictionaryArray.from_arrays(pa.array((~flat_).astype("int8")), ["parallel", "edge_face"]).cast(pa.string()), pa.array(distance[i, j]), pa.array(tilt)],
                [*keys, "a", "b", "kind", "distance", "tilt"],
            )

    # keys ride in the blocks too
    inner = rings.withColumns({f"_k{n}": F.col(k) for n, k in enumerate(keys)})
    blocks = B.in_blocks(inner, [*[f"_k{n}" for n in range(len(keys))], *cell], "id")
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], f"a {kinds['id']}, b {kinds['id']}, kind string, distance double, tilt double"])
    return B.over_pairs(B.near_block_pairs(blocks, cell, [f"_k{n}" for n in range(len(keys))]), kernel, schema)


def near_counts(points: DataFrame, reach: float, within: float) -> DataFrame:
    """Unordered pairs of points (id, grp, name, x, y, z) of different groups within ``reach``, counted by both names.

    Gives (left, right, close, n): the lesser name first, and whether the points are no farther apart than ``within``. No row is
    made for a pair: blocks of points meet, and only counts leave them.
    """
    cell = ["_cx", "_cy", "_cz"]
    # cells narrower than the reach would have more neighbours
    p = B.cells_of(points.select("id", "grp", "name", "x", "y", "z"), reach).where(F.col("id").isNotNull() & F.col("grp").isNotNull() & F.col("name").isNotNull())

    def kernel(a, b, same):
        names = sorted(set(a.column("name").to_pylist()) | set(b.column("name").to_pylist()))
        number = {v: k for k, v in enumerate(names)}
        na, nb = (np.array([number[v] for v in t.column("name").to_pylist()]) for t in (a, b))
        ia, ib, ga, gb = B.column(a, "id"), B.column(b, "id"), B.column(a, "grp"), B.column(b, "grp")
        total = np.zeros((2, len(names), len(names)), "int64")
        for rows in B.strips(len(ia), len(ib)):
            distance = np.sqrt(B.squares(a, b, rows)[0])
            hit = (distance <= reach) & (ga[rows, None] != gb[None, :]) & (ia[rows, None] < ib[None, :] if same else ia[rows, None] != ib[None, :])
            i, j = np.nonzero(hit)
            one, two, close = na[rows][i], nb[j], distance[i, j] <= within
            at = (close * len(names) + np.minimum(one, two)) * len(names) + np.maximum(one, two)
            total += np.bincount(at, minlength=total.size).reshape(total.shape)
        close, one, two = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in one], pa.string()), pa.array([names[k] for k in two], pa.string()), pa.array(close.astype(bool)), pa.array(total[close, one, two])], ["left", "right", "close", "n"])

    each = B.over_pairs(B.near_block_pairs(B.in_blocks(p, cell, "id"), cell), kernel, "left string, right string, close boolean, n long")
    return each.groupBy("left", "right", "close").agg(F.sum("n").alias("n"))


def water_counts(atoms: DataFrame, waters: DataFrame, reach: float = 3.5, keys: list[str] = ()) -> DataFrame:
    """For each group of atoms (id, grp, part, polar): distinct waters touched, in all, by either part and by polar atoms."""
    pairs = range_join(atoms, waters, reach, keys)
    n = lambda c: F.countDistinct(F.when(c, F.col("r_id")))
    return pairs.groupBy(*[F.col(f"l_{k}").alias(k) for k in keys], F.col("l_grp").alias("grp")).agg(
        F.countDistinct("r_id").alias("waters"), n(F.col("l_part") == "backbone").alias("backbone"), n(F.col("l_part") == "side").alias("side_chain"), n(F.col("l_polar")).alias("polar"), F.min("distance").alias("min_distance")
    )


def nearest_inside(points: DataFrame, centres: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Points that lie in the sphere of their nearest centre (id, x, y, z, r); other spheres don't count.

    Near centres are sought first; points that have none within the first reach are sought again at twice the reach.
    """
    keys = list(keys)
    widest = centres.agg(F.max("r")).first()[0] or 0.0
    # a point in its nearest centre's sphere is within the largest radius of it
    reach = widest if widest > 0 else 1e-12
    at, found = first_reach(points, centres, reach, keys), None
    points = points.select(*keys, "id", "x", "y", "z")
    while True:
        pairs = range_join(centres, points, min(at, reach), keys)
        best = pairs.groupBy(*[F.col(f"r_{k}").alias(k) for k in keys], F.col("r_id").alias("id")).agg(F.min(F.struct("distance", F.col("l_id").alias("centre"), F.col("l_r").alias("r"))).alias("b"))
        if at < reach:
            best = keep(best, "inside")
        found = best if found is None else found.unionByName(best)
        if at >= reach:
            break
        points = keep(points.join(best.select(*keys, "id"), [*keys, "id"], "left_anti"), "points")
        if points.isEmpty():
            break
        at = min(2 * at, reach)
    return found.where("b.distance <= b.r").select(*keys, "id", "b.centre", "b.distance")


def contact_class(left: Column, right: Column, gap: Column) -> Column:
    """One class for a contact of residues of these names, ``gap`` between their surfaces: the first rule that holds.

    Opposite charges: there are a positive and a negative one among both residues' properties, which are not the same.
    """
    a, b = E.residue_properties(left), E.residue_properties(right)
    has = lambda props, kind: F.array_contains(props, kind)
    opposite = (has(a, "positive") | has(b, "positive")) & (has(a, "negative") | has(b, "negative")) & (a != b)
    return (
        F.when(opposite, "oppositely_charged_residue_contact")
        .when(has(a, "hydrophobic") & has(b, "hydrophobic"), "hydrophobic_residue_contact")
        .when((gap <= 0.5) & (has(a, "polar") | has(b, "polar")), "polar_residue_contact")
        .otherwise("distance_contact")
    )


def nearest_fraction(a: DataFrame, b: DataFrame, reach: float) -> DataFrame:
    """For each group of a and of b: the shares of their points with a point of the other within reach, and the F-score."""
    pairs = range_join(a, b, reach)
    hit_a = pairs.groupBy(F.col("l_grp").alias("ga"), F.col("r_grp").alias("gb")).agg(F.countDistinct("l_id").alias("na"), F.countDistinct("r_id").alias("nb"))
    size = lambda df, k, n: small(df.groupBy(F.col("grp").alias(k)).agg(F.count("*").alias(n)))
    out = hit_a.join(size(a, "ga", "ta"), "ga").join(size(b, "gb", "tb"), "gb")
    p, q = F.col("na") / F.col("ta"), F.col("nb") / F.col("tb")
    return out.select("ga", "gb", p.alias("share_a"), q.alias("share_b"), (2 * p * q / (p + q)).alias("score"))


def best_match(scores: DataFrame, least: float = 0.1, rival: float = 0.8) -> DataFrame:
    """For each ``ga`` the best ``gb``; none below ``least``, nor if the second comes to ``rival`` of the first (ambiguous)."""
    w = Window.partitionBy("ga").orderBy(F.desc("score"), "gb")
    out = scores.withColumns({"_n": F.row_number().over(w), "_second": F.lead("score").over(w)}).where("_n = 1")
    status = F.when(F.col("score") < least, "unmatched").when(F.coalesce(F.col("_second") >= rival * F.col("score"), F.lit(False)), "ambiguous").otherwise("matched")
    return out.select("ga", F.when(status == "matched", F.col("gb")).alias("gb"), "score", status.alias("status"))


def cross_tab(points: DataFrame, fixed: str, moving: str, by: list[str]) -> DataFrame:
    """Rows in both of two boolean memberships, in either alone, and in neither."""
    f, m = F.col(fixed), F.col(moving)
    n = lambda c: F.sum(c.cast("long"))
    return points.groupBy(*by).agg(n(f & m).alias("both"), n(f & ~m).alias("fixed_only"), n(~f & m).alias("moving_only"), n(~f & ~m).alias("neither"))


def alignment_sums(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Centroids and cross-covariance of paired points (ax..az, bx..bz): all that a best rotation needs."""
    cov = [F.covar_pop(f"a{p}", f"b{q}").alias(f"h_{p}{q}") for p in "xyz" for q in "xyz"]
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(f"{s}{p}").alias(f"m{s}{p}") for s in "ab" for p in "xyz"], *cov, *[F.var_pop(f"{s}{p}").alias(f"v{s}{p}") for s in "ab" for p in "xyz"])


def rigid_alignment(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Rotation and shift that bring points a onto points b with least squares, and the root-mean-square deviation before and after."""
    import numpy as np
    import pandas as pd

    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select(*by).schema.fields)
    names = [f"r{p}{q}" for p in "xyz" for q in "xyz"] + ["tx", "ty", "tz", "rmsd_before", "rmsd_after"]

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                h = np.array([[r[f"h_{p}{q}"] for q in "xyz"] for p in "xyz"])
                u, s, vt = np.linalg.svd(h)
                flip = np.diag([1.0, 1.0, np.sign(np.linalg.det(u @ vt)) or 1.0])
                rotation = u @ flip @ vt
                ma, mb = (np.array([r[f"m{k}{p}"] for p in "xyz"]) for k in "ab")
                spread = sum(r[f"v{k}{p}"] for k in "ab" for p in "xyz")
                before = spread - 2 * np.trace(h) + ((ma - mb) ** 2).sum()
                after = spread - 2 * (s * np.diag(flip)).sum()
                rows.append((*[r[k] for k in by], *rotation.ravel(), *(mb - ma @ rotation), np.sqrt(max(before, 0)), np.sqrt(max(after, 0))))
            yield pd.DataFrame(rows, columns=[*by, *names])

    return alignment_sums(pairs, by).mapInPandas(run, f"{keys}, " + ", ".join(f"{n} double" for n in names))
