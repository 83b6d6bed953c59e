"""Aggregations: occupancy, dynamics, densities, descriptions of series, profile integrals, network metrics."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.joins import small
from gridloom.operators.ranks import joined, quantiles


def ordered_pairs(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"a": F.least("source", "target"), "b": F.greatest("source", "target")})


def persistent_edges(edges: DataFrame, nodes: DataFrame, min_occupancy: float = 0.5) -> DataFrame:
    """Edges (frame, source, target, kind, distance) that hold in enough of the frames that have both nodes.

    In a frame only the closest edge of a pair counts. The kind is the most frequent one, then the first by name.
    ``nodes``: (frame, node).
    """
    order = Window.partitionBy("frame", "a", "b").orderBy("distance", "kind")
    contact = ordered_pairs(edges).withColumn("_n", F.row_number().over(order)).where("_n = 1")
    kinds = contact.groupBy("a", "b", "kind").agg(F.count("*").alias("n"))
    top = kinds.groupBy("a", "b").agg(F.min(F.struct((-F.col("n")).alias("n"), "kind")).alias("top"))
    total = contact.groupBy("a", "b").agg(F.count("*").alias("contact_frames"), F.avg("distance").alias("mean_distance"))
    seen = nodes.distinct()
    eligible = total.join(seen.withColumnRenamed("node", "a"), "a").join(seen.withColumnRenamed("node", "b"), ["b", "frame"]).groupBy("a", "b").agg(F.count("*").alias("eligible_frames"))
    out = total.join(eligible, ["a", "b"]).join(top, ["a", "b"]).withColumn("occupancy", F.col("contact_frames") / F.col("eligible_frames"))
    return out.where(F.col("occupancy") >= min_occupancy).select(F.col("a").alias("source"), F.col("b").alias("target"), "contact_frames", "eligible_frames", "occupancy", F.col("top.kind").alias("kind"), "mean_distance")


def occupancy_all_frames(rows: DataFrame, by: list[str], frames: int, value: str) -> DataFrame:
    """Frames with a row, mean rows a frame that has one, and least value; the denominator is all frames."""
    each = rows.groupBy(*by, "frame").agg(F.count("*").alias("n"), F.min(value).alias("least"))
    return each.groupBy(*by).agg(F.count("*").alias("frames"), (F.count("*") / F.lit(frames)).alias("occupancy"), F.avg("n").alias("mean_count"), F.min("least").alias("min_value"))


def residue_dynamics(frames: DataFrame) -> DataFrame:
    """Mean position and root-mean-square fluctuation of each node (frame, node, x, y, z); every node in every frame."""
    mean = frames.groupBy("node").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("z").alias("mz"))
    off = frames.join(mean, "node").withColumn("d2", sum(((F.col(a) - F.col(f"m{a}")) * (F.col(a) - F.col(f"m{a}")) for a in "xyz"), F.lit(0.0)))
    return off.groupBy("node").agg(F.count("*").alias("frames"), F.sqrt(F.avg("d2")).alias("rmsf"))


def cross_correlation(frames: DataFrame) -> DataFrame:
    """Correlation of displacements of each pair of nodes (one row a frame and node), clipped; null with under 3 frames or no variance.

    Every two nodes that share a frame give a row: as many as nodes squared. Nodes travel in blocks, and sums over shared frames
    are matrix products of two blocks, so that no row is made for a pair's frames.
    """
    from gridloom.operators import blocks as B

    frames = frames.where("frame IS NOT NULL AND node IS NOT NULL")
    mean = frames.groupBy("node").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("z").alias("mz"))
    off = frames.join(mean, "node").select("frame", "node", *[(F.col(a) - F.col(f"m{a}")).alias(f"d{a}") for a in "xyz"])
    each = off.groupBy("node").agg(F.collect_list(F.struct("frame", "dx", "dy", "dz")).alias("path"))
    each = each.select("node", *[F.col(f"path.{c}").alias(c) for c in ("frame", "dx", "dy", "dz")])
    longest = each.agg(F.max(F.size("frame"))).first()[0] or 1
    size = max(32, min(B.BLOCK_ROWS, (1 << 18) // longest))
    kind = frames.schema["node"].dataType.simpleString()

    def kernel(a, b, same):
        turns = np.unique(np.concatenate([t.column("frame").combine_chunks().flatten().to_numpy(zero_copy_only=False) for t in (a, b)]))

        def spread(t):
            """Of each node and frame: there, with a displacement, the displacement."""
            at = t.column("frame").combine_chunks()
            row = np.repeat(np.arange(len(at)), np.diff(at.offsets.to_numpy()))
            col = np.searchsorted(turns, at.flatten().to_numpy(zero_copy_only=False))
            d = np.stack([t.column(f"d{c}").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float) for c in "xyz"], -1)
            null = np.any([t.column(f"d{c}").combine_chunks().flatten().is_null().to_numpy(zero_copy_only=False) for c in "xyz"], 0)
            there, value, full = np.zeros((len(at), len(turns))), np.zeros((len(at), len(turns))), np.zeros((len(at), len(turns), 3))
            there[row, col], value[row, col] = 1, ~null
            bad = np.zeros_like(there)
            bad[row, col] = ~null & ~np.isfinite(d).all(-1)
            full[row, col] = np.where((~null & np.isfinite(d).all(-1))[:, None], d, 0)
            return there, value, full, bad

        (pa_, va, da, xa), (pb, vb, db, xb) = spread(a), spread(b)
        sa, sb, da, db = (da * da).sum(-1), (db * db).sum(-1), da.reshape(len(da), -1), db.reshape(len(db), -1)
        odd = xa.any() or xb.any()
        na, nb = (t.column("node").combine_chunks() for t in (a, b))
        left, right = (n.to_numpy(zero_copy_only=False) for n in (na, nb))
        for rows in B.strips(len(left), len(right)):
            shared = pa_[rows] @ pb.T
            with np.errstate(all="ignore"):
                ab = da[rows] @ db.T / (va[rows] @ vb.T)
                aa, bb = sa[rows] @ pb.T / (va[rows] @ pb.T), pa_[rows] @ sb.T / (pa_[rows] @ vb.T)
                if odd:  # what is no number makes the sum none, which SQL takes for more than 1
                    one, two = xa[rows] @ pb.T > 0, pa_[rows] @ xb.T > 0
                    aa[one], bb[two], ab[xa[rows] @ vb.T + va[rows] @ xb.T > 0] = np.inf, np.inf, np.nan
                got = np.fmax(-1.0, np.fmin(1.0, ab / np.sqrt(aa * bb)))
            # a mean of nothing is null, and so is what comes of it
            none = (shared < 3) | ~(aa >= 1e-12) | ~(bb >= 1e-12) | (va[rows] @ vb.T == 0)
            i, j = np.nonzero((shared > 0) & (left[rows, None] != right[None, :]) & ((left[rows, None] < right[None, :]) | (not same)))
            if not len(i):
                continue
            low = left[rows][i] < right[j]
            first, second = np.where(low, left[rows][i], right[j]), np.where(low, right[j], left[rows][i])
            yield pa.RecordBatch.from_arrays([pa.array(first, na.type), pa.array(second, na.type), pa.array(shared[i, j].astype("int64")), pa.array(got[i, j], mask=none[i, j])], ["a", "b", "frames", "correlation"])

    return B.over_pairs(B.near_block_pairs(B.in_blocks(each, [], "node", size), []), kernel, f"a {kind}, b {kind}, frames long, correlation double")


def circular(rows: DataFrame, by: list[str], angle: str) -> DataFrame:
    """Circular mean in degrees and resultant length; the mean is null when the length is at most 1e-8."""
    out = rows.groupBy(*by).agg(F.count(angle).alias("n"), F.avg(F.sin(F.radians(angle))).alias("_s"), F.avg(F.cos(F.radians(angle))).alias("_c"))
    length = F.sqrt(F.col("_s") * F.col("_s") + F.col("_c") * F.col("_c"))
    return out.select(*by, "n", F.when(length > 1e-8, F.degrees(F.atan2("_s", "_c"))).alias("mean_angle"), length.alias("resultant"))


def density(rows: DataFrame, axes: dict[str, tuple[float, float]], frames: int) -> DataFrame:
    """Counts, density and occupancy of lattice cells: ``axes`` gives each axis its edge and cell width."""
    cell = {f"c_{a}": F.floor((F.col(a) - edge) / width).cast("long") for a, (edge, width) in axes.items()}
    volume = math.prod(width for _, width in axes.values())
    out = rows.withColumns(cell).groupBy(*cell).agg(F.count("*").alias("n"), F.countDistinct("frame").alias("occupied"))
    return out.withColumns({"density": F.col("n") / F.lit(frames * volume), "occupancy": F.col("occupied") / F.lit(float(frames))})


def describe(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Rows, observed, missing, coverage, mean, sample deviation, quantiles (linear) and extremes of each series."""
    v = F.col(value)
    shares = quantiles(rows, by, value, {"median": 0.5, "q025": 0.025, "q975": 0.975})
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count(v).alias("observed"),
        (F.count("*") - F.count(v)).alias("missing"),
        (F.count(v) / F.count("*")).alias("coverage"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("sd"),
        F.min(v).alias("min_value"),
        F.max(v).alias("max_value"),
    )
    return joined(out, shares, by, "left").select(*by, "n", "observed", "missing", "coverage", "mean", "sd", "median", "q025", "q975", "min_value", "max_value")


def halves(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Means of the first n // 2 rows of each series and of the rest."""
    w = Window.partitionBy(*by)
    half = rows.withColumns({"_i": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w)}).withColumn("_first", F.col("_i") < F.floor(F.col("_n") / 2))
    return half.groupBy(*by).agg(F.avg(F.when(F.col("_first"), F.col(value))).alias("first_half"), F.avg(F.when(~F.col("_first"), F.col(value))).alias("second_half"))


def profile_summary(profile: DataFrame, by: list[str]) -> DataFrame:
    """Least and mean radius, its place, length along s, and volume by trapezoids of circular sections."""
    w = Window.partitionBy(*by).orderBy("i")
    nxt = profile.withColumns({"_s": F.lead("s").over(w), "_r": F.lead("r").over(w)}).withColumn("_d", F.abs(F.col("_s") - F.col("s")))
    section = F.lit(math.pi) * (F.col("r") * F.col("r") + F.col("_r") * F.col("_r")) / 2 * F.col("_d")
    out = nxt.groupBy(*by).agg(F.count("*").alias("points"), F.min("r").alias("min_radius"), F.avg("r").alias("mean_radius"), F.min(F.struct("r", "i")).alias("_b"), F.coalesce(F.sum("_d"), F.lit(0.0)).alias("length"), F.coalesce(F.sum(section), F.lit(0.0)).alias("volume"))
    return out.withColumn("bottleneck", F.col("_b.i")).drop("_b")


#: Fixed value: what the geometric conductance is divided by to meet measured ones.
EMPIRICAL_DIVISOR = 5.594


def resistance(profile: DataFrame, by: list[str], resistivity: float = 1.0) -> DataFrame:
    """Integral of 1 / (pi r^2) by trapezoids, and conductances: geometric, with access terms, and geometric corrected.

    Where a radius is not positive the profile is occluded: it has no integral and conducts nothing.
    """
    w = Window.partitionBy(*by).orderBy("i")
    inverse = lambda r: 1 / (F.lit(math.pi) * F.col(r) * F.col(r))
    nxt = profile.withColumns({"_s": F.lead("s").over(w), "_r": F.lead("r").over(w)})
    step = F.when(F.col("_s").isNotNull() & (F.col("r") > 0) & (F.col("_r") > 0), (inverse("r") + inverse("_r")) / 2 * F.abs(F.col("_s") - F.col("s")))
    out = nxt.groupBy(*by).agg((F.min("r") <= 0).alias("occluded"), F.coalesce(F.sum(step), F.lit(0.0)).alias("integral"), F.min(F.struct("i", "r")).alias("_a"), F.max(F.struct("i", "r")).alias("_z"))
    access = 1 / (4 * F.col("_a.r")) + 1 / (4 * F.col("_z.r"))
    conducts = lambda resistance_: F.when(F.col("occluded"), 0.0).when(resistance_ > 0, 100 / (F.lit(resistivity) * resistance_))
    return out.select(
        *by,
        "occluded",
        F.when(~F.col("occluded"), F.col("integral")).alias("resistance_integral"),
        conducts(F.col("integral")).alias("geometric"),
        conducts(F.col("integral") + access).alias("conductance"),
        (conducts(F.col("integral")) / EMPIRICAL_DIVISOR).alias("corrected"),
    )


def network_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges and density (2 E / n (n - 1); the denominator is 1 with under two nodes)."""
    n, e = nodes.agg(F.count("*").alias("nodes")), edges.agg(F.count("*").alias("edges"))
    both = n.crossJoin(e)  # one row each
    pairs = F.when(F.col("nodes") < 2, F.lit(1.0)).otherwise(F.col("nodes") * (F.col("nodes") - 1) / 2)
    return both.withColumn("density", F.col("edges") / pairs)


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("source").alias("node")).unionByName(edges.select(F.col("target").alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def top_degrees(edges: DataFrame, k: int = 10) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "node").limit(k)


def group_matrix(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges between different groups: count and summed weight of each unordered pair. ``groups``: (node, grp)."""
    g = small(groups)
    both = edges.join(g.select(F.col("node").alias("source"), F.col("grp").alias("ga")), "source").join(g.select(F.col("node").alias("target"), F.col("grp").alias("gb")), "target")
    return both.where("ga <> gb").groupBy(F.least("ga", "gb").alias("group_a"), F.greatest("ga", "gb").alias("group_b")).agg(F.count("*").alias("edges"), F.sum("weight").alias("strength"))


def jaccard_matrix(sets: DataFrame) -> DataFrame:
    """Jaccard of the members of each pair of sets (grp, member); every pair that shares a member."""
    size = sets.groupBy("grp").agg(F.count("*").alias("n"))
    a, b = sets.withColumnRenamed("grp", "a"), sets.withColumnRenamed("grp", "b")
    shared = a.join(b, "member").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    both = shared.join(size.select(F.col("grp").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("grp").alias("b"), F.col("n").alias("nb")), "b")
    return both.select("a", "b", "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"))


def free_energy(rows: DataFrame, width: float, low: float, high: float, edge: float, blocks: int = 0, level: float = 0.95) -> DataFrame:
    """-ln of the count of each bin over the mean count of the bins within ``edge`` of either end, empty ones included.

    With ``blocks`` (rows then have a ``block`` from 0 and each block as many frames) a Student interval from the blocks' own
    energies, where every block has rows in the bin and in the bins at the ends.
    """
    from gridloom.operators.estimators import t_quantile

    bins = round((high - low) / width)
    outer = [i for i in range(bins) if min(abs(low + (i + 0.5) * width - low), abs(low + (i + 0.5) * width - high)) <= edge]
    own = F.floor((F.col("s") - low) / width).cast("long")
    by = ["block"] if blocks else []
    at_end = lambda n: F.sum(F.when(F.col("bin").isin(*outer), F.col(n)))
    each = rows.where((F.col("s") >= low) & (F.col("s") < high)).groupBy(own.alias("bin"), *by).agg(F.count("*").alias("m"))
    counts = each.groupBy("bin").agg(F.sum("m").alias("n"))
    reference = F.broadcast(counts.agg((at_end("n") / len(outer)).alias("reference")))  # one row
    centre = F.lit(low) + (F.col("bin") + 0.5) * width
    out = counts.crossJoin(reference).select("bin", "n", centre.alias("centre"), (-F.log(F.col("n") / F.col("reference"))).alias("energy"))
    if not blocks:
        return out
    # a row for each block
    ends = F.broadcast(each.groupBy("block").agg((at_end("m") / len(outer)).alias("reference")))
    spread = each.join(ends, "block").withColumn("g", -F.log(F.col("m") / F.col("reference"))).groupBy("bin").agg(F.count("g").alias("_k"), F.stddev_samp("g").alias("_sd"))
    half = F.when(F.col("_k") == blocks, F.lit(t_quantile((1 + level) / 2, blocks - 1)) * F.col("_sd") / math.sqrt(blocks))
    return out.join(spread, "bin", "left").select("bin", "n", "centre", "energy", (F.col("energy") - half).alias("low"), (F.col("energy") + half).alias("high"))


def run_variants(variants: dict[str, dict], compute) -> DataFrame:
    """What ``compute(**overrides)`` gives (quantity, value) for each named set of overrides, with the variant's name.

    Each is a plan of its own; nothing runs before the whole is asked for.
    """
    out = None
    for name, overrides in variants.items():
        one = compute(**overrides).select(F.lit(name).alias("variant"), "quantity", F.col("value").cast("double").alias("value"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no variant is named")
    return out


def spread(variants: DataFrame, baseline: str) -> DataFrame:
    """Range of each quantity over variants (variant, quantity, value), absolute and relative to the baseline's value."""
    out = variants.groupBy("quantity").agg(F.min("value").alias("least"), F.max("value").alias("greatest"), F.max(F.when(F.col("variant") == baseline, F.col("value"))).alias("base"), F.count("value").alias("runs"))
    return out.withColumn("range", F.col("greatest") - F.col("least")).withColumn("relative_percent", F.when(F.col("base") != 0, 100 * F.col("range") / F.abs("base")))


def features(profile: DataFrame, by: list[str], narrow: float) -> DataFrame:
    """Radius features of each profile, with population variance."""
    r = F.col("r")
    return profile.groupBy(*by).agg(F.min("r").alias("r_min"), F.max("r").alias("r_max"), F.avg("r").alias("r_mean"), F.var_pop("r").alias("r_var"), (F.sum((r < narrow).cast("long")) / F.greatest(F.count("*"), F.lit(1))).alias("narrow_fraction"))


def bounding_box(points: DataFrame, by: list[str]) -> DataFrame:
    return points.groupBy(*by).agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for f, n in ((F.min, "min"), (F.max, "max"), (F.avg, "mean"))])


def covariance(points: DataFrame, by: list[str]) -> DataFrame:
    """Population covariance of coordinates, from which principal axes follow."""
    return points.groupBy(*by).agg(*[F.covar_pop(a, b).alias(f"c_{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")])


def principal_axes(points: DataFrame, by: list[str]) -> DataFrame:
    """Eigenvalues and eigenvectors of each group's covariance, the largest first; first non-zero component positive."""
    import numpy as np
    import pandas as pd

    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.select(*by).schema.fields)

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                m = np.array([[r.c_xx, r.c_xy, r.c_xz], [r.c_xy, r.c_yy, r.c_yz], [r.c_xz, r.c_yz, r.c_zz]])
                values, vectors = np.linalg.eigh(m)
                for n, k in enumerate((2, 1, 0)):
                    v = vectors[:, k] * (1 if next((c for c in vectors[:, k] if abs(c) > 1e-12), 1) > 0 else -1)
                    rows.append((*[getattr(r, b) for b in by], n, float(values[k]), *map(float, v)))
            yield pd.DataFrame(rows, columns=[*by, "axis", "variance", "x", "y", "z"])

    return covariance(points, by).mapInPandas(run, f"{keys}, axis int, variance double, x double, y double, z double")


def exposed_area(spheres: DataFrame, probe: float, directions: int = 256) -> DataFrame:
    """Area of each sphere, swollen by a probe, that no other swollen sphere covers, by points on a golden spiral."""
    from gridloom.operators.joins import range_join

    big = spheres.withColumn("r", F.col("r") + probe)
    most = big.agg(F.max("r")).first()[0] or 0.0
    near = range_join(big, big, 2 * most).where((F.col("l_id") != F.col("r_id")) & (F.col("distance") < F.col("l_r") + F.col("r_r")))
    near = near.select(F.col("l_id").alias("id"), *[(F.col(f"r_{a}") - F.col(f"l_{a}")).alias(f"v{a}") for a in "xyz"], F.col("l_r").alias("ri"), F.col("r_r").alias("rj"))
    k = F.col("k") + F.lit(0.5)
    z = 1 - 2 * k / directions
    turn = F.lit(math.pi * (1 + 5**0.5)) * k
    ring = F.sqrt(1 - z * z)
    spiral = F.broadcast(spheres.sparkSession.range(directions).withColumnRenamed("id", "k").select("k", (ring * F.cos(turn)).alias("dx"), (ring * F.sin(turn)).alias("dy"), z.alias("dz")))  # a fixed number of rows
    dot = F.col("dx") * F.col("vx") + F.col("dy") * F.col("vy") + F.col("dz") * F.col("vz")
    limit = (F.col("ri") * F.col("ri") + F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy") + F.col("vz") * F.col("vz") - F.col("rj") * F.col("rj")) / (2 * F.col("ri"))
    hidden = near.join(spiral, dot > limit + 1e-10).select("id", "k").distinct().groupBy("id").agg(F.count("*").alias("hidden"))
    out = big.join(hidden, "id", "left").withColumn("hidden", F.coalesce("hidden", F.lit(0)))
    return out.select("id", "grp", "hidden", ((directions - F.col("hidden")) / directions * 4 * math.pi * F.col("r") * F.col("r")).alias("area"))


def selected_with_reason(components: DataFrame, least: float, most: float, limit: int) -> DataFrame:
    """Every component (comp, volume) with the decision on it: bounds first (inclusive), then the largest ``limit``."""
    size = F.when(F.col("volume") < least, "below_min_volume").when(F.col("volume") > most, "above_max_volume")
    rank = F.row_number().over(Window.partitionBy(F.col("reason").isNull()).orderBy(F.desc("volume"), "comp"))
    return components.withColumn("reason", size).withColumn("_rank", rank).withColumn("decision", F.coalesce("reason", F.when(F.col("_rank") <= limit, "selected").otherwise("component_limit"))).drop("reason", "_rank")


def even_sample(rows: DataFrame, by: list[str], order: str, value: str, count: int) -> DataFrame:
    """``count`` evenly spaced rows of each series, and the row of the least value."""
    w = Window.partitionBy(*by)
    out = rows.withColumns({"_i": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w), "_m": F.row_number().over(w.orderBy(value, order))})
    places = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda j: F.rint(j * (F.col("_n") - 1) / (count - 1)).cast("int"))
    return out.where(F.array_contains(places, F.col("_i").cast("int")) | (F.col("_m") == 1)).drop("_i", "_n", "_m")
