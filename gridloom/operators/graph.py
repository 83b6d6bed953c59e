"""Graphs and lattices: components, shortest and widest paths, floods, enclosure.

Loops run on the driver over DataFrames; each round is written to the shared folder, so that plans stay short and a lost
executor costs a round at most. Only counts come to the driver.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.store import keep
from gridloom.operators.joins import finite, first_reach, nearest_surface, range_join


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, comp) of every node: comp is the least node that it is connected with.

    ``edges``: (a, b). Each round takes the least label around, then the label's own label (pointer jumping), so rounds grow with
    the logarithm of the longest chain in usual graphs.
    """
    both = keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = keep(nodes.select("node", F.col("node").alias("comp")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("least"))
        step = labels.join(around, "node", "left").select("node", F.least("comp", F.coalesce("least", "comp")).alias("next"), "comp")
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("up"))
        new = keep(step.join(jump, "next", "left").select("node", F.least("next", F.coalesce("up", "next")).alias("comp"), (F.least("next", F.coalesce("up", "next")) != F.col("comp")).alias("moved")), "labels")
        if new.where("moved").isEmpty():
            return new.select("node", "comp")
        labels = new.select("node", "comp")


def point_components(points: DataFrame, reach: float) -> DataFrame:
    """(node, comp) of points (id, x, y, z), those no farther apart than ``reach`` being linked; comp is the least id.

    Links within a small reach are taken first. A longer one joins something only if its ends are still parted, so at twice the
    reach only points outside the largest component look around, and so on: where points lie dense most links are never made.
    """
    points = keep(points.select("id", "x", "y", "z").where(F.col("id").isNotNull()), "points")
    placed = points.where(finite())
    at = first_reach(placed, placed, reach)
    near = range_join(placed, placed, at).where("l_id < r_id").select(F.col("l_id").alias("a"), F.col("r_id").alias("b"))
    labels = components(points.select(F.col("id").alias("node")), near)
    while at < reach:
        at = min(2 * at, reach)
        first = labels.groupBy("comp").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "comp").first()
        if first is None:
            break
        named = keep(placed.join(labels.select(F.col("node").alias("id"), "comp"), "id"), "named")
        rest = named.where(F.col("comp") != first.comp)
        if rest.isEmpty():
            break
        links = range_join(named, rest, at).where("l_comp <> r_comp").select(F.least("l_comp", "r_comp").alias("a"), F.greatest("l_comp", "r_comp").alias("b")).distinct()
        joined = components(labels.select(F.col("comp").alias("node")).distinct(), links).select(F.col("node").alias("comp"), F.col("comp").alias("least"))
        labels = keep(labels.join(joined, "comp").select("node", F.col("least").alias("comp")), "labels")
    return labels


def near_edges(points: DataFrame, sources: DataFrame, reach: float) -> DataFrame:
    """Of the pairs (a, b, distance) of points within ``reach`` all that a widest path from the sources may follow.

    Nodes that short edges connect with a source have a path of short edges, and none longer can be a widest one to them: at twice
    the reach only nodes not connected so far look around, until all are or the reach is met.
    """
    points = keep(points.where(finite()).select("id", "x", "y", "z"), "points")
    at, left, out = first_reach(points, points, reach), points, None
    while True:
        new = range_join(points, left, at).where("l_id <> r_id").select(F.least("l_id", "r_id").alias("a"), F.greatest("l_id", "r_id").alias("b"), "distance").distinct()
        out = keep(new if out is None else out.unionByName(new).distinct(), "near")
        if at >= reach:
            return out
        labels = components(points.select(F.col("id").alias("node")), out)
        known = labels.join(labels.join(sources.select("node"), "node", "left_semi").select("comp").distinct(), "comp", "left_semi").select(F.col("node").alias("id"))
        left = keep(points.join(known, "id", "left_anti"), "left")
        if left.isEmpty():
            return out
        at = min(2 * at, reach)


def ranked_components(labels: DataFrame, least: int = 1, limit: int | None = None) -> DataFrame:
    """Components by size, larger first, then by least node; the size filter comes before the limit."""
    size = labels.groupBy("comp").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    return size.orderBy(F.desc("size"), "comp").limit(limit) if limit else size


def shortest_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, cost, hops, origin): least cost from any source, over undirected edges (a, b, weight) of cost 1 / weight.

    Edges of no weight are left out; of parallel edges the heaviest counts. Ties go to fewer hops, then the lower origin.
    """
    heavy = edges.where("weight > 0").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("weight").alias("weight"))
    both = keep(heavy.unionByName(heavy.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")).select("a", "b", (1 / F.col("weight")).alias("step")), "edges")
    best = keep(sources.select("node", F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.col("node").alias("origin"), F.lit(True).alias("moved")), "costs")
    while not best.where("moved").isEmpty():
        tried = best.where("moved").join(both, F.col("node") == F.col("a")).select(F.col("b").alias("node"), (F.col("cost") + F.col("step")).alias("cost"), (F.col("hops") + 1).alias("hops"), "origin", F.lit(True).alias("moved"))
        old = best.withColumn("moved", F.lit(False))
        # a new value wins only if it is less, so that equal ones don't go round
        best = keep(old.unionByName(tried).groupBy("node").agg(F.min(F.struct("cost", "hops", "origin", "moved")).alias("v")).select("node", "v.*"), "costs")
    return best.drop("moved")


def widest_paths(edges: DataFrame, sources: DataFrame, width: str = "width", length: str | None = None) -> DataFrame:
    """(node, width, length, hops): the greatest least width of a path from any source, over undirected edges; of equal ones the shortest.

    ``length`` names the edges' lengths; without it every edge has length 1. A path goes on from a node's own widest path: ties are
    broken among these.
    """
    own = F.col(length) if length else F.lit(1.0)
    both = edges.select("a", "b", F.col(width).alias("_w"), own.cast("double").alias("_l"))
    both = keep(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "_w", "_l")), "edges")
    start = sources.select("node", F.lit(float("inf")).alias("wide"), F.lit(0.0).alias("far"), F.lit(0).alias("hops"), F.lit(True).alias("moved"))
    best = keep(start, "widths")
    # first the widths alone, then lengths over the edges that keep each node's width
    while not best.where("moved").isEmpty():
        tried = best.where("moved").join(both, F.col("node") == F.col("a")).select(F.col("b").alias("node"), F.least("wide", "_w").alias("wide"), F.lit(True).alias("moved"))
        old = best.select("node", "wide", F.lit(False).alias("moved"))
        best = old.unionByName(tried).groupBy("node").agg(F.min(F.struct((-F.col("wide")).alias("neg"), "moved")).alias("v"))
        best = keep(best.select("node", (-F.col("v.neg")).alias("wide"), "v.moved"), "widths")
    widths = keep(best.select("node", "wide"), "widest")
    # an edge is followed where it hands on the width that its end has: a wider node's own widest path comes first
    ends = both.join(widths.select(F.col("node").alias("a"), F.col("wide").alias("_wa")), "a").join(widths.select(F.col("node").alias("b"), F.col("wide").alias("_wb")), "b")
    tight = keep(ends.where(F.least("_wa", "_w") == F.col("_wb")).select("a", "b", "_l"), "tight")
    paths = keep(start.select("node", "far", "hops", "moved"), "lengths")
    while not paths.where("moved").isEmpty():
        tried = paths.where("moved").join(tight, F.col("node") == F.col("a")).select(F.col("b").alias("node"), (F.col("far") + F.col("_l")).alias("far"), (F.col("hops") + 1).alias("hops"), F.lit(True).alias("moved"))
        old = paths.withColumn("moved", F.lit(False))
        paths = keep(old.unionByName(tried).groupBy("node").agg(F.min(F.struct("far", "hops", "moved")).alias("v")).select("node", "v.*"), "lengths")
    return paths.join(widths, "node").select("node", F.col("wide").alias("width"), F.col("far").alias("length"), "hops")


def distinct_routes(routes: DataFrame, by: list[str], order: list[Column], separation: float, most: int) -> DataFrame:
    """Routes (with x, y, z of their ends) taken greedily by rank, each farther than ``separation`` from those taken."""
    import pandas as pd

    ranked = routes.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))

    def take(pdf):
        kept = []
        for row in pdf.sort_values("_rank").itertuples(index=False):
            if len(kept) < most and all((row.x - o.x) ** 2 + (row.y - o.y) ** 2 + (row.z - o.z) ** 2 > separation**2 for o in kept):
                kept.append(row)
        return pd.DataFrame(kept, columns=pdf.columns)

    return ranked.groupBy(*by).applyInPandas(take, ranked.schema).drop("_rank")


# ------------------------------------------------------------------- lattice


def lattice(spark, low: tuple, high: tuple, spacing: float, most: int = 16_000_000, cover: bool = False) -> DataFrame:
    """Nodes (id, i, j, k, x, y, z) of a regular lattice; more than ``most`` nodes are refused.

    The last node of an axis is the last within the box, or with ``cover`` the first at or beyond its end.
    """
    import math

    n = [max(2, (math.ceil((b - a) / spacing - 1e-9) if cover else math.floor((b - a) / spacing + 1e-9)) + 1) for a, b in zip(low, high, strict=True)]
    if math.prod(n) > most:
        raise ValueError(f"{math.prod(n)} lattice nodes are more than {most}")
    ids = spark.range(math.prod(n))
    k, j, i = F.col("id") % n[2], F.floor(F.col("id") / n[2]) % n[1], F.floor(F.col("id") / (n[1] * n[2]))
    out = ids.select("id", i.cast("long").alias("i"), j.cast("long").alias("j"), k.cast("long").alias("k"))
    return out.select("*", *[(F.lit(a) + F.col(c) * F.lit(spacing)).alias(p) for a, c, p in zip(low, "ijk", "xyz", strict=True)], (F.greatest(*[(F.col(c) == 0).cast("int") for c in "ijk"], *[(F.col(c) == m - 1).cast("int") for c, m in zip("ijk", n, strict=True)]) == 1).alias("boundary"))


def coarser(count: int, most: int, spacing: float) -> float:
    """The spacing that brings a lattice of ``count`` nodes down to ``most``."""
    return spacing if count <= most else spacing * (count / most) ** (1 / 3)


def clearance_field(nodes: DataFrame, spheres: DataFrame, reach: float) -> DataFrame:
    return nodes.join(nearest_surface(nodes.select("id", "x", "y", "z"), spheres, reach).select("id", "clearance"), "id")


def neighbours(nodes: DataFrame, faces_only: bool = False) -> DataFrame:
    """Pairs (a, b), a < b, of lattice nodes that touch: by faces, or also by edges and corners."""
    steps = [d for d in product((-1, 0, 1), repeat=3) if d > (0, 0, 0) and (not faces_only or sum(map(abs, d)) == 1)]
    step = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip("xyz", d, strict=True)]) for d in steps])
    moved = nodes.select(F.col("id").alias("a"), "i", "j", "k", F.explode(step).alias("d")).select("a", *[(F.col(c) + F.col(f"d.{p}")).alias(c) for c, p in zip("ijk", "xyz", strict=True)])
    return moved.join(nodes.select(F.col("id").alias("b"), "i", "j", "k"), ["i", "j", "k"]).select("a", "b")


def free_components(field: DataFrame, probe: float, faces_only: bool = False) -> DataFrame:
    """Nodes whose clearance is at least ``probe``, with their component and whether it touches the boundary."""
    free = keep(field.where(F.col("clearance") >= probe), "free")
    labels = components(free.select(F.col("id").alias("node")), neighbours(free, faces_only))
    out = free.join(labels.select(F.col("node").alias("id"), "comp"), "id")
    return out.withColumn("exterior", F.max("boundary").over(Window.partitionBy("comp")))


def void_volumes(field: DataFrame, probe: float, spacing: float, enclosed: bool = True) -> DataFrame:
    """Components, or only the enclosed ones: nodes, volume, centre, the widest clearance, whether they touch the boundary."""
    inner = free_components(field, probe)
    if enclosed:
        inner = inner.where("NOT exterior")
    return inner.groupBy("comp").agg(F.max("exterior").alias("exterior"), F.count("*").alias("nodes"), (F.count("*") * F.lit(spacing**3)).alias("volume"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"), F.max("clearance").alias("radius"))


def sections(field: DataFrame, probe: float, spacing: float) -> DataFrame:
    """For each plane k: free cells, area and the diameter of a circle of that area, and the widest clearance."""
    import math

    plane = field.where(F.col("clearance") >= probe).groupBy("k").agg(F.count("*").alias("cells"), F.max("clearance").alias("widest"))
    area = F.col("cells") * F.lit(spacing**2)
    return plane.select("k", "cells", area.alias("area"), (2 * F.sqrt(area / math.pi)).alias("diameter"), "widest")


def enclosure(field: DataFrame, probe: float) -> DataFrame:
    """For each free node the number of the 26 lattice rays that meet a node that is not free.

    Rays of one direction are lines of the lattice; along each, a window tells whether a blocked node lies ahead.
    """
    nodes = field.select("id", "i", "j", "k", (F.col("clearance") < probe).cast("int").alias("blocked"))
    lines = [d for d in product((-1, 0, 1), repeat=3) if d > (0, 0, 0)]
    total = F.lit(0)
    for n, (u, v, w) in enumerate(lines):
        axis = "i" if u else "j" if v else "k"
        along = F.col(axis)
        # what stays the same along a line
        line = [F.col("i") - u * along, F.col("j") - v * along, F.col("k") - w * along]
        ahead = Window.partitionBy(*line).orderBy(axis)
        for m, frame in enumerate((ahead.rowsBetween(1, Window.unboundedFollowing), ahead.rowsBetween(Window.unboundedPreceding, -1))):
            nodes = nodes.withColumn(f"h{n}_{m}", F.coalesce(F.max("blocked").over(frame), F.lit(0)))
            total = total + F.col(f"h{n}_{m}")
    return nodes.where("blocked = 0").select("id", total.alias("hits"))


def octants(samples: DataFrame, points: DataFrame, reach: float) -> DataFrame:
    """For each sample the number of sign octants with a point within ``reach``; zero counts as positive."""
    pairs = range_join(points, samples, reach)
    octant = sum(((F.col(f"l_{a}") - F.col(f"r_{a}") >= 0).cast("int") * (1 << n) for n, a in enumerate("xyz")), F.lit(0))
    return pairs.groupBy(F.col("r_id").alias("id")).agg(F.countDistinct(octant).alias("octants"))


def local_clustering(edges: DataFrame) -> DataFrame:
    """Triangles of each node of an undirected graph (a < b)."""
    e = edges.select("a", "b").distinct()
    two = e.join(e.select(F.col("a").alias("b"), F.col("b").alias("c")), "b")
    full = two.join(e.select("a", F.col("b").alias("c")), ["a", "c"])
    return full.select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
