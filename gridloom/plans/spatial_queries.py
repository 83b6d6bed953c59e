"""Queries on points, sets and profiles, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.functions import expr as E
from gridloom.operators import aggregates as A
from gridloom.operators import joins as J
from gridloom.sources import tables as T

REACH = 0.05
DIST = "sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))"


def _r(name, digits=9):
    return F.round(name, digits).alias(name)


def _points(spark, d):
    return T.points(spark, d)


def _contacts(spark, d):
    return J.closest_contacts(_points(spark, d), REACH)


CONTACT_SQL = f"""{T.POINTS_SQL},
pairs AS (SELECT a.id AS ia, b.id AS ib, least(a.grp, b.grp) AS source, greatest(a.grp, b.grp) AS target, {DIST} AS m
  FROM points a JOIN points b ON a.id < b.id AND a.grp <> b.grp WHERE {DIST} <= {REACH}),
net AS (SELECT source, target, m AS distance, ia AS id_a, ib AS id_b, 1 / (1 + greatest(m, 0)) AS weight
  FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY m, ia, ib) AS n FROM pairs) WHERE n = 1)"""


def contact_network(spark, d):
    """Closest pair of points of each two groups within the cutoff."""
    return _contacts(spark, d).select("source", "target", "id_a", "id_b", _r("distance"), _r("weight"))


def contact_degrees(spark, d):
    """Degree of each group in the contact network, the ten highest."""
    return A.top_degrees(_contacts(spark, d))


def contact_surface(spark, d):
    """Closest surfaces of each two groups within the cutoff."""
    return J.closest_contacts(_points(spark, d), 0.03, "surface").select("source", "target", "id_a", "id_b", _r("distance"))


def contact_metrics(spark, d):
    p = _points(spark, d)
    return A.network_metrics(p.select("grp").distinct(), _contacts(spark, d)).select("nodes", "edges", _r("density"))


def distance_pairs(spark, d):
    """Pairs of plain points and marked ones within a distance."""
    p = _points(spark, d)
    return J.range_join(p.where("NOT hetero"), p.where("hetero"), 0.08).select("l_id", "r_id", _r("distance"))


def periodic_pairs(spark, d):
    """Pairs within a distance in a periodic box."""
    p = _points(spark, d)
    return J.periodic_range_join(p.where("NOT hetero").select("id", "x", "y", "z"), p.where("hetero").select("id", "x", "y", "z"), 0.05, 0.4).select("l_id", "r_id", _r("distance"))


def nearest_surface(spark, d):
    """For each marked point the plain sphere of nearest surface."""
    p = _points(spark, d)
    return J.nearest_surface(p.where("hetero").select("id", "x", "y", "z"), p.where("NOT hetero").select("id", "x", "y", "z", "r"), 0.05).select("id", "nearest", _r("clearance"))


def within_surface(spark, d):
    p = _points(spark, d)
    return J.within_surface(p.where("hetero").select("id", "x", "y", "z"), p.where("NOT hetero").select("id", "x", "y", "z", "r"), 0.05).select("id", "sphere", _r("clearance"))


def segment_clearance(spark, d):
    """Clearance of segments between marked points of following ids in a group."""
    from pyspark.sql import Window

    p = _points(spark, d)
    w = Window.partitionBy("grp").orderBy("id")
    ends = p.where("hetero").select("id", *[F.col(c).alias(f"a{c}") for c in "xyz"], *[F.lead(c).over(w).alias(f"b{c}") for c in "xyz"]).where("bx IS NOT NULL")
    return J.segment_clearances(ends, p.where("NOT hetero").select("id", "x", "y", "z", "r")).select("id", _r("clearance"))


def group_annotation(spark, d):
    """Groups near marked points, with roles and influence."""
    p = _points(spark, d)
    samples = p.where("hetero").select("id", "x", "y", "z", (F.col("r") - 0.03).alias("gap"))
    out = J.annotate_groups(samples, p.where("NOT hetero").select("id", "grp", "x", "y", "z"), 0.06, F.col("r_id") % 3 == 0)
    return out.select("grp", "points", "samples", "role", _r("min_gap"), _r("mean_gap"), _r("influence", 6))


def shared_boundary(spark, d):
    """Shares of marked points among the groups whose spheres are nearest."""
    p = _points(spark, d)
    return J.shared_nearest(p.where("hetero").select("id", "x", "y", "z"), p.where("NOT hetero").select("id", "grp", "x", "y", "z", "r"), 0.1).select("grp", "samples", _r("area"))


def lattice_members(spark, d):
    """Plain points by whether their lattice cell holds a marked point."""
    p = _points(spark, d)
    cells = p.where("hetero").select(*[E.half_up_index(F.col(a) / 0.1).alias(n) for n, a in zip("ijk", "xyz", strict=True)])
    return J.lattice_membership(p.where("NOT hetero"), cells, 0.1).groupBy("grp").agg(F.sum(F.col("inside").cast("long")).alias("inside"), F.count("*").alias("n"))


def voxel_keys(spark, d):
    """Lattice indices by both rules, and the packed key."""
    p = _points(spark, d)
    even = {f"e{a}": E.nearest_even_index(F.col(a) / 0.05) for a in "xyz"}
    return p.withColumns(even | {f"u{a}": E.half_up_index(F.col(a) / 0.05) for a in "xyz"}).select("id", *even, "ux", "uy", "uz", E.packed_key(F.col("ex"), F.col("ey"), F.col("ez")).alias("key"))


def exposed_area(spark, d):
    """Exposed area of spheres, by group."""
    p = _points(spark, d).select("id", "grp", "x", "y", "z", "r")
    return A.exposed_area(p, 0.02, 64).groupBy("grp").agg(F.sum("hidden").alias("hidden"), F.round(F.sum("area"), 6).alias("area"))


def bounding_boxes(spark, d):
    out = A.bounding_box(_points(spark, d), ["grp"])
    return out.select("grp", *[_r(c) for c in out.columns if c != "grp"])


def covariances(spark, d):
    out = A.covariance(_points(spark, d), ["grp"])
    return out.select("grp", *[_r(c) for c in out.columns if c != "grp"])


def principal_axes(spark, d):
    out = A.principal_axes(_points(spark, d), ["grp"])
    return out.select("grp", "axis", *[_r(c, 6) for c in ("variance", "x", "y", "z")])


def rigid_transform(spark, d):
    """Points turned about z by a right angle and shifted, with their distance from where they were."""
    p = _points(spark, d)
    moved = E.transform(E.xyz(), [[F.lit(0.0), F.lit(1.0), F.lit(0.0)], [F.lit(-1.0), F.lit(0.0), F.lit(0.0)], [F.lit(0.0), F.lit(0.0), F.lit(1.0)]], [F.lit(1.0), F.lit(2.0), F.lit(3.0)])
    out = p.select("id", *[m.alias(n) for m, n in zip(moved, ("mx", "my", "mz"), strict=True)], E.distance(moved, E.xyz()).alias("moved"))
    return out.select("id", _r("mx"), _r("my"), _r("mz"), _r("moved"))


def radius_fallback(spark, d):
    """A price for each line item: by part and supplier, else by part, else a default."""
    items = T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    fine = T.table(spark, d, "lineitem").where("l_discount > 0.09").groupBy("l_partkey", "l_suppkey").agg(F.max("l_tax").alias("value"))
    coarse = T.table(spark, d, "part").where("p_size < 20").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("value"))
    return J.first_match(items, [(fine, ["l_partkey", "l_suppkey"]), (coarse, ["l_partkey"])], "value", F.lit(-1.0)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "value")


def matched_split(spark, d):
    """Customers with and without orders: a tally."""
    customers = T.table(spark, d, "customer").withColumnRenamed("c_custkey", "k")
    yes, no = J.split_matched(customers, T.table(spark, d, "orders").select(F.col("o_custkey").alias("k")), ["k"])
    tally = lambda df, name: df.groupBy("c_mktsegment").agg(F.count("*").alias("n")).withColumn("matched", F.lit(name))
    return tally(yes, True).unionByName(tally(no, False))


def paired_years(spark, d):
    """Order value of two segments by year: second less first, with full pairing."""
    customers = J.small(T.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"))
    orders = T.table(spark, d, "orders").join(customers, "o_custkey").select(F.year("o_orderdate").cast("long").alias("year"), "c_mktsegment", "o_totalprice")
    one = lambda s: orders.where(F.col("c_mktsegment") == s).groupBy("year").agg(F.avg("o_totalprice").alias("v"))
    return J.paired(one("BUILDING"), one("MACHINERY"), ["year"], "v").select("year", _r("left_value", 2), _r("right_value", 2), _r("difference", 2))


def price_density(spark, d):
    """Density of line items over price and discount, with occupancy over days."""
    items = T.table(spark, d, "lineitem").select((F.col("l_extendedprice") / 1000).alias("px"), (F.col("l_discount") * 100).alias("pd"), F.to_date("l_shipdate").alias("frame"))
    out = A.density(items, {"px": (0.0, 10.0), "pd": (-0.5, 2.0)}, 1000)
    return out.select("c_px", "c_pd", "n", "occupied", _r("density"), _r("occupancy"))


def set_links(spark, d):
    """Overlap of groups of users of one day with those of the next."""
    return J.overlap_links(T.memberships(spark, d)).select("prev_frame", "cur_frame", "prev", "cur", "overlap", _r("jaccard"), _r("containment"))


def set_jaccard(spark, d):
    """Jaccard of the users of each two days."""
    sets = T.memberships(spark, d).select(F.col("frame").alias("grp"), "member")
    return A.jaccard_matrix(sets).select("a", "b", "shared", _r("jaccard"))


def _edges(spark, d):
    """Edges between event types that a user has on one day: distance is the difference of their least values."""
    e = T.table(spark, d, "events").groupBy(F.to_date("ts").alias("frame"), "user_id", "event_type").agg(F.min("value").alias("v"))
    a = e.select("frame", "user_id", F.col("event_type").alias("source"), F.col("v").alias("va"))
    b = e.select("frame", "user_id", F.col("event_type").alias("target"), F.col("v").alias("vb"))
    both = a.join(b, ["frame", "user_id"]).where("source < target")
    return both.select("frame", "source", "target", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("kind"), F.abs(F.col("va") - F.col("vb")).alias("distance")).where("distance <= 20")


EDGES_SQL = """e AS (SELECT ts::DATE AS frame, user_id, event_type, min(value) AS v FROM events GROUP BY ALL),
edges AS (SELECT a.frame, a.event_type AS source, b.event_type AS target, CASE WHEN a.user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS kind, abs(a.v - b.v) AS distance
  FROM e a JOIN e b ON a.frame = b.frame AND a.user_id = b.user_id AND a.event_type < b.event_type WHERE abs(a.v - b.v) <= 20)"""


def persistent_edges(spark, d):
    edges = _edges(spark, d)
    nodes = T.table(spark, d, "events").select(F.to_date("ts").alias("frame"), F.col("event_type").alias("node"))
    return A.persistent_edges(edges, nodes).select("source", "target", "contact_frames", "eligible_frames", "kind", _r("occupancy"), _r("mean_distance"))


def edge_occupancy(spark, d):
    return A.occupancy_all_frames(_edges(spark, d), ["kind", "source", "target"], 30, "distance").select("kind", "source", "target", "frames", _r("occupancy"), _r("mean_count"), _r("min_value"))


def shared_bridges(spark, d):
    """Suppliers that share a part: pairs and the number of parts."""
    items = T.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("site"), F.col("l_partkey").alias("via"))
    return J.bridges(items, "site", "via")


def group_matrix(spark, d):
    edges = _contacts(spark, d)
    groups = _points(spark, d).select(F.col("grp").alias("node"), (F.col("grp") % 3).alias("grp")).distinct()
    return A.group_matrix(edges, groups).select("group_a", "group_b", "edges", _r("strength"))


def series_description(spark, d):
    out = A.describe(T.series(spark, d), ["kind"], "s")
    return out.select("kind", "n", "observed", "missing", *[_r(c, 6) for c in ("coverage", "mean", "sd", "median", "q025", "q975", "min_value", "max_value")])


def series_halves(spark, d):
    return A.halves(T.series(spark, d), ["key"], "frame", "s").select("key", _r("first_half", 6), _r("second_half", 6))


def circular_values(spark, d):
    s = T.series(spark, d).withColumn("angle", F.col("s") * 3 % 360)
    return A.circular(s, ["kind"], "angle").select("kind", "n", _r("mean_angle", 6), _r("resultant", 6))


def profile_summary(spark, d):
    return A.profile_summary(T.profiles(spark, d), ["profile"]).select("profile", "points", "bottleneck", *[_r(c, 4) for c in ("min_radius", "mean_radius", "length", "volume")])


def profile_resistance(spark, d):
    return A.resistance(T.profiles(spark, d), ["profile"]).select("profile", "occluded", _r("resistance_integral", 8), *[_r(c, 6) for c in ("geometric", "conductance", "corrected")])


def profile_features(spark, d):
    return A.features(T.profiles(spark, d), ["profile"], 10).select("profile", *[_r(c, 6) for c in ("r_min", "r_max", "r_mean", "r_var", "narrow_fraction")])


def axial_energy(spark, d):
    """Free energy of users' values, with an interval from five blocks of each user's frames."""
    from gridloom.functions import expr as E

    rows = T.series(spark, d).withColumn("block", E.block_of(F.col("frame"), F.count("*").over(Window.partitionBy("key")), 5))
    return A.free_energy(rows, 5.0, 0.0, 100.0, 10.0, 5).select("bin", "n", "centre", _r("energy"), _r("low"), _r("high"))


def cutoff_sensitivity(spark, d):
    """Numbers of contacts at three cutoffs, as a spread about the middle one."""

    def compute(cutoff):
        one = J.closest_contacts(_points(spark, d), cutoff).agg(F.count("*").cast("double").alias("edges"), F.avg("distance").alias("mean_distance"))
        return one.selectExpr("stack(2, 'edges', edges, 'mean_distance', mean_distance) AS (quantity, value)")

    runs = A.run_variants({"low": {"cutoff": 0.04}, "base": {"cutoff": 0.05}, "high": {"cutoff": 0.06}}, compute)
    return A.spread(runs, "base").select("quantity", "runs", *[_r(c, 6) for c in ("least", "greatest", "base", "range", "relative_percent")])


def component_decisions(spark, d):
    """Parts as components with volumes: each with the decision on it."""
    parts = T.table(spark, d, "part").select(F.col("p_partkey").alias("comp"), F.col("p_retailprice").alias("volume"))
    return A.selected_with_reason(parts, 950.0, 1800.0, 100)


def even_sample(spark, d):
    return A.even_sample(T.profiles(spark, d), ["profile"], "i", "r", 5).select("profile", "i", "r")


def void_classes(spark, d):
    """Boxes of points classed by distance to the box's edge and radius."""
    p = _points(spark, d).select("id", (F.abs("x") * 40).alias("edge"), (F.col("r") * 130).alias("radius"))
    return p.groupBy(E.void_class(F.col("edge"), F.col("radius")).alias("cls")).agg(F.count("*").alias("n"))


def dynamics(spark, d):
    """Fluctuation of suppliers' positions (price, quantity, tax) over ship years that all have."""
    f = _frames(spark, d)
    return A.residue_dynamics(f).select("node", "frames", _r("rmsf", 6))


def cross_correlation(spark, d):
    return A.cross_correlation(_frames(spark, d)).select("a", "b", "frames", _r("correlation", 6))


def _frames(spark, d):
    items = T.table(spark, d, "lineitem")
    return items.groupBy(F.year("l_shipdate").cast("long").alias("frame"), F.col("l_suppkey").alias("node")).agg((F.avg("l_extendedprice") / 10000).alias("x"), F.avg("l_quantity").alias("y"), (F.avg("l_tax") * 100).alias("z"))


FRAMES_SQL = """f AS (SELECT year(l_shipdate)::BIGINT AS frame, l_suppkey AS node, avg(l_extendedprice) / 10000 AS x, avg(l_quantity) AS y, avg(l_tax) * 100 AS z FROM lineitem GROUP BY ALL),
m AS (SELECT node, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM f GROUP BY node)"""

QUERIES = {f.__name__: f for f in (
    contact_network, contact_degrees, contact_surface, contact_metrics, distance_pairs, periodic_pairs, nearest_surface, within_surface, segment_clearance, group_annotation, shared_boundary, lattice_members, voxel_keys,
    exposed_area, bounding_boxes, covariances, principal_axes, rigid_transform, radius_fallback, matched_split, paired_years, price_density, set_links, set_jaccard, persistent_edges, edge_occupancy, shared_bridges,
    group_matrix, series_description, series_halves, circular_values, profile_summary, profile_resistance, profile_features, axial_energy, cutoff_sensitivity, component_decisions, even_sample, void_classes, dynamics, cross_correlation,
)}

_D = "round({0}, 9) AS {0}".format
# eigenvalues in closed form; the eigenvector is the longest cross product of two rows of the matrix less the eigenvalue
AXES_SQL = f"""{T.POINTS_SQL}, m AS (SELECT grp, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, y) AS yy, covar_pop(y, z) AS yz, covar_pop(z, z) AS zz FROM points GROUP BY grp),
p AS (SELECT *, (xx + yy + zz) / 3 AS q, sqrt(((xx - q)**2 + (yy - q)**2 + (zz - q)**2 + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM m),
f AS (SELECT *, acos(greatest(-1, least(1, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * p**3)))) / 3 AS phi FROM p),
e AS (SELECT f.*, axis::INT AS axis, q + 2 * p * cos(phi + [0, 4, 2][axis + 1] * pi() / 3) AS l FROM f, range(3) t(axis)),
v AS (SELECT *, [[xy * yz - xz * (yy - l), xz * xy - (xx - l) * yz, (xx - l) * (yy - l) - xy * xy], [xy * (zz - l) - xz * yz, xz * xz - (xx - l) * (zz - l), (xx - l) * yz - xy * xz], [(yy - l) * (zz - l) - yz * yz, yz * xz - xy * (zz - l), xy * yz - (yy - l) * xz]] AS c FROM e),
w AS (SELECT *, list_transform(c, lambda u: sqrt(u[1] * u[1] + u[2] * u[2] + u[3] * u[3])) AS n FROM v), k AS (SELECT *, list_position(n, list_max(n)) AS i FROM w),
s AS (SELECT *, c[i] AS u, CASE WHEN abs(c[i][1] / n[i]) > 1e-12 THEN sign(c[i][1]) WHEN abs(c[i][2] / n[i]) > 1e-12 THEN sign(c[i][2]) ELSE sign(c[i][3]) END / n[i] AS t FROM k)"""
ORACLE_SQL = {
    "principal_axes": f"WITH {AXES_SQL} SELECT grp, axis, round(l, 6) AS variance, round(u[1] * t, 6) AS x, round(u[2] * t, 6) AS y, round(u[3] * t, 6) AS z FROM s",
    "contact_network": f"WITH {CONTACT_SQL} SELECT source, target, id_a, id_b, {_D('distance')}, {_D('weight')} FROM net",
    "contact_degrees": f"WITH {CONTACT_SQL} SELECT node, count(*) AS degree FROM (SELECT source AS node FROM net UNION ALL SELECT target FROM net) GROUP BY node ORDER BY degree DESC, node LIMIT 10",
    "contact_surface": f"""WITH {T.POINTS_SQL}, pairs AS (SELECT a.id AS ia, b.id AS ib, least(a.grp, b.grp) AS source, greatest(a.grp, b.grp) AS target, {DIST} - a.r - b.r AS m FROM points a JOIN points b ON a.id < b.id AND a.grp <> b.grp WHERE {DIST} - a.r - b.r <= 0.03)
      SELECT source, target, ia AS id_a, ib AS id_b, round(m, 9) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY m, ia, ib) AS n FROM pairs) WHERE n = 1""",
    "contact_metrics": f"WITH {CONTACT_SQL}, n AS (SELECT count(DISTINCT grp) AS nodes FROM points), e AS (SELECT count(*) AS edges FROM net) SELECT nodes, edges, round(edges / CASE WHEN nodes < 2 THEN 1.0::DOUBLE ELSE nodes * (nodes - 1) / 2 END, 9) AS density FROM n, e",
    "distance_pairs": f"WITH {T.POINTS_SQL} SELECT a.id AS l_id, b.id AS r_id, round({DIST}, 9) AS distance FROM points a JOIN points b ON NOT a.hetero AND b.hetero WHERE {DIST} <= 0.08",
    "periodic_pairs": f"""WITH {T.POINTS_SQL}, m AS (SELECT a.id AS l_id, b.id AS r_id, a.x - b.x AS dx, a.y - b.y AS dy, a.z - b.z AS dz FROM points a JOIN points b ON NOT a.hetero AND b.hetero),
      n AS (SELECT l_id, r_id, dx - 0.4::DOUBLE * round_even(dx / 0.4::DOUBLE, 0) AS u, dy - 0.4::DOUBLE * round_even(dy / 0.4::DOUBLE, 0) AS v, dz - 0.4::DOUBLE * round_even(dz / 0.4::DOUBLE, 0) AS w FROM m)
      SELECT l_id, r_id, round(sqrt(u * u + v * v + w * w), 9) AS distance FROM n WHERE sqrt(u * u + v * v + w * w) <= 0.05""",
    "nearest_surface": f"WITH {T.POINTS_SQL} SELECT b.id, arg_min(a.id, struct_pack(d := {DIST} - a.r, i := a.id)) AS nearest, round(min({DIST} - a.r), 9) AS clearance FROM points a JOIN points b ON NOT a.hetero AND b.hetero GROUP BY b.id",
    "within_surface": f"WITH {T.POINTS_SQL} SELECT b.id, a.id AS sphere, round({DIST} - a.r, 9) AS clearance FROM points a JOIN points b ON NOT a.hetero AND b.hetero WHERE {DIST} - a.r <= 0.05",
    "segment_clearance": f"""WITH {T.POINTS_SQL}, s AS (SELECT id, x AS ax, y AS ay, z AS az, lead(x) OVER w AS bx, lead(y) OVER w AS by_, lead(z) OVER w AS bz FROM points WHERE hetero WINDOW w AS (PARTITION BY grp ORDER BY id)),
      t AS (SELECT s.*, p.x, p.y, p.z, p.r, (bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)+(bz-az)*(bz-az) AS l2 FROM s JOIN points p ON NOT p.hetero WHERE bx IS NOT NULL),
      u AS (SELECT *, CASE WHEN l2 > 0 THEN greatest(0, least(1, ((x-ax)*(bx-ax)+(y-ay)*(by_-ay)+(z-az)*(bz-az)) / l2)) ELSE 0 END AS k FROM t),
      v AS (SELECT id, sqrt((x-ax-k*(bx-ax))**2 + (y-ay-k*(by_-ay))**2 + (z-az-k*(bz-az))**2) - r AS gap FROM u)
      SELECT id, round(min(gap), 9) AS clearance FROM v GROUP BY id""",
    "group_annotation": f"""WITH {T.POINTS_SQL}, q AS (SELECT a.grp, a.id AS pid, b.id AS sid, {DIST} - greatest(b.r - 0.03::DOUBLE, 0) AS own, (b.id % 3 = 0)::INT AS near FROM points a JOIN points b ON NOT a.hetero AND b.hetero WHERE {DIST} <= 0.06 + greatest(b.r - 0.03::DOUBLE, 0)),
      g AS (SELECT grp, min(own) AS min_gap, avg(own) AS mean_gap, count(DISTINCT pid) AS points, count(DISTINCT sid) AS samples, max(near) AS near FROM q GROUP BY grp),
      h AS (SELECT *, CASE WHEN min_gap <= 1 AND near = 1 THEN 'bottleneck' WHEN min_gap <= 1 THEN 'lining' WHEN near = 1 THEN 'bottleneck-nearby' ELSE 'nearby' END AS role FROM g)
      SELECT grp, points, samples, role, {_D('min_gap')}, {_D('mean_gap')}, round(1 / (0.25::DOUBLE + greatest(min_gap, 0)) + 0.15::DOUBLE * ln(1 + samples) + CASE role WHEN 'bottleneck' THEN 1 WHEN 'lining' THEN 0.25 ELSE 0 END, 6) AS influence FROM h""",
    "shared_boundary": f"""WITH {T.POINTS_SQL}, q AS (SELECT b.id, a.grp, {DIST} - a.r AS c FROM points a JOIN points b ON NOT a.hetero AND b.hetero WHERE {DIST} - a.r <= 0.1),
      t AS (SELECT DISTINCT id, grp FROM (SELECT *, min(c) OVER (PARTITION BY id) AS m FROM q) WHERE c <= m + 1e-7), s AS (SELECT *, 1 / count(*) OVER (PARTITION BY id)::DOUBLE AS share FROM t)
      SELECT grp, count(*) AS samples, round(sum(share), 9) AS area FROM s GROUP BY grp""",
    "lattice_members": f"""WITH {T.POINTS_SQL}, k AS (SELECT *, floor(x / 0.1::DOUBLE + 0.5)::BIGINT AS i, floor(y / 0.1::DOUBLE + 0.5)::BIGINT AS j, floor(z / 0.1::DOUBLE + 0.5)::BIGINT AS l FROM points)
      SELECT grp, count(*) FILTER ((i, j, l) IN (SELECT (i, j, l) FROM k WHERE hetero)) AS inside, count(*) AS n FROM k WHERE NOT hetero GROUP BY grp""",
    "voxel_keys": f"""WITH {T.POINTS_SQL}, k AS (SELECT id, round_even(x / 0.05::DOUBLE, 0)::BIGINT AS ex, round_even(y / 0.05::DOUBLE, 0)::BIGINT AS ey, round_even(z / 0.05::DOUBLE, 0)::BIGINT AS ez,
      floor(x / 0.05::DOUBLE + 0.5)::BIGINT AS ux, floor(y / 0.05::DOUBLE + 0.5)::BIGINT AS uy, floor(z / 0.05::DOUBLE + 0.5)::BIGINT AS uz FROM points)
      SELECT *, ((ex + 1048576) << 42) | ((ey + 1048576) << 21) | (ez + 1048576) AS key FROM k""",
    "exposed_area": f"""WITH {T.POINTS_SQL}, p AS (SELECT id, grp, x, y, z, r + 0.02::DOUBLE AS r FROM points),
      s AS (SELECT k, sqrt(1 - zz * zz) * cos({3.141592653589793 * (1 + 5**0.5)!r}::DOUBLE * (k + 0.5)) AS dx, sqrt(1 - zz * zz) * sin({3.141592653589793 * (1 + 5**0.5)!r}::DOUBLE * (k + 0.5)) AS dy, zz AS dz FROM (SELECT range AS k, 1 - 2 * (range + 0.5::DOUBLE) / 64 AS zz FROM range(64))),
      h AS (SELECT DISTINCT a.id, k FROM p a JOIN p b ON a.id <> b.id AND {DIST} < a.r + b.r CROSS JOIN s WHERE dx * (b.x - a.x) + dy * (b.y - a.y) + dz * (b.z - a.z) > (a.r * a.r + (b.x-a.x)*(b.x-a.x) + (b.y-a.y)*(b.y-a.y) + (b.z-a.z)*(b.z-a.z) - b.r * b.r) / (2 * a.r) + 1e-10),
      c AS (SELECT p.id, p.grp, p.r, count(k) AS hidden FROM p LEFT JOIN h ON p.id = h.id GROUP BY ALL)
      SELECT grp, sum(hidden)::BIGINT AS hidden, round(sum((64 - hidden) / 64::DOUBLE * 4 * pi() * r * r), 6) AS area FROM c GROUP BY grp""",
    "bounding_boxes": f"WITH {T.POINTS_SQL} SELECT grp, " + ", ".join(f"round({f}({c}), 9) AS {n}_{c}" for c in "xyz" for f, n in (("min", "min"), ("max", "max"), ("avg", "mean"))) + " FROM points GROUP BY grp",
    "covariances": f"WITH {T.POINTS_SQL} SELECT grp, " + ", ".join(f"round(covar_pop({a}, {b}), 9) AS c_{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")) + " FROM points GROUP BY grp",
    "rigid_transform": f"WITH {T.POINTS_SQL}, m AS (SELECT id, x, y, z, 1 - y AS mx, 2 + x AS my, 3 + z AS mz FROM points) SELECT id, {_D('mx')}, {_D('my')}, {_D('mz')}, round(sqrt((mx-x)*(mx-x)+(my-y)*(my-y)+(mz-z)*(mz-z)), 9) AS moved FROM m",
    "radius_fallback": """WITH f AS (SELECT l_partkey, l_suppkey, max(l_tax) AS v FROM lineitem WHERE l_discount > 0.09 GROUP BY ALL), c AS (SELECT p_partkey, p_retailprice AS v FROM part WHERE p_size < 20)
      SELECT l_orderkey, l_linenumber, l.l_partkey, l.l_suppkey, l_extendedprice, coalesce(f.v, c.v, -1) AS value FROM lineitem l LEFT JOIN f ON l.l_partkey = f.l_partkey AND l.l_suppkey = f.l_suppkey LEFT JOIN c ON l.l_partkey = c.p_partkey""",
    "matched_split": "SELECT c_mktsegment, count(*) AS n, c_custkey IN (SELECT o_custkey FROM orders) AS matched FROM customer GROUP BY ALL",
    "paired_years": """WITH o AS (SELECT year(o_orderdate)::BIGINT AS year, c_mktsegment AS s, avg(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
      SELECT a.year, round(a.v, 2) AS left_value, round(b.v, 2) AS right_value, round(b.v - a.v, 2) AS difference FROM o a JOIN o b ON a.year = b.year AND a.s = 'BUILDING' AND b.s = 'MACHINERY'""",
    "price_density": """WITH k AS (SELECT floor(l_extendedprice / 1000 / 10)::BIGINT AS c_px, floor((l_discount * 100 + 0.5) / 2)::BIGINT AS c_pd, l_shipdate::DATE AS frame FROM lineitem)
      SELECT c_px, c_pd, count(*) AS n, count(DISTINCT frame) AS occupied, round(count(*) / 20000::DOUBLE, 9) AS density, round(count(DISTINCT frame) / 1000::DOUBLE, 9) AS occupancy FROM k GROUP BY ALL""",
    "set_links": f"""WITH {T.MEMBERS_SQL}, t AS (SELECT *, dense_rank() OVER (ORDER BY frame) AS turn FROM members), n AS (SELECT frame, grp, count(*) AS n FROM members GROUP BY ALL),
      o AS (SELECT a.frame AS prev_frame, b.frame AS cur_frame, a.grp AS prev, b.grp AS cur, count(*) AS overlap FROM t a JOIN t b ON b.turn = a.turn + 1 AND a.member = b.member GROUP BY ALL),
      j AS (SELECT o.*, overlap / (p.n + c.n - overlap)::DOUBLE AS jaccard, overlap / least(p.n, c.n)::DOUBLE AS containment FROM o JOIN n p ON p.frame = prev_frame AND p.grp = prev JOIN n c ON c.frame = cur_frame AND c.grp = cur)
      SELECT prev_frame, cur_frame, prev, cur, overlap, {_D('jaccard')}, {_D('containment')} FROM j WHERE jaccard >= 0.2 OR containment >= 0.5""",
    "set_jaccard": f"""WITH {T.MEMBERS_SQL}, n AS (SELECT frame, count(*) AS n FROM members GROUP BY frame), o AS (SELECT a.frame AS a, b.frame AS b, count(*) AS shared FROM members a JOIN members b ON a.frame < b.frame AND a.member = b.member GROUP BY ALL)
      SELECT a, b, shared, round(shared / (x.n + y.n - shared)::DOUBLE, 9) AS jaccard FROM o JOIN n x ON x.frame = a JOIN n y ON y.frame = b""",
    "persistent_edges": f"""WITH {EDGES_SQL}, c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame, source, target ORDER BY distance, kind) AS n FROM edges) WHERE n = 1),
      k AS (SELECT source, target, kind, row_number() OVER (PARTITION BY source, target ORDER BY count(*) DESC, kind) AS n FROM c GROUP BY source, target, kind), o AS (SELECT DISTINCT ts::DATE AS frame, event_type AS node FROM events),
      t AS (SELECT source, target, count(*) AS contact_frames, avg(distance) AS mean_distance FROM c GROUP BY ALL),
      x AS (SELECT t.*, (SELECT count(*) FROM o a JOIN o b ON a.frame = b.frame WHERE a.node = t.source AND b.node = t.target) AS eligible_frames FROM t)
      SELECT x.source, x.target, contact_frames, eligible_frames, k.kind, round(contact_frames / eligible_frames::DOUBLE, 9) AS occupancy, {_D('mean_distance')} FROM x JOIN k ON x.source = k.source AND x.target = k.target AND k.n = 1 WHERE contact_frames / eligible_frames::DOUBLE >= 0.5""",
    "edge_occupancy": f"""WITH {EDGES_SQL}, f AS (SELECT kind, source, target, frame, count(*) AS n, min(distance) AS d FROM edges GROUP BY ALL)
      SELECT kind, source, target, count(*) AS frames, round(count(*) / 30::DOUBLE, 9) AS occupancy, round(avg(n), 9) AS mean_count, round(min(d), 9) AS min_value FROM f GROUP BY ALL""",
    "shared_bridges": "WITH s AS (SELECT DISTINCT l_suppkey AS site, l_partkey AS via FROM lineitem) SELECT a.site AS a, b.site AS b, count(DISTINCT a.via) AS shared FROM s a JOIN s b ON a.via = b.via AND a.site < b.site GROUP BY ALL",
    "group_matrix": f"WITH {CONTACT_SQL} SELECT least(source % 3, target % 3) AS group_a, greatest(source % 3, target % 3) AS group_b, count(*) AS edges, round(sum(weight), 9) AS strength FROM net WHERE source % 3 <> target % 3 GROUP BY ALL",
    "series_description": f"""WITH {T.SERIES_SQL} SELECT kind, count(*) AS n, count(s) AS observed, count(*) - count(s) AS missing, 1.0::DOUBLE AS coverage, round(avg(s), 6) AS mean, round(stddev_samp(s), 6) AS sd, round(quantile_cont(s, 0.5), 6) AS median,
      round(quantile_cont(s, 0.025), 6) AS q025, round(quantile_cont(s, 0.975), 6) AS q975, round(min(s), 6) AS min_value, round(max(s), 6) AS max_value FROM series GROUP BY kind""",
    "series_halves": f"WITH {T.SERIES_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM series) SELECT key, round(avg(s) FILTER (frame < n // 2), 6) AS first_half, round(avg(s) FILTER (frame >= n // 2), 6) AS second_half FROM n GROUP BY key",
    "circular_values": f"""WITH {T.SERIES_SQL}, c AS (SELECT kind, count(*) AS n, avg(sin(radians((s * 3) % 360))) AS a, avg(cos(radians((s * 3) % 360))) AS b FROM series GROUP BY kind)
      SELECT kind, n, round(degrees(atan2(a, b)), 6) AS mean_angle, round(sqrt(a * a + b * b), 6) AS resultant FROM c""",
    "profile_summary": f"""WITH {T.PROFILES_SQL}, l AS (SELECT *, lead(s) OVER w AS s2, lead(r) OVER w AS r2 FROM profiles WINDOW w AS (PARTITION BY profile ORDER BY i))
      SELECT profile, count(*) AS points, arg_min(i, struct_pack(r := r, i := i)) AS bottleneck, round(min(r), 4) AS min_radius, round(avg(r), 4) AS mean_radius, round(coalesce(sum(abs(s2 - s)), 0), 4) AS length, round(coalesce(sum(pi() * (r * r + r2 * r2) / 2 * abs(s2 - s)), 0), 4) AS volume FROM l GROUP BY profile""",
    "profile_resistance": f"""WITH {T.PROFILES_SQL}, l AS (SELECT *, lead(s) OVER w AS s2, lead(r) OVER w AS r2 FROM profiles WINDOW w AS (PARTITION BY profile ORDER BY i)),
      g AS (SELECT profile, min(r) <= 0 AS occluded, coalesce(sum((1 / (pi() * r * r) + 1 / (pi() * r2 * r2)) / 2 * abs(s2 - s)), 0) AS q, arg_min(r, i) AS ra, arg_max(r, i) AS rz FROM l GROUP BY profile)
      SELECT profile, occluded, round(q, 8) AS resistance_integral, round(CASE WHEN q > 0 THEN 100 / q END, 6) AS geometric, round(100 / (q + 1 / (4 * ra) + 1 / (4 * rz)), 6) AS conductance, round(CASE WHEN q > 0 THEN 100 / q / 5.594::DOUBLE END, 6) AS corrected FROM g""",
    "profile_features": f"WITH {T.PROFILES_SQL} SELECT profile, round(min(r), 6) AS r_min, round(max(r), 6) AS r_max, round(avg(r), 6) AS r_mean, round(var_pop(r), 6) AS r_var, round(count(*) FILTER (r < 10) / count(*)::DOUBLE, 6) AS narrow_fraction FROM profiles GROUP BY profile",
    "axial_energy": f"""WITH {T.SERIES_SQL}, q AS (SELECT floor(s / 5)::BIGINT AS bin, least(frame * 5 // count(*) OVER (PARTITION BY key), 4) AS block, s FROM series), e AS (SELECT bin, block, count(*) AS m FROM q WHERE s >= 0 AND s < 100 GROUP BY ALL),
      c AS (SELECT bin, sum(m)::BIGINT AS n FROM e GROUP BY bin), d AS (SELECT *, (bin + 0.5) * 5::DOUBLE AS centre FROM c), r AS (SELECT block, sum(m) FILTER (bin IN (0, 1, 18, 19)) / 4::DOUBLE AS ref FROM e GROUP BY block),
      v AS (SELECT bin, count(*) AS k, stddev_samp(-ln(m / ref)) AS sd FROM e JOIN r USING (block) GROUP BY bin), g AS (SELECT bin, n, centre, -ln(n / (SELECT sum(n) / 4::DOUBLE FROM d WHERE centre <= 10 OR centre >= 90)) AS energy FROM d)
      SELECT bin, n, centre, round(energy, 9) AS energy, round(energy - CASE WHEN k = 5 THEN 2.7764451051977987::DOUBLE * sd / sqrt(5) END, 9) AS low, round(energy + CASE WHEN k = 5 THEN 2.7764451051977987::DOUBLE * sd / sqrt(5) END, 9) AS high FROM g JOIN v USING (bin)""",
    "cutoff_sensitivity": f"""WITH {T.POINTS_SQL}, c AS (SELECT * FROM (VALUES ('low', 0.04::DOUBLE), ('base', 0.05::DOUBLE), ('high', 0.06::DOUBLE)) v(variant, cut)),
      p AS (SELECT least(a.grp, b.grp) AS g, greatest(a.grp, b.grp) AS h, min({DIST}) AS m FROM points a JOIN points b ON a.id < b.id AND a.grp <> b.grp GROUP BY ALL),
      q AS (SELECT variant, count(*)::DOUBLE AS e, avg(m) AS d FROM c JOIN p ON m <= cut GROUP BY variant), r AS (SELECT variant, 'edges' AS quantity, e AS value FROM q UNION ALL SELECT variant, 'mean_distance', d FROM q),
      s AS (SELECT quantity, count(value) AS runs, min(value) AS l, max(value) AS g, max(value) FILTER (variant = 'base') AS b FROM r GROUP BY quantity)
      SELECT quantity, runs, round(l, 6) AS least, round(g, 6) AS greatest, round(b, 6) AS base, round(g - l, 6) AS range, round(100 * (g - l) / abs(b), 6) AS relative_percent FROM s""",
    "component_decisions": """WITH r AS (SELECT p_partkey AS comp, p_retailprice AS volume, CASE WHEN p_retailprice < 950 THEN 'below_min_volume' WHEN p_retailprice > 1800 THEN 'above_max_volume' END AS reason FROM part)
      SELECT comp, volume, coalesce(reason, CASE WHEN row_number() OVER (PARTITION BY reason IS NULL ORDER BY volume DESC, comp) <= 100 THEN 'selected' ELSE 'component_limit' END) AS decision FROM r""",
    "even_sample": f"""WITH {T.PROFILES_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY profile) AS n, row_number() OVER (PARTITION BY profile ORDER BY r, i) AS m FROM profiles)
      SELECT profile, i, r FROM n WHERE m = 1 OR list_contains(list_transform([0, 1, 2, 3, 4], lambda j: round_even(j * (n - 1) / 4::DOUBLE, 0)::BIGINT), i)""",
    "void_classes": f"WITH {T.POINTS_SQL} SELECT CASE WHEN abs(x) * 40 <= 6 THEN 'surface_proximal' WHEN r * 130 >= 6 THEN 'large_connected_candidate' ELSE 'buried_cavity' END AS cls, count(*) AS n FROM points GROUP BY ALL",
    "dynamics": f"WITH {FRAMES_SQL} SELECT node, count(*) AS frames, round(sqrt(avg((x-mx)*(x-mx)+(y-my)*(y-my)+(z-mz)*(z-mz))), 6) AS rmsf FROM f JOIN m USING (node) GROUP BY node",
    "cross_correlation": f"""WITH {FRAMES_SQL}, o AS (SELECT frame, node, x - mx AS dx, y - my AS dy, z - mz AS dz FROM f JOIN m USING (node)),
      p AS (SELECT a.node AS a, b.node AS b, count(*) AS frames, avg(a.dx*b.dx+a.dy*b.dy+a.dz*b.dz) AS ab, avg(a.dx*a.dx+a.dy*a.dy+a.dz*a.dz) AS aa, avg(b.dx*b.dx+b.dy*b.dy+b.dz*b.dz) AS bb FROM o a JOIN o b ON a.frame = b.frame AND a.node < b.node GROUP BY ALL)
      SELECT a, b, frames, CASE WHEN frames >= 3 AND aa >= 1e-12 AND bb >= 1e-12 THEN round(greatest(-1, least(1, ab / sqrt(aa * bb))), 6) END AS correlation FROM p""",
}
