"""Queries on spaces of a lattice, images and conformations, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import expr as E
from gridloom.operators import graph as G
from gridloom.operators import voids as V
from gridloom.plans.ordered_queries import ALL, FACES, FREE_SQL, GRID_SQL, STEP, _field
from gridloom.plans.spatial_queries import _frames
from gridloom.sources import tables as T

_r = lambda name, digits=6: F.round(name, digits).alias(name)
PROBE = 0.02
CELL, LOW, HIGH = ((0.3, 0.35, 0.4), (80.0, 95.0, 70.0)), (-0.2, -0.2, -0.2), (0.2, 0.2, 0.2)


def _free(spark, d):
    return _field(spark, d).where(F.col("clearance") >= PROBE)


def certified_edges(spark, d):
    """Links between free lattice nodes that a probe can go along."""
    nodes = _field(spark, d)
    return V.certified_edges(nodes, G.neighbours(nodes), T.points(spark, d).select("id", "x", "y", "z", "r"), PROBE)


def void_kinds(spark, d):
    return V.void_kinds(V.labelled(_free(spark, d), faces_only=True), (8, 8, 8)).select("comp", "nodes", F.col("faces").cast("long").alias("faces"), "kind")


def focus_voids(spark, d):
    """Free nodes near marked points, with the components that they form."""
    return V.focus_components(_free(spark, d), T.points(spark, d).where("hetero"), 0.07, True).select("id", "comp")


def core_regions(spark, d):
    return V.core_regions(_free(spark, d), PROBE, STEP)[1]


def core_fill(spark, d):
    return V.core_fill(_field(spark, d), PROBE, STEP)


def section_pieces(spark, d):
    return V.section_pieces(_free(spark, d))


def exposed_faces(spark, d):
    return V.exposed_faces(V.labelled(_free(spark, d), faces_only=True), STEP).select("comp", "faces", _r("area", 9))


def periodic_images(spark, d):
    """Images of points of a skew cell in a box."""
    return V.periodic_images(T.points(spark, d), E.cell_vectors(*CELL), LOW, HIGH).select("id", _r("x"), _r("y"), _r("z"))


def lumen_cylinder(spark, d):
    """Points in a cylinder, with their positions along it."""
    s, inside = V.cylinder((0.01, 0.0, 0.0), E.named_axis("0,0.6,0.8"), 0.1)
    return T.points(spark, d).withColumn("s", s).where(inside).select("id", _r("s"))


def lumen_path(spark, d):
    """Plain points in the spheres of a path of marked points."""
    p = T.points(spark, d)
    path = p.where("hetero").select("id", "x", "y", "z", (F.col("r") * 2).alias("r"), F.col("id").cast("double").alias("s"))
    return V.along_path(p.where("NOT hetero"), path).select("id", F.col("at").alias("node"), "s")


def conformations(spark, d):
    """Events' values as torsions, their kinds as letters, by user."""
    letter = F.when(F.col("kind") == "view", "H").when(F.col("kind") == "click", "E").when(F.col("kind") == "purchase", "C")
    rows = T.series(spark, d).select("key", (F.col("s") * 7.2 - 360).alias("chi"), letter.alias("letter"))
    return V.conformations(rows, ["key"]).select("key", "n", *[_r(c) for c in ("resultant", "mean_angle", "bin_0", "bin_1", "bin_2", "share_h", "share_e", "share_c")])


def axial_membership(spark, d):
    rows = T.series(spark, d).select("frame", "s", (F.col("kind") == "view").alias("inside"))
    return V.axial_membership(rows, 12.5).select("bin", "n", _r("pooled"), _r("mean_share"))


def fluctuation_halves(spark, d):
    return V.fluctuation_halves(_frames(spark, d)).select("node", "frames", _r("rmsf"), _r("first_half"), _r("second_half"))


QUERIES = {f.__name__: f for f in (certified_edges, void_kinds, focus_voids, core_regions, core_fill, section_pieces, exposed_faces, periodic_images, lumen_cylinder, lumen_path, conformations, axial_membership, fluctuation_halves)}

_FREE = FREE_SQL.format(probe=PROBE, near=FACES)
_FLAT = "abs(a.i-b.i)+abs(a.j-b.j) = 1 AND a.k = b.k"


def _images_sql():
    a, b, c = E.cell_vectors(*CELL)
    moved = ", ".join(f"x{n} + i * {a[d]!r}::DOUBLE + j * {b[d]!r}::DOUBLE + k * {c[d]!r}::DOUBLE AS {n}" for d, n in enumerate("xyz")).replace("xx +", "x +").replace("xy +", "y +").replace("xz +", "z +")
    return f"WITH {T.POINTS_SQL}, m AS (SELECT id, {moved} FROM points, range(-9, 10) u(i), range(-9, 10) v(j), range(-9, 10) w(k)) SELECT id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM m WHERE abs(x) <= 0.2 AND abs(y) <= 0.2 AND abs(z) <= 0.2"


_CORES = """WITH RECURSIVE {0}, f AS (SELECT * FROM c WHERE clearance >= (SELECT greatest({1}, least(2, 0.35::DOUBLE * max(clearance))) FROM c)), n AS (SELECT a.id AS a, b.id AS b FROM f a JOIN f b ON a.id <> b.id AND {2}),
r AS (SELECT id AS node, id AS comp FROM f UNION SELECT n.b, r.comp FROM r JOIN n ON n.a = r.node), l AS (SELECT node AS id, min(comp) AS comp FROM r GROUP BY node), s AS (SELECT comp, count(*) AS nodes FROM l GROUP BY comp),
q AS (SELECT comp, nodes, CASE WHEN nodes >= greatest(8, ceil(0.08::DOUBLE * (SELECT max(nodes) FROM s))) THEN 'qualified' ELSE 'weak_core' END AS decision FROM s)""".format(GRID_SQL, PROBE, ALL)

ORACLE_SQL = {
    "certified_edges": f"""WITH {GRID_SQL}, e AS (SELECT a.id AS a, b.id AS b, a.x AS ax, a.y AS ay, a.z AS az, b.x - a.x AS ux, b.y - a.y AS uy, b.z - a.z AS uz FROM c a JOIN c b ON a.id < b.id AND {ALL} AND a.clearance >= {PROBE} AND b.clearance >= {PROBE}),
      t AS (SELECT a, b, p.r, p.x - ax AS px, p.y - ay AS py, p.z - az AS pz, ux, uy, uz, greatest(0, least(1, ((p.x-ax)*ux + (p.y-ay)*uy + (p.z-az)*uz) / (ux*ux+uy*uy+uz*uz))) AS k FROM e, points p)
      SELECT a, b FROM t GROUP BY a, b HAVING min(sqrt((px-k*ux)**2 + (py-k*uy)**2 + (pz-k*uz)**2) - r) >= {PROBE}""",
    "void_kinds": f"""{_FREE}, k AS (SELECT comp, count(*) AS nodes, bool_or(i = 0) AS a, bool_or(i = 8) AS b, bool_or(j = 0) AS c, bool_or(j = 8) AS d, bool_or(k = 0) AS e, bool_or(k = 8) AS f FROM o GROUP BY comp)
      SELECT comp, nodes, (a::INT + b::INT + c::INT + d::INT + e::INT + f::INT)::BIGINT AS faces, CASE WHEN (a AND b) OR (c AND d) OR (e AND f) THEN 'through_channel' WHEN a OR b OR c OR d OR e OR f THEN 'surface_connected' ELSE 'buried_cavity' END AS kind FROM k""",
    "focus_voids": f"""WITH RECURSIVE {GRID_SQL}, f AS (SELECT * FROM c WHERE clearance >= {PROBE} AND EXISTS (SELECT 1 FROM points p WHERE p.hetero AND sqrt((c.x-p.x)**2+(c.y-p.y)**2+(c.z-p.z)**2) <= 0.07)), n AS (SELECT a.id AS a, b.id AS b FROM f a JOIN f b ON {FACES}),
      r AS (SELECT id AS node, id AS comp FROM f UNION SELECT n.b, r.comp FROM r JOIN n ON n.a = r.node) SELECT node AS id, min(comp) AS comp FROM r GROUP BY node""",
    "core_regions": f"{_CORES} SELECT comp, nodes, decision FROM q",
    "core_fill": f"""{_CORES}, m AS (SELECT f.x, f.y, f.z, f.clearance AS rad, l.comp, q.nodes FROM f JOIN l USING (id) JOIN q ON q.comp = l.comp WHERE decision = 'qualified'),
      d AS (SELECT c.id, m.comp, m.nodes, rad - sqrt((m.x-c.x)*(m.x-c.x)+(m.y-c.y)*(m.y-c.y)+(m.z-c.z)*(m.z-c.z)) AS depth FROM c JOIN m ON c.clearance >= 0 AND sqrt((m.x-c.x)*(m.x-c.x)+(m.y-c.y)*(m.y-c.y)+(m.z-c.z)*(m.z-c.z)) <= rad)
      SELECT id, arg_max(comp, (depth, nodes, -comp)) AS comp FROM d GROUP BY id""",
    "section_pieces": f"""WITH RECURSIVE {GRID_SQL}, f AS (SELECT * FROM c WHERE clearance >= {PROBE}), n AS (SELECT a.id AS a, b.id AS b FROM f a JOIN f b ON {_FLAT}), r AS (SELECT id AS node, id AS comp, k FROM f UNION SELECT n.b, r.comp, r.k FROM r JOIN n ON n.a = r.node),
      l AS (SELECT node, k, min(comp) AS comp FROM r GROUP BY ALL) SELECT k, count(DISTINCT comp) AS pieces FROM l GROUP BY k""",
    "exposed_faces": f"""{_FREE}, d AS (SELECT unnest([[1,0,0],[-1,0,0],[0,1,0],[0,-1,0],[0,0,1],[0,0,-1]]) AS d), e AS (SELECT o.comp, o.i + d[1] AS i, o.j + d[2] AS j, o.k + d[3] AS k FROM o, d)
      SELECT e.comp, count(*) AS faces, round(count(*) * 0.0025::DOUBLE, 9) AS area FROM e LEFT JOIN o b ON b.comp = e.comp AND b.i = e.i AND b.j = e.j AND b.k = e.k WHERE b.id IS NULL GROUP BY e.comp""",
    "periodic_images": _images_sql(),
    "lumen_cylinder": f"WITH {T.POINTS_SQL}, q AS (SELECT id, y * 0.6::DOUBLE + z * 0.8::DOUBLE AS s, (x - 0.01) * (x - 0.01) + y * y + z * z AS d FROM points) SELECT id, round(s, 6) AS s FROM q WHERE d - s * s <= 0.01",
    "lumen_path": f"""WITH {T.POINTS_SQL}, q AS (SELECT b.id, a.id AS node, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS d FROM points a JOIN points b ON a.hetero AND NOT b.hetero WHERE sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) <= a.r * 2)
      SELECT id, arg_min(node, (d, node)) AS node, arg_min(node, (d, node))::DOUBLE AS s FROM q GROUP BY id""",
    "conformations": f"""WITH {T.SERIES_SQL}, q AS (SELECT key, s * 7.2::DOUBLE - 360 AS chi, CASE kind WHEN 'view' THEN 'H' WHEN 'click' THEN 'E' WHEN 'purchase' THEN 'C' END AS letter FROM series), g AS (SELECT *, floor(((chi % 360) + 360) % 360 / 120) AS b FROM q),
      a AS (SELECT key, count(chi) AS n, avg(sin(radians(chi))) AS s, avg(cos(radians(chi))) AS c, avg((b = 0)::INT) AS b0, avg((b = 1)::INT) AS b1, avg((b = 2)::INT) AS b2, avg((letter = 'H')::INT) AS h, avg((letter = 'E')::INT) AS e, avg((letter = 'C')::INT) AS k FROM g GROUP BY key)
      SELECT key, n, round(sqrt(s * s + c * c), 6) AS resultant, CASE WHEN sqrt(s * s + c * c) > 1e-8 THEN round(degrees(atan2(s, c)), 6) END AS mean_angle, round(b0, 6) AS bin_0, round(b1, 6) AS bin_1, round(b2, 6) AS bin_2, round(h, 6) AS share_h, round(e, 6) AS share_e, round(k, 6) AS share_c FROM a""",
    "axial_membership": f"WITH {T.SERIES_SQL}, e AS (SELECT floor(s / 12.5 + 1e-9)::BIGINT AS bin, frame, count(*) AS n, sum((kind = 'view')::INT) AS k FROM series GROUP BY ALL) SELECT bin, sum(n)::BIGINT AS n, round(sum(k) / sum(n), 6)::DOUBLE AS pooled, round(avg(k / n), 6) AS mean_share FROM e GROUP BY bin",
    "fluctuation_halves": """WITH f AS (SELECT year(l_shipdate)::BIGINT AS frame, l_suppkey AS node, avg(l_extendedprice) / 10000 AS x, avg(l_quantity) AS y, avg(l_tax) * 100 AS z FROM lineitem GROUP BY ALL), o AS (SELECT frame, row_number() OVER (ORDER BY frame) - 1 AS t, count(*) OVER () AS n FROM (SELECT DISTINCT frame FROM f)),
      h AS (SELECT f.*, t < n // 2 AS early FROM f JOIN o USING (frame)) SELECT node, count(*) AS frames, round(sqrt(var_pop(x) + var_pop(y) + var_pop(z)), 6) AS rmsf, round(sqrt(var_pop(x) FILTER (early) + var_pop(y) FILTER (early) + var_pop(z) FILTER (early)), 6) AS first_half,
      round(sqrt(var_pop(x) FILTER (NOT early) + var_pop(y) FILTER (NOT early) + var_pop(z) FILTER (NOT early)), 6) AS second_half FROM h GROUP BY node""",
}
