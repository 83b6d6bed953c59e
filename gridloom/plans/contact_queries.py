"""Queries on typed contacts, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import contacts as C
from gridloom.sources import tables as T

_r = lambda name, digits=6: F.round(name, digits).alias(name)
DIST = "sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))"


def _sites(spark, d):
    """Points ten times as far apart, with a second point (h) and a unit normal from further components."""
    at = lambda i: F.col("embedding")[i].cast("double")
    size = F.sqrt(at(6) * at(6) + at(7) * at(7) + at(8) * at(8))
    out = T.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), *[(at(i) * 10).alias(a) for i, a in enumerate("xyz")], *[(at(i) * 10 + at(i + 3) * 4).alias(f"h{a}") for i, a in enumerate("xyz")], *[(at(i + 6) / size).alias(f"n{a}") for i, a in enumerate("xyz")])
    return out.withColumns({"charge": F.col("id") % 3 - 1, "part": F.when(F.col("id") % 2 == 0, "backbone").otherwise("side"), "polar": F.col("id") % 5 == 0})


SITES_SQL = """sites AS (SELECT vec_id AS id, label AS grp, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y, embedding[3]::DOUBLE * 10 AS z,
  embedding[1]::DOUBLE * 10 + embedding[4]::DOUBLE * 4 AS hx, embedding[2]::DOUBLE * 10 + embedding[5]::DOUBLE * 4 AS hy, embedding[3]::DOUBLE * 10 + embedding[6]::DOUBLE * 4 AS hz,
  sqrt(embedding[7]::DOUBLE * embedding[7]::DOUBLE + embedding[8]::DOUBLE * embedding[8]::DOUBLE + embedding[9]::DOUBLE * embedding[9]::DOUBLE) AS s, embedding[7]::DOUBLE / s AS nx, embedding[8]::DOUBLE / s AS ny, embedding[9]::DOUBLE / s AS nz,
  vec_id % 3 - 1 AS charge, CASE WHEN vec_id % 2 = 0 THEN 'backbone' ELSE 'side' END AS part, vec_id % 5 = 0 AS polar FROM embeddings)"""


def hydrogen_bonds(spark, d):
    s = _sites(spark, d)
    return C.hydrogen_bonds(s.where("id % 2 = 0"), s.where("id % 2 = 1").select("id", "grp", "x", "y", "z")).select("donor", "acceptor", _r("distance"), _r("h_distance"), _r("angle", 4))


def charge_pairs(spark, d):
    return C.charge_pairs(_sites(spark, d).select("id", "grp", "charge", "x", "y", "z"), 1.5).select("positive", "negative", "id_a", "id_b", _r("distance"))


def stacked_rings(spark, d):
    return C.stacked_rings(_sites(spark, d).select("id", "grp", "x", "y", "z", "nx", "ny", "nz", (F.col("id") % 10 * 0.02).alias("rms"))).select("a", "b", "kind", _r("distance"), _r("tilt", 4))


def water_counts(spark, d):
    s = _sites(spark, d)
    return C.water_counts(s.where("grp <> 9").select("id", "grp", "part", "polar", "x", "y", "z"), s.where("grp = 9").select("id", "x", "y", "z"), 1.0).select("grp", "waters", "backbone", "side_chain", "polar", _r("min_distance"))


def nearest_inside(spark, d):
    s = _sites(spark, d)
    return C.nearest_inside(s.where("grp <> 9").select("id", "x", "y", "z"), s.where("grp = 9").select("id", "x", "y", "z", (F.col("id") % 4 * 0.5 + 0.2).alias("r"))).select("id", "centre", _r("distance"))


def reference_matches(spark, d):
    s = _sites(spark, d)
    a, b = (s.where(f"id % 2 = {k}").select("id", "grp", "x", "y", "z") for k in (0, 1))
    return C.best_match(C.nearest_fraction(a, b, 0.6), 0.1, 0.95).select("ga", "gb", "status", _r("score"))


def membership_table(spark, d):
    s = _sites(spark, d).withColumns({"fixed": F.col("x") > 0, "moving": F.col("hx") > 0})
    return C.cross_tab(s, "fixed", "moving", ["grp"])


RESIDUES = ("ALA", "ARG", "ASP", "SER", "TYR", "HIS", "GLY", "HOH")


def contact_classes(spark, d):
    names = F.array(*[F.lit(n) for n in RESIDUES])
    s = _sites(spark, d).select("id", "grp", "x", "y", "z", F.element_at(names, (F.col("id") % len(RESIDUES) + 1).cast("int")).alias("name"))
    # a class is the same for either order of names, and depends on the gap only by the rule's 0.5
    kind = C.contact_class(F.col("left"), F.col("right"), F.when(F.col("close"), 0.0).otherwise(1.0))
    return C.near_counts(s, 1.2, 0.5).groupBy(kind.alias("kind")).agg(F.sum("n").alias("n"))


def rigid_alignment(spark, d):
    s = _sites(spark, d).select("grp", *[F.col(a).alias(f"a{a}") for a in "xyz"], *[F.col(f"h{a}").alias(f"b{a}") for a in "xyz"])
    return C.rigid_alignment(s, ["grp"]).select("grp", _r("rmsd_before", 5), _r("rmsd_after", 5), _r("tx", 5), _r("ty", 5), _r("tz", 5))


def alignment_sums(spark, d):
    s = _sites(spark, d).select("grp", *[F.col(a).alias(f"a{a}") for a in "xyz"], *[F.col(f"h{a}").alias(f"b{a}") for a in "xyz"])
    out = C.alignment_sums(s, ["grp"])
    return out.select("grp", "n", _r("max"), _r("mbz"), _r("h_xx"), _r("h_xy"), _r("h_zx"), _r("vax"), _r("vbz"))


QUERIES = {f.__name__: f for f in (hydrogen_bonds, charge_pairs, stacked_rings, water_counts, nearest_inside, reference_matches, membership_table, contact_classes, rigid_alignment, alignment_sums)}

ORACLE_SQL = {
    "hydrogen_bonds": f"""WITH {SITES_SQL}, p AS (SELECT a.id AS donor, b.id AS acceptor, {DIST} AS distance, sqrt((a.hx-b.x)*(a.hx-b.x)+(a.hy-b.y)*(a.hy-b.y)+(a.hz-b.z)*(a.hz-b.z)) AS h_distance,
      (a.x-a.hx)*(b.x-a.hx)+(a.y-a.hy)*(b.y-a.hy)+(a.z-a.hz)*(b.z-a.hz) AS dot, sqrt((a.x-a.hx)*(a.x-a.hx)+(a.y-a.hy)*(a.y-a.hy)+(a.z-a.hz)*(a.z-a.hz)) AS u FROM sites a JOIN sites b ON a.id % 2 = 0 AND b.id % 2 = 1 AND a.grp <> b.grp WHERE {DIST} <= 3.5 AND {DIST} > 1.2),
      q AS (SELECT *, degrees(acos(greatest(-1, least(1, dot / (u * h_distance))))) AS angle FROM p) SELECT donor, acceptor, round(distance, 6) AS distance, round(h_distance, 6) AS h_distance, round(angle, 4) AS angle FROM q WHERE h_distance <= 2.5 AND angle >= 150 AND u > 0.4 AND u <= 1.25""",
    "charge_pairs": f"""WITH {SITES_SQL}, p AS (SELECT a.grp AS positive, b.grp AS negative, a.id AS id_a, b.id AS id_b, {DIST} AS distance FROM sites a JOIN sites b ON a.charge > 0 AND b.charge < 0 AND a.grp <> b.grp WHERE {DIST} <= 1.5)
      SELECT positive, negative, id_a, id_b, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY positive, negative ORDER BY distance, id_a, id_b) AS n FROM p) WHERE n = 1""",
    "stacked_rings": f"""WITH {SITES_SQL}, p AS (SELECT a.id AS a, b.id AS b, {DIST} AS distance, degrees(acos(least(1, abs(a.nx*b.nx+a.ny*b.ny+a.nz*b.nz)))) AS tilt, ((b.x-a.x)*a.nx+(b.y-a.y)*a.ny+(b.z-a.z)*a.nz) AS da, ((b.x-a.x)*b.nx+(b.y-a.y)*b.ny+(b.z-a.z)*b.nz) AS db
      FROM sites a JOIN sites b ON a.id < b.id AND a.grp <> b.grp AND a.id % 10 < 8 AND b.id % 10 < 8 WHERE {DIST} BETWEEN 2.5 AND 5.5), q AS (SELECT *, sqrt(greatest(0, distance * distance - da * da)) AS oa, sqrt(greatest(0, distance * distance - db * db)) AS ob FROM p),
      k AS (SELECT *, CASE WHEN tilt <= 30 AND greatest(oa, ob) <= 2 THEN 'parallel' WHEN tilt >= 60 AND least(oa, ob) <= 2 THEN 'edge_face' END AS kind FROM q) SELECT a, b, kind, round(distance, 6) AS distance, round(tilt, 4) AS tilt FROM k WHERE kind IS NOT NULL""",
    "water_counts": f"""WITH {SITES_SQL} SELECT a.grp, count(DISTINCT b.id) AS waters, count(DISTINCT b.id) FILTER (a.part = 'backbone') AS backbone, count(DISTINCT b.id) FILTER (a.part = 'side') AS side_chain, count(DISTINCT b.id) FILTER (a.polar) AS polar, round(min({DIST}), 6) AS min_distance
      FROM sites a JOIN sites b ON a.grp <> 9 AND b.grp = 9 WHERE {DIST} <= 1.0 GROUP BY a.grp""",
    "nearest_inside": f"""WITH {SITES_SQL}, p AS (SELECT a.id, b.id AS centre, {DIST} AS distance, b.id % 4 * 0.5 + 0.2 AS r, row_number() OVER (PARTITION BY a.id ORDER BY {DIST}, b.id) AS n FROM sites a JOIN sites b ON a.grp <> 9 AND b.grp = 9) SELECT id, centre, round(distance, 6) AS distance FROM p WHERE n = 1 AND distance <= r""",
    "reference_matches": f"""WITH {SITES_SQL}, n AS (SELECT grp, id % 2 AS k, count(*) AS n FROM sites GROUP BY ALL), p AS (SELECT a.grp AS ga, b.grp AS gb, count(DISTINCT a.id) AS na, count(DISTINCT b.id) AS nb FROM sites a JOIN sites b ON a.id % 2 = 0 AND b.id % 2 = 1 WHERE {DIST} <= 0.6 GROUP BY ALL),
      q AS (SELECT ga, gb, na / x.n::DOUBLE AS p, nb / y.n::DOUBLE AS q FROM p JOIN n x ON x.grp = ga AND x.k = 0 JOIN n y ON y.grp = gb AND y.k = 1), s AS (SELECT ga, gb, 2 * p * q / (p + q) AS score FROM q),
      r AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS second FROM s WINDOW w AS (PARTITION BY ga ORDER BY score DESC, gb)) SELECT ga, CASE WHEN score >= 0.1 AND NOT coalesce(second >= 0.95 * score, FALSE) THEN gb END AS gb, CASE WHEN score < 0.1 THEN 'unmatched' WHEN second >= 0.95 * score THEN 'ambiguous' ELSE 'matched' END AS status, round(score, 6) AS score FROM r WHERE n = 1""",
    "membership_table": f"WITH {SITES_SQL} SELECT grp, count(*) FILTER (x > 0 AND hx > 0) AS both, count(*) FILTER (x > 0 AND hx <= 0) AS fixed_only, count(*) FILTER (x <= 0 AND hx > 0) AS moving_only, count(*) FILTER (x <= 0 AND hx <= 0) AS neither FROM sites GROUP BY grp",
    "contact_classes": f"""WITH {SITES_SQL}, t AS (SELECT unnest([['ALA', 'hydrophobic small'], ['ARG', 'positive'], ['ASP', 'negative'], ['SER', 'polar small'], ['TYR', 'hydrophobic polar aromatic'], ['HIS', 'polar positive aromatic'], ['GLY', 'small'], ['HOH', 'other']]) AS v, unnest(range(8)) AS k),
      p AS (SELECT a.id, b.id, u.v[2] AS l, w.v[2] AS r, {DIST} AS m FROM sites a JOIN sites b ON a.id < b.id AND a.grp <> b.grp JOIN t u ON u.k = a.id % 8 JOIN t w ON w.k = b.id % 8 WHERE {DIST} <= 1.2)
      SELECT CASE WHEN (l || r) LIKE '%positive%' AND (l || r) LIKE '%negative%' AND l <> r THEN 'oppositely_charged_residue_contact' WHEN l LIKE '%hydrophobic%' AND r LIKE '%hydrophobic%' THEN 'hydrophobic_residue_contact'
        WHEN m <= 0.5 AND (l LIKE '%polar%' OR r LIKE '%polar%') THEN 'polar_residue_contact' ELSE 'distance_contact' END AS kind, count(*) AS n FROM p GROUP BY ALL""",
    "alignment_sums": f"WITH {SITES_SQL} SELECT grp, count(*) AS n, round(avg(x), 6) AS max, round(avg(hz), 6) AS mbz, round(covar_pop(x, hx), 6) AS h_xx, round(covar_pop(x, hy), 6) AS h_xy, round(covar_pop(z, hx), 6) AS h_zx, round(var_pop(x), 6) AS vax, round(var_pop(hz), 6) AS vbz FROM sites GROUP BY grp",
}
