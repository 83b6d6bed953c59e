"""Queries on selections, lining, comparisons and passages through a lumen, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import expr as E
from gridloom.operators import joins as J
from gridloom.operators import ordered as O
from gridloom.operators import regions as R
from gridloom.operators import selection as S
from gridloom.plans.contact_queries import RESIDUES, SITES_SQL, _sites
from gridloom.plans.ordered_queries import HIGH, LOW
from gridloom.sources import formats as M
from gridloom.sources import sinks
from gridloom.sources import tables as T

_r = lambda name, digits=6: F.round(name, digits).alias(name)
DIST = "sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))"
ELEMENTS = ("H", "C", "N", "O")
NAMES = ("CA", "1HB", "SOD", "FE", "NA", "OG1", "CL2", "CD")


def _pick(values, by):
    """A column that goes through fixed values by a number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))


def _pick_sql(values, by):
    return f"([{', '.join(repr(v) for v in values)}])[({by} % {len(values)} + 1)::INT]"


def _atoms(spark, d):
    """Points as atoms, with an element, an atom's and a residue's name."""
    return T.points(spark, d).withColumns({"element": _pick(ELEMENTS, F.col("id")), "name": _pick(NAMES, F.col("id")), "resname": _pick(RESIDUES + ("SOD", "PRO"), F.col("id"))})


ATOMS_SQL = f"{T.POINTS_SQL}, atoms AS (SELECT *, {_pick_sql(ELEMENTS, 'id')} AS element, {_pick_sql(NAMES, 'id')} AS name, {_pick_sql(RESIDUES + ('SOD', 'PRO'), 'id')} AS resname FROM points)"


def heavy_atoms(spark, d):
    """Atoms without hydrogens and hetero ones, by group and element."""
    return S.selected_atoms(_atoms(spark, d), hetero=False).groupBy("grp", "element").agg(F.count("*").alias("n"))


def wall_exclusions(spark, d):
    """Atoms that a cast of the policy "protein" leaves out, by residue name."""
    return S.excluded_counts(_atoms(spark, d), "protein", ["resname"])


def focus_crop(spark, d):
    p = T.points(spark, d)
    return S.within_reach(p.where("NOT hetero"), p.where("hetero"), 0.05).select("id", "grp")


def margin_crop(spark, d):
    """All points of group 0, and others in its bounding box less a margin."""
    p = T.points(spark, d).withColumn("hetero", F.col("grp") != 0)
    return S.crop_hetero(p, -0.05).groupBy("grp").agg(F.count("*").alias("n"))


def region_mask(spark, d):
    p = T.points(spark, d).withColumn("frame", F.col("id") % 3)
    out = S.fixed_region_mask(p.where("NOT hetero"), p.where("hetero"), 0.06, ["frame"])
    return out.groupBy("frame").agg(F.sum(F.col("inside").cast("long")).alias("inside"), F.count("*").alias("n"))


def pooled_frames(spark, d):
    """Two tables of points as frames 0 and 1."""
    p = T.points(spark, d)
    return S.pooled_frames([p.where("grp < 4"), p.where("grp >= 6")]).groupBy("frame").agg(F.count("*").alias("n"), F.min("id").alias("least"))


def rejoined_frames(spark, d):
    """Users' values joined to their source again by key and frame, with equal times."""
    s = T.series(spark, d)
    out = S.rejoined(s.select("key", "frame", "t", (F.col("s") * 2).alias("twice")), s, ["key", "frame"], "t")
    return out.select("key", "frame", _r("twice"))


def landmark_points(spark, d):
    """Points with the number of points in their group, which every group must have."""
    p = T.points(spark, d)
    return S.looked_up(p.select("id", "grp"), p.groupBy("grp").agg(F.count("*").alias("n")), ["grp"]).select("id", "grp", "n")


RECORDS = ((0, "CA", "ALA", 1.87), (1, "C???", "???", 1.7), (2, "?HB", "???", 1.0), (3, "S???", "S??", 1.41), (4, "????", "???", 1.5))


def record_radii(spark, d):
    """Radii of atoms by the first wildcard record that matches their names."""
    records = spark.createDataFrame(RECORDS, "line long, name string, resname string, radius double")
    return S.record_radii(_atoms(spark, d).select("name", "resname"), records)


def element_names(spark, d):
    """Elements inferred from atoms' names, with and without the element column, and lone ions."""
    names = F.col("name"), F.col("resname")
    out = _atoms(spark, d).select(*names, M.infer_element(*names).alias("inferred"), M.infer_element(*names, F.col("element")).alias("given"), M.is_ion(*names).alias("ion"))
    return out.groupBy("name", "resname", "inferred", "given", "ion").agg(F.count("*").alias("n"))


def residue_classes(spark, d):
    kinds = F.explode(E.residue_properties(F.col("resname")))
    return _atoms(spark, d).select(kinds.alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def route_order(spark, d):
    """Points of each group as routes: the wider first, then the shorter."""
    p = T.points(spark, d).select("grp", "id", F.col("r").alias("width"), F.round(F.abs("x"), 2).alias("length"))
    return S.route_order(p, ["grp"]).select("grp", "id", "place")


def evidence_order(spark, d):
    p = T.points(spark, d).select("grp", F.col("id").cast("string").alias("residue"), F.col("r").alias("area"), F.round(F.abs("y"), 1).alias("contacted"))
    return S.evidence_order(p, ["grp"]).select("grp", "residue", "place")


def stick_rows(spark, d):
    """The first five lining points, and the five other points of most contact."""
    p = T.points(spark, d).select(F.col("id").cast("string").alias("residue"), F.when(F.col("hetero"), "boundary_lining").otherwise("nonlocal_lining_partner").alias("role"), F.col("id").alias("place"), F.round(F.abs("y"), 6).alias("contacted"))
    return S.stick_rows(p, "top:5").select("residue", "role")


def nearest_groups(spark, d):
    """The eight groups of most influence around the origin."""
    return R.nearest_groups(T.points(spark, d).select("id", "grp", "x", "y", "z"), (0.0, 0.0, 0.0), 0.25, 8).select("grp", "points", _r("min_gap"), _r("influence"))


def typed_bridges(spark, d):
    """Groups joined by a water that both have a directional bond with."""
    s = _sites(spark, d)
    dry, wet = s.where("grp <> 9"), s.where("grp = 9")
    plain = ["id", "grp", "x", "y", "z"]
    out = R.typed_bridges(dry.where("id % 2 = 0"), dry.where("id % 2 = 1").select(*plain), wet, wet.select(*plain), least_angle=110.0)
    return out.select("water", "a", "b", _r("distance"), _r("angle", 4))


def shell_lining(spark, d):
    p = T.points(spark, d)
    samples = p.where("hetero").select("id", "x", "y", "z", (F.col("r") - 0.03).alias("clearance"))
    return R.shell_lining(samples, p.where("NOT hetero").select("id", "grp", "x", "y", "z", "r"), 0.03).select("grp", _r("gap", 9), "sample", "samples")


def segment_lining(spark, d):
    p = T.points(spark, d)
    voxels = p.where("hetero").select((F.col("id") % 3).alias("segment"), "x", "y", "z")
    return R.segment_lining(voxels, p.where("NOT hetero"), 0.06).select("segment", "grp", _r("distance", 9), "closest", "atoms")


def region_network(spark, d):
    """The contact network with a node for the region of marked points."""
    p = T.points(spark, d)
    edges = J.closest_contacts(p.where("NOT hetero"), 0.04).withColumn("interaction", F.lit("contact"))
    ends = edges.select(F.col("source").alias("node")).unionByName(edges.select(F.col("target").alias("node")))
    contacts = J.annotate_groups(p.where("hetero").select("id", "x", "y", "z", F.lit(0.0).alias("gap")), p.where("NOT hetero").select("id", "grp", "x", "y", "z"), 0.06, F.lit(False))
    return R.region_network(edges, ends, contacts, "region:void:0").select("source", "target", "interaction", _r("distance"), _r("weight"))


def adjacency(spark, d):
    edges = J.closest_contacts(T.points(spark, d), 0.05)
    return R.adjacency(edges).select("node", F.array_join("neighbours", ",").alias("neighbours"))


def network_similarity(spark, d):
    """Jaccard of the contacts of each two frames, and of an empty one."""
    p = T.points(spark, d).withColumn("frame", F.col("id") % 4)
    e = J.closest_contacts(p, 0.08, keys=["frame"]).select(F.col("frame").alias("grp"), F.concat_ws("-", "source", "target").alias("member"))
    names = p.select(F.col("frame").alias("grp")).unionByName(spark.createDataFrame([(8,), (9,)], "grp long"))
    return R.similarity(names, e).select("a", "b", "shared", _r("jaccard"))


def ever_members(spark, d):
    """Users seen on the first day, on the second, or on both."""
    m = T.memberships(spark, d)
    return R.ever_members(m.where("frame = 0"), m.where("frame = 1")).groupBy("where").agg(F.count("*").alias("n"))


def _routes(spark, d):
    s = _sites(spark, d)
    return s.select("id", "x", "y", "z", F.col("hx").alias("tx"), F.col("hy").alias("ty"), F.col("hz").alias("tz"))


def left_out_routes(spark, d):
    """Routes of odd numbers whose mouth and tail are far from those of all even ones."""
    s = _routes(spark, d)
    return R.left_out_routes(s.where("id % 2 = 1"), s.where("id % 2 = 0"), 0.5, 0.5).select("id")


def group_hydration(spark, d):
    p = T.points(spark, d).withColumn("frame", F.col("id") % 4)
    return R.hydration(p.where("NOT hetero"), p.where("hetero"), 0.1, p).select("grp", "frames", _r("occupancy"), _r("mean_waters"))


def frame_table(spark, d):
    """Contacts, groups in contact and least radius of each frame."""
    p = T.points(spark, d).withColumn("frame", F.col("id") % 4)
    e = J.closest_contacts(p, 0.08, keys=["frame"])
    ends = e.select("frame", F.col("source").alias("g")).unionByName(e.select("frame", F.col("target").alias("g")))
    scalars = {"edges": e.groupBy("frame").agg(F.count("*").alias("value")), "nodes": ends.groupBy("frame").agg(F.countDistinct("g").alias("value")), "narrowest": p.groupBy("frame").agg(F.min("r").alias("value"))}
    return R.frame_table(p, scalars).select("frame", "edges", "nodes", _r("narrowest"))


def split_links(spark, d):
    """Points and their mirror images, ten times as far apart, that a box of 4 parts."""
    pairs = _sites(spark, d).select("id", *[F.col(c).alias(f"a{c}") for c in "xyz"], *[(-F.col(c)).alias(f"b{c}") for c in "xyz"])
    return R.split_links(pairs, (4.0, 4.0, 4.0)).select("id", _r("raw"), _r("image"))


def cell_images(spark, d):
    """Least images of points in a skew cell."""
    s = _sites(spark, d)
    image = E.minimum_image_in(E.xyz(), E.cell_vectors((2.0, 2.5, 3.0), (80.0, 95.0, 70.0)))
    return s.select("id", F.round(E.norm(tuple(image[c] for c in "xyz")), 6).alias("size"))


def boundary_shares(spark, d):
    p = T.points(spark, d)
    return R.boundary_shares(p.where("hetero").select("id", "x", "y", "z", (F.col("r") * 2).alias("area")), p.where("NOT hetero").select("id", "grp", "x", "y", "z", "r"), 0.1).select("grp", "triangles", _r("area"))


def torsions(spark, d):
    """Torsion angles of each four points that follow in a group."""
    from pyspark.sql import Window

    w = Window.partitionBy("grp").orderBy("id")
    s = _sites(spark, d).select("id", "grp", "x", "y", "z").withColumns({f"{c}{k}": F.lead(c, k).over(w) for c in "xyz" for k in (1, 2, 3)})
    at = lambda k: tuple(F.col(f"{c}{k or ''}") for c in "xyz")
    return s.select("id", F.round(E.torsion(at(0), at(1), at(2), at(3), 0.4, 2.2), 5).alias("angle")).where("angle IS NOT NULL")


def axis_positions(spark, d):
    axis = tuple(F.lit(c) for c in E.named_axis("1,2,2"))
    return T.points(spark, d).select("id", F.round(E.project(E.xyz(), tuple(F.lit(0.1) for _ in "xyz"), axis), 9).alias("s"))


def grid_checks(spark, d):
    return T.points(spark, d).groupBy(E.resolution_check(F.when(~F.col("hetero"), F.col("r")), 0.015).alias("status")).agg(F.count("*").alias("n"))


def ladder_steps(spark, d):
    """The values of a ladder next to each order's quantity."""
    q = T.table(spark, d, "lineitem").select(F.col("l_quantity").alias("q")).distinct()
    return q.select("q", F.array_join(E.ladder_neighbours(F.col("q"), [1.0, 5.0, 12.5, 20.0, 45.0]).cast("array<string>"), ",").alias("next"))


def field_voltages(spark, d):
    p = T.points(spark, d)
    zero = F.lit(0.0)
    return p.select("id", F.round(E.field_voltage((zero, F.when(F.col("hetero"), 0.1).otherwise(zero), F.col("r")), (F.lit(60.0), F.lit(60.0), F.lit(80.0)), (zero, F.col("x"), F.col("z"))), 6).alias("voltage"))


def text_hashes(spark, d):
    docs = T.table(spark, d, "documents")
    return docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha256"))


def frame_selection(spark, d):
    """Every third frame of each user from the second to the tenth."""
    return T.frame_range(T.series(spark, d), 1, 10, 3).select("key", "frame", "s")


def frame_inspection(spark, d):
    return T.inspect(T.series(spark, d))


def atom_records(spark, d):
    """Points as coordinate records in fixed columns, read back."""
    p = T.points(spark, d)
    text = p.select(sinks.atom_record(F.col("id").cast("int"), F.lit("CA"), F.lit("ALA"), F.lit("A"), F.col("grp").cast("int"), F.col("x") * 100, F.col("y") * 100, F.col("z") * 100, F.col("r") * 100).alias("value"))
    out = T.fixed_columns(text)
    return out.select("serial", "name", "resname", "chain", "resid", "x", "y", "z", "bfactor", T.label(F.col("chain"), F.col("resname"), F.col("resid"), F.col("icode")).alias("label"))


def _lumen(spark, d, rule):
    out = O.crossings(T.series(spark, d), ["key"], LOW, HIGH, F.col("kind") != "view", rule)
    return out.select("key", F.col("entry").alias("entry_frame"), F.col("exit").alias("exit_frame"), "direction", "status")


def lumen_crossings(spark, d):
    """Passages of users through the slab; a view in the slab counts as beside the lumen."""
    return _lumen(spark, d, "compartment")


def strict_crossings(spark, d):
    """Passages by stays in the lumen that begin and end at different sides."""
    return _lumen(spark, d, "strict")


def transit_summary(spark, d):
    events = O.crossings(T.series(spark, d), ["key"], LOW, HIGH, F.col("kind") != "view")
    out = R.transit_summary(events, ["key"], 50.0)
    return out.select("key", "up", "down", "net", "outside", "unresolved", *[_r(c) for c in ("rate", "mean_transit", "median_transit")], "least_transit", "longest_transit")


def _slab(spark, d):
    return T.series(spark, d).withColumn("state", E.slab_state(F.col("s"), F.lit(LOW), F.lit(HIGH), F.col("kind") != "view"))


def dwell_times(spark, d):
    visits = O.runs(_slab(spark, d), ["key"], "frame", "state", "t").where("state = 'inside'")
    return R.dwell_times(visits.withColumn("censored", F.col("entered_from").isNull() | F.col("exited_to").isNull()), ["key"]).select("key", "visits", "whole", _r("mean_dwell"))


def occupancy_histogram(spark, d):
    s = _slab(spark, d)
    return R.occupancy_histogram(s.where("state = 'inside'").select("frame", F.col("key").alias("member")), s)


def narrow_minima(spark, d):
    """The two least local minima at or below 8 of each profile, or its least point."""
    return O.local_minima(T.profiles(spark, d), ["profile"], threshold=8.0, most=2).select("profile", "i", "r")


QUERIES = {f.__name__: f for f in (
    heavy_atoms, wall_exclusions, focus_crop, margin_crop, region_mask, pooled_frames, rejoined_frames, landmark_points, record_radii, element_names, residue_classes, route_order, evidence_order, stick_rows, nearest_groups,
    typed_bridges, shell_lining, segment_lining, region_network, adjacency, network_similarity, ever_members, left_out_routes, group_hydration, frame_table, split_links, cell_images, boundary_shares, torsions, axis_positions,
    grid_checks, ladder_steps, field_voltages, text_hashes, frame_selection, frame_inspection, atom_records, lumen_crossings, strict_crossings, transit_summary, dwell_times, occupancy_histogram, narrow_minima,
)}

SLAB_SQL = f"{T.SERIES_SQL}, st AS (SELECT *, CASE WHEN s < {LOW} THEN 'below' WHEN s > {HIGH} THEN 'above' WHEN kind <> 'view' THEN 'inside' ELSE 'out' END AS state FROM series)"
RUNS_SQL = f"""{SLAB_SQL}, c AS (SELECT *, frame - row_number() OVER (PARTITION BY key, state ORDER BY frame) AS island FROM st),
r AS (SELECT key, state, min(frame) AS f, max(frame) AS l, count(*) AS frames FROM c GROUP BY key, state, island), v AS (SELECT *, lag(state) OVER w AS before, lead(state) OVER w AS after FROM r WINDOW w AS (PARTITION BY key ORDER BY f))"""
# straight steps from side to side, by the frame before
STRAIGHT = "SELECT key, l AS entry_frame, l + 1 AS exit_frame, CASE WHEN after = 'above' THEN 'up' ELSE 'down' END AS direction, 'unresolved_single_interval' AS status FROM v WHERE state IN ('below', 'above') AND after IN ('below', 'above')"
LUMEN_SQL = f"""{RUNS_SQL}, k AS (SELECT *, sum((state IN ('below', 'above'))::INT) OVER (PARTITION BY key ORDER BY f) AS turn FROM v),
p AS (SELECT key, turn, min(f) AS f, max(l) AS l, bool_or(state = 'inside') AS passed FROM k WHERE state IN ('inside', 'out') GROUP BY key, turn),
e AS (SELECT p.key, p.f AS entry_frame, p.l + 1 AS exit_frame, CASE WHEN b.state = 'above' THEN 'up' ELSE 'down' END AS direction, CASE WHEN passed THEN 'complete' ELSE 'outside_lumen' END AS status
  FROM p JOIN v a ON a.key = p.key AND a.l = p.f - 1 JOIN v b ON b.key = p.key AND b.f = p.l + 1 WHERE a.state IN ('below', 'above') AND b.state IN ('below', 'above') AND a.state <> b.state UNION ALL {STRAIGHT})"""
_BONDS = f"""{SITES_SQL}, p AS (SELECT a.id AS d, a.grp AS dg, b.id AS c, b.grp AS cg, {DIST} AS distance, sqrt((a.hx-b.x)**2+(a.hy-b.y)**2+(a.hz-b.z)**2) AS h, (a.x-a.hx)*(b.x-a.hx)+(a.y-a.hy)*(b.y-a.hy)+(a.z-a.hz)*(b.z-a.hz) AS dot, sqrt((a.x-a.hx)**2+(a.y-a.hy)**2+(a.z-a.hz)**2) AS u
  FROM sites a JOIN sites b ON a.grp <> b.grp AND sqrt((a.x-a.hx)**2+(a.y-a.hy)**2+(a.z-a.hz)**2) > 0.4 AND sqrt((a.x-a.hx)**2+(a.y-a.hy)**2+(a.z-a.hz)**2) <= 1.25 AND ((a.id % 2 = 0 AND b.grp = 9) OR (a.grp = 9 AND b.id % 2 = 1)) WHERE {DIST} <= 3.5 AND {DIST} > 1.2), q AS (SELECT *, degrees(acos(greatest(-1, least(1, dot / (u * h))))) AS angle FROM p WHERE h <= 2.5),
o AS (SELECT water, grp, arg_min(distance, (distance, angle, site)) AS distance, arg_min(angle, (distance, angle, site)) AS angle FROM (SELECT c AS water, dg AS grp, d AS site, distance, angle FROM q WHERE cg = 9 AND angle >= 110 UNION ALL SELECT d, cg, c, distance, angle FROM q WHERE dg = 9 AND angle >= 110) GROUP BY water, grp)"""


def _cell_sql():
    (ax, _, _), (bx, by, _), c = E.cell_vectors((2.0, 2.5, 3.0), (80.0, 95.0, 70.0))
    return f"""SELECT id, round(min(sqrt((x + i * {ax!r}::DOUBLE + j * {bx!r}::DOUBLE + k * {c[0]!r}::DOUBLE)**2 + (y + j * {by!r}::DOUBLE + k * {c[1]!r}::DOUBLE)**2 + (z + k * {c[2]!r}::DOUBLE)**2)), 6) AS size
      FROM sites, range(-6, 7) u(i), range(-6, 7) v(j), range(-6, 7) w(k) GROUP BY id"""


ORACLE_SQL = {
    "heavy_atoms": f"WITH {ATOMS_SQL} SELECT grp, element, count(*) AS n FROM atoms WHERE element <> 'H' AND NOT hetero GROUP BY ALL",
    "wall_exclusions": f"WITH {ATOMS_SQL} SELECT resname, count(*) AS excluded FROM atoms WHERE element = 'H' OR hetero GROUP BY ALL",
    "focus_crop": f"WITH {T.POINTS_SQL} SELECT id, grp FROM points a WHERE NOT hetero AND EXISTS (SELECT 1 FROM points b WHERE b.hetero AND {DIST} <= 0.05)",
    "margin_crop": f"WITH {T.POINTS_SQL}, m AS (SELECT min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS by_, min(z) AS az, max(z) AS bz FROM points WHERE grp = 0) SELECT grp, count(*) AS n FROM points, m WHERE grp = 0 OR (x BETWEEN ax + 0.05 AND bx - 0.05 AND y BETWEEN ay + 0.05 AND by_ - 0.05 AND z BETWEEN az + 0.05 AND bz - 0.05) GROUP BY grp",
    "region_mask": f"WITH {T.POINTS_SQL} SELECT id % 3 AS frame, sum((EXISTS (SELECT 1 FROM points b WHERE b.hetero AND {DIST} <= 0.06))::BIGINT)::BIGINT AS inside, count(*) AS n FROM points a WHERE NOT hetero GROUP BY ALL",
    "pooled_frames": f"WITH {T.POINTS_SQL} SELECT (grp >= 6)::BIGINT AS frame, count(*) AS n, min(id) AS least FROM points WHERE grp < 4 OR grp >= 6 GROUP BY ALL",
    "rejoined_frames": f"WITH {T.SERIES_SQL} SELECT key, frame, round(s * 2, 6) AS twice FROM series",
    "landmark_points": f"WITH {T.POINTS_SQL} SELECT id, grp, count(*) OVER (PARTITION BY grp) AS n FROM points",
    "record_radii": f"WITH {ATOMS_SQL} SELECT DISTINCT name, resname, CASE WHEN name = 'CA' AND resname = 'ALA' THEN 1.87 WHEN name LIKE 'C%' THEN 1.7 WHEN name = '1HB' THEN 1.0 WHEN name LIKE 'S%' AND resname LIKE 'S%' THEN 1.41 ELSE 1.5 END::DOUBLE AS radius FROM atoms",
    "element_names": f"""WITH {ATOMS_SQL} SELECT name, resname, CASE name WHEN 'CA' THEN 'C' WHEN '1HB' THEN 'H' WHEN 'SOD' THEN CASE WHEN resname = 'SOD' THEN 'NA' ELSE 'S' END WHEN 'FE' THEN 'FE' WHEN 'NA' THEN 'N' WHEN 'OG1' THEN 'O' WHEN 'CL2' THEN 'CL' ELSE 'C' END AS inferred, element AS given,
      name = 'SOD' AND resname = 'SOD' AS ion, count(*) AS n FROM atoms GROUP BY ALL""",
    "residue_classes": f"""WITH {ATOMS_SQL}, t AS (SELECT * FROM (VALUES ('ALA', ['hydrophobic', 'small']), ('ARG', ['positive']), ('ASP', ['negative']), ('SER', ['polar', 'small']), ('TYR', ['hydrophobic', 'polar', 'aromatic']), ('HIS', ['polar', 'positive', 'aromatic']), ('GLY', ['small']), ('HOH', ['other']), ('SOD', ['other']), ('PRO', ['hydrophobic'])) v(resname, kinds)),
      k AS (SELECT unnest(kinds) AS kind FROM atoms JOIN t USING (resname)) SELECT kind, count(*) AS n FROM k GROUP BY kind""",
    "route_order": f"WITH {T.POINTS_SQL} SELECT grp, id, row_number() OVER (PARTITION BY grp ORDER BY r DESC, round(abs(x), 2), id) - 1 AS place FROM points",
    "evidence_order": f"WITH {T.POINTS_SQL} SELECT grp, id::VARCHAR AS residue, row_number() OVER (PARTITION BY grp ORDER BY r DESC, round(abs(y), 1) DESC, id::VARCHAR) - 1 AS place FROM points",
    "stick_rows": f"WITH {T.POINTS_SQL} (SELECT id::VARCHAR AS residue, 'boundary_lining' AS role FROM points WHERE hetero ORDER BY id LIMIT 5) UNION ALL (SELECT id::VARCHAR, 'nonlocal_lining_partner' FROM points WHERE NOT hetero ORDER BY round(abs(y), 6) DESC, id::VARCHAR LIMIT 5)",
    "nearest_groups": f"""WITH {T.POINTS_SQL}, q AS (SELECT grp, count(*) AS points, min(sqrt(x * x + y * y + z * z)) AS g FROM points WHERE sqrt(x * x + y * y + z * z) <= 0.25 GROUP BY grp)
      SELECT grp, points, round(g, 6) AS min_gap, round(1 / (0.25::DOUBLE + g) + 0.15::DOUBLE * ln(2) + 0.25, 6) AS influence FROM q ORDER BY 1 / (0.25::DOUBLE + g) DESC, g, grp LIMIT 8""",
    "typed_bridges": f"WITH {_BONDS} SELECT m.water, m.grp AS a, n.grp AS b, round(greatest(m.distance, n.distance), 6) AS distance, round(least(m.angle, n.angle), 4) AS angle FROM o m JOIN o n ON m.water = n.water AND m.grp < n.grp",
    "shell_lining": f"""WITH {T.POINTS_SQL}, q AS (SELECT a.id AS sample, b.grp, {DIST} - b.r - greatest(a.r - 0.03::DOUBLE, 0) AS gap FROM points a JOIN points b ON a.hetero AND NOT b.hetero)
      SELECT grp, round(min(gap), 9) AS gap, arg_min(sample, (gap, sample)) AS sample, count(DISTINCT sample) AS samples FROM q WHERE gap <= 0.03 GROUP BY grp""",
    "segment_lining": f"""WITH {T.POINTS_SQL}, q AS (SELECT a.id % 3 AS segment, b.grp, b.id, min({DIST}) AS d FROM points a JOIN points b ON a.hetero AND NOT b.hetero WHERE {DIST} <= 0.06 GROUP BY ALL)
      SELECT segment, grp, round(min(d), 9) AS distance, arg_min(id, (d, id)) AS closest, count(*) AS atoms FROM q GROUP BY ALL""",
    "region_network": f"""WITH {T.POINTS_SQL}, e AS (SELECT least(a.grp, b.grp) AS s, greatest(a.grp, b.grp) AS t, min({DIST}) AS d FROM points a JOIN points b ON a.id < b.id AND a.grp <> b.grp AND NOT a.hetero AND NOT b.hetero WHERE {DIST} <= 0.04 GROUP BY ALL),
      n AS (SELECT s AS g FROM e UNION SELECT t FROM e), k AS (SELECT b.grp, min({DIST}) AS d, count(DISTINCT a.id) AS m FROM points a JOIN points b ON a.hetero AND NOT b.hetero WHERE {DIST} <= 0.06 GROUP BY b.grp)
      SELECT 'region:void:0' AS source, grp::VARCHAR AS target, 'region_lining' AS interaction, round(d, 6) AS distance, round(1 / (0.25::DOUBLE + d) + 0.15::DOUBLE * ln(1 + m) + 0.25, 6) AS weight FROM k WHERE grp IN (SELECT g FROM n)
      UNION ALL SELECT s::VARCHAR, t::VARCHAR, 'contact', round(d, 6), round(1 / (1 + d), 6) FROM e""",
    "adjacency": f"""WITH {T.POINTS_SQL}, e AS (SELECT DISTINCT a.grp AS s, b.grp AS t FROM points a JOIN points b ON a.grp <> b.grp WHERE {DIST} <= 0.05) SELECT s AS node, string_agg(t::VARCHAR, ',' ORDER BY t) AS neighbours FROM e GROUP BY s""",
    "network_similarity": f"""WITH {T.POINTS_SQL}, e AS (SELECT DISTINCT a.id % 4 AS f, least(a.grp, b.grp) || '-' || greatest(a.grp, b.grp) AS m FROM points a JOIN points b ON a.id % 4 = b.id % 4 AND a.id < b.id AND a.grp <> b.grp WHERE {DIST} <= 0.08),
      n AS (SELECT unnest([0, 1, 2, 3, 8, 9])::BIGINT AS f), c AS (SELECT n.f, count(m) AS k FROM n LEFT JOIN e USING (f) GROUP BY n.f), s AS (SELECT a.f AS a, b.f AS b, count(*) AS k FROM e a JOIN e b ON a.m = b.m AND a.f < b.f GROUP BY ALL)
      SELECT u.f AS a, v.f AS b, coalesce(s.k, 0) AS shared, CASE WHEN u.k + v.k = 0 THEN 1 ELSE round(coalesce(s.k, 0) / (u.k + v.k - coalesce(s.k, 0))::DOUBLE, 6) END AS jaccard FROM c u JOIN c v ON u.f < v.f LEFT JOIN s ON s.a = u.f AND s.b = v.f""",
    "ever_members": f"WITH {T.MEMBERS_SQL}, e AS (SELECT member, bool_or(frame = 0) AS l, bool_or(frame = 1) AS r FROM members WHERE frame < 2 GROUP BY member) SELECT CASE WHEN l AND r THEN 'both' WHEN l THEN 'left' ELSE 'right' END AS \"where\", count(*) AS n FROM e GROUP BY ALL",
    "left_out_routes": f"WITH {SITES_SQL} SELECT a.id FROM sites a WHERE a.id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM sites b WHERE b.id % 2 = 0 AND ({DIST} <= 0.5 OR sqrt((a.hx-b.hx)**2+(a.hy-b.hy)**2+(a.hz-b.hz)**2) <= 0.5))",
    "group_hydration": f"""WITH {T.POINTS_SQL}, q AS (SELECT a.id % 4 AS f, a.grp, count(DISTINCT b.id) AS n FROM points a JOIN points b ON a.id % 4 = b.id % 4 AND NOT a.hetero AND b.hetero WHERE {DIST} <= 0.1 GROUP BY ALL) SELECT grp, count(*) AS frames, round(count(*) / 4, 6) AS occupancy, round(sum(n) / 4, 6) AS mean_waters FROM q GROUP BY grp""",
    "frame_table": f"""WITH {T.POINTS_SQL}, e AS (SELECT DISTINCT a.id % 4 AS f, least(a.grp, b.grp) AS s, greatest(a.grp, b.grp) AS t FROM points a JOIN points b ON a.id % 4 = b.id % 4 AND a.id < b.id AND a.grp <> b.grp WHERE {DIST} <= 0.08), c AS (SELECT f, count(*) AS edges FROM e GROUP BY f),
      n AS (SELECT f, count(DISTINCT g) AS nodes FROM (SELECT f, s AS g FROM e UNION ALL SELECT f, t FROM e) GROUP BY f) SELECT id % 4 AS frame, any_value(edges) AS edges, any_value(nodes) AS nodes, round(min(r), 6) AS narrowest FROM points LEFT JOIN c ON c.f = id % 4 LEFT JOIN n ON n.f = id % 4 GROUP BY ALL""",
    "split_links": f"""WITH {SITES_SQL}, q AS (SELECT id, 2 * sqrt(x*x + y*y + z*z) AS raw, sqrt((2*x - 4 * round_even(x / 2, 0))**2 + (2*y - 4 * round_even(y / 2, 0))**2 + (2*z - 4 * round_even(z / 2, 0))**2) AS image FROM sites)
      SELECT id, round(raw, 6) AS raw, round(image, 6) AS image FROM q WHERE raw > 3 AND image < 2.5 AND raw > image + 0.5""",
    "cell_images": f"WITH {SITES_SQL} {_cell_sql()}",
    "boundary_shares": f"""WITH {T.POINTS_SQL}, q AS (SELECT a.id, b.grp, a.r * 2 AS area, {DIST} - b.r AS c FROM points a JOIN points b ON a.hetero AND NOT b.hetero WHERE {DIST} - b.r <= 0.1), t AS (SELECT DISTINCT id, grp, area FROM (SELECT *, min(c) OVER (PARTITION BY id) AS m FROM q) WHERE c <= m + 1e-7),
      s AS (SELECT grp, area / count(*) OVER (PARTITION BY id) AS part FROM t) SELECT grp, count(*) AS triangles, round(sum(part), 6) AS area FROM s GROUP BY grp""",
    "torsions": f"""WITH {SITES_SQL}, l AS (SELECT id, lead(x) OVER w - x AS ux, lead(y) OVER w - y AS uy, lead(z) OVER w - z AS uz, lead(x, 2) OVER w - lead(x) OVER w AS vx, lead(y, 2) OVER w - lead(y) OVER w AS vy, lead(z, 2) OVER w - lead(z) OVER w AS vz,
        lead(x, 3) OVER w - lead(x, 2) OVER w AS wx, lead(y, 3) OVER w - lead(y, 2) OVER w AS wy, lead(z, 3) OVER w - lead(z, 2) OVER w AS wz FROM sites WINDOW w AS (PARTITION BY grp ORDER BY id)),
      n AS (SELECT *, uy*vz-uz*vy AS nx, uz*vx-ux*vz AS ny, ux*vy-uy*vx AS nz, vy*wz-vz*wy AS mx, vz*wx-vx*wz AS my, vx*wy-vy*wx AS mz, sqrt(ux*ux+uy*uy+uz*uz) AS lu, sqrt(vx*vx+vy*vy+vz*vz) AS lv, sqrt(wx*wx+wy*wy+wz*wz) AS lw FROM l)
      SELECT id, round(degrees(atan2(((ny*mz-nz*my)*vx+(nz*mx-nx*mz)*vy+(nx*my-ny*mx)*vz) / lv, nx*mx+ny*my+nz*mz)), 5) AS angle FROM n WHERE lu BETWEEN 0.4 AND 2.2 AND lv BETWEEN 0.4 AND 2.2 AND lw BETWEEN 0.4 AND 2.2""",
    "axis_positions": f"WITH {T.POINTS_SQL} SELECT id, round(((x - 0.1) + (y - 0.1) * 2 + (z - 0.1) * 2) / 3, 9) AS s FROM points",
    "grid_checks": f"WITH {T.POINTS_SQL} SELECT CASE WHEN hetero THEN 'not_assessed' WHEN r < 0.03::DOUBLE THEN 'warning' ELSE 'ok' END AS status, count(*) AS n FROM points GROUP BY ALL",
    "ladder_steps": """WITH q AS (SELECT DISTINCT l_quantity::DOUBLE AS q FROM lineitem), l AS (SELECT unnest([1.0, 5.0, 12.5, 20.0, 45.0])::DOUBLE AS v)
      SELECT q, concat_ws(',', max(v) FILTER (v < q - 1e-9), min(v) FILTER (v > q + 1e-9)) AS next FROM q, l GROUP BY q""",
    "field_voltages": f"WITH {T.POINTS_SQL} SELECT id, CASE WHEN NOT hetero AND abs(z) / sqrt(x * x + z * z) >= sqrt(0.5) THEN round(1000 * r * 8 * sign(z), 6) END AS voltage FROM points",
    "text_hashes": "SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents",
    "frame_selection": f"WITH {T.SERIES_SQL} SELECT key, frame, s FROM series WHERE frame IN (1, 4, 7)",
    "frame_inspection": f"WITH {T.SERIES_SQL} SELECT count(DISTINCT frame) AS frames, min(frame) AS first, max(frame) AS last FROM series",
    "atom_records": f"WITH {T.POINTS_SQL} SELECT id::INT AS serial, 'CA' AS name, 'ALA' AS resname, 'A' AS chain, grp::INT AS resid, printf('%.3f', x * 100)::DOUBLE AS x, printf('%.3f', y * 100)::DOUBLE AS y, printf('%.3f', z * 100)::DOUBLE AS z, printf('%.2f', r * 100)::DOUBLE AS bfactor, 'A:ALA' || grp AS label FROM points",
    "lumen_crossings": f"WITH {LUMEN_SQL} SELECT * FROM e",
    "strict_crossings": f"""WITH {RUNS_SQL} SELECT key, f AS entry_frame, l + 1 AS exit_frame, CASE WHEN after = 'above' THEN 'up' ELSE 'down' END AS direction, 'complete' AS status FROM v WHERE state = 'inside' AND before IN ('below', 'above') AND after IN ('below', 'above') AND before <> after
      UNION ALL {STRAIGHT}""",
    "transit_summary": f"""WITH {LUMEN_SQL} SELECT key, count(*) FILTER (status = 'complete' AND direction = 'up') AS up, count(*) FILTER (status = 'complete' AND direction = 'down') AS down, up - down AS net, count(*) FILTER (status = 'outside_lumen') AS outside, count(*) FILTER (status = 'unresolved_single_interval') AS unresolved,
      round((up + down) / 50, 6) AS rate, round(avg(exit_frame - entry_frame) FILTER (status = 'complete'), 6) AS mean_transit, round(median(exit_frame - entry_frame) FILTER (status = 'complete'), 6) AS median_transit, min(exit_frame - entry_frame) FILTER (status = 'complete') AS least_transit, max(exit_frame - entry_frame) FILTER (status = 'complete') AS longest_transit FROM e GROUP BY key""",
    "dwell_times": f"WITH {RUNS_SQL} SELECT key, count(*) AS visits, count(*) FILTER (before IS NOT NULL AND after IS NOT NULL) AS whole, round(avg(frames) FILTER (before IS NOT NULL AND after IS NOT NULL), 6) AS mean_dwell FROM v WHERE state = 'inside' GROUP BY key",
    "occupancy_histogram": f"WITH {SLAB_SQL}, f AS (SELECT frame, count(DISTINCT key) FILTER (state = 'inside') AS n FROM st GROUP BY frame) SELECT n, count(*) AS frames FROM f GROUP BY n",
    "narrow_minima": f"""WITH {T.PROFILES_SQL}, n AS (SELECT *, lag(r) OVER w AS a, lead(r) OVER w AS b FROM profiles WINDOW w AS (PARTITION BY profile ORDER BY i)), h AS (SELECT *, (a IS NULL OR r <= a) AND (b IS NULL OR r <= b) AND r <= 8 AS hit FROM n),
      o AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY hit DESC, r, i) AS m FROM h) SELECT profile, i, r FROM o WHERE (hit OR m = 1) AND m <= 2""",
}
