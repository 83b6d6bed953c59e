"""Compositions: what the operators give together, from points to a report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.store import keep
from gridloom.operators import aggregates as A
from gridloom.operators import joins as J
from gridloom.operators import ordered as O
from gridloom.sources import tables as T


def contact_trajectory(points: DataFrame, cutoff: float, min_occupancy: float) -> DataFrame:
    """Contacts of groups in every frame, and those that hold in enough frames. ``points`` has a column frame."""
    edges = J.closest_contacts(points, cutoff, keys=["frame"]).withColumn("kind", F.when(F.col("distance") <= cutoff / 2, "close").otherwise("far"))
    nodes = points.select("frame", F.col("grp").alias("node")).distinct()
    return A.persistent_edges(keep(edges, "edges"), nodes, min_occupancy)


def static_report(points: DataFrame, cutoff: float) -> DataFrame:
    """One row for each group: size, extent, degree and summed weight in the contact network (0 without contacts)."""
    edges = keep(J.closest_contacts(points, cutoff), "edges")
    ends = edges.select(F.col("source").alias("grp"), "weight").unionByName(edges.select(F.col("target").alias("grp"), "weight"))
    network = ends.groupBy("grp").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))
    box = points.groupBy("grp").agg(F.count("*").alias("points"), *[(F.max(c) - F.min(c)).alias(f"extent_{c}") for c in "xyz"])
    return box.join(network, "grp", "left").fillna(0, ["degree", "strength"])


def passage_report(series: DataFrame, low: float, high: float) -> DataFrame:
    """For each key: passages either way, visits with uncensored dwell, and the share of frames inside."""
    events = O.crossing_summary(O.crossings(series, ["key"], low, high), ["key"]).where("key IS NOT NULL")
    state = F.when(F.col("s") < low, "below").when(F.col("s") > high, "above").otherwise("inside")
    named = series.withColumn("state", state)
    visits = O.runs(named, ["key"], "frame", "state", "t").where("state = 'inside'")
    dwell = visits.groupBy("key").agg(F.count("*").alias("visits"), F.avg(F.when(F.col("entered_from").isNotNull() & F.col("exited_to").isNotNull(), F.col("frames"))).alias("mean_dwell"))
    share = named.groupBy("key").agg(F.avg((F.col("state") == "inside").cast("double")).alias("inside_share"))
    return share.join(dwell, "key", "left").join(events, "key", "left").fillna(0, ["visits", "up", "down", "unresolved", "net"])


_r = lambda name, digits=6: F.round(name, digits).alias(name)
DIST = "sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))"


def frame_contacts(spark, d):
    points = T.points(spark, d).withColumn("frame", F.col("id") % 4)
    return contact_trajectory(points, 0.08, 0.5).select("source", "target", "kind", "contact_frames", "eligible_frames", _r("occupancy"), _r("mean_distance"))


def group_report(spark, d):
    return static_report(T.points(spark, d), 0.04).select("grp", "points", F.col("degree").cast("long").alias("degree"), _r("strength"), _r("extent_x"), _r("extent_y"), _r("extent_z"))


def passage_table(spark, d):
    out = passage_report(T.series(spark, d), 15.0, 70.0)
    return out.select("key", "visits", "up", "down", "unresolved", "net", _r("mean_dwell"), _r("inside_share"), _r("mean_transit"))


QUERIES = {f.__name__: f for f in (frame_contacts, group_report, passage_table)}
ORACLE_SQL = {
    "frame_contacts": f"""WITH {T.POINTS_SQL}, p AS (SELECT *, id % 4 AS frame FROM points), q AS (SELECT a.frame, least(a.grp, b.grp) AS source, greatest(a.grp, b.grp) AS target, min({DIST}) AS d FROM p a JOIN p b ON a.frame = b.frame AND a.id < b.id AND a.grp <> b.grp WHERE {DIST} <= 0.08 GROUP BY ALL),
      k AS (SELECT *, CASE WHEN d <= 0.04 THEN 'close' ELSE 'far' END AS kind FROM q), n AS (SELECT source, target, kind, row_number() OVER (PARTITION BY source, target ORDER BY count(*) DESC, kind) AS n FROM k GROUP BY source, target, kind), o AS (SELECT DISTINCT frame, grp FROM p),
      t AS (SELECT source, target, count(*) AS contact_frames, avg(d) AS m FROM k GROUP BY ALL), e AS (SELECT t.*, (SELECT count(*) FROM o a JOIN o b ON a.frame = b.frame WHERE a.grp = t.source AND b.grp = t.target) AS eligible_frames FROM t)
      SELECT e.source, e.target, kind, contact_frames, eligible_frames, round(contact_frames / eligible_frames::DOUBLE, 6) AS occupancy, round(m, 6) AS mean_distance FROM e JOIN n ON e.source = n.source AND e.target = n.target AND n.n = 1 WHERE contact_frames / eligible_frames::DOUBLE >= 0.5""",
    "group_report": f"""WITH {T.POINTS_SQL}, q AS (SELECT least(a.grp, b.grp) AS s, greatest(a.grp, b.grp) AS t, 1 / (1 + min({DIST})) AS w FROM points a JOIN points b ON a.id < b.id AND a.grp <> b.grp WHERE {DIST} <= 0.04 GROUP BY ALL), e AS (SELECT s AS grp, w FROM q UNION ALL SELECT t, w FROM q),
      n AS (SELECT grp, count(*) AS degree, sum(w) AS strength FROM e GROUP BY grp), b AS (SELECT grp, count(*) AS points, max(x) - min(x) AS ex, max(y) - min(y) AS ey, max(z) - min(z) AS ez FROM points GROUP BY grp)
      SELECT b.grp, points, coalesce(degree, 0) AS degree, round(coalesce(strength, 0), 6) AS strength, round(ex, 6) AS extent_x, round(ey, 6) AS extent_y, round(ez, 6) AS extent_z FROM b LEFT JOIN n ON b.grp = n.grp""",
    "passage_table": f"""WITH {T.SERIES_SQL}, st AS (SELECT *, CASE WHEN s < 15 THEN 'below' WHEN s > 70 THEN 'above' ELSE 'inside' END AS state FROM series), c AS (SELECT *, frame - row_number() OVER (PARTITION BY key, state ORDER BY frame) AS island FROM st),
      r AS (SELECT key, state, min(frame) AS f, count(*) AS frames FROM c GROUP BY key, state, island), v AS (SELECT *, lag(state) OVER w AS b, lead(state) OVER w AS a FROM r WINDOW w AS (PARTITION BY key ORDER BY f)),
      d AS (SELECT key, count(*) AS visits, avg(frames) FILTER (a IS NOT NULL AND b IS NOT NULL) AS dwell FROM v WHERE state = 'inside' GROUP BY key), i AS (SELECT key, avg((state = 'inside')::INT) AS share FROM st GROUP BY key),
      x AS (SELECT *, CASE WHEN s < 15 THEN -1 WHEN s > 70 THEN 1 END AS side FROM series), y AS (SELECT *, last_value(side IGNORE NULLS) OVER p AS ls, last_value(CASE WHEN side IS NOT NULL THEN frame END IGNORE NULLS) OVER p AS lf FROM x WINDOW p AS (PARTITION BY key ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      z AS (SELECT key, count(*) FILTER (frame > lf + 1 AND side = 1) AS up, count(*) FILTER (frame > lf + 1 AND side = -1) AS down, count(*) FILTER (frame = lf + 1) AS unresolved, avg(frame - lf - 1) FILTER (frame > lf + 1) AS transit FROM y WHERE side <> ls GROUP BY key)
      SELECT i.key, coalesce(visits, 0) AS visits, coalesce(up, 0) AS up, coalesce(down, 0) AS down, coalesce(unresolved, 0) AS unresolved, coalesce(up - down, 0) AS net, round(dwell, 6) AS mean_dwell, round(share, 6) AS inside_share, round(transit, 6) AS mean_transit FROM i LEFT JOIN d ON i.key = d.key LEFT JOIN z ON i.key = z.key""",
}
