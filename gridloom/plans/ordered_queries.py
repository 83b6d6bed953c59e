"""Queries on ordered frames, graphs, lattices and estimates, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import aggregates as A
from gridloom.operators import estimators as S
from gridloom.operators import graph as G
from gridloom.operators import joins as J
from gridloom.operators import ordered as O
from gridloom.operators import reduction as R
from gridloom.operators import tracking as K
from gridloom.sources import sinks
from gridloom.sources import tables as T

LOW, HIGH = 15.0, 70.0


def _r(name, digits=9):
    return F.round(name, digits).alias(name)


def _state(spark, d):
    state = F.when(F.col("s") < LOW, "below").when(F.col("s") > HIGH, "above").otherwise("inside")
    return T.series(spark, d).withColumn("state", state)


STATE_SQL = f"{T.SERIES_SQL}, st AS (SELECT *, CASE WHEN s < {LOW} THEN 'below' WHEN s > {HIGH} THEN 'above' ELSE 'inside' END AS state FROM series)"


def local_minima(spark, d):
    return O.local_minima(T.profiles(spark, d), ["profile"]).select("profile", "i", "r")


def state_transitions(spark, d):
    return O.transitions(_state(spark, d), ["key"], "frame", "state")


def state_dwell(spark, d):
    return O.dwell(_state(spark, d), ["key"], "state")


def state_visits(spark, d):
    """Runs in the slab, with the sides entered from and left to."""
    out = O.runs(_state(spark, d), ["key"], "frame", "state", "t").where("state = 'inside'")
    return out.select("key", F.col("first").alias("first_frame"), F.col("last").alias("last_frame"), "frames", "entered_from", "exited_to", _r("span", 3))


def member_episodes(spark, d):
    out = O.episodes(T.memberships(spark, d))
    return out.select("grp", "member", F.col("first").alias("first_frame"), F.col("last").alias("last_frame"), "frames", "left_censored", "right_censored")


def member_survival(spark, d):
    return O.survival(T.memberships(spark, d)).select("grp", "lag", "origins", _r("survival"))


def slab_crossings(spark, d):
    return O.crossings(T.series(spark, d), ["key"], LOW, HIGH).select("key", F.col("entry").alias("entry_frame"), F.col("exit").alias("exit_frame"), "direction", "status")


def crossing_summary(spark, d):
    out = O.crossing_summary(O.crossings(T.series(spark, d), ["key"], LOW, HIGH), ["key"])
    return out.select("key", "up", "down", "unresolved", "net", _r("mean_transit"))


def unwrapped_motion(spark, d):
    return O.unwrapped(T.series(spark, d).withColumn("s", F.col("s") % 100), ["key"], 100.0).select("key", "frame", _r("unwrapped", 6))


def net_passage(spark, d):
    return O.net_passage(T.series(spark, d), ["key"], LOW, HIGH).select("key", "frame", _r("net", 6))


def time_regularity(spark, d):
    return O.regularity(T.series(spark, d), ["key"], "t", 0.5)


def arc_lengths(spark, d):
    """Length of the polyline through the points of each group, in order of id."""
    out = O.arc_length(T.points(spark, d), ["grp"], "id")
    return out.select("grp", "id", _r("arc", 6))


def resampled_profiles(spark, d):
    return O.resample(T.profiles(spark, d), ["profile"], 0.75).select("profile", "g", F.col("at").alias("pos"), _r("value", 6))


def profile_bands(spark, d):
    return O.profile_distribution(T.profiles(spark, d), "profile", 0.75).select("g", "n", *[_r(c, 6) for c in ("coverage", "mean", "median", "q025", "q975")])


def lagged_states(spark, d):
    return O.lagged(T.series(spark, d), ["key"], "s", 30.0).select("key", "kind", "pairs", _r("mean_step", 6))


def value_correlation(spark, d):
    return O.guarded_corr(T.series(spark, d), ["key"], "frame", "s").select("key", "n", _r("correlation", 6))


def block_means(spark, d):
    return O.blocks(T.series(spark, d), ["key"], "s", 10).select("key", F.col("block").cast("long").alias("block"), "n", _r("mean", 6))


def as_of_values(spark, d):
    """Each view with the value of the user's latest purchase at or before it."""
    s = T.series(spark, d)
    out = J.as_of(s.where("kind <> 'purchase'").select("key", "frame", "s"), s.where("kind = 'purchase'").select("key", "frame", F.col("s").alias("paid")), "frame", ["key"], ["paid"])
    return out.select("key", "frame", "s", "paid", F.col("as_of").alias("paid_frame"), "held")


def lag_correlations(spark, d):
    out = S.lag_correlation(T.series(spark, d), ["key"], "frame", "s", 5)
    return out.select("key", *[_r(f"rho{k}", 6) for k in range(1, 6)])


def statistical_inefficiency(spark, d):
    return S.by_series(T.series(spark, d), ["key"], "frame", "s", "g double", S.statistical_inefficiency).select("key", _r("g", 6))


def autocorrelation_time(spark, d):
    return S.by_series(T.series(spark, d), ["key"], "frame", "s", "tau double", S.autocorrelation_time).select("key", _r("tau", 6))


def blocking_error(spark, d):
    return S.by_series(T.series(spark, d), ["key"], "frame", "s", "se double, level int", S.blocking_error).select("key", _r("se", 6), "level")


def sampling_uncertainty(spark, d):
    return S.by_series(T.series(spark, d), ["key"], "frame", "s", "status string, mean double, tau double, effective double, blocking_error double, interval_status string, low double, high double", S.sampling_uncertainty).select("key", "status", "interval_status", *[_r(c, 6) for c in ("mean", "tau", "effective", "blocking_error", "low", "high")])


def count_intervals(spark, d):
    """Exact and dispersion-widened intervals of each user's number of purchases."""
    events = T.series(spark, d).withColumn("hit", (F.col("kind") == "purchase").cast("double"))

    def both(x):
        low, high = S.poisson_interval(float(x.sum()))
        return (float(x.sum()), low, high, *S.dispersion_interval(x))

    return S.by_series(events, ["key"], "frame", "hit", "n double, low double, high double, dispersion double, wide_low double, wide_high double", both).select("key", *[_r(c, 6) for c in ("n", "low", "high", "dispersion", "wide_low", "wide_high")])


def diffusion(spark, d):
    n = O.net_passage(T.series(spark, d), ["key"], LOW, HIGH)
    return S.by_series(n, ["key"], "frame", "net", "status string, d double, low double, high double", lambda x: S.collective_diffusion(x, 1.0)).select("key", "status", *[_r(c, 6) for c in ("d", "low", "high")])


def feature_clusters(spark, d):
    """k-means of customers of each segment on balance and nation, first rows as first centres."""
    rows = T.table(spark, d, "customer").select("c_mktsegment", "c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("nation"))
    return R.clusters(rows, "c_mktsegment", "c_custkey", ["c_acctbal", "nation"], 4)


def _small_sets(spark, d):
    return T.memberships(spark, d).withColumn("grp", F.col("member") % 40)


def set_tracks(spark, d):
    """Identities of groups of users over days."""
    return K.track(_small_sets(spark, d))


def track_events(spark, d):
    return K.track(_small_sets(spark, d), "events").groupBy("event").agg(F.count("*").alias("n"), F.sum("gap").alias("gaps"))


def track_lineage(spark, d):
    """How each identity of groups of users began and ended, and what it came from and went into."""
    out = K.track(_small_sets(spark, d), "lineage")
    return out.select("track", "reason", F.col("first").alias("first_frame"), F.col("last").alias("last_frame"), "frames", F.array_join("parents", ",").alias("parents"), F.col("end").alias("end_reason"), "into")


def _near(spark, d, reach=0.06):
    p = T.points(spark, d)
    return p, J.range_join(p, p, reach).where("l_id < r_id").select(F.col("l_id").alias("a"), F.col("r_id").alias("b"), "distance")


NEAR = f"""{T.POINTS_SQL}, e AS (SELECT a.id AS a, b.id AS b, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS distance FROM points a JOIN points b ON a.id < b.id),
n AS (SELECT * FROM e WHERE distance <= 0.06), u AS (SELECT a, b, distance FROM n UNION ALL SELECT b, a, distance FROM n)"""


def point_components(spark, d):
    return G.point_components(T.points(spark, d), 0.045)


def component_sizes(spark, d):
    return G.ranked_components(G.point_components(T.points(spark, d), 0.045), 2, 5)


def point_triangles(spark, d):
    return G.local_clustering(_near(spark, d)[1])


def weighted_paths(spark, d):
    """Least cost from three points over edges of weight 1 / distance."""
    _, e = _near(spark, d)
    sources = spark.createDataFrame([(0,), (7,), (42,)], "node long")
    return G.shortest_paths(e.select("a", "b", (1 / F.col("distance")).alias("weight")), sources).select("node", _r("cost", 6))


def widest_paths(spark, d):
    """Greatest least width, 0.06 less the distance, from three points."""
    sources = spark.createDataFrame([(0,), (7,), (42,)], "node long")
    e = G.near_edges(T.points(spark, d), sources, 0.06)
    out = G.widest_paths(e.select("a", "b", (0.06 - F.col("distance")).alias("width"), "distance"), sources, length="distance")
    return out.where("hops > 0").select("node", _r("width"), _r("length"))


GRID_LOW, GRID_HIGH, STEP = (-0.2, -0.2, -0.2), (0.2, 0.2, 0.2), 0.05
GRID_SQL = f"""{T.POINTS_SQL}, g AS (SELECT (i * 81 + j * 9 + k)::BIGINT AS id, i, j, k, -0.2::DOUBLE + i * 0.05::DOUBLE AS x, -0.2::DOUBLE + j * 0.05::DOUBLE AS y, -0.2::DOUBLE + k * 0.05::DOUBLE AS z, i IN (0, 8) OR j IN (0, 8) OR k IN (0, 8) AS boundary
  FROM range(9) a(i), range(9) b(j), range(9) c(k)),
c AS (SELECT g.*, (SELECT min(sqrt((g.x-p.x)*(g.x-p.x)+(g.y-p.y)*(g.y-p.y)+(g.z-p.z)*(g.z-p.z)) - p.r) FROM points p) AS clearance FROM g)"""


def _field(spark, d):
    nodes = G.lattice(spark, GRID_LOW, GRID_HIGH, STEP)
    return G.clearance_field(nodes, T.points(spark, d).select("id", "x", "y", "z", "r"), 0.1)


def lattice_clearance(spark, d):
    return _field(spark, d).select("id", "i", "j", "k", "boundary", _r("clearance"))


def free_components(spark, d):
    out = G.free_components(_field(spark, d), 0.035, True)
    return out.select("id", "comp", "exterior")


def void_volumes(spark, d):
    return G.void_volumes(_field(spark, d), 0.045, STEP, enclosed=False).select("comp", "nodes", "exterior", _r("volume"), _r("radius"))


def plane_sections(spark, d):
    return G.sections(_field(spark, d), 0.02, STEP).select("k", "cells", _r("area"), _r("diameter"), _r("widest"))


def ray_enclosure(spark, d):
    out = G.enclosure(_field(spark, d), 0.02)
    return out.select("id", F.col("hits").cast("long").alias("hits"))


def octant_coverage(spark, d):
    p = T.points(spark, d)
    return G.octants(p.where("hetero").select("id", "x", "y", "z"), p.where("NOT hetero").select("id", "x", "y", "z"), 0.12)


def json_records(spark, d):
    return sinks.enveloped(T.table(spark, d, "region").select("r_regionkey", "r_name"), "region")


def long_statistics(spark, d):
    stats = A.describe(T.series(spark, d), ["kind"], "s").select("kind", "n", "mean", "median")
    return sinks.long_statistics(stats, ["kind"]).select("kind", "statistic", _r("value", 6))


QUERIES = {f.__name__: f for f in (
    local_minima, state_transitions, state_dwell, state_visits, member_episodes, member_survival, slab_crossings, crossing_summary, unwrapped_motion, net_passage, time_regularity, arc_lengths, resampled_profiles, profile_bands,
    lagged_states, value_correlation, block_means, as_of_values, lag_correlations, statistical_inefficiency, autocorrelation_time, blocking_error, sampling_uncertainty, count_intervals, diffusion, feature_clusters, set_tracks, track_events, track_lineage,
    point_components, component_sizes, point_triangles, weighted_paths, widest_paths, lattice_clearance, free_components, void_volumes, plane_sections, ray_enclosure, octant_coverage, json_records, long_statistics,
)}

_W = "WINDOW w AS (PARTITION BY key ORDER BY frame)"
CROSS_SQL = f"""{T.SERIES_SQL}, a AS (SELECT *, CASE WHEN s < {LOW} THEN -1 WHEN s > {HIGH} THEN 1 END AS side FROM series),
b AS (SELECT *, last_value(side IGNORE NULLS) OVER p AS last_side, last_value(CASE WHEN side IS NOT NULL THEN frame END IGNORE NULLS) OVER p AS last_at FROM a WINDOW p AS (PARTITION BY key ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT key, CASE WHEN frame = last_at + 1 THEN last_at ELSE last_at + 1 END AS entry_frame, frame AS exit_frame, CASE WHEN side = 1 THEN 'up' ELSE 'down' END AS direction, CASE WHEN frame = last_at + 1 THEN 'unresolved_single_interval' ELSE 'complete' END AS status FROM b WHERE side <> last_side)"""
COMPONENTS_SQL = """WITH RECURSIVE {0}, e2 AS (SELECT a, b FROM u WHERE distance <= 0.045), r AS (SELECT id AS node, id AS comp FROM points UNION SELECT e2.b, r.comp FROM r JOIN e2 ON e2.a = r.node), l AS (SELECT node, min(comp) AS comp FROM r GROUP BY node)""".format(NEAR)
RESAMPLE_SQL = f"""{T.PROFILES_SQL}, l AS (SELECT *, lead(s) OVER w AS s2, lead(r) OVER w AS r2 FROM profiles WINDOW w AS (PARTITION BY profile ORDER BY i)),
q AS (SELECT *, unnest(range(ceil(s / 0.75)::BIGINT, CASE WHEN s2 IS NULL THEN floor(s / 0.75)::BIGINT + 1 ELSE ceil(s2 / 0.75)::BIGINT END)) AS g FROM l),
v AS (SELECT profile, g, g * 0.75::DOUBLE AS pos, CASE WHEN s2 IS NULL THEN r ELSE r + (r2 - r) * ((g * 0.75::DOUBLE - s) / (s2 - s)) END AS value FROM q)"""
FREE_SQL = """WITH RECURSIVE {0}, f AS (SELECT * FROM c WHERE clearance >= {{probe}}), n AS (SELECT a.id AS a, b.id AS b FROM f a JOIN f b ON a.id <> b.id AND {{near}}),
r AS (SELECT id AS node, id AS comp FROM f UNION SELECT n.b, r.comp FROM r JOIN n ON n.a = r.node), l AS (SELECT node AS id, min(comp) AS comp FROM r GROUP BY node),
o AS (SELECT f.*, comp, bool_or(boundary) OVER (PARTITION BY comp) AS exterior FROM f JOIN l USING (id))""".format(GRID_SQL)
FACES = "abs(a.i-b.i)+abs(a.j-b.j)+abs(a.k-b.k) = 1"
ALL = "abs(a.i-b.i) <= 1 AND abs(a.j-b.j) <= 1 AND abs(a.k-b.k) <= 1"
_LINES = [(u, v, w) for u in (-1, 0, 1) for v in (-1, 0, 1) for w in (-1, 0, 1) if (u, v, w) != (0, 0, 0)]

#: 99 % points of chi-squared with 1, 2, ... degrees of freedom.
CHI2_99 = [6.634896601021213, 9.210340371976182, 11.344866730144373, 13.276704135987622, 15.08627246938899, 16.811893829770927, 18.475306906582357, 20.090235029663233, 21.665994333461924, 23.209251158954356]
LAGS_SQL = f"""{T.SERIES_SQL}, dv AS (SELECT key, frame, s - avg(s) OVER (PARTITION BY key) AS d, count(*) OVER (PARTITION BY key) AS n FROM series),
cv AS (SELECT a.key, b.frame - a.frame AS k, sum(a.d * b.d) AS c, any_value(a.n) AS n FROM dv a JOIN dv b ON a.key = b.key AND b.frame >= a.frame GROUP BY ALL),
rh AS (SELECT cv.key, cv.k, CASE WHEN z.c > 0 THEN cv.c / z.c ELSE (cv.k = 0)::INT END AS rho, cv.n FROM cv JOIN cv z ON z.key = cv.key AND z.k = 0)"""
START = "SELECT * FROM (VALUES (0::BIGINT, {0}::DOUBLE), (7, {0}), (42, {0}))"
NET_SQL = f"""{T.SERIES_SQL}, mm AS (SELECT key, frame, greatest({LOW}, least({HIGH}, s)) AS c FROM series), qq AS (SELECT key, frame, coalesce(c - lag(c) OVER w, 0) AS q FROM mm {_W}), nn AS (SELECT key, frame, sum(q) OVER w / {HIGH - LOW} AS net, count(*) OVER (PARTITION BY key) AS n FROM qq {_W})"""

ORACLE_SQL = {
    "statistical_inefficiency": f"""WITH {LAGS_SQL}, p AS (SELECT a.key, a.k, a.rho + b.rho AS pair FROM rh a JOIN rh b ON a.key = b.key AND b.k = a.k + 1 WHERE a.k % 2 = 1 AND a.k < a.n // 2), q AS (SELECT *, min(CASE WHEN pair <= 0 THEN k END) OVER (PARTITION BY key) AS stop FROM p),
      t AS (SELECT key, sum(pair) FILTER (stop IS NULL OR k < stop) AS total FROM q GROUP BY key) SELECT r.key, round(greatest(1, least(r.n, 1 + 2 * coalesce(total, 0))), 6)::DOUBLE AS g FROM rh r LEFT JOIN t USING (key) WHERE r.k = 0""",
    "autocorrelation_time": f"""WITH {LAGS_SQL}, q AS (SELECT key, k, n, 2 * sum(rho) OVER (PARTITION BY key ORDER BY k) - 1 AS tau FROM rh)
      SELECT key, round(greatest(1, least(any_value(n), coalesce(arg_min(tau, k) FILTER (k >= 5 * tau), arg_max(tau, k)))), 6)::DOUBLE AS tau FROM q GROUP BY key""",
    "blocking_error": f"""WITH RECURSIVE {T.SERIES_SQL}, b AS (SELECT key, 0 AS lv, list(s ORDER BY frame) AS x FROM series GROUP BY key UNION ALL SELECT key, lv + 1, list_transform(range(1, len(x) // 2 + 1), lambda i: (x[2 * i - 1] + x[2 * i]) / 2) FROM b WHERE len(x) >= 4),
      m AS (SELECT *, list_avg(x) AS m, len(x) AS n FROM b WHERE len(x) >= 2), v AS (SELECT key, lv, n, list_avg(list_transform(x, lambda u: (u - m) * (u - m))) AS s, list_sum(list_transform(range(1, n), lambda i: (x[i] - m) * (x[i + 1] - m))) / n AS g FROM m),
      t AS (SELECT *, sum(CASE WHEN s > 0 THEN n * (g / s) * (g / s) ELSE 0 END) OVER (PARTITION BY key ORDER BY lv DESC) AS stat, max(lv) OVER (PARTITION BY key) AS top FROM v),
      o AS (SELECT *, coalesce(min(CASE WHEN stat < ({CHI2_99})[lv + 1] THEN lv END) OVER (PARTITION BY key), top) AS pick FROM t) SELECT key, round(sqrt(s / n), 6) AS se, lv AS level FROM o WHERE lv = pick""",
    "diffusion": f"""WITH {NET_SQL}, h AS (SELECT *, n // 5 AS seg, greatest(2, n // 5 // 10) AS hi FROM nn), p AS (SELECT key, -1 AS part, frame, net, hi FROM h UNION ALL SELECT key, frame // seg, frame, net, hi FROM h WHERE seg >= 2 * hi + 2 AND frame // seg < 5),
      m AS (SELECT a.key, a.part, b.frame - a.frame AS lag, avg((b.net - a.net) * (b.net - a.net)) AS msd FROM p a JOIN p b ON a.key = b.key AND a.part = b.part AND b.frame - a.frame BETWEEN 1 AND a.hi GROUP BY ALL), v AS (SELECT key, part, regr_slope(msd, lag) / 2 AS d FROM m GROUP BY ALL),
      e AS (SELECT key, any_value(d) FILTER (part = -1) AS d, 2.7764451051977987::DOUBLE * stddev_samp(d) FILTER (part >= 0) / sqrt(5) AS half FROM v GROUP BY key), f AS (SELECT key, any_value(n) AS n, any_value(hi) AS hi FROM h GROUP BY key)
      SELECT f.key, CASE WHEN n < 2 * hi + 2 THEN 'insufficient_frames' ELSE 'estimated' END AS status, CASE WHEN n >= 2 * hi + 2 THEN round(d, 6) END AS d, CASE WHEN n >= 2 * hi + 2 AND half IS NOT NULL THEN round(greatest(0, d - half), 6) END AS low, CASE WHEN n >= 2 * hi + 2 THEN round(d + half, 6) END AS high FROM f LEFT JOIN e USING (key)""",
    "weighted_paths": f"""WITH RECURSIVE {NEAR}, t(node, cost) USING KEY (node) AS ({START.format('0.0')} UNION SELECT u.b, min(t.cost + u.distance) FROM t JOIN u ON u.a = t.node LEFT JOIN recurring.t r ON r.node = u.b WHERE r.cost IS NULL OR t.cost + u.distance < r.cost GROUP BY u.b)
      SELECT node, round(cost, 6) AS cost FROM t""",
    "widest_paths": f"""WITH RECURSIVE {NEAR}, t(node, wide) USING KEY (node) AS ({START.format("'inf'")} UNION SELECT u.b, max(least(t.wide, 0.06::DOUBLE - u.distance)) FROM t JOIN u ON u.a = t.node LEFT JOIN recurring.t r ON r.node = u.b WHERE r.wide IS NULL OR least(t.wide, 0.06::DOUBLE - u.distance) > r.wide GROUP BY u.b),
      g AS MATERIALIZED (SELECT u.a, u.b, u.distance FROM u JOIN t x ON x.node = u.a JOIN t y ON y.node = u.b WHERE least(x.wide, 0.06::DOUBLE - u.distance) = y.wide),
      l(node, far) USING KEY (node) AS ({START.format('0.0')} UNION SELECT g.b, min(l.far + g.distance) FROM l JOIN g ON g.a = l.node LEFT JOIN recurring.l r ON r.node = g.b WHERE r.far IS NULL OR l.far + g.distance < r.far GROUP BY g.b)
      SELECT t.node, round(wide, 9) AS width, round(far, 9) AS length FROM t JOIN l ON l.node = t.node WHERE t.node NOT IN (0, 7, 42)""",
    "local_minima": f"WITH {T.PROFILES_SQL}, n AS (SELECT *, lag(r) OVER w AS a, lead(r) OVER w AS b FROM profiles WINDOW w AS (PARTITION BY profile ORDER BY i)) SELECT profile, i, r FROM n WHERE (a IS NULL OR r <= a) AND (b IS NULL OR r <= b)",
    "state_transitions": f"WITH {STATE_SQL}, l AS (SELECT key, frame, lag(state) OVER w AS from_label, state AS to_label FROM st {_W}) SELECT * FROM l WHERE from_label <> to_label",
    "state_dwell": f"WITH {STATE_SQL} SELECT key, state, count(*) AS frames FROM st GROUP BY ALL",
    "state_visits": f"""WITH {STATE_SQL}, c AS (SELECT *, frame - row_number() OVER (PARTITION BY key, state ORDER BY frame) AS island FROM st),
      r AS (SELECT key, state, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS frames, max(t) - min(t) AS span FROM c GROUP BY key, state, island),
      v AS (SELECT *, lag(state) OVER (PARTITION BY key ORDER BY first_frame) AS entered_from, lead(state) OVER (PARTITION BY key ORDER BY first_frame) AS exited_to FROM r)
      SELECT key, first_frame, last_frame, frames, entered_from, exited_to, round(span, 3) AS span FROM v WHERE state = 'inside'""",
    "member_episodes": f"""WITH {T.MEMBERS_SQL}, c AS (SELECT *, frame - row_number() OVER (PARTITION BY grp, member ORDER BY frame) AS island FROM members)
      SELECT grp, member, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS frames, min(frame) = (SELECT min(frame) FROM members) AS left_censored, max(frame) = (SELECT max(frame) FROM members) AS right_censored FROM c GROUP BY grp, member, island""",
    "member_survival": f"""WITH {T.MEMBERS_SQL}, c AS (SELECT *, frame - row_number() OVER (PARTITION BY grp, member ORDER BY frame) AS island FROM members), e AS (SELECT *, max(frame) OVER (PARTITION BY grp, member, island) AS last FROM c),
      l AS (SELECT grp, lag, frame, avg((last >= frame + lag)::INT) AS share FROM e, range(21) t(lag) WHERE frame + lag <= (SELECT max(frame) FROM members) GROUP BY ALL)
      SELECT grp, lag, count(*) AS origins, round(avg(share), 9) AS survival FROM l GROUP BY ALL""",
    "slab_crossings": f"WITH {CROSS_SQL} SELECT * FROM x",
    "crossing_summary": f"""WITH {CROSS_SQL} SELECT key, count(*) FILTER (status = 'complete' AND direction = 'up') AS up, count(*) FILTER (status = 'complete' AND direction = 'down') AS down, count(*) FILTER (status <> 'complete') AS unresolved,
      up - down AS net, round(avg(exit_frame - entry_frame) FILTER (status = 'complete'), 9) AS mean_transit FROM x GROUP BY ROLLUP (key)""",
    "unwrapped_motion": f"WITH {T.SERIES_SQL}, m AS (SELECT key, frame, s % 100 AS s FROM series), q AS (SELECT key, frame, s, s - lag(s) OVER w AS q FROM m {_W}) SELECT key, frame, round(sum(coalesce(q - 100::DOUBLE * round_even(q / 100::DOUBLE, 0), s)) OVER w, 6) AS unwrapped FROM q {_W}",
    "net_passage": f"WITH {T.SERIES_SQL}, m AS (SELECT key, frame, greatest({LOW}, least({HIGH}, s)) AS c FROM series), q AS (SELECT key, frame, coalesce(c - lag(c) OVER w, 0) AS q FROM m {_W}) SELECT key, frame, round(sum(q) OVER w / {HIGH - LOW}, 6) AS net FROM q {_W}",
    "time_regularity": f"""WITH {T.SERIES_SQL}, q AS (SELECT key, frame, t - lag(t) OVER w AS q FROM series {_W}), f AS (SELECT *, first_value(q IGNORE NULLS) OVER (PARTITION BY key ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f FROM q)
      SELECT key, coalesce(max(abs(q - f) / abs(f)), 0) <= 0.5 AS regular, coalesce(min(q) > 0, true) AS increasing FROM f GROUP BY key""",
    "arc_lengths": f"""WITH {T.POINTS_SQL}, q AS (SELECT grp, id, coalesce(sqrt((x - lag(x) OVER w)**2 + (y - lag(y) OVER w)**2 + (z - lag(z) OVER w)**2), 0) AS q FROM points WINDOW w AS (PARTITION BY grp ORDER BY id)) SELECT grp, id, round(sum(q) OVER (PARTITION BY grp ORDER BY id), 6) AS arc FROM q""",
    "resampled_profiles": f"WITH {RESAMPLE_SQL} SELECT profile, g, pos, round(value, 6) AS value FROM v",
    "profile_bands": f"WITH {RESAMPLE_SQL} SELECT g, count(*) AS n, round(count(*) / (SELECT count(DISTINCT profile) FROM profiles)::DOUBLE, 6) AS coverage, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.025), 6) AS q025, round(quantile_cont(value, 0.975), 6) AS q975 FROM v GROUP BY g",
    "lagged_states": f"""WITH {T.SERIES_SQL}, p AS (SELECT key, s, lead(s) OVER w AS n FROM series {_W})
      SELECT key, CASE WHEN s >= 30 AND n >= 30 THEN 'wet' WHEN s < 30 AND n < 30 THEN 'dry' ELSE 'changed' END AS kind, count(*) AS pairs, round(avg(abs(n - s)), 6) AS mean_step FROM p WHERE n IS NOT NULL GROUP BY ALL""",
    "value_correlation": f"WITH {T.SERIES_SQL} SELECT key, count(*) AS n, CASE WHEN count(*) >= 3 AND least(stddev_pop(frame), stddev_pop(s)) > 1e-10 THEN round(corr(frame, s), 6) END AS correlation FROM series GROUP BY key",
    "block_means": f"WITH {T.SERIES_SQL}, b AS (SELECT key, s, ntile(10) OVER w - 1 AS block FROM series {_W}) SELECT key, block, count(*) AS n, round(avg(s), 6) AS mean FROM b GROUP BY ALL",
    "as_of_values": f"""WITH {T.SERIES_SQL}, p AS (SELECT key, frame, s AS paid FROM series WHERE kind = 'purchase'), v AS (SELECT key, frame, s FROM series WHERE kind <> 'purchase'),
      l AS (SELECT v.*, p.frame AS pf, p.paid FROM v ASOF LEFT JOIN p ON v.key = p.key AND v.frame >= p.frame), f AS (SELECT key, min(frame) AS ff, arg_min(paid, frame) AS fp FROM p GROUP BY key)
      SELECT l.key, frame, s, coalesce(paid, fp) AS paid, coalesce(pf, ff) AS paid_frame, coalesce(pf, ff) <> frame AS held FROM l LEFT JOIN f ON l.key = f.key""",
    "lag_correlations": f"""WITH {T.SERIES_SQL}, m AS (SELECT key, frame, s - avg(s) OVER (PARTITION BY key) AS d FROM series), l AS (SELECT key, d, {', '.join(f'lead(d, {k}) OVER w AS l{k}' for k in range(1, 6))} FROM m {_W})
      SELECT key, {', '.join(f'round(coalesce(sum(d * l{k}), 0) / sum(d * d), 6) AS rho{k}' for k in range(1, 6))} FROM l GROUP BY key""",
    "point_components": f"{COMPONENTS_SQL} SELECT node, comp FROM l",
    "component_sizes": f"{COMPONENTS_SQL} SELECT comp, count(*) AS size FROM l GROUP BY comp HAVING count(*) >= 2 ORDER BY size DESC, comp LIMIT 5",
    "point_triangles": f"WITH {NEAR}, t AS (SELECT p.a AS x, p.b AS y, q.b AS z FROM n p JOIN n q ON p.b = q.a JOIN n r ON r.a = p.a AND r.b = q.b) SELECT node, count(*) AS triangles FROM (SELECT unnest([x, y, z]) AS node FROM t) GROUP BY node",
    "lattice_clearance": f"WITH {GRID_SQL} SELECT id, i, j, k, boundary, round(clearance, 9) AS clearance FROM c",
    "free_components": FREE_SQL.format(probe=0.035, near=FACES) + " SELECT id, comp, exterior FROM o",
    "void_volumes": FREE_SQL.format(probe=0.045, near=ALL) + " SELECT comp, count(*) AS nodes, bool_or(boundary) AS exterior, round(count(*) * 0.05::DOUBLE**3, 9) AS volume, round(max(clearance), 9) AS radius FROM o GROUP BY comp",
    "plane_sections": f"WITH {GRID_SQL} SELECT k, count(*) AS cells, round(count(*) * 0.0025::DOUBLE, 9) AS area, round(2 * sqrt(count(*) * 0.0025::DOUBLE / pi()), 9) AS diameter, round(max(clearance), 9) AS widest FROM c WHERE clearance >= 0.02 GROUP BY k",
    "ray_enclosure": f"WITH {GRID_SQL}, d AS (SELECT * FROM (VALUES {', '.join(map(str, _LINES))}) v(u, v, w)) SELECT a.id, (SELECT count(*) FROM d WHERE EXISTS (SELECT 1 FROM c b, range(1, 9) t(n) WHERE b.clearance < 0.02 AND b.i = a.i + n * u AND b.j = a.j + n * v AND b.k = a.k + n * w)) AS hits FROM c a WHERE a.clearance >= 0.02",
    "octant_coverage": f"WITH {T.POINTS_SQL} SELECT b.id, count(DISTINCT (a.x >= b.x)::INT + 2 * (a.y >= b.y)::INT + 4 * (a.z >= b.z)::INT) AS octants FROM points a JOIN points b ON NOT a.hetero AND b.hetero WHERE sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) <= 0.12 GROUP BY b.id",
    "json_records": """SELECT '{"schema_version":"0.1","kind":"region","data":{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}}' AS value FROM region""",
    "long_statistics": f"WITH {T.SERIES_SQL}, d AS (SELECT kind, count(*)::DOUBLE AS n, avg(s) AS mean, quantile_cont(s, 0.5) AS median FROM series GROUP BY kind) SELECT kind, statistic, round(value, 6) AS value FROM (UNPIVOT d ON n, mean, median INTO NAME statistic VALUE value)",
}
