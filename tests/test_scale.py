"""What keeps jobs bounded as tables grow, and that results stay those of the plain rule."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import aggregates as A
from gridloom.operators import blocks as B
from gridloom.operators import cast as K
from gridloom.operators import contacts as C
from gridloom.operators import estimators as S
from gridloom.operators import graph as G
from gridloom.operators import joins as J
from gridloom.sources import sinks
from gridloom.sources import tables as T


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cross_correlation_meets_blocks_not_rows(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_ROWS", 32)
    monkeypatch.setattr(B, "STRIP_PAIRS", 500)
    rng = np.random.default_rng(1)
    rows = [(f, n, *map(float, rng.normal(size=3))) for f in range(5) for n in range(100) if rng.random() < 0.8]
    rows += [(0, 200, None, 1.0, 2.0), (1, 200, 1.0, 1.0, 2.0), (2, 200, 4.0, 1.0, 2.0), (3, 200, 0.0, 1.0, 2.5), (0, None, 1.0, 1.0, 1.0), (None, 3, 1.0, 1.0, 1.0)]
    f = spark.createDataFrame(rows, "frame long, node long, x double, y double, z double")
    got = A.cross_correlation(f)
    plan = plan_of(got)
    assert "MapInArrow" in plan and plan.count("Join") == 3  # of blocks, not of frames
    con = duckdb.connect()
    con.register("t", f.where("frame IS NOT NULL AND node IS NOT NULL").toPandas())
    want = con.sql("""WITH m AS (SELECT node, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM t GROUP BY node), o AS (SELECT frame, node, x - mx AS dx, y - my AS dy, z - mz AS dz FROM t JOIN m USING (node)),
      p AS (SELECT a.node AS a, b.node AS b, count(*) AS frames, avg(a.dx*b.dx+a.dy*b.dy+a.dz*b.dz) AS ab, avg(a.dx*a.dx+a.dy*a.dy+a.dz*a.dz) AS aa, avg(b.dx*b.dx+b.dy*b.dy+b.dz*b.dz) AS bb FROM o a JOIN o b ON a.frame = b.frame AND a.node < b.node GROUP BY ALL)
      SELECT a, b, frames, CASE WHEN frames >= 3 AND aa >= 1e-12 AND bb >= 1e-12 THEN greatest(-1, least(1, ab / sqrt(aa * bb))) END AS c FROM p ORDER BY a, b""").fetchall()
    have = sorted(map(tuple, got.collect()))
    assert [r[:3] for r in have] == [r[:3] for r in want]
    for g, w in zip(have, want, strict=True):
        assert (g[3] is None) == (w[3] is None or math.isnan(w[3])) and (g[3] is None or g[3] == pytest.approx(w[3], abs=1e-9))


def test_atom_records_hold_long_numbers(spark):
    numbers = [0, 1, 99_999, 100_000, 100_001, 615_000, 43_770_015, 43_770_016, 87_440_031, -12, None]
    resid = [1, 9_999, 10_000, 1_223_055, 1_223_056, 2_436_111, 7, 8, 9, -5, None]
    p = spark.createDataFrame(list(zip(numbers, resid, strict=True)), "n int, k int")
    one = F.lit(1.0)
    text = p.select("n", "k", sinks.atom_record(F.col("n"), F.lit("CA"), F.lit("ALA"), F.lit("A"), F.col("k"), one, one, one, one).alias("value"))
    assert {len(r.value) for r in text.where("n IS NOT NULL").collect()} == {66}
    back = T.fixed_columns(text.where("n IS NOT NULL")).select("serial", "resid", "x")
    assert sorted(map(tuple, back.collect())) == sorted((n, k, 1.0) for n, k in zip(numbers[:-1], resid[:-1], strict=True))
    assert text.where("n = 100000").first().value[6:11] == "A0000" and text.where("n = 43770016").first().value[6:11] == "a0000"
    with pytest.raises(Exception, match="no number of 5 columns"):
        spark.range(1).select(sinks.fixed_number(F.lit(87_440_032), 5)).collect()


def test_bridges_shuffle_no_pairs(spark):
    rows = [(s, v) for v in range(30) for s in range(0, 40, v % 5 + 1)] * 2 + [(None, 1), (3, None)]
    got = J.bridges(spark.createDataFrame(rows, "site long, via long"), "site", "via")
    assert "Join" not in plan_of(got)
    want = {}
    for v in range(30):
        held = sorted(set(range(0, 40, v % 5 + 1)))
        for i, a in enumerate(held):
            for b in held[i + 1 :]:
                want[a, b] = want.get((a, b), 0) + 1
    assert {(r.a, r.b): r.shared for r in got.collect()} == want


def test_series_intervals_work_out_what_they_give(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=80)
    full = S.block_mean_bands(x[:, None])
    asked = []
    monkeypatch.setattr(S, "t_quantile", lambda p, k, f=S.t_quantile: asked.append(p) or f(p, k))
    got = S.series_interval(x)
    assert (got["status"], got["low"], got["high"]) == ("estimated", full["low"][0], full["high"][0])
    assert len(asked) == 1 and S.t_quantile(0.975, 5.0) == pytest.approx(2.570582, abs=1e-6)
    rows = spark.range(40).selectExpr("id % 4 AS key", "id AS frame", "double(id) AS s")
    assert "REPARTITION_BY_NUM" in plan_of(S.by_series(rows, ["key"], "frame", "s", "mean double", lambda v: (float(v.mean()),)))


def cloud(spark, n, seed=0, spread=1.0):
    """Dense points with groups and radii, and one far off."""
    rng = np.random.default_rng(seed)
    p = rng.normal(size=(n, 3)) * spread
    p[-1] = (40.0, 0.0, 0.0)
    rows = [(i, i % 4, *map(float, p[i]), 0.1 + 0.1 * (i % 3), i % 3 - 1) for i in range(n)]
    return spark.createDataFrame(rows, "id long, grp long, x double, y double, z double, r double, charge long").localCheckpoint(), p


def reaches(monkeypatch, *modules):
    """The reaches that joins by distance are asked for."""
    asked = []
    true = J.range_join
    for m in modules:
        monkeypatch.setattr(m, "range_join", lambda left, right, reach, keys=(): asked.append(reach) or true(left, right, reach, keys))
    return asked


def test_segments_have_their_clearance_however_far(spark):
    df, p = cloud(spark, 600)
    ends = [(0, 0, 0, 0, 1, 1, 1), (1, 60, 0, 0, 60, 5, 0), (2, 1, 1, 1, 1, 1, 1), (3, -9, 0, 0, 9, 0, 0)]
    segments = spark.createDataFrame([(i, *map(float, e)) for i, *e in ends], "id long, ax double, ay double, az double, bx double, by double, bz double")
    got = {r.id: r.clearance for r in J.segment_clearances(segments, df).collect()}
    r = 0.1 + 0.1 * (np.arange(600) % 3)
    for i, *e in ends:
        a, b = np.array(e[:3], float), np.array(e[3:], float)
        k = np.clip((p - a) @ (b - a) / max(1e-300, (b - a) @ (b - a)), 0, 1)
        assert got[i] == pytest.approx((np.linalg.norm(p - a - k[:, None] * (b - a), axis=1) - r).min(), abs=1e-9)
    assert {r.id for r in J.segment_clearances(segments, df, 0.5).collect()} == {i for i in got if got[i] <= 0.5}
    narrow = {r.grp: (r.spheres, r.gap) for r in K.constrictions(segments, df, 2.0, 0.2).collect()}
    gaps = np.full(600, np.inf)
    for _, *e in ends:
        a, b = np.array(e[:3], float), np.array(e[3:], float)
        k = np.clip((p - a) @ (b - a) / max(1e-300, (b - a) @ (b - a)), 0, 1)
        gaps = np.minimum(gaps, np.linalg.norm(p - a - k[:, None] * (b - a), axis=1) - r)
    hit = gaps <= gaps.min() + 0.2
    assert {g: v[0] for g, v in narrow.items()} == {g: int(hit[g::4].sum()) for g in range(4) if hit[g::4].any()}


def test_closest_pairs_of_groups_are_sought_near_first(spark, monkeypatch):
    df, p = cloud(spark, 800)
    asked = reaches(monkeypatch, J)
    far = np.linalg.norm(p[:, None] - p[None], axis=-1)
    got = {(r.source, r.target): (r.id_a, r.id_b) for r in J.closest_contacts(df, 3.0).collect()}
    want = {(g, h): min((far[a, b], min(a, b), max(a, b)) for a in range(g, 800, 4) for b in range(h, 800, 4))[1:] for g in range(4) for h in range(g + 1, 4)}
    assert got == want and max(asked) < 2.5
    r = 0.1 + 0.1 * (np.arange(800) % 3)
    bare = far - r[:, None] - r[None]
    got = {(x.source, x.target): x.distance for x in J.closest_contacts(df, 3.0, "surface").collect()}
    assert got == {k: pytest.approx(bare[k[0] :: 4, k[1] :: 4].min(), abs=1e-9) for k in want} and max(asked) < 2.5
    got = {(x.positive, x.negative): x.distance for x in C.charge_pairs(df, 3.0).collect()}
    plus, minus = np.arange(800) % 3 == 2, np.arange(800) % 3 == 0
    side = lambda g, m: (np.arange(800) % 4 == g) & m
    assert got == {(g, h): pytest.approx(far[np.ix_(side(g, plus), side(h, minus))].min(), abs=1e-9) for g in range(4) for h in range(4) if g != h} and max(asked) < 2.5


def test_nearest_ones_are_sought_near_first(spark, monkeypatch):
    df, p = cloud(spark, 800)
    asked = reaches(monkeypatch, J, C)
    samples, spheres = df.where("grp = 0"), df.where("grp <> 0")
    r = 0.1 + 0.1 * (np.arange(800) % 3)
    rest = np.arange(800) % 4 != 0
    bare = np.where(rest, np.linalg.norm(p[:, None] - p[None], axis=-1) - r, np.inf)
    got = {x.id: x.nearest for x in J.nearest_surface(samples, spheres, 3.0).collect()}
    assert got == {i: int(bare[i].argmin()) for i in range(0, 800, 4)} and asked[0] < 1.5
    del asked[:]
    far = np.where(rest, np.linalg.norm(p[:, None] - p[None], axis=-1), np.inf)
    wide = spheres.withColumn("r", F.when(F.col("id") == 1, 30.0).otherwise(F.col("r")))
    got = {x.id: x.centre for x in C.nearest_inside(samples, wide).collect()}
    r[1] = 30.0
    assert got == {i: int(far[i].argmin()) for i in range(0, 800, 4) if far[i].min() <= r[far[i].argmin()]} and asked[0] < 15


def test_rings_and_counts_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(B, "STRIP_PAIRS", 3000)
    monkeypatch.setattr(B, "in_blocks", lambda df, by, salt, true=B.in_blocks: true(df, by, salt, 64))
    df, p = cloud(spark, 300, 5)
    rng = np.random.default_rng(9)
    n = rng.normal(size=(300, 3))
    n /= np.linalg.norm(n, axis=1)[:, None]
    rings = df.select("id", "grp", "x", "y", "z").join(spark.createDataFrame([(i, *map(float, n[i])) for i in range(300)], "id long, nx double, ny double, nz double"), "id").withColumn("frame", F.col("id") % 2)
    out = C.stacked_rings(rings, 0.5, 3.0, ["frame"])
    assert "MapInArrow" in plan_of(out)
    want = {}
    for i in range(300):
        for j in range(i + 1, 300):
            d = p[j] - p[i]
            if i % 4 == j % 4 or i % 2 != j % 2 or not 0.5 <= np.linalg.norm(d) <= 3.0:
                continue
            tilt = math.degrees(math.acos(min(1.0, abs(n[i] @ n[j]))))
            off = [math.sqrt(max(0.0, d @ d - (d @ m) ** 2)) for m in (n[i], n[j])]
            if tilt <= 30 and max(off) <= 2 or tilt >= 60 and min(off) <= 2:
                want[i % 2, i, j] = "parallel" if tilt <= 30 else "edge_face"
    assert {(r.frame, r.a, r.b): r.kind for r in out.collect()} == want
    named = df.withColumn("name", F.concat(F.lit("n"), F.col("id") % 3))
    counts = {}
    for i in range(300):
        for j in range(i + 1, 300):
            d = np.linalg.norm(p[j] - p[i])
            if i % 4 != j % 4 and d <= 1.0:
                k = (*sorted((f"n{i % 3}", f"n{j % 3}")), bool(d <= 0.5))
                counts[k] = counts.get(k, 0) + 1
    assert {tuple(r)[:3]: r.n for r in C.near_counts(named, 1.0, 0.5).collect()} == counts


def test_components_and_widest_paths_take_short_links_first(spark, monkeypatch):
    from gridloom.operators import reduction as R

    df, p = cloud(spark, 700)
    far = np.linalg.norm(p[:, None] - p[None], axis=-1)
    want = np.arange(700)
    while True:
        new = np.where(far <= 1.0, want[None, :], 700).min(1)
        if (new == want).all():
            break
        want = new
    made = []
    true = G.components
    monkeypatch.setattr(G, "components", lambda nodes, edges: made.append(edges.count()) or true(nodes, edges))
    assert {r.node: r.comp for r in G.point_components(df, 1.0).collect()} == dict(enumerate(map(int, want)))
    assert max(made) < (far <= 1.0).sum() / 4
    got = {r.state: (r.components, r.largest) for r in R.removed_points(df, df.where("id % 7 = 0").select(F.col("id").alias("node")), 1.0).collect()}
    assert got["whole"] == (len(set(want)), np.bincount(want).max())
    source = spark.createDataFrame([(0,)], "node long")
    pairs = J.range_join(df, df, 1.0).where("l_id < r_id").select(F.col("l_id").alias("a"), F.col("r_id").alias("b"), "distance")
    near = G.near_edges(df, source, 1.0)
    assert near.count() < pairs.count() / 2
    widest = lambda e: sorted(map(tuple, G.widest_paths(e.withColumn("width", 1 - F.col("distance")), source, length="distance").collect()))
    assert widest(near) == widest(pairs)


def test_typed_bridges_seek_near_bonds_first(spark, monkeypatch):
    from gridloom.operators import regions as N

    df, _ = cloud(spark, 600, 2)
    sites = df.withColumns({f"h{c}": F.col(c) + s for c, s in zip("xyz", (0.6, 0.3, -0.2), strict=True)})
    dry, wet = sites.where("grp <> 0"), sites.where("grp = 0")
    ask = lambda: sorted(map(tuple, N.typed_bridges(dry.where("id % 2 = 0"), dry.where("id % 2 = 1"), wet, wet, nearest=0.3, least_angle=100.0).collect()))
    monkeypatch.setattr(N, "first_reach", lambda left, right, most, *rest: most)
    plain = ask()
    monkeypatch.setattr(N, "first_reach", lambda left, right, most, *rest: 0.8)
    assert plain and ask() == plain
