"""Operators against hand-made cases, theory and brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import expr as E
from gridloom.operators import estimators as S
from gridloom.operators import graph as G
from gridloom.operators import joins as J
from gridloom.operators import ordered as O
from gridloom.operators import ranks
from gridloom.operators import reduction as R
from gridloom.operators.tracking import track
from gridloom.sources import sinks
from gridloom.sources import tables as T


def one(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns))


def test_range_join_is_inclusive_and_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    p = rng.uniform(-2, 2, (80, 3)).round(2)
    p[1] = p[0] + [0.5, 0, 0]
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, x double, y double, z double")
    got = {(r.l_id, r.r_id) for r in J.range_join(df, df, 0.5).where("l_id < r_id").collect()}
    d = np.sqrt(((p[:, None] - p) ** 2).sum(2))
    assert got == {(i, j) for i in range(80) for j in range(i + 1, 80) if d[i, j] <= 0.5}


def test_nearest_surface_is_not_nearest_centre(spark):
    spheres = spark.createDataFrame([(1, 1.0, 0.0, 0.0, 0.1), (2, 3.0, 0.0, 0.0, 2.9)], "id long, x double, y double, z double, r double")
    samples = spark.createDataFrame([(9, 0.0, 0.0, 0.0)], "id long, x double, y double, z double")
    r = J.nearest_surface(samples, spheres, 0.01).first()
    assert (r.nearest, round(r.clearance, 9)) == (2, 0.1)


def test_expressions(spark):
    row = one(spark, x=0.5, y=1.5, z=-0.5)
    r = row.select(E.nearest_even_index(F.col("x")), E.half_up_index(F.col("x")), E.nearest_even_index(F.col("y")), E.half_up_index(F.col("z")), E.minimum_image(F.lit(7.0), F.lit(10.0))).first()
    assert tuple(r) == (0, 1, 2, 0, -3.0)
    at = lambda *v: tuple(F.lit(float(c)) for c in v)
    t = row.select(E.torsion(at(1, 0, 0), at(0, 0, 0), at(0, 1, 0), at(0, 1, 1)), E.torsion(at(9, 0, 0), at(0, 0, 0), at(0, 1, 0), at(0, 1, 1)), E.segment_distance(at(0, 2, 0), at(-1, 0, 0), at(1, 0, 0))).first()
    assert abs(t[0]) == pytest.approx(90) and t[1] is None and t[2] == pytest.approx(2)
    props = row.select(E.residue_properties(F.lit("HIS")), E.formal_charge(F.lit("asp")), T.label(F.lit(""), F.lit("ALA"), F.lit(42), F.lit("B")), E.accession(F.lit(" 1abc "))).first()
    assert set(props[0]) == {"polar", "positive", "aromatic"} and tuple(props)[1:] == (-1, "_:ALA42B", "1ABC")


def test_fixed_column_records(spark, tmp_path):
    line = "ATOM      1  CA AALA A  42      11.104   6.134  -6.504  0.50 20.00           C  "
    rows = T.fixed_columns(spark.createDataFrame([(line,), (line.replace(" AALA", " BALA"),), ("REMARK",)], "value string"))
    r = T.one_altloc(rows).collect()
    assert len(r) == 1 and (r[0].x, r[0].resname, r[0].altloc, r[0].element) == (11.104, "ALA", "A", "C")
    (tmp_path / "bad.pdb").write_text(line.replace("11.104", "nan   ") + "\n")
    with pytest.raises(Exception, match="coordinate"):
        T.read_fixed_columns(spark, str(tmp_path / "bad.pdb")).collect()
    with pytest.raises(ValueError):
        T.frame_range(spark.range(3).withColumnRenamed("id", "frame"), 2, 2, 1)


def test_crossings_by_the_compartment_rule(spark):
    s = [-9, 0, 0, 9, 9, -9, 0, -9, 0, 9]
    df = spark.createDataFrame([("m", i, float(v)) for i, v in enumerate(s)], "key string, frame long, s double")
    got = sorted(tuple(r) for r in O.crossings(df, ["key"], -5.0, 5.0).collect())
    assert got == [("m", 1, 3, "up", "complete"), ("m", 4, 5, "down", "unresolved_single_interval"), ("m", 8, 9, "up", "complete")]
    inside_first = df.where("frame in (1, 3)")
    assert O.crossings(inside_first, ["key"], -5.0, 5.0).count() == 0


def test_survival_averages_origins(spark):
    rows = [("g", 1, f) for f in (0, 1, 2)] + [("g", 2, 0), ("g", 2, 2)]
    df = spark.createDataFrame(rows, "grp string, member long, frame long")
    got = {r.lag: r.survival for r in O.survival(df).collect()}
    assert got[0] == 1 and got[1] == pytest.approx((0.5 + 1) / 2) and got[2] == pytest.approx(0.5)


def test_tracking_moves_splits_merges(spark):
    sets = {0: {0: "abcdef", 1: "xyz"}, 1: {0: "abc", 1: "def", 2: "xyz"}, 2: {0: "abcdef"}, 3: {0: "pq"}}
    rows = [(f, g, m) for f, s in sets.items() for g, ms in s.items() for m in ms]
    df = spark.createDataFrame(rows, "frame long, grp long, member string")
    got = {(r.frame, r.grp): (r.track, r.reason) for r in track(df).collect()}
    assert got[0, 0] == (0, "first_frame") and got[1, 0] == (0, "continued") and got[1, 1] == (2, "split") and got[1, 2] == (1, "continued")
    assert got[2, 0][0] == 0 and got[3, 0] == (3, "birth")
    events = sorted((r.frame, r.event, r.track) for r in track(df, "events").collect())
    assert (1, "split", 0) in events and (2, "merge", 0) in events and (2, "death", 1) in events and (3, "birth", 3) in events
    line = {r.track: r for r in track(df, "lineage").collect()}
    assert (line[2].reason, line[2].parents, line[2].end, line[2].into) == ("split", [0], "merge", 0)
    assert (line[1].end, line[1].frames, line[1].last) == ("death", 2, 1) and line[3].end == "last_frame" and line[0].end == "death"
    late = df.where("frame < 3").unionByName(df.where("frame = 3").withColumn("frame", F.lit(6).cast("long")))
    assert {r.gap for r in track(late, "events").where("frame = 6").collect()} == {3}
    owned = df.withColumn("owner", F.lit("a")).unionByName(df.where("frame > 0").withColumn("owner", F.lit("b")))
    each = track(owned, by=["owner"]).collect()
    assert {(r.frame, r.grp): (r.track, r.reason) for r in each if r.owner == "a"} == got
    assert {r.reason for r in each if r.owner == "b" and r.frame == 1} == {"first_frame"}


def test_components_and_paths(spark):
    nodes = spark.range(8).withColumnRenamed("id", "node")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (5, 6)], "a long, b long")
    comp = {r.node: r.comp for r in G.components(nodes, edges).collect()}
    assert comp == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 5, 7: 7}
    weighted = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 0.25), (2, 3, 0.0)], "a long, b long, weight double")
    cost = {r.node: (r.cost, r.hops) for r in G.shortest_paths(weighted, nodes.where("node = 0")).collect()}
    assert cost == {0: (0.0, 0), 1: (1.0, 1), 2: (2.0, 2)}
    wide = {r.node: r.width for r in G.widest_paths(weighted.withColumnRenamed("weight", "width"), nodes.where("node = 0")).collect()}
    assert wide[2] == 1.0 and wide[3] == 0.0


def test_quantiles_and_intervals():
    assert S.chi2_quantile(0.95, 1) == pytest.approx(3.841459, abs=1e-5)
    assert S.chi2_quantile(0.99, 10) == pytest.approx(23.20925, abs=1e-4)
    assert S.t_quantile(0.975, 4) == pytest.approx(2.776445, abs=1e-5)
    low, high = S.poisson_interval(10)
    assert (low, high) == (pytest.approx(4.795389, abs=1e-5), pytest.approx(18.390356, abs=1e-5))
    assert S.poisson_interval(0)[0] == 0


def test_correlation_time_of_an_autoregression():
    rng = np.random.default_rng(2)
    x, phi = np.zeros(60_000), 0.8
    for i in range(1, len(x)):
        x[i] = phi * x[i - 1] + rng.standard_normal()
    assert S.autocorrelation_time(x) == pytest.approx((1 + phi) / (1 - phi), rel=0.15)
    assert S.statistical_inefficiency(x) == pytest.approx((1 + phi) / (1 - phi), rel=0.15)
    error, _ = S.blocking_error(x)
    assert error == pytest.approx(math.sqrt(9 * x.var() / len(x)), rel=0.35)
    assert S.sampling_uncertainty(np.ones(50))["status"] == "unavailable_observed_constant"
    assert S.sampling_uncertainty(x[:10])["status"] == "unavailable_too_few_frames"
    assert S.sampling_uncertainty(x[:100], regular=False)["interval_status"] == "unavailable_irregular_timestamps"
    assert S.sampling_uncertainty(np.append(x[:100], np.nan))["status"] == "unavailable_missing_frames"
    short, long = S.sampling_uncertainty(x[:60]), S.sampling_uncertainty(x[:5000])
    assert (short["status"], short["interval_status"], short["low"]) == ("estimated", "insufficient_blocks", None)
    assert long["interval_status"] == "estimated" and long["effective"] == pytest.approx(5000 / long["tau"]) and long["low"] < long["mean"] < long["high"] and long["error"] > 0
    low, high, spread = S.moving_block_bootstrap(x, 100)
    assert low < x.mean() < high and spread > 0


#: 99 % points of chi-squared with 1, 2, ... degrees of freedom.
CHI2_99 = (6.634896601021213, 9.210340371976182, 11.344866730144373, 13.276704135987622, 15.08627246938899, 16.811893829770927, 18.475306906582357, 20.090235029663233, 21.665994333461924, 23.209251158954356)


def test_blocking_by_its_formulas():
    rng = np.random.default_rng(12)
    for n in (64, 37, 1000, 5):
        x = np.cumsum(rng.standard_normal(n)) * 0.2 + rng.standard_normal(n)
        levels, now = [], x.tolist()
        while len(now) >= 2:
            mean = sum(now) / len(now)
            var = sum((v - mean) ** 2 for v in now) / len(now)
            gamma = sum((a - mean) * (b - mean) for a, b in zip(now, now[1:])) / len(now)
            levels.append((len(now), var, gamma))
            now = [(now[i] + now[i + 1]) / 2 for i in range(0, len(now) - 1, 2)]
        want = len(levels) - 1
        for k in range(len(levels)):
            if sum(m * (g / v) ** 2 for m, v, g in levels[k:] if v > 0) < CHI2_99[k]:
                want = k
                break
        error, level = S.blocking_error(x)
        assert level == want and error == pytest.approx(math.sqrt(levels[want][1] / levels[want][0]), rel=1e-12)
    assert S.blocking_error(np.array([0.0, 1.0] * 32)) == (0.0, 1)


def test_kmeans_and_diffusion():
    rows = np.array([[0.0, 0], [10, 10], [0.1, 0], [10.1, 10], [0, 0.2]])
    labels, _ = S.kmeans(rows, 2)
    assert labels.tolist() == [0, 1, 0, 1, 0]
    walk = np.cumsum(np.random.default_rng(3).standard_normal(20_000))
    got = S.collective_diffusion(walk, 1.0)
    assert got["low"] <= got["d"] <= got["high"] and abs(got["d"] - 0.5) < 0.2
    lags = np.arange(1, 401)
    fit = lambda x: np.polyfit(lags, [np.mean((x[k:] - x[:-k]) ** 2) for k in lags], 1)[0] / 2
    half = 2.7764451051977987 * np.std([fit(walk[i * 4000 : (i + 1) * 4000]) for i in range(5)], ddof=1) / math.sqrt(5)
    assert (got["d"], got["high"]) == pytest.approx((fit(walk), fit(walk) + half), rel=1e-9)
    assert S.collective_diffusion(walk[:5], 1.0)["status"] == "insufficient_frames" and S.collective_diffusion(walk[:12], 1.0)["low"] is None


def test_clusters_equal_those_of_one_process(spark):
    rng = np.random.default_rng(8)
    rows = [(g, i, float(x), float(y)) for g in ("a", "b") for i, (x, y) in enumerate(rng.standard_normal((60, 2)) + rng.integers(0, 3, (60, 1)) * 4)]
    rows += [("c", i, 1.0, 2.0) for i in range(5)]
    got = {(r.g, r.i): r.cluster for r in R.clusters(spark.createDataFrame(rows, "g string, i long, x double, y double"), "g", "i", ["x", "y"], 3).collect()}
    for g in "abc":
        own = [r for r in rows if r[0] == g]
        labels, _ = S.kmeans(np.array([r[2:] for r in own]), 3)
        assert [got[g, r[1]] for r in own] == labels.tolist()


def test_quantiles_by_ranges(spark):
    rng = np.random.default_rng(9)
    rows = [(k, None if i % 11 == 0 else float(x)) for k, n in (("a", 1000), ("b", 7), ("c", 1)) for i, x in enumerate(rng.standard_normal(n).round(1), 1)]
    got = {r.k: r for r in ranks.quantiles(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v", {"low": 0.025, "mid": 0.5, "third": 1 / 3}).collect()}
    for k in "abc":
        own = [v for n, v in rows if n == k and v is not None]
        assert [got[k].low, got[k].mid, got[k].third] == pytest.approx(np.quantile(own, [0.025, 0.5, 1 / 3]).tolist(), abs=1e-12)


def test_envelope_has_no_nan(spark):
    df = spark.createDataFrame([(1, float("nan"))], "a int, b double")
    assert sinks.enveloped(df, "k").first()[0] == '{"schema_version":"0.1","kind":"k","data":{"a":1,"b":null}}'


def test_unpaired_keys_are_errors(spark):
    a, b = spark.createDataFrame([(1, 2.0)], "k int, v double"), spark.createDataFrame([(2, 2.0)], "k int, v double")
    with pytest.raises(Exception, match="partner"):
        J.paired(a, b, ["k"], "v").collect()


def test_bands_and_blocks():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((800, 3)) + [0.0, 1.0, 2.0]
    x[3, 2] = np.nan
    got = S.block_mean_bands(x)
    assert got["status"] == "estimated" and np.isnan(got["low"][2])
    assert (got["wide_low"][:2] <= got["low"][:2]).all() and (got["low"][:2] < x[:, :2].mean(0)).all() and (got["high"][:2] > x[:, :2].mean(0)).all()
    assert S.block_mean_bands(x[:10])["status"] == S.block_mean_bands(x[:30])["status"] == "insufficient_independent_blocks"
    assert S.block_mean_bands(np.full((100, 2), np.nan))["status"] == "no_complete_coverage"
    assert [S.series_interval(v)["status"] for v in ([], [np.nan], [1.0, 1.0], [1.0, np.nan], [1.0, 2.0])] == ["no_observations", "no_observations", "unavailable_observed_constant", "unavailable_missing_frames", "insufficient_independent_blocks"]
    assert S.series_interval(x[:, 0], regular=False)["status"] == "unavailable_irregular_timestamps" and S.series_interval(x[:, 0])["low"] == pytest.approx(got["low"][0])
    skew = np.exp(rng.standard_normal((800, 1)))
    one_sided = S.block_mean_bands(skew)  # the two tails of the studentised replicates differ
    assert one_sided["high"][0] - skew.mean() != pytest.approx(skew.mean() - one_sided["low"][0], rel=1e-3)
    assert S.disjoint_block_bootstrap(np.ones(100), 10)["status"] == "no_variation_between_blocks"
    one_ = S.disjoint_block_bootstrap(x[:, 0], 20)
    assert one_["low"] < x[:, 0].mean() < one_["high"]
    current = S.net_current(np.ones((100, 1)), np.zeros((100, 1)), [2.0], 50.0)
    assert current["current"] == 4.0 and current["low"] < 4.0 < current["high"] and current["method"] == "poisson"
    assert current["high"] == pytest.approx((200 + 1.959963984540054 * 20) / 50, rel=1e-9)
    burst = S.net_current(np.repeat([1.0, 0, 0, 0, 0, 0, 0, 0, 0, 0], 10)[:, None], np.zeros((100, 1)), [1.0], 1.0)
    assert burst["method"] == "blocks" and burst["high"] == pytest.approx(10 + 2.2621571627409915 * 10, rel=1e-9)
    none_ = S.net_current(np.zeros((100, 1)), np.zeros((100, 1)), [1.0], 1.0)
    assert none_["high"] == pytest.approx(3.688879454113936, rel=1e-9) and none_["low"] == -none_["high"]
    assert S.dispersion_interval(np.ones(15))[0] == 1.0


def test_polyline_is_resampled_along_its_length(spark):
    df = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (0, 1, 1.0, 0.0, 0.0), (0, 2, 1.0, 1.0, 0.0)], "k long, n long, x double, y double, z double")
    got = [(r.g, r.x, r.y) for r in O.resample_polyline(df, ["k"], "n", 0.5).orderBy("g").collect()]
    assert got == [(0, 0.0, 0.0), (1, 0.5, 0.0), (2, 1.0, 0.0), (3, 1.0, 0.5), (4, 1.0, 1.0)]
