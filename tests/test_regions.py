"""Selections, regions, lumen passages and voids on hand-made cases, and what they refuse."""

import pytest
from pyspark.sql import functions as F

from gridloom.functions import expr as E
from gridloom.operators import graph as G
from gridloom.operators import joins as J
from gridloom.operators import ordered as O
from gridloom.operators import regions as R
from gridloom.operators import selection as S
from gridloom.operators import voids as V
from gridloom.streaming import passages as P


def test_passages_by_both_rules(spark):
    # below, lumen, beside the lumen, above; then straight down; then in and out on one side; then around the lumen
    path = [(0, True), (5, True), (5, False), (10, True), (0, True), (5, True), (0, True), (5, False), (10, True), (5, True), (0, True)]
    rows = spark.createDataFrame([("k", i, float(s), lateral) for i, (s, lateral) in enumerate(path)], "key string, frame long, s double, lateral boolean")
    told = lambda rule: [tuple(r)[1:] for r in O.crossings(rows, ["key"], 1.0, 9.0, F.col("lateral"), rule).orderBy("exit").collect()]
    straight = (3, 4, "down", "unresolved_single_interval")
    assert told("compartment") == [(1, 3, "up", "complete"), straight, (7, 8, "up", "outside_lumen"), (9, 10, "down", "complete")]
    assert told("strict") == [straight, (9, 10, "down", "complete")]
    with pytest.raises(ValueError):
        O.crossings(rows, ["key"], 1.0, 9.0, rule="other")


def test_frames_of_a_stream_may_be_late_within_the_hold():
    frames = [(i, s) for i, s in enumerate([0.0, 5, 10, 5, 0, 5, 10, 10])]
    want = P.advance((0, 0, -1, [], []), frames, 1.0, 9.0)[1]
    state, got = (0, 0, -1, [], []), []
    for part in ([frames[1], frames[0]], [frames[3], frames[4]], [frames[2], frames[6]], [frames[5], frames[7]]):
        state, events = P.advance(state, part, 1.0, 9.0, hold=3)
        got += events
    got += P.advance(state, [(11, 10.0)], 1.0, 9.0, hold=3)[1]
    assert got == want
    with pytest.raises(ValueError, match="after"):
        P.advance((0, 0, 9, [], []), [(4, 5.0)], 1.0, 9.0)


def test_samples_without_coordinates_have_no_sphere(spark):
    spheres = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0), (2, None, 0.0, 0.0, 1.0)], "id long, x double, y double, z double, r double")
    samples = spark.createDataFrame([(1, 3.0, 0.0, 0.0), (2, None, 0.0, 0.0), (3, float("nan"), 0.0, 0.0), (4, 900.0, 0.0, 0.0)], "id long, x double, y double, z double")
    got = {r.id: (r.nearest, r.clearance) for r in J.nearest_surface(samples, spheres, 0.5).collect()}
    assert got == {1: (1, 2.0), 2: (None, None), 3: (None, None), 4: (1, 899.0)}
    assert J.nearest_surface(samples, spheres.where("id = 2"), 0.5).where("nearest IS NOT NULL").count() == 0


def test_widest_paths_break_ties_by_length(spark):
    edges = spark.createDataFrame([(0, 1, 5.0, 1.0), (1, 2, 2.0, 1.0), (0, 3, 2.0, 0.2), (3, 2, 2.0, 0.3), (2, 4, 1.0, 1.0)], "a long, b long, width double, far double")
    got = {r.node: (r.width, r.length, r.hops) for r in G.widest_paths(edges, spark.range(1).withColumnRenamed("id", "node"), length="far").collect()}
    assert got[2] == (2.0, 0.5, 2) and got[4] == (1.0, 1.5, 3) and got[1] == (5.0, 1.0, 1)


def test_refusals(spark):
    frames = spark.createDataFrame([(0, 1.0), (1, 2.0)], "frame long, t double")
    with pytest.raises(Exception, match="missing"):
        S.rejoined(frames, frames.where("frame = 0"), ["frame"], "t").collect()
    with pytest.raises(Exception, match="time differs"):
        S.rejoined(frames, frames.withColumn("t", F.col("t") + 1), ["frame"], "t").collect()
    with pytest.raises(Exception, match="no entry for 1"):
        S.looked_up(frames, frames.where("frame = 0").withColumnRenamed("t", "v"), ["frame"]).collect()
    for more, few in ((frames, frames.where("frame = 0")), (frames.where("frame = 0"), frames)):
        with pytest.raises(ValueError, match="frame"):
            S.all_frames(more, few)
    assert S.all_frames(frames, frames).count() == 2
    assert G.lattice(spark, (0, 0, 0), (1, 1, 1), 0.3).count() == 64 and G.lattice(spark, (0, 0, 0), (1, 1, 1), 0.3, cover=True).count() == 125
    records = spark.createDataFrame([(0, "C???", "ALA", 1.7)], "line long, name string, resname string, radius double")
    with pytest.raises(Exception, match="no radius record"):
        S.record_radii(spark.createDataFrame([("OG", "SER")], "name string, resname string"), records).collect()
    rows = spark.createDataFrame([("A", "boundary_lining", 0, 0.5), ("B", "other", 1, 0.5)], "residue string, role string, place long, contacted double")
    assert [r.residue for r in S.stick_rows(rows, "A").collect()] == ["A"] and S.stick_rows(rows, "top:0").count() == 0
    for wrong in ("B", "C", "", "top:x"):
        with pytest.raises(ValueError):
            S.stick_rows(rows, wrong)
    with pytest.raises(ValueError):
        S.wall_atoms(rows, "none")
    pairs = spark.createDataFrame([(0.1, 0.0, 0.0, 9.9, 0.0, 0.0)], "ax double, ay double, az double, bx double, by double, bz double")
    with pytest.raises(ValueError, match="boundary"):
        R.whole_pairs(pairs, (10.0, 10.0, 10.0))
    with pytest.raises(ValueError, match="cells"):
        V.periodic_images(spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "id long, x double, y double, z double"), E.cell_vectors((1, 1, 1), (90, 90, 90)), (0, 0, 0), (9, 9, 9))
    nodes = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0), (1, 1, 1.0, 0.0, 0.0), (1, 2, 1.0, 0.0, 0.0)], "frame long, node long, x double, y double, z double")
    with pytest.raises(Exception, match="lacks node 2"):
        V.fluctuation_halves(nodes).collect()


def test_small_expressions(spark):
    row = spark.range(1)
    get = lambda c: row.select(c.alias("v")).first().v
    assert [get(E.entry_code(F.lit(t))) for t in (" 1grm ", "PDB_00001GRM", "xgrm", "1GRMX")] == ["1GRM", "pdb_00001grm", None, None]
    assert tuple(get(E.model_id(F.lit("a/AF-P12345-F1-model_v4.cif")))) == ("P12345", 1, 4, "cif")
    assert get(E.model_id(F.lit("AF-12345-F1"))) is None and tuple(get(E.model_id(F.lit("AF-P12345-F2")))) == ("P12345", 2, None, None)
    assert get(E.tokens(F.lit(" a,b,,a "))) == ["a", "b"] and get(E.tokens(F.lit("resname NA and x, y"))) == ["resname NA and x, y"]
    assert get(E.charge_overrides(F.lit("na=1, CL = -1"))) == {"NA": 1.0, "CL": -1.0}
    with pytest.raises(Exception, match="NAME=q"):
        get(E.charge_overrides(F.lit("na")))
    assert tuple(get(E.parsed_coord(F.lit("1, -2.5,3")))) == (1.0, -2.5, 3.0) and get(E.parsed_coord(F.lit("1,2"))) is None
    assert get(E.ladder_neighbours(F.lit(2.0), [1.0, 2.0, 3.0])) == [1.0, 3.0] and get(E.ladder_neighbours(F.lit(0.5), [1.0])) == [1.0]
    assert E.standard_variants(0.5, 1.4, 0.5, ladder=(1.2, 1.4, 1.6), delta=1.0, grids=(0.4, 0.5, 0.6)) == [("margin", 1.5), ("probe", 1.2), ("probe", 1.6), ("grid", 0.4), ("grid", 0.6)]
    u, v = E.basis_of((F.lit(0.0), F.lit(0.0), F.lit(2.0)))
    for a in (u, v):
        assert get(E.dot(a, a)) == pytest.approx(1) and get(a[2]) == pytest.approx(0)
    assert get(E.dot(u, v)) == pytest.approx(0)
    with pytest.raises(ValueError):
        E.named_axis("w")
    volts = E.field_voltage((F.lit(0.0), F.lit(0.0), F.lit(0.02)), (F.lit(60.0), F.lit(60.0), F.lit(100.0)), (F.lit(0.0), F.lit(0.1), F.lit(-1.0)))
    assert get(volts) == pytest.approx(-200.0)


def test_empty_sets_are_alike(spark):
    names = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "grp string")
    members = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 2)], "grp string, member long")
    got = {(r.a, r.b): r.jaccard for r in R.similarity(names, members).collect()}
    assert got == {("a", "b"): 0.5, ("a", "c"): 0.0, ("a", "d"): 0.0, ("b", "c"): 0.0, ("b", "d"): 0.0, ("c", "d"): 1.0}
