"""Formats and reductions on hand-made cases."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import reduction as R
from gridloom.sources import formats as M


def test_grid_round_trip(spark, tmp_path):
    cells = [(i, j, k, float(i + 2 * j + 4 * k)) for i, j, k in itertools.product(range(2), range(3), range(2))]
    df = spark.createDataFrame(cells, "i long, j long, k long, value double")
    lines = [r.value for r in M.grid_lines(df, (2, 3, 2), (1.0, 0.0, 0.0), 0.5).orderBy("n").collect()]
    (tmp_path / "g.dx").write_text("# made\n" + "\n".join(lines) + '\nattribute "dep" string "positions"\n')
    back = M.read_grid(spark, str(tmp_path / "g.dx")).collect()
    assert {(r.i, r.j, r.k): r.value for r in back} == {(i, j, k): v for i, j, k, v in cells}
    assert {r.x for r in back if r.i == 1} == {1.5}
    (tmp_path / "g.dx").write_text("\n".join(lines[:-1]))
    with pytest.raises(Exception, match="as many values"):
        M.read_grid(spark, str(tmp_path / "g.dx")).collect()


def test_parameters_and_settings(spark):
    got = M.parameters(spark.createDataFrame([("Electric-Field-Z = 0.1 ; volts",), ("; only a note",), ("dt=0.002",)], "value string"))
    assert {tuple(r) for r in got.collect()} == {("electric_field_z", "0.1"), ("dt", "0.002")}
    settings, origin = M.Settings.load('{"probe": 1.2, "cutoff": 5}', {"cutoff": 4})
    assert (settings.probe, settings.cutoff, settings.spacing) == (1.2, 4.0, 0.5)
    assert (origin["cutoff"], origin["probe"], origin["spacing"]) == ("cli", "config", "default")
    with pytest.raises(ValueError):
        M.Settings.load('{"nothing": 1}')


def test_loop_rows(spark, tmp_path):
    text = "data_x\nloop_\n_atom_site.group_PDB\n_atom_site.id\n_atom_site.label_atom_id\n_atom_site.auth_atom_id\n_atom_site.Cartn_x\nATOM 1 CA . 1.5\nHETATM 2 'O5\'x y' ? -2\n#\n"
    (tmp_path / "a.cif").write_text(text)
    rows = M.loop_atoms(M.read_loop(spark, str(tmp_path / "a.cif"))).orderBy("serial").collect()
    assert [(r.name, r.x, r.hetero) for r in rows] == [("CA", 1.5, False), ("O5'x y", -2.0, True)]


def test_elements(spark):
    df = spark.createDataFrame([("CA", "ALA"), ("CA", "CA"), ("1HB", "ALA"), ("NA+", "NA+"), ("OW", "SOL"), ("SOD", "SOD"), ("FE", "HEM"), ("CD", "CD2"), ("CD", "PRO"), ("NA", "HEM"), ("", "X"), ("CL1", "LIG")], "n string, r string")
    assert [r[0] for r in df.select(M.infer_element(F.col("n"), F.col("r"))).collect()] == ["C", "CA", "H", "NA", "O", "NA", "FE", "CD", "C", "N", "C", "CL"]
    given = spark.createDataFrame([("HG", "CYS", "HG"), ("X", "X", "Zn2+"), ("CA", "CA", "C"), ("CA", "CA", "?")], "n string, r string, e string")
    names = [F.col(c) for c in "nre"]
    assert [tuple(r) for r in given.select(M.infer_element(*names), M.is_ion(*names)).collect()] == [("HG", False), ("ZN", False), ("C", False), ("CA", True)]
    assert df.where(M.is_water(F.col("r"))).count() == 1


def test_polymer_runs(spark):
    residues = spark.createDataFrame([(1, True, True), (2, False, False), (3, False, True), (4, False, True), (5, False, True)], "grp long, polymer boolean, declared boolean")
    links = spark.createDataFrame([(1, 2), (3, 4)], "a long, b long")
    assert {r.grp for r in M.polymer_groups(residues, links).collect()} == {1, 2, 3, 4}
    atoms = spark.createDataFrame([("A", 1, "C", 0.0, 0.0, 0.0), ("A", 2, "N", 1.3, 0.0, 0.0), ("B", 3, "N", 1.3, 0.0, 0.0)], "chain string, grp long, name string, x double, y double, z double")
    assert [tuple(r) for r in M.linked_groups(atoms).collect()] == [(1, 2)]


def test_cuts_equal_removal():
    rng = random.Random(1)
    for _ in range(30):
        edges = sorted({tuple(sorted(rng.sample(range(9), 2))) for _ in range(rng.randint(3, 14))})

        def parts(es, nodes):
            left, n = set(nodes), 0
            while left:
                n += 1
                todo = [left.pop()]
                while todo:
                    x = todo.pop()
                    for a, b in es:
                        for p, q in ((a, b), (b, a)):
                            if p == x and q in left:
                                left.discard(q)
                                todo.append(q)
            return n

        nodes = {x for e in edges for x in e}
        whole = parts(edges, nodes)
        bridges = {e for e in edges if parts([f for f in edges if f != e], nodes) > whole}
        points = {x for x in nodes if parts([e for e in edges if x not in e], nodes - {x}) > whole}
        assert R.cut_parts(edges) == (bridges, points)


def test_components_equal_numpy(spark):
    x = np.random.default_rng(2).standard_normal((200, 3)) @ np.array([[2, 1, 0], [0, 1, 0], [0, 0, 0.3]])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = {(r.component, r.column): (r.variance, r.loading) for r in R.principal_components(df, ["a", "b", "c"], 2).collect()}
    values = np.sort(np.linalg.eigvalsh(np.corrcoef(x.T)))[::-1]
    assert [got[c, "a"][0] for c in (0, 1)] == pytest.approx(values[:2].tolist())
    best = R.nearest_to_centre(df.withColumn("k", F.monotonically_increasing_id()).withColumn("g", F.lit(0)), "g", "k", ["a", "b", "c"]).first()
    assert best.n == 200


def test_variants_and_removal(spark):
    df = spark.createDataFrame([(0.9, "x"), (1.0, "x"), (1.1, "y"), (1.2, "y"), (1.3, "z")], "probe double, outcome string")
    assert R.chosen_variant(df).first().outcome == "x"
    nodes = spark.range(4).withColumnRenamed("id", "node")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "a long, b long")
    got = {r.state: (r.components, r.largest) for r in R.removed_connectivity(edges, nodes, nodes.where("node = 1")).collect()}
    assert got == {"whole": (1, 4), "removed": (2, 2)}
