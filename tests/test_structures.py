"""Structure files, radius tables, bundles and the choice of outputs."""

import json

import pytest
from pyspark.sql import functions as F

from gridloom.sources import formats as M
from gridloom.sources import sinks
from gridloom.sources import structures as R

ATOM = "ATOM  {0:5d} {1:<4s} {2:>3s} {3:1s}{4:4d}    {5:8.3f}{6:8.3f}{7:8.3f}  1.00 20.00          {8:>2s}"


def test_models_and_suffixes(spark, tmp_path):
    lines = ["MODEL        1", ATOM.format(1, " CA", "ALA", "A", 1, 1, 2, 3, "C"), ATOM.format(2, " CB", "ALA", "B", 1, 1, 2, 4, ""), "ENDMDL", "MODEL        2", ATOM.format(1, " CA", "ALA", "A", 1, 9, 2, 3, "C"), "ENDMDL"]
    path = tmp_path / "a.pdb"
    path.write_text("\n".join(lines) + "\n")
    first = R.read_structure(spark, str(path))
    assert sorted((r.name, r.x, r.element) for r in first.collect()) == [("CA", 1.0, "C"), ("CB", 1.0, "C")]
    assert [r.x for r in R.read_structure(spark, str(path), 1).collect()] == [9.0]
    with pytest.raises(ValueError, match="model 2"):
        R.read_structure(spark, str(path), 2)
    with pytest.raises(ValueError, match="suffix"):
        R.read_structure(spark, str(tmp_path / "a.xyz"))
    assert [r.name for r in R.chosen_chains(first, ["B"]).collect()] == ["CB"]
    with pytest.raises(ValueError, match="Z"):
        R.chosen_chains(first, ["B", "Z"])


def test_loops_with_text_blocks(spark, tmp_path):
    head = "data_x\nloop_\n" + "".join(f"_atom_site.{n}\n" for n in ("group_PDB", "id", "label_atom_id", "auth_comp_id", "Cartn_x", "pdbx_PDB_model_num"))
    path = tmp_path / "a.cif"
    path.write_text(head + "ATOM 1 CA\nALA 1.5 1\nATOM 2\n;a name\nof two lines\n;\nALA 2.5 1\nATOM 1 CA ALA 7.5 2\n#\n_other 1\n")
    rows = M.read_loop(spark, str(path)).collect()
    assert [r.row["Cartn_x"] for r in rows] == ["1.5", "2.5", "7.5"] and rows[1].row["label_atom_id"] == "a name\nof two lines"
    assert [r.x for r in R.read_structure(spark, str(path), 1).collect()] == [7.5]
    for wrong, text in (("as many tokens", head + "ATOM 1 CA\n#\n"), ("no end", head + "ATOM 1 CA\n;open\n"), ("twice", head + "_atom_site.id\nATOM 1 CA ALA 1 1 2\n#\n")):
        path.write_text(text)
        with pytest.raises(Exception, match=wrong):
            M.read_loop(spark, str(path)).collect()


def test_radii_in_order(spark, tmp_path):
    (tmp_path / "r.csv").write_text("# radii\nkind,key,radius\nelement,C,1.7\nelement,O,1.5\natom,CA,1.9\natom,ALA:CA,2.0\nion,NA,1.4\ndefault,,1.6\n")
    (tmp_path / "r.json").write_text(json.dumps({"element_radii": {"C": 1.7, "O": 1.5}, "atom_radii": {"CA": 1.9, "ala:ca": 2.0}, "ion_radii": {"NA": 1.4}, "default_radius": 1.6}))
    atoms = spark.createDataFrame([("CA", "ALA", "C"), ("CA", "GLY", "C"), ("SOD", "SOD", "NA"), ("OG", "SER", "O"), ("ZN", "ZN", "ZN")], "name string, resname string, element string")
    want = {("CA", "ALA"): 2.0, ("CA", "GLY"): 1.9, ("SOD", "SOD"): 1.4, ("OG", "SER"): 1.5, ("ZN", "ZN"): 1.6}
    for name in ("r.csv", "r.json"):
        out = R.with_radius(atoms, R.radius_table(spark, str(tmp_path / name)))
        assert out.columns == ["name", "resname", "element", "radius"]
        assert {(r.name, r.resname): r.radius for r in out.collect()} == want
    (tmp_path / "r.rad").write_text("remark\nVDWR OG   SER      1.45\nVDWR Z??? ???      1.10\n")
    records = R.radius_records(spark, str(tmp_path / "r.rad"))
    table = R.radius_table(spark, str(tmp_path / "r.csv")).where("kind <> 'element'")
    got = {(r.name, r.resname): r.radius for r in R.with_radius(atoms, table, records).collect()}
    assert got == want | {("OG", "SER"): 1.45, ("ZN", "ZN"): 1.1}
    with pytest.raises(Exception, match="no radius record"):
        R.with_radius(atoms.withColumn("name", F.lit("XX")), table, records).collect()
    (tmp_path / "bad.csv").write_text("kind,key,radius\nelement,C,-1\n")
    with pytest.raises(Exception, match="no radius"):
        R.radius_table(spark, str(tmp_path / "bad.csv")).collect()


def test_bundles(spark, tmp_path):
    folder = str(tmp_path / "out")
    listed = sinks.write_bundle({"a": spark.range(3), "b": spark.range(2)}, folder, "numbers")
    rows = listed.collect()
    assert {r.path.split("/")[0] for r in rows} == {"a", "b"} and {r.kind for r in rows} == {"numbers"} and all(len(r.sha256) == 64 for r in rows)
    assert spark.read.parquet(f"{folder}/a").count() == 3
    with pytest.raises(ValueError, match="holds a bundle"):
        sinks.write_bundle({"a": spark.range(3)}, folder, "numbers")


def test_chosen_outputs():
    known = ["profile", "voids"], ["figures", "scenes"], (["profile"], ["figures"])
    assert sinks.chosen_outputs(*known) == (["profile"], ["data", "figures"])
    assert sinks.chosen_outputs(*known, asked=["voids"]) == (["voids"], ["data", "figures"])
    assert sinks.chosen_outputs(*known, asked=["scenes", "voids", "default"]) == (["profile", "voids"], ["data", "figures", "scenes"])
    assert sinks.chosen_outputs(*known, asked=["none"]) == (["profile"], ["data"])
    assert sinks.chosen_outputs(*known, everything=True, skipped=["profile"]) == (["voids"], ["data", "figures", "scenes"])
    for wrong in ({"asked": ["x"]}, {"asked": ["voids"], "everything": True}, {"asked": ["voids"], "skipped": ["voids"]}):
        with pytest.raises(ValueError):
            sinks.chosen_outputs(*known, **wrong)
