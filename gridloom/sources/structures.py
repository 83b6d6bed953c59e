"""Structures from files by their suffix, the models in them, and radii of atoms from tables of several formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators import selection as S
from gridloom.operators.joins import small
from gridloom.sources import formats as M
from gridloom.sources import tables as T

#: Fixed value: the radius of an element that no table has.
DEFAULT_RADIUS = 1.70


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their file and their order in it (rising, not dense)."""
    return spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"))


def with_model(lines: DataFrame) -> DataFrame:
    """Coordinate lines (file, line, value) with the number of the model that they stand in; files without models have model 0.

    Only the lines that begin a model are put in order, for each file; the others find their model between these.
    """
    marks = lines.where(F.substring("value", 1, 6) == "MODEL ").select("file", F.col("line").alias("_from"))
    w = Window.partitionBy("file").orderBy("_from")
    marks = small(marks.withColumns({"model": F.row_number().over(w) - 1, "_to": F.lead("_from").over(w)}))
    atoms = lines.where(F.substring("value", 1, 6).isin("ATOM  ", "HETATM"))
    inside = (F.col("a.file") == F.col("m.file")) & (F.col("a.line") >= F.col("m._from")) & (F.col("m._to").isNull() | (F.col("a.line") < F.col("m._to")))
    return atoms.alias("a").join(marks.alias("m"), inside, "left").select("a.file", "a.line", "a.value", F.coalesce("m.model", F.lit(0)).alias("model"))


def read_structure(spark: SparkSession, path: str, model: int = 0) -> DataFrame:
    """Atoms of a structure file, by its suffix: fixed columns (pdb, ent) or a token loop (cif, mmcif).

    Of several models one is taken; one that the file lacks is an error. Hydrogens' and other elements that the file doesn't give
    are inferred from the names; of alternate locations one stays.
    """
    suffix = path.lower().removesuffix(".gz").rsplit(".", 1)[-1]
    if suffix in ("pdb", "ent"):
        lines = with_model(numbered_lines(spark, path)).where(F.col("model") == model)
        atoms = T.fixed_columns(lines)
    elif suffix in ("cif", "mmcif"):
        rows = M.read_loop(spark, path)
        number = F.expr("try_cast(row['pdbx_PDB_model_num'] AS int)")
        first = rows.agg(F.min(number)).first()[0]
        atoms = M.loop_atoms(rows if first is None else rows.where(number == first + model))
    else:
        raise ValueError(f"no structure has the suffix {suffix}")
    if atoms.limit(1).isEmpty():
        raise ValueError(f"the file has no atoms of model {model}")
    element = M.infer_element(F.col("name"), F.col("resname"), F.col("element"))
    return T.one_altloc(atoms.withColumn("element", element))


def chosen_chains(atoms: DataFrame, chains: list[str] | None) -> DataFrame:
    """Atoms of the named chains; a name that no atom has is an error."""
    if chains is None:
        return atoms
    have = {r[0] for r in atoms.where(F.col("chain").isin(*chains)).select("chain").distinct().collect()}  # of those named
    if missing := sorted(set(chains) - have):
        raise ValueError("no chain is named " + ", ".join(missing))
    return atoms.where(F.col("chain").isin(*chains))


def radius_table(spark: SparkSession, path: str) -> DataFrame:
    """Radii (kind, key, radius) of a CSV file with that header or of a JSON object; kinds: element, atom, ion, default."""
    suffix = path.lower().rsplit(".", 1)[-1]
    if suffix == "csv":
        rows = spark.read.csv(path, header=True, comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
        rows = rows.toDF(*[c.strip().lower() for c in rows.columns])
        if not {"kind", "key", "radius"} <= set(rows.columns):
            raise ValueError("a radius table has the columns kind, key and radius")
        out = rows.select(F.lower("kind").alias("kind"), F.upper(F.coalesce("key", F.lit(""))).alias("key"), F.col("radius").try_cast("double").alias("radius"))
    elif suffix == "json":
        text = spark.read.text(path, wholetext=True)
        part = lambda kind: F.from_json(F.get_json_object("value", f"$.{kind}_radii"), "map<string,double>")
        maps = [text.select(F.lit(kind).alias("kind"), F.explode(part(kind)).alias("key", "radius")) for kind in ("element", "atom", "ion")]
        last = text.select(F.lit("default").alias("kind"), F.lit("").alias("key"), F.get_json_object("value", "$.default_radius").cast("double").alias("radius")).where("radius IS NOT NULL")
        out = maps[0].unionByName(maps[1]).unionByName(maps[2]).withColumn("key", F.upper("key")).unionByName(last)
    else:
        raise ValueError("a radius table is a CSV or a JSON file")
    fine = F.col("kind").isin("element", "atom", "ion", "default") & (F.col("radius") > 0)
    return out.where(F.when(F.coalesce(fine, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no radius: "), F.concat_ws(" ", "kind", "key"))).cast("boolean")))


def radius_records(spark: SparkSession, path: str) -> DataFrame:
    """Wildcard records (line, name, resname, radius) of a file of fixed columns: names in 6 to 9 and 11 to 13, the radius in 14 to 23."""
    lines = numbered_lines(spark, path).where(F.upper(F.substring("value", 1, 4)) == "VDWR")
    field = F.trim(F.substring(F.rpad("value", 23, " "), 14, 10))
    wrong = F.col("value").contains("\t") | ~field.contains(".") | field.try_cast("double").isNull()
    radius = F.when(wrong, F.raise_error(F.concat(F.lit("no radius in: "), "value")).cast("double")).otherwise(field.try_cast("double"))
    part = lambda a, n: F.rtrim(F.upper(F.substring("value", a, n)))
    return lines.select("line", part(6, 4).alias("name"), part(11, 3).alias("resname"), radius.alias("radius"))


def with_radius(atoms: DataFrame, table: DataFrame, records: DataFrame | None = None, default: float | None = None) -> DataFrame:
    """``atoms`` (name, resname, element) with a radius: the first of residue and atom, atom, lone ion, record, element, default.

    With ``records`` there is no falling through to the element: an atom that no record matches is an error. Without a default in
    table or call, atoms of no known radius keep a null.
    """
    name, residue = F.upper(F.trim("name")), F.upper(F.trim("resname"))
    of = lambda kind, n: small(table.where(F.col("kind") == kind).groupBy(F.col("key").alias(f"_k{n}")).agg(F.first("radius").alias(f"_r{n}")))
    keys: list[tuple[str, Column]] = [("atom", F.concat_ws(":", residue, name)), ("atom", name), ("ion", F.when(M.is_ion(name, residue, F.col("element")), M.infer_element(name, residue, F.col("element"))))]
    if records is None:
        keys.append(("element", F.upper("element")))
    out = atoms
    for n, (kind, key) in enumerate(keys):
        out = out.withColumn(f"_k{n}", key).join(of(kind, n), f"_k{n}", "left").drop(f"_k{n}")
    found = [F.col(f"_r{n}") for n in range(len(keys))]
    if records is not None:
        left = S.record_radii(out.where(F.coalesce(*found).isNull()).select("name", "resname"), records)
        out = out.withColumns({"_n": name, "_s": residue}).join(left.select(F.col("name").alias("_n"), F.col("resname").alias("_s"), F.col("radius").alias("_rr")), ["_n", "_s"], "left").drop("_n", "_s")
        found.append(F.col("_rr"))
    last = F.broadcast(table.agg(F.max(F.when(F.col("kind") == "default", F.col("radius"))).alias("_rd")))  # one row
    out = out.crossJoin(last).withColumn("radius", F.coalesce(*found, "_rd", F.lit(default).cast("double")))
    return out.select(*[c for c in out.columns if not c.startswith("_r")])
