"""Text formats: scalar grids, run parameters, settings with their origin, tokenised loops, atoms' elements."""

from __future__ import annotations

import dataclasses
import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.store import keep


def grid_header(lines: list[str]) -> dict:
    """Counts, origin and spacing of an OpenDX header."""
    out: dict[str, Any] = {"delta": []}
    for line in lines:
        parts = line.split()
        if "counts" in parts and "gridpositions" in parts:
            out["counts"] = tuple(map(int, parts[-3:]))
        elif parts[:1] == ["origin"]:
            out["origin"] = tuple(map(float, parts[1:4]))
        elif parts[:1] == ["delta"]:
            out["delta"].append(tuple(map(float, parts[1:4])))
    if {"counts", "origin"} - set(out) or len(out["delta"]) != 3:
        raise ValueError("the grid's header is not complete")
    return out


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, k, x, y, z, value) of an OpenDX scalar grid; the last axis runs fastest. One file is one row until it is split."""
    whole = spark.read.text(path, wholetext=True)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for text in batch.column(0).to_pylist():
                lines = [x for x in text.splitlines() if x and not x.startswith("#")]
                start = next(n for n, x in enumerate(lines) if "data follows" in x) + 1
                head = grid_header(lines[:start])
                values = []
                for line in lines[start:]:
                    if line.startswith(("attribute", "object", "component")):
                        break
                    values.extend(map(float, line.split()))
                n = head["counts"]
                if len(values) != n[0] * n[1] * n[2]:
                    raise ValueError("the grid has not as many values as its header says")
                at = np.indices(n).reshape(3, -1)
                place = np.array(head["origin"])[:, None] + np.array(head["delta"]).T @ at
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in (*at, *place, np.array(values))], ["i", "j", "k", "x", "y", "z", "value"])

    return whole.mapInArrow(run, "i long, j long, k long, x double, y double, z double, value double")


def grid_lines(values: DataFrame, counts: tuple, origin: tuple, spacing: float) -> DataFrame:
    """Ordered lines (n, value) of an OpenDX grid from (i, j, k, value), three values a line; missing ones are 0."""
    spark = values.sparkSession
    a, b, c = counts
    head = [f"object 1 class gridpositions counts {a} {b} {c}", "origin " + " ".join(map(str, origin)), f"delta {spacing} 0 0", f"delta 0 {spacing} 0", f"delta 0 0 {spacing}", f"object 2 class gridconnections counts {a} {b} {c}", f"object 3 class array type double rank 0 items {a * b * c} data follows"]
    top = spark.createDataFrame(list(enumerate(head)), "n long, value string")
    cells = spark.range(a * b * c).select("id", F.floor(F.col("id") / (b * c)).alias("i"), (F.floor(F.col("id") / c) % b).alias("j"), (F.col("id") % c).alias("k"))
    full = cells.join(values.select("i", "j", "k", "value"), ["i", "j", "k"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    rows = full.groupBy(F.floor(F.col("id") / 3).alias("line")).agg(F.array_sort(F.collect_list(F.struct("id", "value"))).alias("v"))
    body = rows.select((F.col("line") + len(head)).alias("n"), F.array_join(F.transform("v", lambda x: F.format_string("%.6g", x["value"])), " ").alias("value"))
    return top.unionByName(body)


def parameters(lines: DataFrame) -> DataFrame:
    """key and value of ``key = value`` lines; what follows a semicolon is a comment, keys are lower case with underscores."""
    bare = F.trim(F.split(F.col("value"), ";")[0])
    rows = lines.select(bare.alias("line")).where(F.col("line").contains("="))
    return rows.select(F.lower(F.regexp_replace(F.trim(F.split("line", "=", 2)[0]), "-", "_")).alias("key"), F.trim(F.split("line", "=", 2)[1]).alias("value"))


def tokens(line: str) -> list[str]:
    """Tokens of a line of a loop file; quoted ones may hold spaces, and end at a quote before white space."""
    import re

    return [a or b or c for a, b, c in re.findall(r"'((?:[^']|'(?=\S))*)'(?=\s|$)|\"((?:[^\"]|\"(?=\S))*)\"(?=\s|$)|(\S+)", line)]


def loop_values(lines: list[str]):
    """Tokens of a loop's lines in order; what stands between two lines that begin with a semicolon is one token."""
    held: list[str] | None = None
    for line in lines:
        if held is not None:
            if line.startswith(";"):
                yield "\n".join(held)
                held = None
                yield from tokens(line[1:])
            else:
                held.append(line)
        elif line.startswith(";"):
            held = [line[1:]]
        else:
            yield from tokens(line)
    if held is not None:
        raise ValueError("a text block of the loop has no end")


def read_loop(spark: SparkSession, path: str, prefix: str = "_atom_site.") -> DataFrame:
    """Rows of one loop of a token file, as maps by column name; ``.`` and ``?`` are empty.

    A row may go over several lines, a value too if semicolons begin its first line and the one after. Names that occur twice, and
    values that don't fill the last row, are errors.
    """
    whole = spark.read.text(path, wholetext=True)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for text in batch.column(0).to_pylist():
                names, body, block = [], [], False
                for line in text.splitlines():
                    if not block and line.startswith(prefix):
                        names.append(line.strip()[len(prefix) :])
                    elif names and not block and (line.startswith(("#", "loop_", "_", "data_")) or not line.strip()):
                        if body:
                            break
                    elif names:
                        block ^= line.startswith(";")
                        body.append(line)
                if len(set(names)) != len(names):
                    raise ValueError("the loop has a name twice")
                values = list(loop_values(body))
                if names and len(values) % len(names):
                    raise ValueError("a row of the loop has not as many tokens as the loop has names")
                width = max(1, len(names))
                for at in range(0, len(values), 4096 * width):
                    part = values[at : at + 4096 * width]
                    rows = [[(n, "" if t in (".", "?") else t) for n, t in zip(names, part[i : i + width], strict=True)] for i in range(0, len(part), width)]
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.map_(pa.string(), pa.string()))], ["row"])

    return whole.mapInArrow(run, "row map<string,string>")


def loop_atoms(rows: DataFrame) -> DataFrame:
    """Atoms from loop rows: author names and numbers, else the file's own."""
    first = lambda *names: F.coalesce(*[F.nullif(F.col("row")[n], F.lit("")) for n in names], F.lit(""))
    number = lambda n: F.expr(f"try_cast(row['{n}'] AS double)")
    return rows.select(
        F.expr("try_cast(row['id'] AS int)").alias("serial"), first("auth_atom_id", "label_atom_id").alias("name"), first("label_alt_id").alias("altloc"), first("auth_comp_id", "label_comp_id").alias("resname"),
        first("auth_asym_id", "label_asym_id").alias("chain"), first("auth_seq_id", "label_seq_id").try_cast("int").alias("resid"), first("pdbx_PDB_ins_code").alias("icode"),
        number("Cartn_x").alias("x"), number("Cartn_y").alias("y"), number("Cartn_z").alias("z"), number("occupancy").alias("occupancy"), number("B_iso_or_equiv").alias("bfactor"),
        F.upper(first("type_symbol")).alias("element"), (F.col("row")["group_PDB"] == "HETATM").alias("hetero"),
    )


#: The elements' symbols.
ELEMENTS = (
    "H HE LI BE B C N O F NE NA MG AL SI P S CL AR K CA SC TI V CR MN FE CO NI CU ZN GA GE AS SE BR KR RB SR Y ZR NB MO TC RU RH PD AG CD IN SN SB TE I XE "
    "CS BA LA CE PR ND PM SM EU GD TB DY HO ER TM YB LU HF TA W RE OS IR PT AU HG TL PB BI PO AT RN FR RA AC TH PA U NP PU AM CM BK CF ES FM MD NO LR RF DB SG BH HS MT DS RG CN NH FL MC LV TS OG"
).split()
#: Ions named alike as residue and as atom, by element; and those whose two names differ.
SAME_NAME_IONS = {
    "LI": ("LIT", "LI", "LI+"), "NA": ("SOD", "NA", "NA+"), "K": ("POT", "K", "K+"), "RB": ("RUB", "RB", "RB+"), "CS": ("CES", "CS", "CS+"), "MG": ("MG",), "CA": ("CAL", "CA"), "BA": ("BAR",),
    "ZN": ("ZN",), "CU": ("CU",), "F": ("F", "F-"), "CL": ("CLA", "CL", "CL-"), "BR": ("BR", "BR-"), "I": ("I", "I-"),
}
OTHER_IONS = {("ZN2", "ZN"): "ZN", ("CD2", "CD"): "CD", ("CU1", "CU"): "CU"}
#: Names of protein carbons; two-letter symbols that begin no carbon's or nitrogen's name, and those that do.
CARBONS = "C CA CB CD CD1 CD2 CE CE1 CE2 CE3 CG CG1 CG2 CH2 CZ CZ2 CZ3".split()
CLEAR_SYMBOLS, SHARED_SYMBOLS = ("CL", "BR", "FE", "MG", "MN", "ZN", "LI", "CU", "SE"), ("CA", "NA", "CO", "NI")
WATERS = ("HOH", "WAT", "SOL", "TIP3", "TIP4", "SPC", "H2O")


def is_water(resname: Column) -> Column:
    return F.upper(F.trim(resname)).isin(*WATERS)


def _ion_element(name: Column, resname: Column) -> Column:
    """The element of a lone ion, from the atom's and the residue's names together; null for all else."""
    alike = [F.when((name == resname) & name.isin(*names), symbol) for symbol, names in SAME_NAME_IONS.items()]
    return F.coalesce(*alike, *[F.when((resname == r) & (name == n), symbol) for (r, n), symbol in OTHER_IONS.items()])


def _explicit(element: Column | None) -> Column:
    """The element column's symbol without charge signs and digits, if it is one."""
    if element is None:
        return F.lit(None).cast("string")
    bare = F.regexp_replace(F.upper(F.coalesce(element, F.lit(""))), "[^A-Z]", "")
    return F.when(bare.isin(*ELEMENTS), bare)


def infer_element(name: Column, resname: Column, element: Column | None = None) -> Column:
    """An atom's element, in upper case: the first rule that says one.

    The element column, if it holds a symbol; a lone ion's names; C for an empty name; then, after leading digits are taken
    off: protein carbons' names (but CA of residue CA); two-letter symbols that begin no carbon's or nitrogen's name; others
    only where residue and atom bear that symbol; the first letter.
    """
    atom, residue = F.upper(F.trim(F.coalesce(name, F.lit("")))), F.upper(F.trim(F.coalesce(resname, F.lit(""))))
    rest = F.regexp_replace(atom, "^[0-9]+", "")
    two = F.substring(rest, 1, 2)
    return F.coalesce(
        _explicit(element),
        _ion_element(atom, residue),
        F.when(atom == "", "C"),
        F.when(rest.isin(*CARBONS) & (residue != "CA"), "C"),
        F.when(two.isin(*CLEAR_SYMBOLS), two),
        F.when(rest.isin(*SHARED_SYMBOLS) & (rest == residue), rest),
        F.when(rest != "", F.substring(rest, 1, 1)),
        F.lit("C"),
    )


def is_ion(name: Column, resname: Column, element: Column | None = None) -> Column:
    """A lone ion: both names are one's, and the element column, if it holds a symbol, doesn't say otherwise."""
    symbol = _ion_element(F.upper(F.trim(name)), F.upper(F.trim(resname)))
    return F.coalesce(symbol.isNotNull() & (F.coalesce(_explicit(element), symbol) == symbol), F.lit(False))


def linked_groups(atoms: DataFrame, reach: float = 1.75) -> DataFrame:
    """Links (a, b) between residues of one chain whose N and C atoms are bonded. Atoms: chain, grp, name, x, y, z."""
    from gridloom.operators.joins import range_join

    part = lambda n: atoms.where(F.upper(F.trim("name")) == n).select("chain", "grp", "x", "y", "z")
    pairs = range_join(part("N"), part("C"), reach, ["chain"]).where("l_grp <> r_grp")
    return pairs.select(F.least("l_grp", "r_grp").alias("a"), F.greatest("l_grp", "r_grp").alias("b")).distinct()


def polymer_groups(residues: DataFrame, links: DataFrame) -> DataFrame:
    """Candidate residues that count as polymer: in a run that touches one, or in a run of several that are all declared.

    ``residues``: grp, polymer (known), declared.
    """
    from gridloom.operators.graph import components

    runs = components(residues.select(F.col("grp").alias("node")), links)
    joined = keep(residues.join(runs.select(F.col("node").alias("grp"), "comp"), "grp"), "runs")
    whole = joined.groupBy("comp").agg(F.max(F.col("polymer").cast("int")).alias("_p"), F.count("*").alias("_n"), F.min(F.col("declared").cast("int")).alias("_d"))
    fine = (F.col("_p") == 1) | ((F.col("_n") > 1) & (F.col("_d") == 1))
    return joined.join(whole, "comp").where(fine).select("grp")


@dataclasses.dataclass(frozen=True)
class Settings:
    """Settings of a run; each knows whether it came from the command line, a file or the default."""

    cutoff: float = 4.5
    metric: str = "center"
    probe: float = 1.4
    spacing: float = 0.5
    min_occupancy: float = 0.5

    @classmethod
    def load(cls, text: str | None = None, given: dict | None = None) -> tuple[Settings, dict[str, str]]:
        known = {f.name: f.type for f in dataclasses.fields(cls)}
        config, given = (json.loads(text) if text else {}), given or {}
        for name in [*config, *given]:
            if name not in known:
                raise ValueError(f"no setting is named {name}")
        merged = {k: (given | {})[k] if k in given else config[k] for k in known if k in given or k in config}
        merged = {k: float(v) if known[k] == "float" else str(v) for k, v in merged.items()}
        origin = {k: "cli" if k in given else "config" if k in config else "default" for k in known}
        return cls(**merged), origin
