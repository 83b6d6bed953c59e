"""Sinks: CSV with a header, JSON records in an envelope, Parquet, and fixed text formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = "0.1"


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header; null is empty."""
    df.write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def enveloped(df: DataFrame, kind: str) -> DataFrame:
    """One JSON text a row: schema version, kind and the row as data; NaN becomes null."""
    clean = [F.when(F.isnan(f"`{n}`"), None).otherwise(F.col(f"`{n}`")).alias(n) if t in ("double", "float") else F.col(f"`{n}`") for n, t in df.dtypes]
    return df.select(F.to_json(F.struct(F.lit(VERSION).alias("schema_version"), F.lit(kind).alias("kind"), F.struct(*clean).alias("data")), {"ignoreNullFields": "false"}).alias("value"))


def write_json(df: DataFrame, kind: str, path: str) -> None:
    enveloped(df, kind).write.mode("overwrite").text(path)


def write_parquet(df: DataFrame, path: str, *by: str) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def long_statistics(df: DataFrame, keys: list[str]) -> DataFrame:
    """Wide statistics as (keys, statistic, value) rows."""
    values = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.expr(f"stack({len(values)}, {', '.join(f'{chr(39)}{c}{chr(39)}, CAST(`{c}` AS double)' for c in values)}) AS (statistic, value)"))


def fixed_number(number: Column, width: int) -> Column:
    """A whole number in ``width`` columns: decimal as far as it goes, then in base 36 with a first capital, then a small letter.

    After 99999 comes A0000, after ZZZZZ a0000 (in five columns). A number that has no such place is an error.
    """
    from gridloom.sources.tables import base_36_starts

    n = number.cast("long")
    capital, small, end = base_36_starts(width)
    lead = 10 * 36 ** (width - 1)
    letters = lambda start: F.lpad(F.conv((n - start + lead).cast("string"), 10, 36), width, "0")
    wrong = F.raise_error(F.concat(F.lit(f"no number of {width} columns: "), n.cast("string"))).cast("string")
    return F.when((n < capital) & (n > -(10 ** (width - 1))), n.cast("string")).when((n >= capital) & (n < small), letters(capital)).when((n >= small) & (n < end), F.lower(letters(small))).when(n.isNotNull(), wrong)


def atom_record(serial: Column, name: Column, resname: Column, chain: Column, resid: Column, x: Column, y: Column, z: Column, b: Column) -> Column:
    """A coordinate record in fixed columns; numbers too long for theirs are written by :func:`fixed_number`."""
    return F.format_string("ATOM  %5s %-4s %3s %1s%4s    %8.3f%8.3f%8.3f  1.00%6.2f", fixed_number(serial, 5), name, resname, chain, fixed_number(resid, 4), x, y, z, b)


def manifest(files: DataFrame, root: str | None = None) -> DataFrame:
    """Path, size and SHA-256 of files read with the ``binaryFile`` source; with ``root`` the path below that folder, with slashes."""
    path = F.translate("path", "\\", "/")
    if root is not None:
        folder = root.replace("\\", "/").removeprefix("file:").rstrip("/") + "/"
        at = F.locate(folder, path)
        path = F.when(at > 0, F.substring(path, at + len(folder), F.length(path))).otherwise(F.raise_error(F.concat(F.lit("not below the folder: "), path)))
    return files.select(path.alias("path"), "length", F.sha2("content", 256).alias("sha256"))


def write_bundle(tables: dict[str, DataFrame], folder: str, kind: str) -> DataFrame:
    """One Parquet dataset for each table below a folder, and a manifest of all their files beside them, which is returned.

    A folder that holds a manifest already is not written to.
    """
    some = next(iter(tables.values()))
    spark, folder = some.sparkSession, folder.rstrip("/")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        raise ValueError(f"{folder} holds a bundle")
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load([f"{folder}/{name}" for name in tables])
    listed = manifest(files, folder).withColumn("kind", F.lit(kind))
    listed.write.json(f"{folder}/manifest")
    return spark.read.schema(listed.schema).json(f"{folder}/manifest")


def chosen_outputs(analyses: list[str], formats: list[str], defaults: tuple[list[str], list[str]], asked: list[str] = (), everything: bool = False, skipped: list[str] = ()) -> tuple[list[str], list[str]]:
    """Which analyses to run and which formats to write; ``asked`` names either, and what it doesn't name stays at the default.

    The format ``data`` is always written. Unknown names, all with a choice, and an analysis both asked for and skipped are errors.
    """
    asked = list(dict.fromkeys(asked))
    if everything and asked:
        raise ValueError("choose outputs or all of them")
    unknown = [t for t in asked if t not in (*analyses, *formats, "default", "none", "data")]
    both = [t for t in asked if t in skipped]
    if unknown or both:
        raise ValueError("no such output: " + ", ".join(unknown) if unknown else "asked for and skipped: " + ", ".join(both))
    kinds, wanted = [t for t in asked if t in formats], [t for t in asked if t in analyses]
    if everything:
        kinds, wanted = list(formats), list(analyses)
    if not kinds and "none" not in asked or "default" in asked:
        kinds += defaults[1]
    if not wanted or "default" in asked:
        wanted += defaults[0]
    return [a for a in analyses if a in wanted and a not in skipped], sorted({*kinds, "data"})
