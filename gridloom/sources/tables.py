"""Scans: the tables of a folder, and the logical inputs that the operators take from them.

Every scan is a Parquet read by Spark, so filters and columns reach the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def points(spark: SparkSession, folder: str) -> DataFrame:
    """Points with a radius and a group, from the first three components of the embeddings."""
    at = lambda i: F.col("embedding")[i].cast("double")
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("label").alias("grp"),
        at(0).alias("x"),
        at(1).alias("y"),
        at(2).alias("z"),
        ((F.col("vec_id") % 5 + 1) * F.lit(0.01)).alias("r"),
        (F.col("label") == 9).alias("hetero"),
    )


POINTS_SQL = """points AS (SELECT vec_id AS id, label AS grp, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z,
  (vec_id % 5 + 1) * 0.01::DOUBLE AS r, label = 9 AS hetero FROM embeddings)"""


def series(spark: SparkSession, folder: str) -> DataFrame:
    """Ordered frames of one value a key, from events: key, frame (from 0), t (seconds), kind, s."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, folder, "events").select(
        F.col("user_id").alias("key"),
        (F.row_number().over(order) - 1).cast("long").alias("frame"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t"),
        F.col("event_type").alias("kind"),
        F.col("value").alias("s"),
        "event_id",
    )


SERIES_SQL = """series AS (SELECT user_id AS key, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS frame,
  epoch_us(ts) / 1e6::DOUBLE AS t, event_type AS kind, value AS s, event_id FROM events)"""


def memberships(spark: SparkSession, folder: str) -> DataFrame:
    """Sets over frames: the users seen on each day, as (frame, member, grp); a group is a user's number modulo 7."""
    events = table(spark, folder, "events")
    first = events.agg(F.min(F.to_date("ts")).alias("first"))
    return (
        events.select(F.to_date("ts").alias("day"), "user_id")
        .distinct()
        .crossJoin(F.broadcast(first))  # one row
        .select(F.datediff("day", "first").cast("long").alias("frame"), F.col("user_id").alias("member"), (F.col("user_id") % 7).alias("grp"))
    )


MEMBERS_SQL = """members AS (SELECT DISTINCT date_diff('day', (SELECT min(ts::DATE) FROM events), ts::DATE)::BIGINT AS frame, user_id AS member, user_id % 7 AS grp FROM events)"""


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Profiles, one for each part: running index s and radius r, in a complete order."""
    order = Window.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    return table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("profile"), (F.row_number().over(order) - 1).cast("long").alias("i"), (F.row_number().over(order) - 1).cast("double").alias("s"), F.col("l_quantity").alias("r")
    )


PROFILES_SQL = """profiles AS (SELECT l_partkey AS profile, (row_number() OVER w - 1)::BIGINT AS i, (row_number() OVER w - 1)::DOUBLE AS s, l_quantity AS r FROM lineitem
  WINDOW w AS (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice))"""


def base_36_starts(width: int) -> tuple[int, int, int]:
    """The first numbers that ``width`` columns hold with a first capital and with a first small letter, and the first they don't."""
    step = 26 * 36 ** (width - 1)
    return 10**width, 10**width + step, 10**width + 2 * step


def fixed_number(text: Column, width: int) -> Column:
    """The whole number of trimmed columns: decimal, or in base 36 by its first letter; null if it is neither."""
    capital, small, _ = base_36_starts(width)
    value = F.conv(F.upper(text), 36, 10).cast("long") - 10 * 36 ** (width - 1)
    plain = text.try_cast("int")
    return F.when(text.rlike(f"^[A-Z][0-9A-Z]{{{width - 1}}}$"), value + capital).when(text.rlike(f"^[a-z][0-9a-z]{{{width - 1}}}$"), value + small).otherwise(plain).cast("int")


def fixed_columns(lines: DataFrame) -> DataFrame:
    """Coordinate records in fixed columns, from a text scan (column ``value``): one row for each atom record."""
    v = F.col("value")
    part = lambda a, n: F.trim(F.substring(v, a, n))
    num = lambda a, n: F.expr(f"try_cast(trim(substring(value, {a}, {n})) AS double)")
    return lines.where(F.substring(v, 1, 6).isin("ATOM  ", "HETATM")).select(
        fixed_number(part(7, 5), 5).alias("serial"),
        part(13, 4).alias("name"),
        part(17, 1).alias("altloc"),
        part(18, 3).alias("resname"),
        part(22, 1).alias("chain"),
        fixed_number(part(23, 4), 4).alias("resid"),
        part(27, 1).alias("icode"),
        num(31, 8).alias("x"),
        num(39, 8).alias("y"),
        num(47, 8).alias("z"),
        num(55, 6).alias("occupancy"),
        num(61, 6).alias("bfactor"),
        F.upper(part(77, 2)).alias("element"),
        F.substring(v, 1, 6).eqNullSafe("HETATM").alias("hetero"),
    )


def read_fixed_columns(spark: SparkSession, path: str) -> DataFrame:
    """:func:`fixed_columns` of a text file; a coordinate that is no finite number is an error."""
    rows = fixed_columns(spark.read.text(path))
    bad = F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull() | F.isnan("x") | F.isnan("y") | F.isnan("z")
    return rows.withColumn("x", F.when(bad, F.raise_error(F.concat(F.lit("coordinate of atom "), F.col("serial").cast("string")))).otherwise(F.col("x")))


def one_altloc(atoms: DataFrame) -> DataFrame:
    """Blank alternate locations, and of the others the first in each residue."""
    first = F.min(F.when(F.col("altloc") != "", F.col("altloc"))).over(Window.partitionBy("chain", "resid", "icode"))
    return atoms.withColumn("_first", first).where((F.col("altloc") == "") | (F.col("altloc") == F.col("_first"))).drop("_first")


def frame_range(frames: DataFrame, start: int, stop: int, stride: int, frame: str = "frame") -> DataFrame:
    """Frames of the half-open range; a negative start, or a stride below one, is an error."""
    if start < 0 or stride < 1 or stop <= start:
        raise ValueError("the frame range is empty or negative")
    f = F.col(frame)
    return frames.where((f >= start) & (f < stop) & ((f - start) % stride == 0))


def inspect(frames: DataFrame, frame: str = "frame") -> DataFrame:
    """Number, first and last of the frames, without reading anything else."""
    return frames.agg(F.countDistinct(frame).alias("frames"), F.min(frame).alias("first"), F.max(frame).alias("last"))


def radius_records(lines: DataFrame) -> DataFrame:
    """Wildcard radius records (``VDWR name residue radius``) of a text scan, in file order by ``line``."""
    parts = F.split(F.trim("value"), r"\s+")
    return lines.where(F.upper(parts[0]) == "VDWR").select("line", parts[1].alias("name"), parts[2].alias("resname"), F.expr("try_cast(split(trim(value), '\\\\s+')[3] AS double)").alias("radius"))


def label(chain: Column, resname: Column, resid: Column, icode: Column) -> Column:
    """A residue's label: chain or ``_``, a colon, name, number and insertion code."""
    return F.concat(F.when(F.trim(chain) == "", F.lit("_")).otherwise(F.trim(chain)), F.lit(":"), resname, resid.cast("string"), F.trim(icode))
