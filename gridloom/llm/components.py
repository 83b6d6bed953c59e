"""Connected components of links between integers, in Spark: alternating large and small stars.

Each round joins every node to the least number it knows of, first through larger neighbours, then through smaller
ones; the links that remain when nothing changes are stars. Rounds grow with the logarithm of the longest chain. Links
stay distributed; each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import keep

#: Links that one file of a round holds, about.
FILE_LINKS = 100_000


def _star(links: DataFrame, large: bool) -> DataFrame:
    """``links``: (a, b) with a > b, distinct."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        moved = links.join(least, "a")
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link: root is the least number that it is linked to, step by step."""
    now = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    now, mark = keep(now, "links"), None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        # few links need few files; the number grows with theirs
        now = keep(_star(_star(now, True), False).coalesce(1 + seen[0] // FILE_LINKS), "links")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
