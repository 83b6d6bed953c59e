r"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Each source gets a share of ``ratio`` times all words, in proportion to its weight and at most ``most`` times its own
words; what is above that limit goes to the other sources by weight. A source whose target is r times its words
gives every document floor(r) whole copies. The rest of its target is a sample of unequal probabilities: a document's
inclusion is in proportion to a weight of its size (its size's class of bits; the weight doubles with four times the
size), so that the words expected are the rest of the target; classes whose inclusion would pass 1 give each document one
more whole copy, for certain. The others are ranked by Pareto order: the odds of a random number over the odds of their
inclusion. Ranks are taken from the lowest up to the point nearest to the target. The random number is a hash of
doc_id and a seed, so that reruns agree.

No group is brought to one task: documents are counted in ranges of the rank for each source, and only the range in
which the sample ends is sorted, to find the last rank taken. Then each row is decided by itself. Sources are numbered
by a sort dealt to ranges, and shares above the limit are found by sums over all sources, repeated until none is above.

Null texts are empty and count no words. A null source is a source of its own, after all others. Documents without
words are taken or left by rank and add nothing. Rows with the same doc_id and text share a rank and are taken or
left together. An empty table gives an empty mix. All columns of :func:`mix_sources` pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import keep, text_key, word_count

WEIGHTS = (5, 2, 1)
#: Ranges of the Pareto rank in which words are counted, for each source: so many for each 1 up to MOST_RANK. All ranks
#: beyond that lie in one more; samples of many documents end near rank 1.
RANGES, MOST_RANK = 4096, 4
#: Rows of the table of sources up to which it is broadcast; beyond, documents are joined in salted groups.
BROADCAST_SOURCES = 20_000
SALTS = 32


def uniform(doc_id: Column, seed: int) -> Column:
    """A number strictly between 0 and 1 that depends on doc_id and the seed only."""
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long") + 0.5) / F.lit(float(2**52))


def _sizes(docs: DataFrame, seed: int) -> DataFrame:
    """What decides about each row of ``docs``, and the row itself as a struct."""
    size = word_count(F.col("text"))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        text_key(F.col("source")).alias("key"),
        F.col("source").cast("string").alias("source"),
        uniform(F.col("doc_id"), seed).alias("u"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("tie"),
        size.alias("size"),
    )
    return rows.withColumn("class", F.length(F.bin("size")))


def _weight(size_class: Column) -> Column:
    """Doubles with every second class, that is with four times the size."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.floor((size_class - 1) / 2).cast("int"))


def _rank(c: Column, size_class: Column, top: Column, u: Column) -> tuple[Column, Column]:
    """A document's inclusion (1 above the class ``top``), and its Pareto rank where that lies between 0 and 1."""
    inclusion = F.when(size_class > top, F.lit(1.0)).otherwise(c * _weight(size_class))
    odds = lambda p: p / (1 - p)
    return inclusion, F.when((inclusion > 0) & (size_class <= top), odds(u) / odds(inclusion))


def _range(rank: Column) -> Column:
    return F.floor(F.least(rank, F.lit(float(MOST_RANK))) * RANGES)


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``place``, from 0 by ``order``: sorted in ranges, each numbered by itself from where the one before ends."""
    part = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = keep(part.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "mix-numbered")
    ends = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each range
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first")).withColumn("before", F.coalesce(F.sum("n").over(ends), F.lit(0)))
    return rows.join(F.broadcast(sizes.drop("n")), "part").withColumn("place", F.col("at") - F.col("first") + F.col("before")).drop("part", "at", "first", "before")


def _targets(sources: DataFrame, weights, ratio: float, most: float) -> DataFrame:
    """``sources`` (key, source, source_size) with the weight and target of each."""
    sources = numbered(sources, F.col("source").isNull(), F.col("source"))
    sources = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
    sources = keep(sources.withColumn("limit", F.col("source_size") * F.lit(float(most))).withColumn("fill", F.col("limit") / F.col("weight")), "mix-weights")
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0)
    level, full = -1.0, -1
    while True:
        above = F.col("fill") < F.lit(level)
        had, taken, left = sources.agg(F.count(F.when(above, 1)), F.sum(F.when(above, F.col("limit"))), F.sum(F.when(~above, F.col("weight")))).first()
        if had == full or not left:
            break
        full, level = had, (total * ratio - (taken or 0.0)) / left
    level = F.lit(level if left else None).cast("double")
    return sources.withColumn("target", F.least("limit", F.coalesce(level * F.col("weight"), F.col("limit")))).drop("place", "fill")


def source_plan(rows: DataFrame, weights=WEIGHTS, ratio: float = 1.5, most: float = 2.0) -> DataFrame:
    """A row for each source of ``rows`` (of :func:`_sizes`, written): size, target, whole copies, what its inclusions are, and the last rank taken."""
    classes = keep(rows.groupBy("key", "source", "class").agg(F.sum("size").alias("words")), "mix-classes")
    sources = _targets(classes.groupBy("key", "source").agg(F.sum("words").alias("source_size")), weights, ratio, most)
    some = F.col("source_size") > 0
    sources = sources.withColumn("whole", F.when(some, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    sources = keep(sources.withColumn("rest", F.when(some, F.col("target") - F.col("whole") * F.col("source_size")).otherwise(F.lit(0.0))), "mix-targets")
    # the greatest class whose inclusion stays below 1, if all greater ones are taken for certain; there are at most 64 classes
    greater = Window.partitionBy("key").orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("key").orderBy("class").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = classes.withColumn("certain", F.coalesce(F.sum("words").over(greater), F.lit(0)).cast("long"))
    at = at.withColumn("weighted", F.sum(F.col("words") * _weight(F.col("class"))).over(upto)).join(sources.select("key", "rest"), "key")
    at = at.withColumn("c", F.when(F.col("weighted") > 0, (F.col("rest") - F.col("certain")) / F.col("weighted")).otherwise(F.lit(0.0)))
    at = at.where(F.col("c") * _weight(F.col("class")) < 1).groupBy("key").agg(F.max(F.struct("class", "c", "certain")).alias("at"))
    at = at.select("key", F.col("at.class").alias("top"), F.col("at.c").alias("c"), F.col("at.certain").cast("double").alias("certain"))
    sources = keep(sources.join(at, "key").withColumn("sampled", F.col("rest") - F.col("certain")), "mix-sources")
    # the range of ranks in which the words taken pass what is left to sample
    ranked = _joined(rows.select("key", "u", "id", "tie", "size", "class"), sources.select("key", "top", "c", "sampled"))
    ranked = ranked.withColumn("rank", _rank(F.col("c"), F.col("class"), F.col("top"), F.col("u"))[1]).where(F.col("rank").isNotNull())
    ranges = keep(ranked.groupBy("key", "sampled", _range(F.col("rank")).alias("range")).agg(F.sum("size").alias("words")), "mix-ranges")
    up = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = ranges.withColumn("before", F.sum("words").over(up) - F.col("words"))
    cut = keep(cut.where((F.col("before") < F.col("sampled")) & (F.col("before") + F.col("words") >= F.col("sampled"))).select("key", F.col("range").alias("cut"), "before"), "mix-cut")
    few = cut.count() <= BROADCAST_SOURCES
    inside = ranked.withColumn("cut", _range(F.col("rank"))).join(F.broadcast(cut) if few else cut, ["key", "cut"])
    # copies of a row stand together, and are counted together
    inside = inside.groupBy("key", "rank", "id", "tie", "before", "sampled").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("key").orderBy("rank", "id", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("through", F.col("before") + F.sum("words").over(order))
    start = F.col("through") - F.col("words")
    near = (start < F.col("sampled")) & ((F.col("through") <= F.col("sampled")) | (F.col("through") - F.col("sampled") < F.col("sampled") - start))
    last = inside.where(near).groupBy("key").agg(F.max(F.struct("rank", "id", "tie")).alias("last"))
    return keep(sources.join(cut.drop("before").join(last, "key", "left"), "key", "left"), "mix-plan")


def _joined(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with what the plan says of their source: broadcast up to BROADCAST_SOURCES, beyond that in salted groups."""
    if plan.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(plan), "key")
    salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.floor(F.col("u") * 1e6 % SALTS).cast("int")).join(salted, ["key", "salt"]).drop("salt")


def decided(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of :func:`_sizes` with ``copies``, ``inclusion``, ``rank`` and what the plan says of their source."""
    inclusion, rank = _rank(F.col("c"), F.col("class"), F.col("top"), F.col("u"))
    # below the range of the cut every rank is taken, in it those up to the last
    # ("cut" is null where the source has nothing left to sample)
    before = _range(F.col("rank")) < F.col("cut")
    taken = (F.col("class") > F.col("top")) | F.coalesce(F.col("rank").isNotNull() & (before | ((_range(F.col("rank")) == F.col("cut")) & (F.struct("rank", "id", "tie") <= F.col("last")))), F.lit(False))
    joined = _joined(rows, plan.select("key", "source_size", "target", "whole", "top", "c", "cut", "last"))
    return joined.withColumns({"inclusion": inclusion, "rank": rank}).withColumn("copies", F.col("whole") + F.when(taken, 1).otherwise(0))


def mix_report(docs: DataFrame, seed: int = 7, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, then inclusion, pareto_rank and copies, of every document."""
    rows = keep(_sizes(docs.select("doc_id", "text", "source"), seed).withColumn("doc_id", F.col("row.doc_id")).drop("row"), "mix-sizes")
    return decided(rows, source_plan(rows, **options)).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "inclusion", F.col("rank").alias("pareto_rank"), "copies")


def mix_sources(docs: DataFrame, seed: int = 7, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, with the columns of ``docs``."""
    sizes = keep(_sizes(docs.select("doc_id", "text", "source"), seed).drop("row"), "mix-sizes")
    mixed = decided(_sizes(docs, seed), source_plan(sizes, **options)).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents, mixed by weights 5, 2, 1 to 150 % of all words."""
    return mix_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS tie,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':7'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
e AS (SELECT *, length(bin(size))::INT AS cls FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
f AS (SELECT *, source_size * 2.0::DOUBLE AS lim, source_size * 2.0::DOUBLE / weight AS fill, sum(source_size) OVER ()::DOUBLE AS total FROM w),
g AS (SELECT *,
         coalesce(sum(lim) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
         sum(weight) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left FROM f),
h AS (SELECT *, (total * 1.5::DOUBLE - full_before) / weight_left AS lv FROM g),
lvl AS (SELECT arg_min(lv, fill) AS level FROM h WHERE lv <= fill),
t AS (SELECT source, source_size, least(lim, coalesce(level * weight, lim)) AS target FROM h, lvl),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
q AS (SELECT *, CASE WHEN source_size > 0 THEN target - whole * source_size::DOUBLE ELSE 0 END AS rest FROM p),
cl AS (SELECT source, cls, sum(size)::BIGINT AS words, (1::BIGINT << ((cls - 1) // 2))::BIGINT AS wt FROM e GROUP BY source, cls),
cs AS (SELECT *,
         coalesce(sum(words) OVER (PARTITION BY source ORDER BY cls DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS certain,
         sum(words * wt) OVER (PARTITION BY source ORDER BY cls ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE AS weighted FROM cl),
cr AS (SELECT cs.*, q.rest, CASE WHEN weighted > 0 THEN (q.rest - certain) / weighted ELSE 0 END AS c FROM cs JOIN q ON cs.source IS NOT DISTINCT FROM q.source),
ct AS (SELECT source, max(cls) AS top, arg_max(c, cls) AS c, arg_max(rest - certain, cls) AS sampled FROM cr WHERE c * wt < 1 GROUP BY source),
j AS (SELECT e.*, q.source_size, q.target, q.whole, ct.top, ct.sampled,
         CASE WHEN e.cls > ct.top THEN 1.0::DOUBLE ELSE ct.c * (1::BIGINT << ((e.cls - 1) // 2))::DOUBLE END AS inclusion
      FROM e JOIN q ON e.source IS NOT DISTINCT FROM q.source JOIN ct ON e.source IS NOT DISTINCT FROM ct.source),
r AS (SELECT *, CASE WHEN inclusion > 0 AND cls <= top THEN (u / (1 - u)) / (inclusion / (1 - inclusion)) END AS pareto_rank FROM j),
c AS (SELECT *,
         sum(size) OVER (PARTITION BY source, pareto_rank IS NULL ORDER BY pareto_rank, coalesce(doc_id::VARCHAR, ''), tie RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS thru,
         sum(size) OVER (PARTITION BY source, pareto_rank IS NULL, pareto_rank, coalesce(doc_id::VARCHAR, ''), tie) AS own FROM r),
k AS (SELECT *, whole + CASE WHEN cls > top THEN 1 WHEN pareto_rank IS NULL THEN 0
         WHEN thru - own < sampled AND (thru <= sampled OR thru - sampled < sampled - (thru - own)) THEN 1 ELSE 0 END AS copies FROM c)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, inclusion, pareto_rank, copies::BIGINT AS copies
FROM k"""
