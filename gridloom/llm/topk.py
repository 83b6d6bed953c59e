"""Exact top-k by inner product: an impact-ordered index, read score-at-a-time.

Components become integers, floor(256 x). Rows are dealt by hash into index blocks of bounded size; a block's index
holds, for each dimension, its rows ordered by impact level (a level spans :data:`STEP` integer values). For a query, a level of a dimension is a
posting segment; its impact is the least contribution that its rows can get there, over the least that any row of
the block gets. Segments are added to the rows' accumulators by descending impact. At any time a row's score is at
least its accumulator, and at most that plus the best impact still to come in each dimension plus the width of
levels. The reading stops only when that proves that all but a few rows can't be among the k best (or at the end);
rows that still can are scored exactly. Blocks' winners are then ranked together.

Queries are those rows that the caller marks; they too are packed into blocks, and every pair of a query block and an
index block is one group, so no task grows with the input. A packed index block travels once for each query block, a
packed query block once for each index block; blocks of these sizes hold both down. Null vectors, empty ones and those with null or
non-finite components take no part, nor do rows without id. Shorter vectors end in zeros. A candidate with the query's
id is the query's own row. Copies of vectors tie, and the smaller id wins. Repeated query rows count once. An empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import keep
from gridloom.llm.vectors import best, packed, spread, unpacked, usable

#: Values of a level, rows of an index block and queries of a query block.
STEP, INDEX_ROWS, QUERY_ROWS = 4, 32_768, 8192
#: Segments between two looks at the bound, and the share of a block that may be left to score exactly.
LOOK, FEW = 128, 1 / 64


class ImpactBlock:
    """The index of one block: ``ids`` and an integer matrix."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        level = values // STEP
        self.order = np.argsort(level, axis=0, kind="stable").T.copy()
        self.segments = []  # dimension, level, begin and end in the order
        for d in range(values.shape[1]):
            have, begin = np.unique(level[self.order[d], d], return_index=True)
            self.segments.append(np.stack([np.full(len(have), d), have, begin, np.append(begin[1:], len(ids))], 1))
        self.table = np.concatenate(self.segments) if len(ids) else np.zeros((0, 4), np.int64)

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows, and never the query's own."""
        table, n = self.table, len(self.ids)
        q = query[table[:, 0]]
        ends = table[:, 1] * STEP
        low = np.minimum(q * ends, q * (ends + STEP - 1))
        floor = np.zeros(len(query), np.int64)
        for d, segment in enumerate(self.segments):
            sides = query[d] * np.array([segment[0, 1], segment[-1, 1]]) * STEP
            floor[d] = min(sides[0], sides[1], sides[0] + query[d] * (STEP - 1), sides[1] + query[d] * (STEP - 1))
        impact = low - floor[table[:, 0]]
        order = np.argsort(-impact, kind="stable")
        slack = int(np.abs(query).sum()) * (STEP - 1)
        # the best impact still to come in each dimension, whose segments are read in falling order
        later = [impact[order[table[order, 0] == d]] for d in range(len(query))]
        at = np.zeros(len(query), np.int64)
        left = int(sum(x[0] for x in later))
        low_sum = np.zeros(n, np.int64)
        own_at = np.flatnonzero(self.ids == own)
        some = np.arange(n)
        for step, s in enumerate(order):
            d, _, begin, end = table[s]
            low_sum[self.order[d, begin:end]] += impact[s]
            at[d] += 1
            mine = later[d]
            left += int((mine[at[d]] if at[d] < len(mine) else 0) - mine[at[d] - 1])
            if step % LOOK == LOOK - 1 and n > k + 1:
                seen = np.delete(low_sum, own_at)
                if len(seen) > k:
                    edge = np.partition(seen, len(seen) - k)[len(seen) - k]
                    some = np.flatnonzero(low_sum + (left + slack) >= edge)
                    if len(some) <= max(4 * k, n * FEW):
                        break
        else:
            seen = np.delete(low_sum, own_at)
            if len(seen) > k:
                edge = np.partition(seen, len(seen) - k)[len(seen) - k]
                some = np.flatnonzero(low_sum + slack >= edge)
        some = some[self.ids[some] != own]
        scores = self.values[some] @ query
        top = best(scores, self.ids[some], k)
        return self.ids[some][top], scores[top]


def integers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and the vector in integers, of the rows that take part."""
    v = F.col(f"`{vector_col}`")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    return rows.select("id", F.transform("v", lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("v"))


def top_k(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of highest integer inner product for each query.

    ``is_query`` is a condition on a column named ``id``.
    """
    rows = keep(integers(vectors, id_col, vector_col), "topk-rows")
    queries = keep(rows.where(is_query).dropDuplicates(["id", "v"]), "topk-queries")
    total, width, high = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    asked, width = queries.count(), width or 1
    dtype = np.int16 if (high or 0) < 2**15 else np.int64
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])
    # blocks are numbered by partition: as many as it takes for their size, and for several cores to be busy
    blocks, parts = max(6, -(-total // INDEX_ROWS)), max(1, -(-asked // QUERY_ROWS))
    number = lambda upto: F.pmod(F.xxhash64("turn"), F.lit(upto)).cast("int")
    index = packed(rows, width, dtype, max(1, INDEX_ROWS // 16)).select(number(blocks).alias("block"), "ids", "vecs")
    index = spread(index, "part", F.lit(parts))
    asks = packed(queries, width, dtype, max(1, QUERY_ROWS // 16)).select(number(parts).alias("part"), "ids", "vecs")
    asks = spread(asks, "block", F.lit(blocks))

    def run(left, right):
        import pyarrow as pa

        out = [[], [], []]
        if left.num_rows and right.num_rows:
            block = ImpactBlock(*unpacked(left, width, dtype, np.int64))
            for own, query in zip(*unpacked(right, width, dtype, np.int64), strict=True):
                found, scores = block.search(query, own, k)
                out[0].append(np.full(len(found), own, np.int64))
                out[1].append(found)
                out[2].append(scores)
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
        return pa.table(flat, names=["query_id", "vec_id", "score"])

    found = index.groupBy("block", "part").cogroup(asks.groupBy("block", "part")).applyInArrow(run, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of every fiftieth vector, against all others."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0, 5)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5"""
