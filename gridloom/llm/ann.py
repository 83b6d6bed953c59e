"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

The tree is fitted with numpy on at most :data:`SAMPLE_ROWS` rows, those of the smallest hash of their id: each node's rows
are split by k-means into ``branches`` children, down to leaves. Every row of the table is then put in its leaf. For a
query a priority queue holds nodes by the inner product with their centres; the best is taken off, its children are
put on, and a leaf taken off is visited. How many leaves a query visits is widened until the mean recall of
:data:`SAMPLE_QUERIES` queries, measured against all rows, reaches ``recall``; that number holds for all queries, but a query goes on
until its leaves hold more rows than are asked for.

Rows of a leaf and the queries that visit it meet in packed blocks of bounded size, so a leaf that holds a third of all rows,
or one that all queries visit, is many tasks. Each block gives a query's best rows; they are ranked together. Scores are
inner products of the original vectors in double precision, added in one order everywhere, so that copies tie exactly.

Null vectors, empty and zero ones and those with null or non-finite components take no part, nor do rows without id.
Shorter vectors end in zeros. A candidate with the query's id is the query's own row. Ties go to the smaller id. Repeated
query rows count once. With fewer rows than asked for, all are returned. An empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import keep
from gridloom.llm.vectors import best, matrix, packed, spread, unpacked, usable

#: Rows that the tree is fitted on, and queries that visits are calibrated on.
SAMPLE_ROWS, SAMPLE_QUERIES = 20_000, 256
#: Rows and queries of a block.
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 4096


def kmeans(x: np.ndarray, k: int, rng, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Centres and the number of the nearest centre of each row; fewer centres if rows are the same."""
    centres = np.unique(x[rng.choice(len(x), min(k, len(x)), replace=False)], axis=0)
    for _ in range(rounds):
        near = _nearest(x, centres)
        have = np.unique(near)
        new = np.stack([x[near == c].mean(0) for c in have])
        if new.shape == centres.shape and np.allclose(new, centres):
            break
        centres = new
    return centres, _nearest(x, centres)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * (x @ centres.T), axis=1)


class Tree:
    """Nodes in arrays: centre, children (empty for a leaf) and the number of a leaf."""

    def __init__(self, x: np.ndarray, branches: int = 8, leaf_rows: int = 160, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.centre, self.children, self.leaf, self.leaves = [x.mean(0)], [[]], [-1], 0
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            near = None
            if len(rows) > leaf_rows:
                centres, near = kmeans(x[rows], branches, rng)
            if near is None or len(centres) < 2:
                self.leaf[node], self.leaves = self.leaves, self.leaves + 1
                continue
            for c in range(len(centres)):
                self.children[node].append(len(self.centre))
                todo.append((len(self.centre), rows[near == c]))
                self.centre.append(centres[c])
                self.children.append([])
                self.leaf.append(-1)
        self.centre = np.stack(self.centre)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row belongs to."""
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            near = _nearest(x[rows], self.centre[self.children[node]])
            todo += [(child, rows[near == c]) for c, child in enumerate(self.children[node])]
        return out

    def visits(self, query: np.ndarray, most: int, rows: np.ndarray | None = None, least: int = 0) -> list[int]:
        """Leaves in the order in which best-bin-first search visits them: ``most``, or more until they hold ``least`` rows."""
        value = self.centre @ query
        queue, out, held = [(-value[0], 0)], [], 0
        while queue and (len(out) < most or held < least):
            _, node = heapq.heappop(queue)
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(queue, (-value[child], child))
            else:
                out.append(self.leaf[node])
                held += int(rows[self.leaf[node]]) if rows is not None else 0
        return out


def nearest_leaves(placed: DataFrame, asks: np.ndarray, own: np.ndarray, k: int, width: int, dtype) -> tuple[np.ndarray, np.ndarray]:
    """For a bounded number of queries, the leaves of their true k nearest among all rows: (query's place, leaf)."""

    def run(batches):
        import pyarrow as pa

        kept = [(np.zeros(0),) * 3 for _ in own]
        for batch in batches:
            for i in range(batch.num_rows):
                ids, values = unpacked(pa.Table.from_batches([batch.slice(i, 1)]), width, dtype)
                for q, (scores, mine) in enumerate(zip((values @ asks.T).T, own, strict=True)):
                    scores = np.where(ids == mine, -np.inf, scores)
                    s, d, leaf = (np.concatenate(x) for x in zip(kept[q], (scores, ids, np.full(len(ids), batch.column("key")[i].as_py()))))
                    top = best(s, d, k)
                    kept[q] = (s[top], d[top], leaf[top])
        for q, (s, d, leaf) in enumerate(kept):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(s), q, np.int64), s.astype(np.float64), d.astype(np.int64), leaf.astype(np.int64))], ["q", "score", "id", "leaf"])

    found = placed.select("key", "ids", "vecs").mapInArrow(run, "q long, score double, id long, leaf long").where(F.col("score") > float("-inf"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    got = found.withColumn("rank", rank).where(F.col("rank") <= k).select("q", "leaf").toArrow()
    return np.asarray(got.column("q")), np.asarray(got.column("leaf"))


def calibrated(tree: Tree, asks: np.ndarray, query: np.ndarray, leaf: np.ndarray, recall: float) -> int:
    """The fewest leaves whose visit finds the share ``recall`` of the queries' nearest rows, which are in these leaves."""
    place = np.empty((len(asks), tree.leaves), np.int64)
    for q, ask in enumerate(asks):
        place[q, tree.visits(ask, tree.leaves)] = np.arange(tree.leaves)
    found = np.bincount(place[query, leaf], minlength=tree.leaves)
    return int(np.argmax(np.cumsum(found) >= recall * len(leaf))) + 1 if len(leaf) else 1


def exact_scores(values: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, each added in the same order."""
    out = np.zeros(len(values))
    for d in range(values.shape[1]):
        out += values[:, d] * query[d]
    return out


def nearest(vectors: DataFrame, is_query: Column, k: int, recall: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k nearest rows found.

    ``is_query`` is a condition on a column named ``id``.
    """
    single = vectors.select(F.col(f"`{vector_col}`")).schema[0].dataType.simpleString() == "array<float>"
    dtype = np.float32 if single else np.float64
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    rows = keep(rows.where(F.col("id").isNotNull() & usable(F.col("v")) & F.exists("v", lambda x: x != 0)), "ann-rows")
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    total, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not total:
        return rows.sparkSession.createDataFrame([], schema).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).toArrow()
    x, ids = matrix(sample.column("v"), width), np.asarray(sample.column("id"))
    tree = Tree(x)

    def by_leaf(values):
        leaf = tree.leaf_of(values)
        order = np.argsort(leaf, kind="stable")
        return [(int(leaf[rows[0]]), rows) for rows in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1) if len(rows)]

    placed = keep(packed(rows, width, dtype, BLOCK_ROWS // 4, by_leaf), "ann-placed")
    # a bounded number of leaves
    held = np.zeros(tree.leaves, np.int64)
    for leaf, n in placed.groupBy("key").agg(F.sum("n")).collect():
        held[leaf] = n
    asks, own = x[:SAMPLE_QUERIES], ids[:SAMPLE_QUERIES]
    most = calibrated(tree, asks, *nearest_leaves(placed, asks, own, k, width, dtype), recall)

    def by_visit(values):
        visits: dict[int, list[int]] = {}
        for i, query in enumerate(values):
            for leaf in tree.visits(query, most, held, k + 1):
                visits.setdefault(leaf, []).append(i)
        return [(leaf, np.array(rows)) for leaf, rows in visits.items()]

    asked = keep(packed(rows.where(is_query).dropDuplicates(["id", "v"]), width, dtype, BLOCK_QUERIES // 4, by_visit), "ann-asked")
    size = placed.groupBy("key").agg(F.ceil(F.sum("n") / BLOCK_ROWS).alias("blocks"))
    size = F.broadcast(size.join(asked.groupBy("key").agg(F.ceil(F.sum("n") / BLOCK_QUERIES).alias("parts")), "key"))
    number = lambda name, upto: F.pmod(F.xxhash64("turn"), F.col(upto)).cast("int").alias(name)
    left = placed.join(size, "key").select("ids", "vecs", F.col("key").alias("leaf"), number("block", "blocks"), "parts")
    left = spread(left, "part", F.col("parts"))
    right = asked.join(size, "key").select("ids", "vecs", F.col("key").alias("leaf"), number("part", "parts"), "blocks")
    right = spread(right, "block", F.col("blocks"))

    def run(a, b):
        import pyarrow as pa

        out = [[], [], []]
        if a.num_rows and b.num_rows:
            have, values = unpacked(a, width, dtype)
            for own, query in zip(*unpacked(b, width, dtype), strict=True):
                rough = values @ query
                rough[have == own] = -np.inf
                if len(rough) > k:
                    edge = np.partition(rough, len(rough) - k)[len(rough) - k]
                    some = np.flatnonzero(rough >= edge - 1e-9 * max(1.0, abs(edge)))
                else:
                    some = np.arange(len(rough))
                some = some[have[some] != own]
                scores = exact_scores(values[some], query)
                top = best(scores, have[some], k)
                out[0].append(np.full(len(top), own, np.int64))
                out[1].append(have[some][top])
                out[2].append(scores[top])
        kinds = (np.int64, np.int64, np.float64)
        return pa.table([np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, kinds, strict=True)], names=["query_id", "vec_id", "score"])

    keys = ("leaf", "block", "part")
    found = left.select("ids", "vecs", *keys).groupBy(*keys).cogroup(right.select("ids", "vecs", *keys).groupBy(*keys)).applyInArrow(run, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_ann(spark, sf_dir: str) -> DataFrame:
    """The twenty nearest found of every twentieth vector, against all others."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0, 20)
