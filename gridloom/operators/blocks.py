"""Work on all pairs of rows, or all near ones, in blocks: a bounded number of rows travels as one, and numpy meets two blocks.

Where a job has as many pairs as rows squared, a row for each pair in a join is what fails. Here a task holds two blocks and a
strip of their pairs at a time, whatever the number of rows, and any number of executors share the pairs of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.store import keep

#: Rows of a block, and pairs of rows that are worked on at once.
BLOCK_ROWS, STRIP_PAIRS = 2048, 1 << 19
#: Partitions that pairs of blocks are dealt to at most.
MOST_PARTITIONS = 4096


def packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(data)).read_all()


def in_blocks(df: DataFrame, by: list[str], salt: str, size: int = BLOCK_ROWS) -> DataFrame:
    """``df`` as blocks (by, block, data) of about ``size`` rows at most with equal ``by``, dealt by a hash of ``salt``; written."""
    many = df.groupBy(*by).agg(F.ceil(F.count("*") / size).cast("int").alias("_k"))
    dealt = df.join(many, by) if by else df.crossJoin(F.broadcast(many))  # one row
    dealt = dealt.withColumn("_s", F.pmod(F.xxhash64(salt), F.col("_k")).cast("int")).drop("_k")
    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema.fields}
    inner = [c for c in df.columns if c not in by]

    def pack(keys: tuple, table: pa.Table) -> pa.Table:
        one = {c: [k.as_py()] for c, k in zip([*by, "_s"], keys, strict=True)}
        return pa.table(one | {"data": [packed(table.select(inner).combine_chunks())]}, schema=pa.schema([*[table.schema.field(c) for c in (*by, "_s")], pa.field("data", pa.binary())]))

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*by, "_s")) + ", data binary"
    out = keep(dealt.groupBy(*by, "_s").applyInArrow(pack, schema), "blocks")
    return out.select(*by, F.xxhash64(*by, "_s").alias("block"), "data")


def near_block_pairs(blocks: DataFrame, cell: list[str], keys: list[str] = ()) -> DataFrame:
    """Pairs (a, b: data) of blocks, each once, whose cells (whole numbers) touch or are the same; without ``cell`` all pairs.

    A block meets itself too, then ``same`` is true.
    """
    keys = list(keys)
    steps = [d for d in product((-1, 0, 1), repeat=len(cell)) if d >= (0,) * len(cell)]
    step = F.array(*[F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip(cell, d, strict=True)], F.lit(int(any(d))).alias("_o")) for d in steps]) if cell else F.array(F.struct(F.lit(0).alias("_o")))
    a = blocks.select(*keys, *cell, F.col("block").alias("_a")).withColumn("_d", F.explode(step)).select(*keys, *[(F.col(c) + F.col(f"_d.{c}")).alias(c) for c in cell], "_a", F.col("_d._o").alias("_o"))
    b = blocks.select(*keys, *cell, F.col("block").alias("_b"))
    on = [*keys, *cell]
    # only numbers of blocks meet here; within a cell each two once
    pairs = (a.join(b, on) if on else a.crossJoin(b)).where((F.col("_o") == 1) | (F.col("_a") <= F.col("_b"))).select("_a", "_b")
    pairs = keep(pairs, "pairs")
    parts = max(1, min(MOST_PARTITIONS, pairs.count()))
    left = pairs.join(blocks.select(F.col("block").alias("_a"), F.col("data").alias("a")), "_a").repartition(parts, "_a", "_b")
    right = pairs.join(blocks.select(F.col("block").alias("_b"), F.col("data").alias("b")), "_b").repartition(parts, "_a", "_b")
    return left.join(right.hint("shuffle_hash"), ["_a", "_b"]).select("a", "b", (F.col("_a") == F.col("_b")).alias("same"))


def over_pairs(pairs: DataFrame, kernel: Callable[[pa.Table, pa.Table, bool], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``kernel`` gives for each pair of blocks."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                a, b, same = (batch.column(k)[i] for k in range(3))
                yield from kernel(unpacked(a.as_buffer()), unpacked(b.as_buffer()), same.as_py())

    return pairs.mapInArrow(run, schema)


def strips(rows: int, others: int) -> Iterator[slice]:
    """Slices of ``rows`` whose pairs with ``others`` are a strip."""
    step = max(1, STRIP_PAIRS // max(1, others))
    for k in range(0, rows, step):
        yield slice(k, min(rows, k + step))


def column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def cells_of(df: DataFrame, reach: float, names: tuple[str, ...] = ("_cx", "_cy", "_cz")) -> DataFrame:
    """``df`` with the cell of its point as whole numbers, ``reach`` wide; rows without a place are left out."""
    fine = F.lit(True)
    for c in "xyz":
        fine = fine & F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False))
    return df.where(fine).withColumns({n: F.floor(F.col(c) / F.lit(float(reach))).cast("long") for n, c in zip(names, "xyz", strict=True)})


def squares(a: pa.Table, b: pa.Table, rows: slice) -> tuple[np.ndarray, tuple]:
    """Squared distances of a strip, added up as SQL does, and the differences b - a."""
    d = tuple(column(b, c)[None, :] - column(a, c)[rows, None] for c in "xyz")
    return (d[0] * d[0] + d[1] * d[1]) + d[2] * d[2], d


def whole(n: float) -> int:
    return max(1, math.ceil(n))
