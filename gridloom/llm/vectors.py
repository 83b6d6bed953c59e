"""What the vector searches share: which rows take part, and packing of vectors into arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector has components, none of them null, NaN or infinite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


def matrix(column, width: int, dtype=np.float64) -> np.ndarray:
    """An Arrow list column as a matrix; shorter vectors end in zeros."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), dtype)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def packed(rows: DataFrame, width: int, dtype, most: int, key=None) -> DataFrame:
    """Rows (id, v) as packed blocks: turn (a number of its own), n, ids and vecs as bytes, of at most ``most`` rows.

    With ``key``, a function from a matrix to lists of row numbers by key, there are blocks for each key, and rows may be in several.
    """
    kind = np.dtype(dtype)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        turn = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, values = np.asarray(batch.column("id").to_numpy(zero_copy_only=False), np.int64), matrix(batch.column("v"), width)
            for k, rows in ((0, np.arange(len(ids))),) if key is None else key(values):
                for at in range(0, len(rows), most):
                    some = rows[at : at + most]
                    columns = [pa.array([x], t) for x, t in ((int(k), pa.int32()), (turn, pa.int64()), (len(some), pa.int64()), (ids[some].tobytes(), pa.binary()), (values[some].astype(kind).tobytes(), pa.binary()))]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "turn", "n", "ids", "vecs"])
                    turn += 1

    return rows.select("id", "v").mapInArrow(run, "key int, turn long, n long, ids binary, vecs binary")


def unpacked(table, width: int, dtype, to=np.float64) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of an Arrow table of packed blocks."""
    ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), np.int64)
    return ids, np.frombuffer(b"".join(table.column("vecs").to_pylist()), dtype).reshape(-1, width).astype(to)


def spread(df: DataFrame, name: str, upto: Column) -> DataFrame:
    """Each row once for every number from 0 to ``upto`` less one."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), (upto - 1).cast("int"))))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids, in order."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= edge)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]
