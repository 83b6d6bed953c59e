"""What the operators share: written tables, and text held as flat arrays of bytes."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; a temporary one only for a local master."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage, survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridloom-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def word_count(text):
    """Number of words of a string column, as long; null and empty texts have none."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE)
    inner = F.size(parts) - F.when(parts[0] == "", 1).otherwise(0)
    last = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return (inner - last).cast("long")


def text_key(column):
    """A string that tells null from every text, for joins and groups on a nullable column."""
    return F.when(column.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), column.cast("string")))


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Within it, at most so many rows go to Python at once: texts may be long. The session's own setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def trim() -> None:
    """Gives memory that Python no longer uses back to the system, where the C library can."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def hold() -> None:
    """Lets Python keep up to 16 MB that it frees, where the C library can: small arrays made anew in a loop cost page faults otherwise."""
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 16 << 20)  # M_TRIM_THRESHOLD


# ---------------------------------------------------------------- flat bytes

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_rng = np.random.default_rng(20240229)
_BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: A second hash, by other codes and another base, for those who need 128 bits.
_BYTE_CODE_2 = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE_2 = np.uint64(0xD1B54A32D192ED03)
_bases = {"up": _BASE, "down": np.uint64(pow(int(_BASE), -1, 2**64)), "up2": _BASE_2, "down2": np.uint64(pow(int(_BASE_2), -1, 2**64))}
_powers: dict[str, np.ndarray] = {k: np.ones(1, np.uint64) for k in _bases}


def powers(kind: str, n: int) -> np.ndarray:
    """The first n powers, modulo 2**64, of the hash base ("up") or of its inverse ("down"); "up2" and "down2": of the second hash."""
    have = _powers[kind]
    if len(have) < n:
        step = np.full(max(n, 1 << 20), _bases[kind], np.uint64)
        step[0] = 1
        with np.errstate(over="ignore"):
            have = _powers[kind] = np.multiply.accumulate(step)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on all."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def flat_texts(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string array end to end, and n + 1 offsets; nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column, "").cast(pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def prefix_hash(raw: np.ndarray, second: bool = False) -> np.ndarray:
    """Cumulative hash: the part [a, b) has the hash (p[b] - p[a]) * base**-a, modulo 2**64."""
    out = np.zeros(len(raw) + 1, np.uint64)
    code, up = (_BYTE_CODE_2, "up2") if second else (_BYTE_CODE, "up")
    np.cumsum(code[raw] * powers(up, len(raw)), out=out[1:])
    return out


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word; words end at white space and at the end of their text."""
    gap = np.ones(len(raw) + 1, bool)
    gap[:-1] = _IS_SPACE[raw]
    first = ~gap[:-1]
    first[1:] &= gap[:-2] if len(raw) > 1 else True
    breaks = offsets[1:-1]
    breaks = breaks[breaks < len(raw)]
    first[breaks] |= ~gap[:-1][breaks]
    last = ~gap[:-1]
    last[:-1] &= gap[1:-1]
    inner = breaks[breaks > 0] - 1
    last[inner] |= ~gap[:-1][inner]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def lower(raw: np.ndarray) -> np.ndarray:
    """A to Z in lower case, other bytes as they are."""
    return _LOWER[raw]


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each part [start, end), in order of start; about ``most`` bytes are worked on at once."""
    out = np.zeros(len(start), np.uint64)
    at = 0
    while at < len(start):
        base = int(start[at])
        stop = max(int(np.searchsorted(start, base + most)), at + 1)
        s, e = start[at:stop] - base, end[at:stop] - base
        p = prefix_hash(raw[base : base + int(e.max())])
        out[at:stop] = mix((p[e] - p[s]) * powers("down", len(p))[s] + (e - s).astype(np.uint64))
        at = stop
    return out


def numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each value, in order of first appearance, and where each number first appears."""
    import pandas as pd

    which, values = pd.factorize(hashes)
    first = np.empty(len(values), np.int64)
    first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
    return which, first


def pieces_of(batch_rows: int, lengths: np.ndarray, most: int):
    """Cut rows into runs of at most ``most`` bytes (one row at least)."""
    begin = 0
    total = np.concatenate([[0], np.cumsum(lengths)])
    while begin < batch_rows:
        stop = int(np.searchsorted(total, total[begin] + most, "right")) - 1
        stop = min(max(stop, begin + 1), batch_rows)
        yield begin, stop
        begin = stop
