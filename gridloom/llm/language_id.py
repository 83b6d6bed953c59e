"""Language identification by unigram pieces, summed over all segmentations.

For each language there is a probability of every piece of a fixed public vocabulary (a SentencePiece model
file, all of it; its single bytes cover any text). A text is cut into units, a space and a word in lower case (A to Z), of
any length. The probability of a unit is the sum over all its segmentations into
pieces, which a forward algorithm adds up; a text's log probability is the sum over its units. The language of the
highest one is predicted.

Learning is expectation-maximisation over all training texts: forward and backward sums give the expected count of each piece in each
language, every partition adds up its own, and sums of counts, smoothed, are the next probabilities.

Each distinct unit of a batch is worked out once: many units of one length side by side in numpy, those of more than
:data:`SHORT` bytes one by one, in blocks of positions whose sums are handed on, so that memory stays bounded and no
segmentation is left out. Only tables of vocabulary size, for each language, are sent to the driver or to executors; more than
:data:`MOST_LANGUAGES` languages are an error.

Null texts and texts without a letter are ``und`` with score 0. Rows with a null language are not learned from. Equal languages:
the first by code point. The score is the share of the predicted language when log probabilities are divided by the
square root of the number of units. Very long texts are worked on whole; repeated rows give repeated results; without
rows to learn from everything is ``und``. Other columns are not read.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common as C
from gridloom.llm.sentencepiece_codec import BYTE, CONTROL, MARK, MODEL, UNKNOWN, _fields

#: Longest unit worked out beside others, and positions of a longer one that are worked out at once.
SHORT, POSITIONS = 64, 4096
#: Each byte's scale in sums of products, so that few units' sums leave the range below.
SCALE = 2.0**8
#: Beyond these, sums are divided by themselves and the logarithm is kept.
LEAST, MOST = 1e-100, 1e100
SLICE_BYTES, SIDE_BY_SIDE = 24 << 20, 16_384
#: The tables must stay small; more languages than this are an error.
MOST_LANGUAGES = 500


class Pieces:
    """Pieces as byte strings, found by hash."""

    def __init__(self, model: bytes):
        found: dict[bytes, None] = {}
        for number, value in _fields(model):
            if number == 1:
                x = dict(_fields(value))
                if x.get(3, 1) not in (UNKNOWN, CONTROL, BYTE):
                    found[x[1].decode().replace(MARK, " ").encode()] = None
        for b in range(256):
            found[bytes([b])] = None
        self.pieces = list(found)
        self.lengths = np.array(sorted({len(p) for p in self.pieces}))
        hashes = np.zeros(len(self.pieces), np.uint64)
        for n in self.lengths:
            at = [i for i, p in enumerate(self.pieces) if len(p) == n]
            raw = np.frombuffer(b"".join(self.pieces[i] for i in at), np.uint8).reshape(-1, n)
            hashes[at] = self.part(self.prefix(raw), 0, int(n))
        self.bits = 18
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        for i, (h, slot) in enumerate(zip(hashes.tolist(), self.slots(hashes).tolist(), strict=True)):
            while self.keys[slot]:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.keys[slot], self.values[slot] = h, i

    @staticmethod
    def prefix(units: np.ndarray) -> np.ndarray:
        """Cumulative hashes of the rows of a byte matrix; transposed, so that a position is one array."""
        out = np.zeros((units.shape[1] + 1, len(units)), np.uint64)
        np.cumsum(C._BYTE_CODE[units.T] * C.powers("up", units.shape[1])[:, None], axis=0, out=out[1:])
        return out

    @staticmethod
    def part(prefix: np.ndarray, begin, size: int) -> np.ndarray:
        """Hashes of the parts of ``size`` bytes from a place, or from each of several places."""
        h = (prefix[begin + size] - prefix[begin]) * C.powers("down", len(prefix))[begin]
        return (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) + np.uint64(size)

    def slots(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of pieces, -1 where there is none."""
        slot = self.slots(h)
        key = self.keys[slot]
        out = np.where(key == h, self.values[slot], -1)
        left = np.flatnonzero((key != h) & (key != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            key = self.keys[slot[left]]
            out[left] = np.where(key == h[left], self.values[slot[left]], -1)
            left = left[(key != h[left]) & (key != 0)]
        return out


def units_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with a space before every word; start, length and text number of each unit."""
    raw = np.insert(C.lower(raw), offsets[:-1], 32)  # a space before each text; white space is a space
    raw[C._IS_SPACE[raw]] = 32
    start, end, text = C.words_of(raw, offsets + np.arange(len(offsets)))
    return raw, start - 1, end - start + 1, text


def distinct_units(column):
    """Bytes; start and length of each distinct unit; for every unit its number among these and its text."""
    raw, begin, size, text = units_of(*C.flat_texts(column))
    hashes = C.word_hashes(raw, begin, begin + size)
    which, first = C.numbered(hashes)
    return raw, begin[first], size[first], which, text


def _out_of_range(x: np.ndarray) -> np.ndarray | None:
    """What to divide sums by that are near the ends of double precision, 1 for others; None if there are no such ones."""
    if x.min() >= LEAST and x.max() <= MOST:
        return None
    return np.where((x > 0) & ((x < LEAST) | (x > MOST)), x, 1.0)


def sums(pieces: Pieces, probability: np.ndarray, raw, begin, size, counts=None):
    """Log probability of each unit in each language; with ``counts`` of units, also expected counts of pieces.

    ``probability``: pieces by languages, scaled by SCALE to the power of the piece's length.
    """
    languages = probability.shape[1]
    logs = np.zeros((len(begin), languages))
    expected = np.zeros((len(pieces.pieces), languages)) if counts is not None else None
    for i in np.flatnonzero(size > SHORT).tolist():
        logs[i] = long_sums(pieces, probability, raw[begin[i] : begin[i] + size[i]], None if counts is None else counts[i], expected)
    order = np.argsort(size, kind="stable")[: np.count_nonzero(size <= SHORT)]
    cuts = np.flatnonzero(np.diff(size[order])) + 1
    for same in np.split(order, cuts):
        for at in range(0, len(same), SIDE_BY_SIDE):
            rows = same[at : at + SIDE_BY_SIDE]
            if not len(rows):
                continue
            n = int(size[rows[0]])
            prefix = pieces.prefix(raw[begin[rows][:, None] + np.arange(n)])
            forward = np.zeros((n + 1, len(rows), languages))
            forward[0] = 1
            shift = None  # log of what each position's sums are divided by
            reach = int(pieces.lengths[-1]) + 1
            arcs = []
            for a in range(n):
                if (ratio := _out_of_range(forward[a])) is not None:
                    shift = np.zeros_like(forward) if shift is None else shift
                    forward[a : a + reach] /= ratio
                    shift[a:] += np.log(ratio)
                for step in pieces.lengths[pieces.lengths <= n - a].tolist():
                    ids = pieces.find(pieces.part(prefix, a, step))
                    some = np.flatnonzero(ids >= 0)
                    if len(some):
                        ids = ids[some]
                        forward[a + step, some] += forward[a, some] * probability[ids]
                        if counts is not None:
                            arcs.append((a, step, some, ids))
            total = forward[n]
            log_total = np.log(total) + (0 if shift is None else shift[n])
            logs[rows] = log_total - n * np.log(SCALE)
            if counts is None:
                continue
            weight = counts[rows] / total
            back = None  # as shift, for the backward sums
            backward = np.zeros_like(forward)
            backward[n] = 1
            got, what, last = [], [], n
            for a, step, some, ids in reversed(arcs):
                if a != last:  # the sums at last are complete
                    if (ratio := _out_of_range(backward[last])) is not None:
                        back = np.zeros_like(total) if back is None else back
                        backward[last : last + reach] /= ratio
                        back += np.log(ratio)
                    last = a
                after = backward[a + step, some] * probability[ids]
                backward[a, some] += after
                if shift is None and back is None:
                    got.append(forward[a, some] * after * weight[some])
                else:
                    off = (0 if shift is None else shift[a, some]) + (0 if back is None else back[some]) - log_total[some]
                    got.append(np.exp(np.log(np.maximum(forward[a, some] * after, 1e-300)) + off) * counts[rows][some])
                what.append(ids)
            got, what = np.concatenate(got), np.concatenate(what)
            for k in range(languages):
                expected[:, k] += np.bincount(what, got[:, k], len(expected))
    return logs, expected


def _arcs(pieces: Pieces, raw: np.ndarray, low: int, high: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each position from ``low`` to ``high`` the numbers of the pieces that begin there, and where they end."""
    longest = int(pieces.lengths[-1])
    part = raw[low : min(high + longest, len(raw))]
    prefix = C.prefix_hash(part)
    ids, ends, at = [], [], []
    for step in pieces.lengths[pieces.lengths <= len(part)].tolist():
        place = np.arange(min(high - low, len(part) - step + 1))
        found = pieces.find(pieces.part(prefix, place, step))
        some = np.flatnonzero(found >= 0)
        ids.append(found[some])
        ends.append(low + some + step)
        at.append(some)
    ids, ends, at = np.concatenate(ids), np.concatenate(ends), np.concatenate(at)
    turn = np.argsort(at, kind="stable")
    edges = np.searchsorted(at[turn], np.arange(high - low + 1))
    return [(ids[turn[a:b]], ends[turn[a:b]]) for a, b in zip(edges, edges[1:])]


def _forward(pieces: Pieces, probability: np.ndarray, raw: np.ndarray, low: int, high: int, start: np.ndarray, arcs: list) -> tuple[np.ndarray, np.ndarray]:
    """Sums at positions from ``low`` to ``high`` and a piece beyond, divided by exp(shift), and that shift for each position."""
    reach = int(pieces.lengths[-1]) + 1
    sums_, shift = np.zeros((high - low + reach, probability.shape[1])), np.zeros((high - low + 1, probability.shape[1]))
    sums_[:reach] = start
    for k in range(high - low):
        if (ratio := _out_of_range(sums_[k])) is not None:
            sums_[k : k + reach] /= ratio
            shift[k:] += np.log(ratio)
        ids, ends = arcs[k]
        sums_[ends - low] += sums_[k] * probability[ids]
    return sums_, shift


def long_sums(pieces: Pieces, probability: np.ndarray, raw: np.ndarray, counts: np.ndarray | None = None, expected: np.ndarray | None = None) -> np.ndarray:
    """Log probability of one unit of any length in each language; with ``counts`` of it, ``expected`` is added to.

    Blocks of positions are gone through once; for expected counts they are gone through again from the last to the first, each with
    the forward sums that it began with.
    """
    n, languages, reach = len(raw), probability.shape[1], int(pieces.lengths[-1]) + 1
    start, total = np.zeros((reach, languages)), np.zeros(languages)
    start[0] = 1
    starts = []
    for low in range(0, n, POSITIONS):
        high = min(low + POSITIONS, n)
        starts.append((low, high, start, total))
        made, shift = _forward(pieces, probability, raw, low, high, start, _arcs(pieces, raw, low, high))
        start, total = made[high - low :].copy(), total + shift[-1]
    with np.errstate(divide="ignore"):
        log_total = np.log(start[0]) + total
    if counts is None:
        return log_total - n * np.log(SCALE)
    back, back_shift = np.zeros((reach, languages)), np.zeros(languages)  # backward sums from the block's end on
    back[0] = 1
    for low, high, first, before in reversed(starts):
        arcs = _arcs(pieces, raw, low, high)
        made, shift = _forward(pieces, probability, raw, low, high, first, arcs)
        sums_ = np.concatenate([np.zeros((high - low, languages)), back])
        for k in range(high - low - 1, -1, -1):
            ids, ends = arcs[k]
            after = sums_[ends - low] * probability[ids]
            sums_[k] = after.sum(0)
            off = np.exp(np.clip(before + shift[k] + back_shift - log_total, -700, 700))
            expected[ids] += made[k] * after * (off * counts)
            if (ratio := _out_of_range(sums_[k])) is not None:
                sums_[k : k + reach] /= ratio
                back_shift = back_shift + np.log(ratio)
        back = sums_[:reach].copy()
    return log_total - n * np.log(SCALE)


_pieces: dict[int, Pieces] = {}


def vocabulary(model: bytes) -> Pieces:
    """The vocabulary of a model file, built once in each Python process."""
    key = hash(model)
    if key not in _pieces:
        _pieces[key] = Pieces(model)
    return _pieces[key]


def _slices(batch):
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    for a, b in C.pieces_of(batch.num_rows, sizes, SLICE_BYTES):
        yield batch.slice(a, b - a)


def scaled(pieces: Pieces, counts: np.ndarray, smooth: float) -> np.ndarray:
    """Probabilities from counts, with each byte's scale."""
    p = (counts + smooth) / (counts + smooth).sum(0)
    return p * SCALE ** np.array([len(x) for x in pieces.pieces], float)[:, None]


def learn(docs: DataFrame, model_path: str = MODEL, rounds: int = 2, smooth: float = 0.1):
    """Languages in code-point order and their scaled piece probabilities, from rows (text, lang)."""
    model = Path(model_path).read_bytes()
    rows = docs.select("text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    languages = sorted(r[0] for r in rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    pieces = vocabulary(model)
    if not languages:
        return [], np.zeros((len(pieces.pieces), 0))
    # to start with, earlier pieces of the vocabulary are likelier, in all languages
    counts = np.repeat(1.0 / (np.arange(len(pieces.pieces)) + 100.0)[:, None], len(languages), axis=1)
    probability = scaled(pieces, counts, 0.0)
    for _ in range(rounds):
        held = rows.sparkSession.sparkContext.broadcast(probability)

        def expect(batches, held=held):
            import pyarrow as pa

            mine, number = vocabulary(model), {x: i for i, x in enumerate(languages)}
            total = np.zeros((len(mine.pieces), len(languages)))
            for batch in batches:
                for part in _slices(batch):
                    raw, begin, size, which, text = distinct_units(part.column("text"))
                    lang = np.array([number[x] for x in part.column("lang").to_pylist()], np.int64)
                    seen = np.bincount(which * len(languages) + lang[text], minlength=len(begin) * len(languages))
                    total += sums(mine, held.value, raw, begin, size, seen.reshape(-1, len(languages)).astype(float))[1]
            piece, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(total[piece, k])], ["piece", "language", "n"])

        got = rows.mapInArrow(expect, "piece int, language int, n double").groupBy("piece", "language").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros_like(counts)
        counts[np.asarray(got.column("piece")), np.asarray(got.column("language"))] = np.asarray(got.column("n"))
        probability = scaled(pieces, counts, smooth)
    return languages, probability


def identify(docs: DataFrame, languages: list[str], probability: np.ndarray, model_path: str = MODEL) -> DataFrame:
    """doc_id, held_out if there is such a column, lang_pred and score of each row."""
    model = Path(model_path).read_bytes()
    held = docs.sparkSession.sparkContext.broadcast(probability)
    names = [c for c in docs.columns if c in ("doc_id", "held_out")]
    rows = docs.select(*names, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), "text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in names) + ", lang_pred string, score double"

    def run(batches):
        import pyarrow as pa

        mine, table = vocabulary(model), held.value
        for batch in batches:
            for part in _slices(batch):
                n = part.num_rows
                best, score = np.zeros(n, np.int64), np.zeros(n)
                letters = np.asarray(part.column("letters").to_numpy(zero_copy_only=False), bool) & bool(languages)
                if languages:
                    raw, begin, size, which, text = distinct_units(part.column("text"))
                    logs = sums(mine, table, raw, begin, size)[0]
                    total = np.stack([np.bincount(text, logs[which, k], n) for k in range(len(languages))], 1)
                    best = total.argmax(1)
                    gap = (total - total.max(1, keepdims=True)) / np.sqrt(np.maximum(np.bincount(text, minlength=n), 1))[:, None]
                    score = np.where(letters, 1 / np.exp(gap).sum(1), 0.0)
                said = [languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + [pa.array(said, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def held_out(doc_id: Column, parts: int, which: int = 2) -> Column:
    """Whether crc32 of doc_id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == which, F.lit(False))


def op6_language(spark, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", held_out(F.col("doc_id"), 4))
    return identify(docs, *learn(docs.where(~F.col("held_out"))))
