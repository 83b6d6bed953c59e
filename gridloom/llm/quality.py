"""Quality by co-training: a classifier of text content and one of page metadata teach each other.

Content features come from the whole text: shares of byte classes, repetition of words, word pairs and lines, word
lengths, and shares of hashed words. Metadata features are source, language and length. Both views are fitted by
logistic regression on labelled rows; in each round each view gives the documents without labels that it is surest of, on
either side, to the other view as further examples; all documents without labels are gone through in each round. Each view is then calibrated (Platt scaling) on labelled rows held out
from the rounds, and a logistic regression on the two calibrated log odds joins them. The joint score is a probability of
quality 1. Documents below ``limit`` are rejected; it is the lower of 0.5 and that score below which only ``loss`` of the
good held-out rows lie.

Fitting uses at most :data:`LABELLED_ROWS` labelled rows, those of the smallest hash of doc_id, and of each round at most
:data:`PER_ROUND` documents of either side for each view. Everything is scored, each row by itself.

Null texts are empty; null metadata is a value of its own; so are unknown sources and languages. Labels that are null
or contradict each other are left out. Without labels of both kinds everything scores 0.5 and is kept. Very long
texts are read whole; repeated rows score alike; an empty table stays empty; other columns pass through, those named like
the outputs are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import common as C

LABELLED_ROWS = 20_000
ROUNDS, SURE, PER_ROUND = 4, 0.95, 500
HASHED, SOURCES, LANGS, LENGTHS = 192, 128, 32, 20
SLICE_BYTES = 2 << 20

#: Byte classes: letters of either case, digits, white space, other signs, and bytes beyond ASCII.
_CLASS = np.full(256, 4, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 5
_CLASS[[32, 9, 10, 11, 12, 13]] = 3
_SIGNS = b"!?.,;:|#*<>{}[]()=/\\&%$@_-+\"'"
_SIGN = np.full(256, len(_SIGNS), np.int64)
for _i, _b in enumerate(_SIGNS):
    _SIGN[_b] = _i


def _repetition(hashes: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text the share of distinct values, and of the most frequent one."""
    if not len(hashes):
        return np.ones(n), np.zeros(n)
    which, first = C.numbered(C.mix(hashes + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    total = np.maximum(np.bincount(text, minlength=n), 1)
    top = np.zeros(n)
    np.maximum.at(top, text[first], np.bincount(which))
    return np.bincount(text[first], minlength=n) / total, top / total


def content_features(column) -> np.ndarray:
    """A row of features for each text."""
    raw, offsets = C.flat_texts(column)
    n, sizes = len(offsets) - 1, np.diff(offsets)
    low = C.lower(raw)
    start, end, text = C.words_of(raw, offsets)
    words = C.word_hashes(low, start, end)
    count, some = np.bincount(text, minlength=n), np.maximum(np.bincount(text, minlength=n), 1)
    length = np.bincount(text, end - start, n) / some
    spread = np.sqrt(np.maximum(np.bincount(text, (end - start) ** 2.0, n) / some - length**2, 0))
    distinct, top = _repetition(words, text, n)
    same = text[1:] == text[:-1]
    pairs, pair_top = _repetition((words[:-1] * np.uint64(3) + words[1:])[same], text[1:][same], n)
    breaks = np.flatnonzero(raw == 10)
    begin = np.unique(np.concatenate([offsets[:-1][sizes > 0], breaks + 1]))
    begin = begin[begin < len(raw)]
    stop = np.append(begin[1:], len(raw))
    owner = np.searchsorted(offsets, begin, "right") - 1
    lines, line_top = _repetition(C.word_hashes(low, begin, stop), owner, n)
    n_lines = np.bincount(owner, minlength=n)
    of = np.repeat(np.arange(n), sizes)
    bytes_ = np.maximum(sizes, 1)[:, None]
    classes = np.bincount(of * 6 + _CLASS[raw], minlength=n * 6).reshape(n, 6) / bytes_
    signs = np.bincount(of * (len(_SIGNS) + 1) + _SIGN[raw], minlength=n * (len(_SIGNS) + 1)).reshape(n, -1)[:, :-1] / bytes_
    hashed = np.bincount(text * HASHED + (words % np.uint64(HASHED)).astype(np.int64), minlength=n * HASHED).reshape(n, HASHED) / some[:, None]
    dense = np.stack([np.log1p(count), np.log1p(n_lines), length, spread, distinct, top, pairs, pair_top, lines, line_top, sizes / (1 + n_lines) / 1000], 1)
    return np.concatenate([dense, classes, np.sqrt(signs), np.sqrt(hashed)], 1).astype(np.float32)


def _crc(value, size: int) -> int:
    import zlib

    return 0 if value is None else 1 + zlib.crc32(str(value).encode()) % (size - 1)


def metadata_features(source: list, lang: list, n_chars: list) -> np.ndarray:
    """One-hot features: hashed source, hashed language, length by doubling."""
    out = np.zeros((len(source), SOURCES + LANGS + LENGTHS), np.float32)
    for i, (s, x, n) in enumerate(zip(source, lang, n_chars, strict=True)):
        out[i, _crc(s, SOURCES)] = 1
        out[i, SOURCES + _crc(x, LANGS)] = 1
        out[i, SOURCES + LANGS + (0 if n is None or n < 0 else min(1 + int(np.log2(n + 1)), LENGTHS - 1))] = 1
    return out


#: Rows that a fit works on at once.
BLOCK = 2048


class Logistic:
    """Ridge logistic regression by Newton steps on standardised features, block of rows by block: rows are never copied whole."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 3.0, rounds: int = 7):
        n, width = x.shape
        blocks = [slice(a, a + BLOCK) for a in range(0, n, BLOCK)]
        self.mean = sum(x[b].sum(0, dtype=np.float64) for b in blocks) / n
        self.scale = np.sqrt(sum(((x[b] - self.mean) ** 2).sum(0) for b in blocks) / n) + 1e-6
        w, penalty = np.zeros(width + 1), np.full(width + 1, ridge)
        penalty[-1] = 1e-3
        # both classes weigh alike
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        for _ in range(rounds):
            h, g = np.diag(penalty), -penalty * w
            for b in blocks:
                z = np.concatenate([(x[b] - self.mean) / self.scale, np.ones((len(x[b]), 1))], 1)
                weight = np.where(y[b] == 1, 0.5 / share, 0.5 / (1 - share))
                p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                h += (z * (weight * p * (1 - p))[:, None]).T @ z
                g += z.T @ (weight * (y[b] - p))
            w += np.linalg.solve(h, g)
        self.w = w

    def odds(self, x: np.ndarray) -> np.ndarray:
        parts = [((x[a : a + BLOCK] - self.mean) / self.scale) @ self.w[:-1] for a in range(0, len(x), BLOCK)]
        return np.clip(np.concatenate([np.zeros(0), *parts]) + self.w[-1], -30, 30)


class CoTrained:
    """The two views, their calibration and their joint score."""

    def __init__(self, views: list[np.ndarray], label: np.ndarray, pool: DataFrame | None = None, loss: float = 0.003):
        """``label``: 0 or 1. Every fifth row of either label is held out for calibration. ``pool``: rows (key, a, b) without labels."""
        held = np.sort(np.concatenate([np.flatnonzero(label == side)[::5] for side in (0, 1)]))
        train = np.setdiff1d(np.arange(len(label)), held)
        own = [(v[train], label[train].astype(float)) for v in views]
        self.models = [Logistic(x, y) for x, y in own]
        taken = [np.zeros(0, np.int64) for _ in views]
        for _ in range(ROUNDS if pool is not None else 0):
            more = surest(pool, self.models, taken)
            if not any(len(keys) for keys, _, _ in more):
                break
            for pupil, (keys, x, y) in enumerate(more):
                taken[pupil] = np.append(taken[pupil], keys)
                own[pupil] = (np.concatenate([own[pupil][0], x]), np.append(own[pupil][1], y))
            self.models = [Logistic(x, y) for x, y in own]
        truth = label[held].astype(float)
        held_odds = [m.odds(v[held]) for m, v in zip(self.models, views, strict=True)]
        self.platt = [Logistic(o[:, None], truth, ridge=1.0) for o in held_odds]
        calibrated = np.stack([p.odds(o[:, None]) for p, o in zip(self.platt, held_odds, strict=True)], 1)
        self.joint = Logistic(calibrated, truth, ridge=1.0)
        good = np.sort(self.score(calibrated)[truth == 1])
        self.limit = float(min(0.5, good[int(loss * len(good))])) if len(good) else 0.0

    def score(self, calibrated: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.joint.odds(calibrated)))

    def apply(self, views: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated log odds of both views, and the joint score."""
        odds = np.stack([p.odds(m.odds(v)[:, None]) for p, m, v in zip(self.platt, self.models, views, strict=True)], 1)
        return odds, self.score(odds)


def _views(part) -> list[np.ndarray]:
    lists = [part.column(c).to_pylist() for c in ("source", "lang", "n_chars")]
    return [content_features(part.column("text")), metadata_features(*lists)]


def _slices(batch):
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    for a, b in C.pieces_of(batch.num_rows, sizes, SLICE_BYTES):
        for at in range(a, b, 2000):
            yield batch.slice(at, min(2000, b - at))
    C.trim()


def _features(rows: DataFrame, names: str) -> DataFrame:
    """Packed features of both views, a and b, of rows with the named columns (as in a schema), text, source, lang, n_chars."""
    first = [x.split()[0] for x in names.split(", ")]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in _slices(batch):
                views = [pa.array([r.tobytes() for r in v], pa.binary()) for v in _views(part)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in first], *views], [*first, "a", "b"])

    return rows.select(*first, "text", "source", "lang", "n_chars").mapInArrow(run, f"{names}, a binary, b binary")


def surest(pool: DataFrame, models: list[Logistic], taken: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each view as a pupil: keys, features and sides of the PER_ROUND rows of either side that the other view is surest of.

    ``pool``: key and packed features a, b. Keys in ``taken``, by pupil, are left out.
    """
    edge = np.log(SURE / (1 - SURE))

    def run(batches):
        import pyarrow as pa

        best = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.asarray(batch.column("key"))
            views = [_packed_rows(batch.column(c)) for c in ("a", "b")]
            for teacher, pupil in ((0, 1), (1, 0)):
                odds = models[teacher].odds(views[teacher])
                left = ~np.isin(key, taken[pupil])
                for side, sure in ((1, odds >= edge), (0, odds <= -edge)):
                    give = np.flatnonzero(sure & left)
                    old = best.get((pupil, side))
                    rows = (key[give], np.abs(odds[give]), views[pupil][give])
                    if old:
                        rows = tuple(np.concatenate(x) for x in zip(old, rows, strict=True))
                    turn = np.lexsort((rows[0], -rows[1]))[:PER_ROUND]
                    best[pupil, side] = tuple(x[turn] for x in rows)
        for (pupil, side), (key, strength, x) in best.items():
            n = len(key)
            yield pa.RecordBatch.from_arrays([pa.array([pupil] * n, pa.int32()), pa.array([side] * n, pa.int32()), pa.array(key), pa.array(strength), pa.array([r.tobytes() for r in x], pa.binary())], ["pupil", "side", "key", "strength", "x"])

    found = C.keep(pool.select("key", "a", "b").mapInArrow(run, "pupil int, side int, key long, strength double, x binary"), "quality-surest")
    out = []
    for pupil in (0, 1):
        rows = [found.where((F.col("pupil") == pupil) & (F.col("side") == side)).orderBy(F.desc("strength"), "key").limit(PER_ROUND) for side in (1, 0)]
        got = rows[0].unionByName(rows[1]).select("key", "x", "side").toArrow()
        x = _packed_rows(got.column("x")) if len(got) else np.zeros((0, len(models[pupil].mean)), np.float32)
        out.append((np.asarray(got.column("key")), x, np.asarray(got.column("side")).astype(float)))
    return out


def fit(docs: DataFrame, labels: DataFrame) -> CoTrained | None:
    """The co-trained views; None without labels of both kinds."""
    clean = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("most"))
    clean = clean.where("label = most").select("doc_id", F.col("label").cast("int"))
    # at most LABELLED_ROWS numbers
    chosen = F.broadcast(C.keep(clean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_ROWS), "quality-chosen"))
    docs = docs.select("doc_id", "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars")).where("doc_id IS NOT NULL")
    got = _features(docs.join(chosen, "doc_id"), "doc_id long, label int").toArrow()
    ids, label = np.asarray(got.column("doc_id")), np.asarray(got.column("label"))
    if len(set(label.tolist())) < 2 or min(np.bincount(label)) < 10:
        return None
    turn = np.lexsort((label, ids))
    views = [_packed_rows(got.column(c))[turn] for c in ("a", "b")]
    del got
    C.trim()
    # features are dealt, not texts; by one plan at every size
    free = _features(docs, "doc_id long").join(labels.select("doc_id").hint("merge"), "doc_id", "left_anti")
    pool = C.keep(free.select(F.xxhash64("doc_id", "a", "b").alias("key"), "a", "b"), "quality-pool")
    return CoTrained(views, label[turn], pool)


def _packed_rows(column) -> np.ndarray:
    """Rows of equal length from an Arrow column of packed single-precision numbers."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    column = column.chunk(0) if hasattr(column, "chunk") else column
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.float32).reshape(len(column), -1)


OUTPUTS = ["quality_score", "quality_keep", "text_score", "metadata_score"]


def score(docs: DataFrame, model: CoTrained | None) -> DataFrame:
    """``docs`` with quality_score, quality_keep, and the calibrated probabilities text_score and metadata_score."""
    new = OUTPUTS
    if model is None:
        half = F.lit(0.5)
        return docs.withColumns({"quality_score": half, "quality_keep": F.lit(True), "text_score": half, "metadata_score": half})
    rest = [f for f in docs.schema.fields if f.name not in new]
    schema = T.StructType(rest + [T.StructField(c, T.BooleanType() if c == "quality_keep" else T.DoubleType()) for c in new])
    names = [f.name for f in rest]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in _slices(batch):
                odds, joint = model.apply(_views(part))
                each = 1 / (1 + np.exp(-odds))
                made = [pa.array(joint), pa.array(joint >= model.limit), pa.array(each[:, 0]), pa.array(each[:, 1])]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + made, names + new)

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)


def filter_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``, also those named like the outputs of :func:`score`."""
    aside = {c: c + "_" * max(1, len(max(docs.columns, key=len))) for c in docs.columns if c in OUTPUTS}
    scored = score(docs.withColumnsRenamed(aside), fit(docs, labels))
    return scored.where("quality_keep").select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, and whether each is kept."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, fit(docs, labels)).select("doc_id", "quality_score", "quality_keep", "text_score", "metadata_score")
