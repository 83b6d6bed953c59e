"""Scores of whole texts by a small causal self-attention model on subword ids, and by a word unigram base.

Tokens are lower-case words (A to Z) and one end a text. A word's subwords are the byte-pair pieces, of a public vocabulary, of a
space and the word (words of more than 64 bytes in parts). The :data:`ACTIVE` most frequent subwords of the training
texts have a place of their own in the model, all others share one.

Next-subword probabilities have two parts. Counts of neighbouring subwords over all training texts give P(next | last),
smoothed. Self-attention over the subwords before (queries, keys and values are linear in count-based embeddings, and there is a
learned bias for each distance) raises or lowers classes of next subwords: P(next | before) is P(next | last) times
exp(attention's logit of next's class), normalised. The attention's weights are trained in numpy by Adam on all windows of all
training texts, each window once: in two rounds, each partition by itself, averaged after each round. Windows are cut text by text, so that every subword and
every end is predicted in one of them, short texts are filled up. A text is scored in windows of :data:`WINDOW` subwords that overlap: each scores its last
:data:`STRIDE` subwords, the ones before are context, so every subword and the end are scored once.

The base is sum of log10((c + 1) / (N + V + 1)) over tokens, with c, N and V counted over all training texts. Words
are told apart by 64-bit hashes. The :data:`OFTEN` most frequent words' counts are sent to all tasks; the others'
occurrences are dealt by hash range to their counts, and their sums go back to the texts.

Null texts are empty: one end. Very long texts are scored whole. Rows with a null doc_id are trained on. Repeated rows score alike. Without
training rows the base's counts are zero and the model is uniform. An empty table stays empty; other columns are not read.
"""

from __future__ import annotations

import base64
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common as C
from gridloom.llm.ann import kmeans
from gridloom.llm.language_id import held_out

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
OWN, SHARED, OFTEN = 2047, 1024, 65_536
WINDOW, STRIDE = 32, 24
#: Fills windows up: an end as context, nothing to predict.
PAD = 65_535
#: Neighbouring subwords that are counted at once, and words whose subwords a Python worker remembers.
PAIRS, REMEMBERED = 2_000_000, 300_000
#: Partitions whose counts one task adds up.
MERGED = 64
#: Windows trained on in one run of Adam; rounds, between which weights are averaged and to which runs are dealt in turn.
RUN, ROUNDS = 4096, 2
DIM, VALUES, CLASSES = 16, 16, 32
SLICE_BYTES, RANGE_BYTES = 3 << 20, 32 << 20
UNIT = 64
#: Logits are held within this, where exponentials in single precision stay in range; training keeps far from that.
LIMIT = 40
_GAP = np.arange(WINDOW)[:, None] - np.arange(WINDOW)
_LATER = np.where(_GAP >= 0, 0, -1e9).astype(np.float32)


class Subwords:
    """Byte-pair pieces of words."""

    def __init__(self, data: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        self.size = max(ranks.values()) + 1
        self._encode = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        # hashes of words, rising; where each one's subwords begin, and how many they are; the subwords
        self.memory = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def encode(self, word: bytes) -> list[int]:
        word = b" " + word
        if len(word) <= UNIT:
            return self._encode(word)
        return [i for a in range(0, len(word), UNIT) for i in self._encode(word[a : a + UNIT])]


    def encoded(self, hashes: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Subword ids of different words end to end, and the number of each one's. Words seen before are remembered by hash."""
        known, begin, size, ids = self.memory
        at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
        new = np.flatnonzero(known[at] != hashes) if len(known) else np.arange(len(hashes))
        if len(new):
            data = raw.tobytes()
            lists = [self.encode(data[a:b]) for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)]
            many = np.array([len(x) for x in lists], np.int32)
            fresh = np.fromiter((i for x in lists for i in x), np.int32, many.sum())
            if len(known) + len(new) > REMEMBERED:  # all of this call's words are remembered anyhow
                old = np.flatnonzero(np.isin(known, hashes))
                keep = np.repeat(begin[old], size[old]) + np.arange(size[old].sum()) - np.repeat(np.cumsum(size[old]) - size[old], size[old])
                known, ids, size = known[old], ids[keep], size[old]
                begin = np.cumsum(size) - size
            begin = np.concatenate([begin, len(ids) + np.cumsum(many) - many])
            known, size, ids = np.concatenate([known, hashes[new]]), np.concatenate([size, many]), np.concatenate([ids, fresh])
            turn = np.argsort(known, kind="stable")
            known, begin, size = known[turn], begin[turn], size[turn]
            self.memory = known, begin, size, ids
            at = np.searchsorted(known, hashes)
        n = size[at].astype(np.int64)
        return ids[np.repeat(begin[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)], n


_subwords: dict[int, Subwords] = {}


def subwords(data: bytes) -> Subwords:
    key = hash(data)
    if key not in _subwords:
        _subwords[key] = Subwords(data)
    return _subwords[key]


def _slices(batch):
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    for a, b in C.pieces_of(batch.num_rows, sizes, SLICE_BYTES):
        yield batch.slice(a, b - a)


class Words:
    """The words of a slice: text of each, its number among the distinct ones, and where these are."""

    def __init__(self, column):
        raw, self.offsets = C.flat_texts(column)
        self.raw = C.lower(raw)
        start, end, self.text = C.words_of(raw, self.offsets)
        hashes = C.word_hashes(self.raw, start, end)
        self.which, first = C.numbered(hashes)
        self.hash, self.start, self.end = hashes[first], start[first], end[first]
        self.texts = len(self.offsets) - 1

    def bytes_of(self, i: int) -> bytes:
        return self.raw[self.start[i] : self.end[i]].tobytes()

    def pieces(self, table: Subwords, some: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Subword ids of the distinct words end to end, and n + 1 offsets; of words not in ``some`` none."""
        wanted = np.arange(len(self.hash)) if some is None else np.asarray(some)
        sizes = np.zeros(len(self.hash), np.int64)
        ids, sizes[wanted] = table.encoded(self.hash[wanted], self.raw, self.start[wanted], self.end[wanted])
        return ids, np.concatenate([[0], np.cumsum(sizes)])

    def stream(self, ids: np.ndarray, at: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Subwords of all texts, each text ended by id -1: their places in the model, their ids, and n + 1 offsets."""
        sizes = (at[1:] - at[:-1])[self.which]
        per_text = np.bincount(self.text, sizes, self.texts).astype(np.int64) + 1
        offsets = np.concatenate([[0], np.cumsum(per_text)])
        out = np.full(offsets[-1], -1, np.int32)
        to = np.cumsum(sizes) - sizes + self.text  # one end for each text before
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[np.repeat(to, sizes) + within] = ids[np.repeat(at[self.which], sizes) + within]
        return place[out], out, offsets


def _by_range(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by hash range, and the edges of the ranges in it."""
    at = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    return order, np.searchsorted(at[order], np.arange((1 << bits) + 1))


def count_words(train: DataFrame, bits: int) -> DataFrame:
    """A row for each hash range: packed hashes, counts, lengths and bytes of its words; also the number of texts."""

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            for part in _slices(batch):
                w = Words(part.column("text"))
                counts = np.bincount(w.which, minlength=len(w.hash)).astype(np.int64)
                order, edges = _by_range(w.hash, bits)
                sizes = w.end - w.start
                rows = []
                for r in range(1 << bits):
                    i = order[edges[r] : edges[r + 1]]
                    if len(i):
                        at = np.repeat(w.start[i], sizes[i]) + np.arange(sizes[i].sum()) - np.repeat(np.cumsum(sizes[i]) - sizes[i], sizes[i])
                        rows.append((r, w.hash[i].tobytes(), counts[i].tobytes(), sizes[i].tobytes(), w.raw[at].tobytes(), 0))
                rows.append((0, b"", b"", b"", b"", part.num_rows))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.int32(), *[pa.binary()] * 4, pa.int64()))], ["r", "hashes", "counts", "sizes", "words", "texts"])

    def merge(table):
        import pyarrow as pa

        hashes, counts, sizes = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("hashes", np.uint64), ("counts", np.int64), ("sizes", np.int64)))
        words = np.frombuffer(b"".join(table.column("words").to_pylist()), np.uint8)
        which, first = C.numbered(hashes)
        total = np.bincount(which, counts, len(first)).astype(np.int64) if len(first) else np.zeros(0, np.int64)
        begin = (np.cumsum(sizes) - sizes)[first]
        n = sizes[first]
        at = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        row = (table.column("r")[0].as_py(), hashes[first].tobytes(), total.tobytes(), n.tobytes(), words[at].tobytes(), sum(table.column("texts").to_pylist()), int(total.sum()), len(first))
        return pa.table([pa.array([x], t) for x, t in zip(row, (pa.int32(), *[pa.binary()] * 4, *[pa.int64()] * 3), strict=True)], names=["r", "hashes", "counts", "sizes", "words", "texts", "n", "v"])

    dealt = train.select("text").mapInArrow(deal, "r int, hashes binary, counts binary, sizes binary, words binary, texts long")
    return dealt.groupBy("r").applyInArrow(merge, "r int, hashes binary, counts binary, sizes binary, words binary, texts long, n long, v long")


def subword_counts(words: DataFrame, vocabulary: bytes) -> np.ndarray:
    """How often each subword stands in the counted words; a table of vocabulary size."""

    def run(batches):
        import pyarrow as pa

        table = subwords(vocabulary)
        total = np.zeros(table.size, np.int64)
        for batch in batches:
            for counts, sizes, data in zip(*[batch.column(c).to_pylist() for c in ("counts", "sizes", "words")], strict=True):
                ends = np.cumsum(np.frombuffer(sizes, np.int64)).tolist()
                lists = [table.encode(data[a:b]) for a, b in zip([0, *ends], ends)]
                many = np.repeat(np.frombuffer(counts, np.int64), [len(x) for x in lists])
                np.add.at(total, np.fromiter((i for x in lists for i in x), np.int64, len(many)), many)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    got = words.select("counts", "sizes", "words").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(subwords(vocabulary).size, np.int64)
    out[np.asarray(got.column("id"))] = np.asarray(got.column("n"))
    return out


def places(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each subword, then of the end (place 0), and the logarithm to 10 of each one's share of its place.

    The OWN most frequent have a place of their own; the others, by falling count, are dealt to SHARED places in turn.
    """
    turn = np.empty(len(counts), np.int64)
    turn[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    place = np.where(turn < OWN, turn + 1, OWN + 1 + (turn - OWN) % SHARED).astype(np.int32)
    some = counts + 1.0
    share = np.log10(some / np.bincount(place, some)[place])
    return np.append(place, np.int32(0)), np.append(share, 0.0)


def windows_of(x: np.ndarray, offsets: np.ndarray):
    """Blocks of windows of WINDOW + 1 places in which each place of each text is predicted once; before a text stand ends, as when it is scored."""
    back = WINDOW - STRIDE
    size = np.diff(offsets)
    many = -(-(size + back) // WINDOW)
    text = np.repeat(np.arange(len(size)), many)
    begin = (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * WINDOW - back - 1  # in its text
    for a in range(0, len(text), RUN):
        own = text[a : a + RUN, None]
        at = begin[a : a + RUN, None] + np.arange(WINDOW + 1)
        inside = (at >= 0) & (at < size[own])
        yield np.where(inside, x[np.where(inside, at + offsets[own], 0)], PAD).astype(np.uint16)


def gather(train: DataFrame, place: np.ndarray, vocabulary: bytes) -> DataFrame:
    """Packed counts of neighbouring places (kind 0, by group of rows r and part) and windows to train on (kind 1, in round r)."""
    size = int(place.max()) + 1
    per = 128

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        table, turn = subwords(vocabulary), TaskContext.get().partitionId()
        part_of, names = pa.array([turn], pa.int32()), ["kind", "r", "part", "a", "b"]
        total, pairs, held = np.zeros(size * size, np.int32), [], 0

        def add():
            nonlocal pairs, held
            if pairs:
                codes = np.sort(np.concatenate(pairs))
                begin = np.flatnonzero(np.diff(codes, prepend=-1))
                total[codes[begin]] += np.diff(np.append(begin, len(codes))).astype(np.int32)
            pairs, held = [], 0

        for batch in batches:
            for part in _slices(batch):
                w = Words(part.column("text"))
                x, _, offsets = w.stream(*w.pieces(table), place)
                last = np.empty_like(x)
                last[1:] = x[:-1]  # a text begins after an end
                last[offsets[:-1]] = 0
                pairs.append(last * np.int32(size) + x)
                held += len(x)
                if held >= PAIRS:
                    add()
                del w, last
                C.trim()
                for whole in windows_of(x, offsets):
                    yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([turn % ROUNDS], pa.int32()), part_of, pa.array([whole.tobytes()], pa.binary()), pa.array([b""], pa.binary())], names)
                    turn += 1
        add()
        some = np.flatnonzero(total)
        edges = np.searchsorted(some, np.arange(0, size + per, per) * size)
        for r, (a, b) in enumerate(zip(edges, edges[1:])):
            if a < b:
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([r], pa.int32()), part_of, pa.array([(some[a:b] - r * per * size).astype(np.uint32).tobytes()], pa.binary()), pa.array([total[some[a:b]].astype(np.float32).tobytes()], pa.binary())], names)

    return train.select("text").mapInArrow(run, "kind int, r int, part int, a binary, b binary")


def neighbour_counts(gathered: DataFrame, size: int) -> np.ndarray:
    """Counts of (last, next) places, as a matrix of fixed size.

    Partitions' counts are added up MERGED at a time, so that no group holds more than that many of them.
    """
    per = 128

    def add(table):
        import pyarrow as pa

        total = np.zeros(per * size, np.float64)
        for a, b in zip(table.column("a").to_pylist(), table.column("b").to_pylist(), strict=True):
            total[np.frombuffer(a, np.uint32)] += np.frombuffer(b, np.float32)
        some = np.flatnonzero(total)
        row = (table.column("r")[0].as_py(), table.column("part")[0].as_py(), some.astype(np.uint32).tobytes(), total[some].astype(np.float32).tobytes())
        return pa.table([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["r", "part", "a", "b"])

    out = np.zeros(size * size, np.float32)
    counts = gathered.where("kind = 0").select("r", "part", "a", "b")
    parts = (counts.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        parts = -(-parts // MERGED)
        counts = counts.withColumn("part", F.floor(F.col("part") / MERGED).cast("int")).groupBy("r", "part").applyInArrow(add, "r int, part int, a binary, b binary")
        if parts == 1:
            break
    for r, _, a, b in counts.toLocalIterator():
        out[np.frombuffer(a, np.uint32).astype(np.int64) + r * per * size] = np.frombuffer(b, np.float32)
    return out.reshape(size, size)


def _limit(x: np.ndarray) -> None:
    """Holds logits within LIMIT; nearly always they are."""
    if x.max() > LIMIT or x.min() < -LIMIT:
        np.clip(x, np.float32(-LIMIT), np.float32(LIMIT), out=x)


def _turn(x: np.ndarray) -> np.ndarray:
    """The last two axes turned, as a copy: products of many small matrices are faster with it than with a view."""
    return np.ascontiguousarray(x.transpose(0, 2, 1))


class Model:
    """Counts, embeddings and classes, which are fixed, and the attention's weights."""

    def __init__(self, counts: np.ndarray, smooth: float = 8.0, seed: int = 1):
        size = len(counts)
        rng = np.random.default_rng(seed)
        share = (counts.sum(0) + 0.5) / (counts.sum() + 0.5 * size)
        share = share.astype(np.float32)
        row = counts.sum(1, keepdims=True)
        chance = (counts + np.float32(smooth) * share) / (row + np.float32(smooth))
        self.log_next = np.log(chance)
        # correspondence analysis of the counts, by random projection: rows embed the last place, columns the next
        left, right = np.sqrt(row[:, 0] + 1), np.sqrt(counts.sum(0) + 1)
        a = counts / left[:, None] / right
        basis = rng.standard_normal((size, DIM + 9)).astype(np.float32)
        for _ in range(3):
            basis = np.linalg.qr(a.T @ (a @ basis))[0]
        u, s, vt = np.linalg.svd(a @ basis, full_matrices=False)
        v = (basis @ vt.T)[:, 1 : DIM + 1]
        self.embed = self._even(u[:, 1 : DIM + 1] / left[:, None])
        ahead = self._even(v / right[:, None])
        self.group = kmeans(ahead.astype(np.float64), CLASSES, rng)[1].astype(np.int32)
        self.classes = int(self.group.max()) + 1
        self.log_group = np.full((size, self.classes), -30, np.float32)
        for c in np.unique(self.group):
            self.log_group[:, c] = np.log(chance[:, self.group == c].sum(1))
        normal = lambda *shape: (rng.standard_normal(shape) * 0.3 / np.sqrt(shape[0])).astype(np.float32)
        self.weights = {
            "query": normal(DIM, DIM),
            "key": normal(DIM, DIM),
            "value": normal(DIM, VALUES) * 3,
            "out": normal(VALUES, self.classes),
            "bias": np.zeros(self.classes, np.float32),
            "distance": np.zeros(WINDOW, np.float32),
        }

    @staticmethod
    def _even(x: np.ndarray) -> np.ndarray:
        """Rows of one length, so that rare places don't outweigh frequent ones."""
        return (x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9) * np.sqrt(x.shape[1]) / 2).astype(np.float32)

    def _turned(self, x: np.ndarray):
        """Embeddings of windows ``x``, their queries, keys and values, and the weights, not normalised, of what stands before each place."""
        w = self.weights
        e = np.take(self.embed, x, axis=0)
        b, n = x.shape
        turned = (e.reshape(b * n, DIM) @ np.concatenate([w["query"] * np.float32(DIM**-0.5), w["key"], w["value"]], 1)).reshape(b, n, -1)
        q, k, v = turned[:, :, :DIM], turned[:, :, DIM : 2 * DIM], turned[:, :, 2 * DIM :]
        s = q @ _turn(k)
        s += w["distance"][np.maximum(_GAP[:n, :n], 0)]
        _limit(s)
        s += _LATER[:n, :n]
        np.exp(s, out=s)
        return e, q, k, v, s

    def forward(self, x: np.ndarray) -> np.ndarray:
        """Class logits, without counts, after each place of windows ``x``."""
        *_, v, s = self._turned(x)
        return (s @ v) / s.sum(2, keepdims=True) @ self.weights["out"] + self.weights["bias"]

    def gradient(self, x: np.ndarray, target: np.ndarray, with_loss: bool = False) -> tuple[float, dict[str, np.ndarray]]:
        w = self.weights
        some = target != PAD
        x, target = np.where(x == PAD, 0, x), np.where(some, target, 0)
        b, n = x.shape
        e, q, k, v, s = self._turned(x)
        # sums over short axes are products with ones
        total = (s.reshape(b * n, n) @ np.ones(n, np.float32)).reshape(b, n, 1)
        h = s @ v
        h /= total
        flat = h.reshape(b * n, VALUES)
        p = flat @ w["out"]
        p += w["bias"]
        _limit(p)
        p += np.take(self.log_group, x.ravel(), axis=0)
        np.exp(p, out=p)
        each = (some.ravel() / np.float32(max(1, np.count_nonzero(some)))).astype(np.float32)
        share = each / (p @ np.ones(self.classes, np.float32))
        goal, flat_p = np.arange(b * n) * self.classes + np.take(self.group, target.ravel()), p.reshape(-1)
        loss = float(-(np.log(flat_p[goal] * share / np.maximum(each, np.float32(1e-30)) + 1e-30) * each).sum()) if with_loss else 0.0
        p *= share[:, None]
        flat_p[goal] -= each
        # what the weights' sum divides is taken from dh at once
        dh = (p @ w["out"].T).reshape(b, n, VALUES)
        dh /= total
        ds = dh @ _turn(v)
        ds -= ((dh * h).reshape(b * n, VALUES) @ np.ones(VALUES, np.float32)).reshape(b, n, 1)
        ds *= s
        turned = np.empty((b, n, 2 * DIM + VALUES), np.float32)
        np.matmul(ds, k, out=turned[:, :, :DIM])
        np.matmul(ds.transpose(0, 2, 1), q, out=turned[:, :, DIM : 2 * DIM])
        np.matmul(s.transpose(0, 2, 1), dh, out=turned[:, :, 2 * DIM :])
        weights = (e.transpose(0, 2, 1) @ turned).sum(0)
        weights[:, :DIM] *= np.float32(DIM**-0.5)
        distance = np.bincount(np.maximum(_GAP[:n, :n], 0).ravel(), ds.sum(0).ravel(), WINDOW)  # zero for what comes later
        return loss, {
            "query": weights[:, :DIM],
            "key": weights[:, DIM : 2 * DIM],
            "value": weights[:, 2 * DIM :],
            "out": (h.transpose(0, 2, 1) @ p.reshape(b, n, -1)).sum(0),
            "bias": np.ones(b * n, np.float32) @ p,
            "distance": distance.astype(np.float32),
        }

    def train(self, windows: np.ndarray, rate: float, batch: int = 64) -> None:
        """Adam over windows of WINDOW + 1 places, once, in an order that the windows' number fixes."""
        C.hold()
        order = np.random.default_rng(len(windows)).permutation(len(windows))
        names = list(self.weights)
        shapes = [self.weights[k].shape for k in names]
        ends = np.cumsum([self.weights[k].size for k in names])
        flat = np.concatenate([self.weights[k].ravel() for k in names])  # the weights are views of it
        self.weights = {k: part.reshape(shape) for k, part, shape in zip(names, np.split(flat, ends[:-1]), shapes, strict=True)}
        m, v = np.zeros_like(flat), np.zeros_like(flat)
        for step, a in enumerate(range(0, len(order), batch), 1):
            rows = windows[np.sort(order[a : a + batch])]
            _, parts = self.gradient(rows[:, :-1], rows[:, 1:])
            g = np.concatenate([parts[k].ravel() for k in names])
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.01) * (g * g - v)
            flat *= np.float32(1 - rate * 0.02)
            flat -= np.float32(rate / (1 - 0.9**step)) * m / (np.sqrt(v * np.float32(1 / (1 - 0.99**step))) + np.float32(1e-8))

    def tables(self) -> tuple:
        """What scoring needs: queries, keys and values of the places, the weight of each distance, what turns values into logits, and class chances by counts.

        A last value of one adds up the weights of what stands before, and then meets the bias. Logits are held within LIMIT, as in training.
        """
        w = self.weights
        q = (self.embed @ w["query"]) * np.float32(DIM**-0.5)
        k, v = self.embed @ w["key"], self.embed @ w["value"]
        gap = _GAP[WINDOW - STRIDE :]
        distance = np.where(gap >= 0, w["distance"][np.maximum(gap, 0)], np.float32(-1e9)).astype(np.float32)
        most = np.linalg.norm(q, axis=1).max() * np.linalg.norm(k, axis=1).max() + np.abs(w["distance"]).max()
        if most > LIMIT:
            q, distance = q * np.float32(LIMIT / most), np.maximum(distance * np.float32(LIMIT / most), np.float32(-1e9))
        most = np.linalg.norm(v, axis=1).max() * np.linalg.norm(w["out"], axis=0).max() + np.abs(w["bias"]).max()
        fit = np.float32(min(1.0, LIMIT / max(most, 1e-9)))
        one = np.ones((len(v), 1), np.float32)
        return q, np.concatenate([k, v, one], 1), distance, np.concatenate([w["out"], w["bias"][None]]) * fit, np.exp(self.log_group)

    def log10_scores(self, x: np.ndarray, offsets: np.ndarray, batch: int = 96) -> np.ndarray:
        """For each text the log10 probability of its places (the last one its end), each scored in one window.

        Before a text stand ends, as in training windows.
        """
        texts = len(offsets) - 1
        size = np.diff(offsets)
        many = -(-size // STRIDE)
        text = np.repeat(np.arange(texts), many)
        begin = (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * STRIDE  # first place scored, in its text
        back = WINDOW - STRIDE
        last = np.zeros(len(x) + WINDOW + 1, np.int32)  # what stands before each place
        last[back + 1 : back + 1 + len(x)] = x
        last[back + offsets[:-1]] = 0
        by_counts = np.take(self.log_next.ravel(), last[back : back + len(x)].astype(np.int64) * len(self.log_next) + x)
        goal = np.append(np.take(self.group, x), np.zeros(WINDOW, np.int32))
        span, ahead = np.arange(WINDOW), np.arange(STRIDE)
        q, kv, distance, turn, chance = self.tables()
        first, left = offsets[text] + begin, size[text] - begin
        row, ones = np.arange(batch * STRIDE) * self.classes, np.ones(self.classes, np.float32)
        out = np.zeros(len(text))
        for a in range(0, len(text), batch):
            at = first[a : a + batch, None]
            seen = np.take(last, at + span)
            early = np.flatnonzero(begin[a : a + batch] < back)
            if len(early):
                seen[early] = np.where(begin[a : a + batch][early, None] - back + span < 0, 0, seen[early])
            here = seen[:, back:]
            both = np.take(kv, seen, axis=0)
            s = np.take(q, here, axis=0) @ _turn(both[:, :, :DIM])
            s += distance
            np.exp(s, out=s)
            h = s @ both[:, :, DIM:]
            h /= h[:, :, VALUES:].copy()
            z = h.reshape(-1, VALUES + 1) @ turn
            own = np.take(z.ravel(), row[: len(z)] + np.take(goal, at + ahead).ravel())
            np.exp(z, out=z)
            z *= np.take(chance, here.ravel(), axis=0)
            score = (own - np.log(z @ ones)).reshape(-1, STRIDE)
            short = np.flatnonzero(left[a : a + batch] < STRIDE)
            score[short] = np.where(ahead < left[a : a + batch][short, None], score[short], 0)
            out[a : a + batch] = score.sum(1, dtype=np.float64)
        out = np.bincount(text, out, texts) + np.bincount(np.repeat(np.arange(texts), size), by_counts, texts)
        return out / np.log(10)


def average(models: list[tuple[dict, int]]) -> dict:
    total = sum(n for _, n in models)
    return {k: sum(w[k] * np.float32(n / total) for w, n in models) for k in models[0][0]}


def fit(gathered: DataFrame, size: int, rate: float = 0.02) -> Model:
    """The model: counts from all training texts, attention from their windows."""
    import copy
    import pickle

    model = Model(neighbour_counts(gathered, size))
    for turn in range(ROUNDS):
        windows = gathered.where((F.col("kind") == 1) & (F.col("r") == turn)).select("a")
        lean = copy.copy(model)
        lean.log_next = None  # only scores need it
        sent = gathered.sparkSession.sparkContext.broadcast(pickle.dumps(lean, protocol=5))

        def train(batches, sent=sent, turn=turn):
            import pyarrow as pa

            mine, n = pickle.loads(sent.value), 0
            for batch in batches:
                for data in batch.column("a").to_pylist():
                    rows = np.frombuffer(data, np.uint16).reshape(-1, WINDOW + 1).astype(np.int64)
                    if len(rows):
                        mine.train(rows, rate / (1 + turn))
                        n += len(rows)
                        del rows
            C.trim()
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(mine.weights)], pa.binary()), pa.array([n], pa.int64())], ["w", "n"])

        # weights are a few thousand numbers; partitions' averages are averaged in groups before they reach the driver
        def merge(table):
            import pyarrow as pa

            got = [(pickle.loads(w), n) for w, n in zip(table.column("w").to_pylist(), table.column("n").to_pylist(), strict=True)]
            return pa.table([pa.array([pickle.dumps(average(got))], pa.binary()), pa.array([sum(n for _, n in got)], pa.int64())], names=["w", "n"])

        each = windows.mapInArrow(train, "w binary, n long").where("n > 0")
        with C.batch_rows(gathered.sparkSession, 32):  # of RUN windows each
            got = each.groupBy(F.pmod(F.xxhash64("w"), F.lit(16))).applyInArrow(merge, "w binary, n long").collect()
        if got:
            model.weights = average([(pickle.loads(w), n) for w, n in got])
        sent.unpersist()
    return model


def score_texts(docs: DataFrame, train: DataFrame, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs`` (doc_id, held_out, text)."""
    spark = docs.sparkSession
    vocabulary = Path(vocabulary_path).read_bytes()
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(3, int(np.ceil(np.log2(max(1, total / RANGE_BYTES)))))
    words = C.keep(count_words(train, bits), "words")
    n, v, texts = words.agg(F.sum("n"), F.sum("v"), F.sum("texts")).first()
    n, v, texts = (n or 0) + (texts or 0), (v or 0) + bool(texts), texts or 0
    counts = subword_counts(words, vocabulary)
    place, log_rest = places(counts)
    gathered = C.keep(gather(train, place, vocabulary), "gathered")
    model = fit(gathered, int(place.max()) + 1)
    often = _often(words)
    sent = spark.sparkContext.broadcast((model, place, log_rest, often))  # of fixed size

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        C.trim()
        mine, where, log_other, (hash_often, count_often) = sent.value
        table, part_of, turn = subwords(vocabulary), TaskContext.get().partitionId(), 0
        names = ["kind", "slice", "i", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "r", "hashes", "texts", "tf"]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        for batch in batches:
            for part in _slices(batch):
                w = Words(part.column("text"))
                x, ids, offsets = w.stream(*w.pieces(table), where)
                score = mine.log10_scores(x, offsets) + np.bincount(np.repeat(np.arange(w.texts), np.diff(offsets)), log_other[ids], w.texts)
                at = np.minimum(np.searchsorted(hash_often, w.hash), max(len(hash_often) - 1, 0))
                known = hash_often[at] == w.hash if len(hash_often) else np.zeros(len(w.hash), bool)
                c = np.where(known, count_often[at], 0) if len(hash_often) else np.zeros(len(w.hash))
                base = np.bincount(w.text, np.log10(c + 1)[w.which], w.texts) + np.log10(texts + 1)
                n_known = np.bincount(w.text, known[w.which], w.texts).astype(np.int64) + (texts > 0)
                number = (part_of << 24) + turn
                turn += 1
                m = part.num_rows
                none = [None] * m
                columns = [[0] * m, [number] * m, np.arange(m), part.column("doc_id"), part.column("held_out"), np.bincount(w.text, minlength=m) + 1, n_known, base, score, none, none, none, none]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
                # the other words, once for each text
                rare = np.flatnonzero(~known[w.which])
                pair = w.text[rare] * len(w.hash) + w.which[rare]
                which, first = C.numbered(pair.astype(np.uint64))
                tf = np.bincount(which, minlength=len(first)).astype(np.uint32)
                hashes, text = w.hash[w.which[rare[first]]], w.text[rare[first]].astype(np.uint32)
                order, edges = _by_range(hashes, bits)
                rows = [(r, order[a:b]) for r, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]
                if rows:
                    none = [None] * len(rows)
                    columns = [[1] * len(rows), [number] * len(rows), *[none] * 7, [r for r, _ in rows], [hashes[i].tobytes() for _, i in rows], [text[i].tobytes() for _, i in rows], [tf[i].tobytes() for _, i in rows]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
                C.trim()

    schema = "kind int, slice long, i int, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, r int, hashes binary, texts binary, tf binary"
    made = C.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text").mapInArrow(run, schema), "scored")

    def add(left, right):
        import pyarrow as pa

        have, counts_ = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if right.num_rows:
            have = np.frombuffer(right.column("hashes")[0].as_py(), np.uint64)
            counts_ = np.frombuffer(right.column("counts")[0].as_py(), np.int64)
            order = np.argsort(have)
            have, counts_ = have[order], counts_[order]
        rows = []
        for number, h, text, tf in zip(*[left.column(c).to_pylist() for c in ("slice", "hashes", "texts", "tf")], strict=True):
            h, text, tf = np.frombuffer(h, np.uint64), np.frombuffer(text, np.uint32), np.frombuffer(tf, np.uint32)
            if len(have):
                at = np.minimum(np.searchsorted(have, h), len(have) - 1)
                c = np.where(have[at] == h, counts_[at], 0)
            else:
                c = np.zeros(len(h))
            some, which = np.unique(text, return_inverse=True)
            rows.append((number, some.astype(np.int32).tobytes(), np.bincount(which, tf * (c > 0)).astype(np.int64).tobytes(), np.bincount(which, tf * np.log10(c + 1.0)).tobytes()))
        return pa.table([pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.int64(), *[pa.binary()] * 3))], names=["slice", "i", "known", "more"])

    def total_up(table):
        import pyarrow as pa

        i, known, more = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("i", np.int32), ("known", np.int64), ("more", np.float64)))
        some = np.unique(i)
        columns = [np.full(len(some), table.column("slice")[0].as_py(), np.int64), some, np.bincount(i, known)[some].astype(np.int64), np.bincount(i, more)[some]]
        return pa.table([pa.array(x) for x in columns], names=["slice", "i", "known", "more"])

    # a row for each slice and range, then one for each text
    rare = made.where("kind = 1").select("r", "slice", "hashes", "texts", "tf").groupBy("r").cogroup(words.select("r", "hashes", "counts").groupBy("r")).applyInArrow(add, "slice long, i binary, known binary, more binary")
    rare = rare.groupBy("slice").applyInArrow(total_up, "slice long, i int, known long, more double")
    rows = made.where("kind = 0").select("slice", "i", "doc_id", "held_out", "n_tokens", "n_known", "base", "score").join(rare, ["slice", "i"], "left")
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))
    return rows.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def _often(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, rising, and counts of the OFTEN most frequent words."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for h, c in zip(b.column("hashes").to_pylist(), b.column("counts").to_pylist(), strict=True):
                h, c = np.frombuffer(h, np.int64), np.frombuffer(c, np.int64)
                best = np.lexsort((h, -c))[:OFTEN]
                yield pa.RecordBatch.from_arrays([pa.array(h[best]), pa.array(c[best])], ["h", "c"])

    got = words.select("hashes", "counts").mapInArrow(run, "h long, c long").orderBy(F.desc("c"), "h").limit(OFTEN).toArrow()
    h, c = np.asarray(got.column("h")).astype(np.int64).view(np.uint64), np.asarray(got.column("c"))
    order = np.argsort(h)
    return h[order], c[order]


def op1_lm_score(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id"), 7))
    return score_texts(docs, docs.where(~F.col("held_out")))
