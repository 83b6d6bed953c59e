"""Removal of long passages that occur more than once, byte by byte, by distributed prefix doubling.

A position is repeated if the ``length`` bytes from it also stand at another position, of any text. Every byte of
repeated positions' strings is removed. Positions are ranked by ever longer strings: the rank of a string of twice the
length is the pair of the ranks of its halves, at an offset of the half; pairs are dealt to ranges, sorted and counted there,
and positions whose pair is alone drop out. The name of a rank is a hash of its string: of 64 bits in the rounds that only
rule positions out, of 128 bits (two independent polynomial hashes) in the last one, which decides what is removed.

To start with, only content-defined positions are ranked: a place is a cut where the hash of the bytes before it says so.
Round by round, runs of 1, 2, 4 phrases between cuts are ranked. A phrase run that is alone in the corpus rules out each
position whose string holds it with the bytes that place its cuts. The ranks that are not alone go into a bit filter of fixed size, which
tasks look up in the next round; what gets through it by chance costs work only. In the last rounds every byte
position left is ranked by the pair of its two halves of the full length.

Texts that are equal (by 128 bits) are one: all but one of them stay out of the ranking (again by a bit filter), and if they are long enough all their bytes
are removed. Null texts are empty. Texts shorter than the length lose nothing. Very long texts are ranked whole. Strings never
cross texts, but may overlap in one. The text that is left is the bytes left, less any character that has lost some of its
bytes. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common as C

LENGTH = 400
#: Bytes whose hash places a cut, and leading hash bits that must be zero there.
CUT_BYTES, CUT_BITS = 12, 5
#: Phrases of the runs ranked, round by round.
ROUNDS = (1, 2, 4)
#: The filter's bits, as a power of two: eight for each entry expected, and no more than this.
MOST_BITS = 27
SLICE_BYTES = 2 << 20
#: Positions that one range ranks at once.
RANGE_POSITIONS = 3_000_000
_TURN = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _slices(batch):
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    for a, b in C.pieces_of(batch.num_rows, sizes, SLICE_BYTES):
        yield batch.slice(a, b - a)


def text_keys(raw: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A 128-bit hash of each text."""
    return [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(offsets, offsets[1:])]


# ------------------------------------------------------------- bit filters


def filter_size(entries: float) -> int:
    return min(MOST_BITS, max(10, int(np.ceil(np.log2(8 * max(1, entries))))))


def bit_rows(hashes: np.ndarray, size: int):
    """Words of a filter of 2**size bits and the bits that these hashes set in them."""
    at = np.concatenate([(C.mix(hashes + t) >> np.uint64(64 - size)).astype(np.int64) for t in _TURN[:3]])
    word, bit = at >> 6, np.left_shift(np.int64(1), at & 63)
    order = np.argsort(word, kind="stable")
    word, bit = word[order], bit[order]
    first = np.flatnonzero(np.diff(word, prepend=-1))
    return word[first], np.bitwise_or.reduceat(bit, first) if len(first) else bit


def gathered_filter(rows: DataFrame, size: int) -> np.ndarray:
    """The filter from rows (word, bits): of a fixed number of words."""
    got = rows.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (size - 6), np.int64)
    out[np.asarray(got.column("word"))] = np.asarray(got.column("bits"))
    return out


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    out, size = np.ones(len(hashes), bool), len(bits).bit_length() + 5
    for t in _TURN[:3]:
        at = (C.mix(hashes + t) >> np.uint64(64 - size)).astype(np.int64)
        out &= (bits[at >> 6] >> (at & 63)) & 1 == 1
    return out


# ----------------------------------------------------------------- ranking


class Phrases:
    """Cuts of the texts of a slice, and the ranks of runs of 1, 2, 4 phrases."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw, self.offsets = raw, offsets
        self.prefix = C.prefix_hash(raw)
        self.down = C.powers("down", len(raw) + 1)
        k = CUT_BYTES
        if len(raw) > k:
            place = C.mix(self._hash(np.arange(len(raw) + 1 - k), k))
            cut = np.flatnonzero(place >> np.uint64(64 - CUT_BITS) == 0) + k
        else:
            cut = np.zeros(0, np.int64)
        text = np.searchsorted(offsets, cut - 1, "right") - 1 if len(cut) else cut
        inside = cut - k >= offsets[text] if len(cut) else np.zeros(0, bool)
        self.cut, self.text = cut[inside], text[inside]
        # runs[m]: first phrase of each run of m phrases, and its rank; a phrase lies between cuts of one text
        first = np.flatnonzero(self.text[1:] == self.text[:-1]) if len(self.cut) > 1 else np.zeros(0, np.int64)
        size = self.cut[first + 1] - self.cut[first] if len(first) else first
        rank = C.mix((self.prefix[self.cut[first + 1]] - self.prefix[self.cut[first]]) * self.down[self.cut[first]] + size.astype(np.uint64)) if len(first) else np.zeros(0, np.uint64)
        self.runs = {1: (first, rank)}

    def _hash(self, at: np.ndarray, size: int) -> np.ndarray:
        return (self.prefix[at + size] - self.prefix[at]) * self.down[at]

    def double(self, m: int, kept: np.ndarray) -> None:
        """Ranks of runs of 2 m phrases, from pairs of ranks at an offset of m, where both are kept."""
        first, rank = self.runs[m]
        at = np.full(len(self.cut) + 2 * m, -1, np.int64)
        at[first[kept]] = np.flatnonzero(kept)
        pair = np.flatnonzero((at[: len(self.cut)] >= 0) & (at[m : m + len(self.cut)] >= 0))
        a, b = at[pair], at[pair + m]
        # a run of m phrases at pair + m is of the same text, as a text's last cut begins no phrase
        self.runs[2 * m] = (pair, C.mix(rank[a] * _TURN[3] + C.mix(rank[b] + np.uint64(m))))

    def left(self, filters: list[np.ndarray], length: int) -> np.ndarray:
        """Positions that no phrase run alone in the corpus rules out."""
        offsets, cut = self.offsets, self.cut
        n = len(self.raw)
        step = np.zeros(n + 2, np.int32)
        for bits, m in zip(filters, ROUNDS):
            first, rank = self.runs[m]
            kept = passes(bits, rank)
            alone = first[~kept]
            if len(alone):
                text = self.text[alone]
                lo = np.maximum(cut[alone + m] - length, offsets[text])
                hi = np.minimum(cut[alone] - CUT_BYTES, offsets[text + 1] - length)
                some = lo <= hi
                np.add.at(step, lo[some], 1)
                np.add.at(step, hi[some] + 1, -1)
            if 2 * m in ROUNDS and 2 * m not in self.runs:
                self.double(m, kept)
        out = np.cumsum(step[:n]) == 0
        # a position needs the full length in its text
        sizes = np.diff(offsets)
        tail = np.minimum(sizes, length - 1)
        ends = np.repeat(offsets[1:] - tail, tail) + np.arange(tail.sum()) - np.repeat(np.cumsum(tail) - tail, tail)
        out[ends] = False
        return np.flatnonzero(out)



def last_ranks(raw: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The rank of the full length at each position, from the ranks of its halves at an offset of one half: two 64-bit parts."""
    half, out = length // 2, []
    for second in (False, True):
        prefix, down = C.prefix_hash(raw, second), C.powers("down2" if second else "down", len(raw) + 1)
        here, there = ((prefix[at + a + n] - prefix[at + a]) * down[at + a] for a, n in ((0, half), (half, length - half)))
        out.append(C.mix(C.mix(here) * _TURN[3] + C.mix(there)))
    return out[0], out[1]


def _dealt(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    at = (hashes >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.int64)
    order = np.argsort(at, kind="stable")
    return order, np.searchsorted(at[order], np.arange((1 << bits) + 1))


def _ranked(docs: DataFrame, length: int, keep: np.ndarray, filters: list[np.ndarray], m: int, bits: int, size: int) -> np.ndarray:
    """The filter of ranks of runs of m phrases that stand more than once."""
    sent = docs.sparkSession.sparkContext.broadcast((keep, filters))

    def deal(batches):
        import pyarrow as pa

        keep, filters = sent.value
        for batch in batches:
            for part in _slices(batch):
                raw, offsets = _chosen(part, keep, length)
                if not len(raw):
                    continue
                phrases = Phrases(raw, offsets)
                for bits_, k in zip(filters, ROUNDS):
                    phrases.double(k, passes(bits_, phrases.runs[k][1]))
                rank = phrases.runs[m][1]
                order, edges = _dealt(rank, bits)
                rows = [(r, rank[order[a:b]].tobytes()) for r, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["r", "ranks"])

    def count(table):
        import pyarrow as pa

        ranks = np.sort(np.frombuffer(b"".join(table.column("ranks").to_pylist()), np.uint64))
        again = np.unique(ranks[1:][ranks[1:] == ranks[:-1]])
        word, bit = bit_rows(again, size)
        return pa.table([pa.array(word), pa.array(bit)], names=["word", "bits"])

    dealt = docs.select("doc_id", "text").mapInArrow(deal, "r int, ranks binary")
    out = gathered_filter(dealt.groupBy("r").applyInArrow(count, "word long, bits long"), size)
    sent.destroy()
    return out


def _named(keys: list[bytes], doc_id) -> np.ndarray:
    """A hash of text and doc_id, by which one of several equal texts is chosen."""
    key = np.frombuffer(b"".join(keys), np.uint64)[::2]
    ids = np.asarray(doc_id.fill_null(-1).to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
    return C.mix(key ^ C.mix(ids))


def _chosen(part, keep: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of those texts of a slice that are ranked."""
    raw, offsets = C.flat_texts(part.column("text"))
    some = passes(keep, _named(text_keys(raw, offsets), part.column("doc_id"))) & (np.diff(offsets) >= length)
    return _taken(raw, offsets, some)


def _taken(raw: np.ndarray, offsets: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return raw[np.repeat(some, np.diff(offsets))], np.concatenate([[0], np.cumsum(np.diff(offsets)[some])])


def _described(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), size, 128-bit key, name and SHA-256 of each row."""

    def describe(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for part in _slices(batch):
                raw, offsets = C.flat_texts(part.column("text"))
                keys = text_keys(raw, offsets)
                sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(offsets, offsets[1:])]
                named = _named(keys, part.column("doc_id"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pc.fill_null(part.column("text"), ""), pa.array(np.diff(offsets)), pa.array(keys, pa.binary()), pa.array(named.view(np.int64)), pa.array(sha)], ["doc_id", "text", "n_bytes", "key", "named", "sha"])

    return docs.mapInArrow(describe, "doc_id long, text string, n_bytes long, key binary, named long, sha string")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, what is left of the text and the spans removed, of each row of ``docs``.

    Spans are start:end in bytes of the text given, end exclusive, joined by commas.
    """
    if length < 1:
        raise ValueError(f"a passage has one byte at least, not {length}")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = C.keep(_described(docs).drop("text", "sha"), "described")
    texts = rows.where(F.col("n_bytes") >= length).groupBy("key").agg(F.min("named").alias("named"), F.count("*").alias("copies"))
    total, number = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count("*")).first()
    size = filter_size(number)

    def set_bits(batches):
        import pyarrow as pa

        for batch in batches:
            word, bit = bit_rows(np.asarray(batch.column("named")).view(np.uint64), size)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bit)], ["word", "bits"])

    keep = gathered_filter(texts.select("named").mapInArrow(set_bits, "word long, bits long"), size)
    filters: list[np.ndarray] = []
    for m in ROUNDS:
        bits = max(4, int(np.ceil(np.log2(max(1, total / 32 / m / RANGE_POSITIONS)))))
        filters.append(_ranked(docs, length, keep, filters, m, bits, filter_size(total / 256 / m)))
    sent = docs.sparkSession.sparkContext.broadcast((keep, filters))

    def left(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        keep, filters = sent.value
        part_of, turn = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in _slices(batch):
                raw, offsets = _chosen(part, keep, length)
                if not len(raw):
                    continue
                at = Phrases(raw, offsets).left(filters, length)
                # texts with positions left, packed into one row
                text = np.searchsorted(offsets, at, "right") - 1
                some = np.zeros(len(offsets) - 1, bool)
                some[text] = True
                if not len(at):
                    continue
                before = np.concatenate([[0], np.cumsum(np.where(some, 0, np.diff(offsets)))])
                at = at - before[text]
                raw, offsets = _taken(raw, offsets, some)
                edge = np.flatnonzero(np.diff(at, prepend=-2) != 1)
                runs = np.stack([at[edge], np.diff(np.append(edge, len(at)))], 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([(part_of << 24) + turn]), pa.array([raw.tobytes()], pa.binary()), pa.array([offsets.tobytes()], pa.binary()), pa.array([runs.tobytes()], pa.binary()), pa.array([len(at)])], ["slice", "raw", "offsets", "runs", "positions"])
                turn += 1

    slices = C.keep(docs.mapInArrow(left, "slice long, raw binary, offsets binary, runs binary, positions long"), "left")
    sent.destroy()
    positions = slices.agg(F.sum("positions")).first()[0] or 0
    bits = max(4, int(np.ceil(np.log2(max(1, positions / RANGE_POSITIONS)))))

    def last_pairs(raw, offsets, runs):
        runs = np.frombuffer(runs, np.int64).reshape(-1, 2)
        at = np.repeat(runs[:, 0], runs[:, 1]) + np.arange(runs[:, 1].sum()) - np.repeat(np.cumsum(runs[:, 1]) - runs[:, 1], runs[:, 1])
        raw, offsets = np.frombuffer(raw, np.uint8), np.frombuffer(offsets, np.int64)
        ranks = last_ranks(raw, at, length)
        return raw, offsets, at, ranks, *_dealt(ranks[0], bits)

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                number, *packed = (batch.column(c)[i].as_py() for c in ("slice", "raw", "offsets", "runs"))
                _, _, _, ranks, order, edges = last_pairs(*packed)
                some = [(r, order[a:b]) for r, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in some], pa.int32()), pa.array([number] * len(some), pa.int64()), *[pa.array([x[i].tobytes() for _, i in some], pa.binary()) for x in ranks]], ["r", "slice", "ranks", "seconds"])

    def again(table):
        import pyarrow as pa

        lists = [np.frombuffer(x, np.uint64) for x in table.column("ranks").to_pylist()]
        which, _ = C.numbered(np.concatenate(lists))
        second, _ = C.numbered(np.frombuffer(b"".join(table.column("seconds").to_pylist()), np.uint64))
        which, _ = C.numbered(which.astype(np.uint64) * np.uint64(len(second) + 1) + second.astype(np.uint64))
        more = (np.bincount(which) > 1)[which]
        flags = [np.packbits(x).tobytes() for x in np.split(more, np.cumsum([len(x) for x in lists])[:-1])]
        return pa.table([table.column("slice"), table.column("r"), pa.array(flags, pa.binary())], names=["slice", "r", "flags"])

    dealt = slices.select("slice", "raw", "offsets", "runs").mapInArrow(deal, "r int, slice long, ranks binary, seconds binary")
    flags = dealt.groupBy("r").applyInArrow(again, "slice long, r int, flags binary")

    def cut_out(table, said):
        import pyarrow as pa

        out = [[], [], [], [], [], []]
        if table.num_rows:
            raw, offsets, at, _, order, edges = last_pairs(*(table.column(c)[0].as_py() for c in ("raw", "offsets", "runs")))
            repeated = np.zeros(len(at), bool)
            for r, x in zip(said.column("r").to_pylist(), said.column("flags").to_pylist(), strict=True):
                mine = order[edges[r] : edges[r + 1]]
                repeated[mine] = np.unpackbits(np.frombuffer(x, np.uint8), count=len(mine)).astype(bool)
            step = np.zeros(len(raw) + 1, np.int32)
            np.add.at(step, at[repeated], 1)
            np.add.at(step, at[repeated] + length, -1)
            gone = np.cumsum(step[:-1]) > 0
            rise = gone.copy()
            rise[1:] &= ~gone[:-1]
            begins = offsets[:-1][np.diff(offsets) > 0]
            rise[begins] = gone[begins]
            keys = text_keys(raw, offsets)
            for i, (a, b) in enumerate(zip(offsets, offsets[1:])):
                if gone[a:b].any():
                    left = raw[a:b][~gone[a:b]].tobytes()
                    ends = np.flatnonzero(np.diff(gone[a:b].astype(np.int8), prepend=0, append=0)).tolist()
                    cuts = ",".join(f"{x}:{y}" for x, y in zip(ends[::2], ends[1::2], strict=True))
                    for x, y in zip(out, (keys[i], int(gone[a:b].sum()), int(rise[a:b].sum()), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore"), cuts), strict=True):
                        x.append(y)
        return pa.table([pa.array(x, t) for x, t in zip(out, (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=["key", "removed", "spans", "kept", "rest", "cuts"])

    found = slices.select("slice", "raw", "offsets", "runs").groupBy("slice").cogroup(flags.groupBy("slice")).applyInArrow(cut_out, "key binary, removed long, spans long, kept string, rest string, cuts string")
    once = C.keep(found, "cut").dropDuplicates(["key"])
    many = texts.where("copies > 1").select("key", F.lit(True).alias("copied"))
    told = _described(docs).drop("named").join(once.join(many, "key", "full_outer"), "key", "left")
    copied = F.coalesce("copied", F.lit(False)) & (F.col("n_bytes") >= length)
    return told.select(
        "doc_id",
        "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(copied, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        F.when(copied, F.lit("")).otherwise(F.coalesce("rest", "text")).alias("text"),
        F.when(copied, F.concat(F.lit("0:"), F.col("n_bytes"))).otherwise(F.coalesce("cuts", F.lit(""))).alias("spans"),
    )


def op4_repeats(spark, sf_dir: str) -> DataFrame:
    """What is left of all documents without strings of 400 bytes that occur more than once."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
