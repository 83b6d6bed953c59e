"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a one-pass Viterbi.

The automaton runs over the text once. At each position it reports, along its output links, every piece that ends
there, longest first; each relaxes the best score of that position. The best path is then read backwards. Scores are
those of the model file; user-defined pieces score as in the public unigram segmenter (length times the best score,
less 0.1), and a character that is no piece costs the worst score less ten and becomes byte pieces (or the unknown
piece, if the model has no bytes). Of equal paths the one with the longer last piece stays. Model files hold pieces
and scores, whatever they were trained for; the result is the best-scoring segmentation by those scores.

If no piece of the model has a space mark after another character, a best path never crosses such a place, so words
are segmented one by one and remembered: a bounded memo that changes no result. Other models are run on whole texts.

Encoding puts a space mark first if the model says so and writes spaces as marks. Decoding joins pieces, reads
byte pieces as UTF-8 and takes that first mark away: it gives the text back exactly, except that a space mark
(U+2581) in the text comes back as a space (``check`` is false there). Null texts give a null list, empty texts an empty one. Very long texts
are worked on whole. Repeated rows repeat; empty tables stay empty; other columns pass through, and columns that have
the names of the outputs are replaced.
"""

from __future__ import annotations

import re
import struct
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
#: Words kept in the memo of a Python worker, and the longest word kept.
MEMO_WORDS, MEMO_LENGTH = 200_000, 48
#: Text worked on at once, in bytes (one row at least).
SLICE_BYTES = 4 << 20


def _fields(data: bytes):
    """(number, value) of each field of a protocol-buffer message; nested messages stay bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            value = varint()
        elif key & 7 == 2:
            n = varint()
            value = data[at : at + n]
            at += n
        else:
            n = 4 if key & 7 == 5 else 8
            value = data[at : at + n]
            at += n
        yield key >> 3, value


class Codec:
    """Encoder and decoder of one model file, given as bytes."""

    def __init__(self, model: bytes):
        import ahocorasick

        pieces, self.prefix, squeeze = [], True, True
        for number, value in _fields(model):
            if number == 1:
                x = dict(_fields(value))
                pieces.append((x[1].decode(), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, NORMAL)))
            elif number == 3:
                x = dict(_fields(value))
                self.prefix, squeeze = bool(x.get(3, 1)), bool(x.get(4, 1))
                if x.get(2):
                    raise ValueError("models with a normalisation table are not supported")
        if squeeze:
            raise ValueError("models that remove extra white space can't be decoded exactly")
        usual = [s for _, s, kind in pieces if kind == NORMAL]
        top, self.unknown_score = max(usual), min(usual) - 10
        self.bytes_at = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unknown = next((i for i, x in enumerate(pieces) if x[2] == UNKNOWN), 0)
        self.automaton = ahocorasick.Automaton()
        self.single, by_word = set(), True
        for i, (p, s, kind) in enumerate(pieces):
            if kind in (NORMAL, USER) and p:
                self.automaton.add_word(p, (i, len(p), s if kind == NORMAL else len(p) * top - 0.1))
                if len(p) == 1:
                    self.single.add(p)
                by_word &= MARK not in p.lstrip(MARK)
        self.automaton.make_automaton()
        self.words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall if by_word else lambda text: [text]
        self.raw = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(MARK, " ").encode() for p, _, kind in pieces]
        self.memo: dict[str, tuple[int, ...]] = {}

    def best_path(self, word: str) -> tuple[int, ...]:
        """Ids of the best segmentation of one word, with its space marks."""
        n = len(word)
        best, back = [0.0] + [float("-inf")] * n, [(-1, 0)] * (n + 1)
        done, single, unknown = 0, self.single, self.unknown_score

        def close(upto):  # positions whose character is no piece
            for p in range(done + 1, upto + 1):
                if word[p - 1] not in single and best[p - 1] + unknown > best[p]:
                    best[p], back[p] = best[p - 1] + unknown, (-1, 1)

        known = single.issuperset(word)
        for end, (piece, size, score) in self.automaton.iter(word):
            end += 1
            if not known and end - 1 > done:
                close(end - 1)
                done = end - 1
            score += best[end - size]
            if score > best[end]:
                best[end], back[end] = score, (piece, size)
        if not known:
            close(n)
        ids, at = [], n
        while at:
            piece, size = back[at]
            if piece >= 0:
                ids.append(piece)
            elif self.bytes_at:
                ids.extend(self.bytes_at[b] for b in reversed(word[at - 1].encode()))
            else:
                ids.append(self.unknown)
            at -= size
        return tuple(reversed(ids))

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        memo, out = self.memo, []
        for word in self.words((MARK if self.prefix else "") + text.replace(" ", MARK)):
            ids = memo.get(word)
            if ids is None:
                ids = self.best_path(word)
                if len(word) <= MEMO_LENGTH:
                    if len(memo) >= MEMO_WORDS:
                        memo.clear()
                    memo[word] = ids
            out += ids
        return out

    def decode(self, ids) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


_codecs: dict[int, Codec] = {}


def codec(model: bytes) -> Codec:
    """The codec of a model file, built once in each Python process."""
    key = hash(model)
    if key not in _codecs:
        _codecs[key] = Codec(model)
    return _codecs[key]


def _slices(batch, text: str):
    import pyarrow.compute as pc

    from gridloom.llm.common import pieces_of

    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    for a, b in pieces_of(batch.num_rows, sizes, SLICE_BYTES):
        yield batch.slice(a, b - a)


def encode(df: DataFrame, model_path: str = MODEL, text: str = "text", ids: str = "piece_ids", check: str | None = None) -> DataFrame:
    """``df`` with the list of piece ids of ``text``; with ``check``, also whether decoding gives the text back."""
    model = Path(model_path).read_bytes()
    new = [ids] + [check] * bool(check)
    rest = [f for f in df.schema.fields if f.name not in new]
    schema = T.StructType(rest + [T.StructField(ids, T.ArrayType(T.IntegerType()))] + [T.StructField(c, T.BooleanType()) for c in new[1:]])
    names = [f.name for f in rest]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        coder = codec(model)
        for batch in batches:
            for part in _slices(batch, text):
                texts = part.column(text).to_pylist()
                lists = [None if t is None else coder.encode(t) for t in texts]
                offsets = np.zeros(len(lists) + 1, np.int32)
                np.cumsum([len(x or ()) for x in lists], out=offsets[1:])
                flat = np.fromiter((i for x in lists if x for i in x), np.int32, offsets[-1])
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array([x is None for x in lists]))
                columns = [part.column(c) for c in names] + [column]
                if check:
                    columns.append(pa.array([None if t is None else coder.decode(x) == t for t, x in zip(texts, lists, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names + new)

    return df.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)


def decode(df: DataFrame, model_path: str = MODEL, ids: str = "piece_ids", text: str = "text") -> DataFrame:
    """``df`` with ``text`` decoded from the list of piece ids."""
    model = Path(model_path).read_bytes()
    rest = [f for f in df.schema.fields if f.name != text]
    schema = T.StructType([*rest, T.StructField(text, T.StringType())])
    names = [f.name for f in rest]

    def run(batches):
        import pyarrow as pa

        coder = codec(model)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [None if x is None else coder.decode(x) for x in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + [pa.array(texts, pa.string())], [*names, text])

    return df.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Piece ids of all documents, their number, and whether decoding them gives the text back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, check="round_trip").select("doc_id", F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long").alias("n_pieces"), "piece_ids", "round_trip")
