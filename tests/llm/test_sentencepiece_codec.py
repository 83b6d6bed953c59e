import random
from pathlib import Path

import sentencepiece
from pyspark.sql import types as T

from gridloom.llm import sentencepiece_codec as S

MODEL = Path(S.MODEL).read_bytes()
# the trainer's model type, turned from BPE to unigram: the public library then runs its own Viterbi on these scores
UNIGRAM = MODEL.replace(b"\x12\x06tok_v0\x18\x02", b"\x12\x06tok_v0\x18\x01")
TEXTS = ["", " ", "a", "Hello  world\n\t x ", "été ①②  über", "the nation, the\nthe", "\U0001f600 ok", "ab" * 40, "  lead", "x" * 300]


def test_same_path_score_as_the_public_library():
    library = sentencepiece.SentencePieceProcessor(model_proto=UNIGRAM)
    coder = S.Codec(MODEL)
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("théng aß ñ,.on") for _ in range(rng.randint(1, 25))) for _ in range(300)]
    for text in texts:
        # the library adds scores in single precision, which an unknown character's penalty uses up
        if len(text) <= 60 and coder.single.issuperset(text.replace(" ", S.MARK)):
            assert coder.encode(text) == library.encode(text), text


def test_round_trip_and_edge_cases(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("piece_ids", T.StringType())])
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS + [None, "w " * 30_000, "q" * 50_000, "a", "a"])]
    coded = S.encode(spark.createDataFrame(rows, schema), check="ok")
    out = {r.doc_id: r for r in coded.collect()}
    assert len(out) == len(rows)
    for i, text, _ in rows:
        assert (out[i].piece_ids is None) == (text is None)
        assert out[i].ok is (None if text is None else True)
    assert out[0].piece_ids == []
    back = {r.doc_id: r.text for r in S.decode(coded.drop("text")).collect()}
    assert back == {i: t for i, t, _ in rows}
    assert S.encode(spark.createDataFrame([], schema)).count() == 0


def test_a_text_with_a_space_mark_does_not_come_back(spark):
    rows = S.encode(spark.createDataFrame([(1, "a▁b"), (2, "a b")], "doc_id long, text string"), check="ok").orderBy("doc_id").collect()
    assert [r.ok for r in rows] == [False, True] and rows[0].piece_ids == rows[1].piece_ids


def test_path_is_best_by_brute_force():
    coder = S.Codec(MODEL)
    scores = {}
    for key, (i, n, s) in coder.automaton.items():
        scores[key] = s

    def best(word):
        if not word:
            return 0.0
        return max((scores[word[:k]] + best(word[k:]) for k in range(1, len(word) + 1) if word[:k] in scores), default=float("-inf"))

    ids = {v[0]: k for k, v in coder.automaton.items()}
    for word in ("▁nation", "▁▁the", "ing", "▁reason"):
        assert sum(scores[ids[i]] for i in coder.best_path(word)) == best(word)
