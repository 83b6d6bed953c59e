"""Every document operator on awkward documents and on an empty table."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridloom.llm import language_id, lm_score, mixing, ngram_join, pii, quality, repeats, sentencepiece_codec
from tests.llm import cases


def language(docs):
    docs = docs.withColumn("held_out", language_id.held_out(F.col("doc_id"), 4))
    return language_id.identify(docs, *language_id.learn(docs.where(~F.col("held_out")), rounds=1))


def lm(docs):
    docs = docs.select("doc_id", "text").withColumn("held_out", language_id.held_out(F.col("doc_id"), 7))
    return lm_score.score_texts(docs, docs.where(~F.col("held_out")))


def co_trained(docs):
    labels = docs.select("doc_id", F.lit(None).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    return quality.score(docs, quality.fit(docs, labels))


OPERATORS = {"lm": lm, "language": language, "quality": co_trained, "repeats": repeats.remove_repeats, "near": ngram_join.near_duplicates, "pii": lambda docs: pii.find(docs).select("row.doc_id", "base", "spans"), "mix": mixing.mix_report, "pieces": sentencepiece_codec.encode}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(spark, name):
    docs = cases.awkward(spark)
    got = OPERATORS[name](docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.select("doc_id").collect())
    twice = [tuple(r) for r in got if r.doc_id == 12]
    assert twice[0] == twice[1]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_stay_empty(spark, name):
    assert OPERATORS[name](cases.empty(spark)).count() == 0


def test_defined_results(spark):
    docs = cases.awkward(spark)
    said = {r.doc_id: r for r in language(docs).collect()}
    assert all((said[i].lang_pred, said[i].score) == ("und", 0.0) for i in (1, 2, 3, 5))
    assert said[8].lang_pred in ("en", "fr") and 0 <= said[8].score <= 1
    near = {r.doc_id: r for r in ngram_join.near_duplicates(docs).collect()}
    assert near[1].n_shingles == near[2].n_shingles == near[3].n_shingles == 0 and near[3].component_id == 3
    assert near[12].component_id == near[13].component_id == 12 and near[4].n_shingles == 1
    out = {r.doc_id: r for r in repeats.remove_repeats(docs).collect()}
    assert out[1].n_bytes == 0 and out[1].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert out[8].n_removed == 60_000 and out[8].n_spans == 1
    assert all(r.quality_keep and r.quality_score == 0.5 for r in co_trained(docs).collect())
    score = {r.doc_id: r for r in lm(docs).collect()}
    assert score[1].n_tokens == 1 and score[9].n_tokens == 30_001 and all(r.score < 0 for r in score.values())


def test_rows_pass_through_filters(spark):
    docs = cases.awkward(spark)
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and {r.pii_base for r in clean.collect()} == {"k"}
    assert Counter(r.text is None for r in clean.collect()) == Counter(r.text is None for r in docs.collect())
    left = ngram_join.keep_one(docs)
    assert left.columns == docs.columns
    ids = Counter(r.doc_id for r in left.select("doc_id").collect())
    assert ids[12] == 1 and ids[13] == 0 and ids[1] == 1 and ids[None] == 1
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == docs.columns and {r.mix_u for r in mixed.collect()} == {"k"}
