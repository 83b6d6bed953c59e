"""The corpus pipeline on the smallest tables."""

import re

import corpus_pipeline as P
from gridloom.llm import sentencepiece_codec
from tests.llm import cases

FOLDER = "/root/testdata/sf0.001"


def survivors(docs):
    """By brute force: the least doc_id of each group linked by five-word shingles at 0.8 or more."""
    sets = {}
    for r in docs:
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d for d in sets if find(d) == d}


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {"documents": docs}
    now = docs
    for name, stage in P.STAGES:
        now = rows[name] = stage(spark, now, FOLDER).cache()
        if name != P.STAGES[-1][0]:
            assert now.columns == docs.columns
    bad = spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality = 0")
    assert rows["quality"].join(bad, "doc_id").count() <= 0.2 * max(1, bad.count())
    assert rows["near_duplicates"].count() < rows["quality"].count()
    assert {r.doc_id for r in rows["near_duplicates"].collect()} == survivors(rows["quality"].collect())
    assert not [r for r in rows["personal_data"].collect() if re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r.text or "")]
    assert rows["mixture"].count() > 0 and rows["pieces"].count() == rows["mixture"].count()
    texts = sorted(r.text or "" for r in rows["mixture"].select("text").collect())
    back = sentencepiece_codec.decode(rows["pieces"].select("piece_ids"))
    assert sorted(r.text or "" for r in back.select("text").collect()) == texts
    assert P.run(spark, FOLDER).count() == rows["pieces"].count()


def test_stages_on_awkward_and_empty_documents(spark):
    """Nulls, empty and long texts, repeated rows and columns named like the operators' own."""
    docs = cases.awkward(spark)
    for name, stage in P.STAGES[:-1]:
        now = stage(spark, docs, FOLDER)
        assert now.columns == docs.columns, name
        rows = now.collect()
        assert rows and {(r.mix_u, r.pii_base, r.quality_score, r.row) for r in rows} == {("k",) * 4}, name
        assert stage(spark, cases.empty(spark), FOLDER).count() == 0, name
    coded = {r.doc_id: r for r in P.STAGES[-1][1](spark, docs, FOLDER).collect()}
    assert coded[1].piece_ids is None and coded[1].n_pieces == 0 and coded[2].piece_ids == []
    assert P.STAGES[-1][1](spark, cases.empty(spark), FOLDER).count() == 0


def test_the_session_keeps_its_batch_size(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert P.run(spark, FOLDER).columns == ["doc_id", "source", "lang", "n_pieces", "piece_ids"]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
