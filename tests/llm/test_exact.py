"""Operators against brute force and planted cases."""

import hashlib
import math
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import ann, language_id, lm_score, mixing, ngram_join, pii, quality, repeats, topk
from tests.llm import cases

FOLDER = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string")


def some_vectors(n=700, d=12, seed=1):
    rng = np.random.default_rng(seed)
    x = (rng.standard_normal((n, d)) + rng.integers(0, 4, (n, 1))).astype(np.float32)
    rows = [(i, [float(c) for c in v], "k") for i, v in enumerate(x)]
    rows[5] = (5, rows[3][1], "k")
    rows += [(90_000, None, "k"), (90_100, [], "k"), (90_200, [None] * d, "k"), (90_300, [float("nan")] * d, "k"), (90_400, [float("inf")] * d, "k"), (None, rows[1][1], "k"), (90_500, [0.0] * d, "k"), (90_600, [0.5], "k")]
    return rows


def test_topk_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "INDEX_ROWS", 100)
    rows = some_vectors()
    got = topk.top_k(vectors(spark, rows), F.col("id") % 50 == 0, 5)
    fine = {i: np.array([math.floor(256 * c) for c in v] + [0] * (12 - len(v))) for i, v, _ in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v)}
    want = set()
    for q in fine:
        if q % 50 == 0:
            best = sorted(((-int(fine[q] @ fine[c]), c) for c in fine if c != q))[:5]
            want |= {(q, n, c, -s) for n, (s, c) in enumerate(best, 1)}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()} == want
    assert topk.top_k(vectors(spark, []), F.col("id") % 50 == 0, 5).count() == 0


def test_impact_block_bounds_hold_on_clusters():
    rng = np.random.default_rng(4)
    x = (rng.standard_normal((3000, 8)) * 20 + rng.integers(-80, 80, (1, 8)) * (rng.random((3000, 1)) < 0.1)).astype(np.int64)
    block = topk.ImpactBlock(np.arange(3000), x)
    for q in (0, 7, 1234):
        ids, scores = block.search(x[q], q, 5)
        order = sorted((-int(x[q] @ x[c]), c) for c in range(3000) if c != q)[:5]
        assert [(-s, i) for i, s in zip(ids.tolist(), scores.tolist(), strict=True)] == [(s, c) for s, c in order]


def test_neighbours_are_exact_and_recall_is_reached(spark, monkeypatch):
    rows = some_vectors(3000, 16, 3)
    got = ann.nearest(vectors(spark, rows), F.col("id") % 20 == 0, 20).collect()
    fine = {i: np.array(list(v) + [0.0] * (16 - len(v))) for i, v, _ in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    ids = np.array(sorted(fine))
    x = np.stack([fine[i] for i in ids])
    hits = total = 0
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
        assert r.score == pytest.approx(float(fine[r.query_id] @ fine[r.vec_id]), rel=1e-12) and r.vec_id != r.query_id
    assert set(by) == {int(i) for i in ids if i % 20 == 0}
    for q, found in by.items():
        found.sort(key=lambda r: r.rank)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found) and len(found) == 20
        s = x @ fine[q]
        s[ids == q] = -np.inf
        true = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        hits, total = hits + len(true & {r.vec_id for r in found}), total + 20
    assert hits / total >= 0.9
    assert ann.nearest(vectors(spark, []), F.col("id") % 20 == 0, 20).count() == 0
    few = ann.nearest(vectors(spark, rows[:6]), F.col("id") % 20 == 0, 20).collect()
    assert len(few) == 5


def test_recall_on_the_given_vectors_without_visiting_all_leaves(spark, monkeypatch):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    most = []
    monkeypatch.setattr(ann, "calibrated", lambda tree, *a, real=ann.calibrated: most.append((real(tree, *a), tree.leaves)) or most[-1][0])
    found = {}
    for r in ann.nearest(table, F.col("id") % 20 == 0, 20).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    rows = table.orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(found[int(ids[q])] & set(ids[np.argsort(-s)[:20]].tolist()))
    assert hits / (20 * len(found)) >= 0.9 and most[0][0] < most[0][1]


def test_repeats_equal_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    line = lambda n: "".join(rng.choice("abcdeé fgh") for _ in range(n))
    shared = [line(600), line(450), line(401)]
    texts = [line(300) + shared[0] + line(200), shared[0][50:] + shared[1], line(700), "ab" * 500, line(399), shared[1] + line(30) + shared[1], shared[2][1:] + "z", line(10) + shared[2], line(420)]
    texts += [texts[2], texts[8], None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(repeats, "SLICE_BYTES", 1500)
    got = {r.doc_id: r for r in repeats.remove_repeats(docs).collect()}
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 400] for b in raw for i in range(len(b) - 399))
    for i, b in enumerate(raw):
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 399):
            if seen[b[p : p + 400]] > 1:
                gone[p : p + 400] = True
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        spans = sum(bool(gone[p]) and not (p and gone[p - 1]) for p in range(len(b)))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), int(gone[: len(b)].sum()), spans, hashlib.sha256(kept).hexdigest())
        assert got[i].text == kept.decode("utf-8", "ignore")


@pytest.mark.parametrize("length", [1, 25, 60])
def test_spans_of_repeats_of_any_length_equal_brute_force(spark, length):
    rng = random.Random(12)
    line = lambda n: "".join(rng.choice("abcdeé fgh") for _ in range(n))
    shared = [line(150), line(70), line(40)]
    texts = [line(30) + shared[0] + line(90), shared[0][20:] + shared[1], line(80), "ab" * 90, shared[1] + line(30) + shared[1] + shared[2], line(9) + shared[2], "xyz", "0", None, ""]
    texts += [texts[2], "7" * 59 + "8"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in repeats.remove_repeats(docs, length).collect()}
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    for i, b in enumerate(raw):
        gone = {q for p in range(len(b) - length + 1) if seen[b[p : p + length]] > 1 for q in range(p, p + length)}
        ends = [p for p in range(len(b) + 1) if (p in gone) != (p - 1 in gone)]
        assert (got[i].spans, got[i].n_removed) == (",".join(f"{x}:{y}" for x, y in zip(ends[::2], ends[1::2], strict=True)), len(gone))
        kept = bytes(c for p, c in enumerate(b) if p not in gone)
        assert (got[i].kept_sha256, got[i].n_spans) == (hashlib.sha256(kept).hexdigest(), len(ends) // 2)


def test_repeats_equal_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id IS NOT NULL")
    raw = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    got = {r.doc_id: r for r in repeats.remove_repeats(docs).collect()}
    seen = Counter()
    for b in raw.values():
        seen.update(hash(b[p : p + 400]) for p in range(len(b) - 399))
    for i, b in raw.items():
        gone = np.zeros(len(b) + 1, np.int32)
        for p in range(len(b) - 399):
            if seen[hash(b[p : p + 400])] > 1:
                gone[p] += 1
                gone[p + 400] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("cluster", [1500, 1])
def test_links_equal_brute_force(spark, monkeypatch, cluster):
    monkeypatch.setattr(ngram_join, "CLUSTER_SETS", cluster)
    monkeypatch.setattr(ngram_join, "GROUP_SETS", 7)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(6):
        base = [rng.choice(words) for _ in range(rng.randint(60, 160))]
        for _ in range(rng.randint(2, 25)):
            t = base[:]
            for _ in range(rng.randint(0, 5)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t) if rng.random() < 0.8 else " ".join(t).upper())
    texts += ["a b", "A  b", "a", "", None, "b a"]
    docs = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == {i * 3: (len(s), find(i) * 3) for i, s in enumerate(sets)}


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        total = sum((x := int(c) * (1 + i % 2)) - 9 * (x > 9) for i, c in enumerate(reversed(d)))
        return 12 <= len(d) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def test_base_spans_equal_the_patterns(spark):
    texts = ["a@b.com@c.de x_a@b.c_d@e.f", "a.b+c@d-e.f.g.", "1.2.3.4.5.6.7.8 256.1.1.1 0255.01.1.1", "4111 1111-1111 1111 4111111111111112", "+1 (555) 010-2345- +44 20 7946 0958 +12", "é+49-30-1234567\U0001f600 q@r.st", "", None, "1" * 3000, "a" * 3000 + "@b.cc"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionByName(documents(spark).select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    found = {r.row.doc_id: r for r in pii.find(docs).collect()}
    for r in docs.collect():
        want = sorted((m.start(), k, m.end()) for k, p in enumerate(BASE.values()) for m in re.finditer(p, r.text or "") if passes(pii.KINDS[k], m[0]))
        assert [(x.s, x.kind, x.e) for x in found[r.doc_id].base] == want, r.text
        assert {tuple(x) for x in found[r.doc_id].base} <= {tuple(x) for x in found[r.doc_id].spans}


def test_boosting_adds_spans_like_the_base_ones(spark):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        number = f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
        rows.append((i, f"please call +1-{number} today" if i % 30 else f"please call {number} today"))
    for i in range(900, 1200):
        rows.append((i, f"pages {rng.randint(10, 99)} {rng.randint(100, 999)} {rng.randint(100, 999)} of the report"))
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string"), precision=0.9).collect()
    assert all(len(r.spans) == (1 if r.row.doc_id < 900 else 0) for r in found if r.row.doc_id % 30 or r.row.doc_id >= 900)
    added = [r for r in found if r.row.doc_id < 900 and r.row.doc_id % 30 == 0 and r.spans]
    assert len(added) >= 20


def test_spans_that_no_base_pattern_gives_are_added(spark):
    rng = random.Random(4)

    def card():
        digits = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return next(digits + c for c in "0123456789" if passes("card", digits + c))

    rows = [(i, f"paid with {card()} at once") for i in range(100)]
    rows += [(100, f"both {card()} {card()} were charged")]  # the base pattern reads them as one number of 32 digits
    rows += [(i, f'set token = "{rng.randbytes(20).hex()}" there') for i in range(200, 300)]
    rows += [(300, f'it said "{rng.randbytes(20).hex()}" there'), (301, "a-long-word-without-any-numeral and Internationalisierungs1")]
    found = {r.row.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(found[100].base) == 0 and [(x.kind, x.s, x.e) for x in found[100].spans] == [(2, 5, 21), (2, 22, 38)]
    assert all(len(found[i].spans) == 1 and found[i].spans[0].kind == 4 for i in range(200, 301)) and not found[301].spans
    assert pii.redact(spark.createDataFrame(rows[100:101], "doc_id long, text string")).first().text == rows[100][1]  # nothing to learn from


def test_mix_prefers_by_size_and_cuts_on_the_pareto_rank(spark):
    report = mixing.mix_report(documents(spark)).collect()
    by = {}
    for r in report:
        by.setdefault((r.source_size, r.target), []).append(r)
    for (size, target), rows in by.items():
        whole = math.floor(target / size)
        if whole < 2:
            assert sum(r.inclusion * r.size for r in rows) == pytest.approx(target - whole * size, rel=1e-9)
        taken = [r.pareto_rank for r in rows if r.pareto_rank is not None and r.copies > whole]
        left = [r.pareto_rank for r in rows if r.pareto_rank is not None and r.copies == whole]
        assert not taken or not left or max(taken) < min(left)
        assert all(r.copies == whole + 1 for r in rows if r.inclusion == 1)
        short, long = (np.mean([r.inclusion for r in rows if (r.size > 60) == side] or [0]) for side in (False, True))
        assert short <= long + 1e-9 or whole == 2


def test_numbering_by_ranges(spark):
    rows = mixing.numbered(spark.range(0, 5000).selectExpr("id * 7919 % 5000 AS x").repartition(7), F.col("x")).collect()
    assert sorted((r.x, r.place) for r in rows) == [(i, i) for i in range(5000)]


def test_mix_meets_its_targets(spark):
    report = mixing.mix_report(cases.awkward(spark)).collect()
    assert sum({r.source_size: r.target for r in report}.values()) <= 1.5 * sum(r.size for r in report) + 1e-6
    assert all(0 <= r.taken <= 2 * r.size for r in report)
    again = mixing.mix_report(cases.awkward(spark).repartition(3)).collect()
    assert Counter((r.doc_id, r.taken) for r in report) == Counter((r.doc_id, r.taken) for r in again)
    real = mixing.mix_report(documents(spark)).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max("size").alias("most")).collect()
    assert all(abs(r.taken - r.target) <= r.most for r in real)
    counts = mixing.mix_sources(documents(spark)).groupBy("doc_id").count()
    both = mixing.mix_report(documents(spark)).where("copies > 0").join(counts, "doc_id").where("copies <> count")
    assert both.count() == 0


def test_language_is_found_on_held_out_documents(spark):
    docs = documents(spark).withColumn("held_out", language_id.held_out(F.col("doc_id"), 4))
    got = language_id.identify(docs, *language_id.learn(docs.where(~F.col("held_out")))).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert held and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_forward_sums_all_segmentations():
    from pathlib import Path

    pieces = language_id.vocabulary(Path(language_id.MODEL).read_bytes())
    rng = np.random.default_rng(2)
    p = rng.random((len(pieces.pieces), 2))
    p /= p.sum(0)
    table = p * language_id.SCALE ** np.array([len(x) for x in pieces.pieces], float)[:, None]
    number = {x: i for i, x in enumerate(pieces.pieces)}

    def total(word, k):
        if not word:
            return 1.0
        return sum(p[number[word[:n]], k] * total(word[n:], k) for n in range(1, len(word) + 1) if word[:n] in number)

    words = [" nation", " the", " über", "x"]
    raw = np.frombuffer("".join(words).encode(), np.uint8)
    size = np.array([len(w.encode()) for w in words])
    begin = np.cumsum(size) - size
    logs, expected = language_id.sums(pieces, table, raw, begin, size, np.ones((4, 2)))
    for i, w in enumerate(words):
        for k in range(2):
            assert logs[i, k] == pytest.approx(math.log(total(w.encode(), k)), rel=1e-9)
    lengths = np.array([len(x) for x in pieces.pieces])
    assert (expected * lengths[:, None]).sum(0) == pytest.approx([size.sum()] * 2)


def test_quality_follows_labels_and_keeps_good_documents(spark):
    docs, labels = documents(spark), spark.read.parquet(f"{FOLDER}/labels.parquet")
    good = docs.where("doc_id % 2 = 0").limit(80)
    bad = docs.where("doc_id % 2 = 1").limit(80).withColumn("text", F.concat(F.repeat(F.lit("BUY NOW!! "), 40), F.substring("text", 1, 50)))
    both = good.unionByName(bad)
    labels = good.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).unionByName(bad.select("doc_id", F.lit(0).alias("quality"), F.lit(0).alias("toxic")))
    got = quality.score(both, quality.fit(both, labels.where("doc_id % 5 < 4"))).collect()
    assert sum(r.quality_keep for r in got if r.doc_id % 2 == 0) >= 78
    assert sum(r.quality_keep for r in got if r.doc_id % 2 == 1) <= 2
    assert quality.filter_quality(both, labels).columns == both.columns


def test_quality_on_labels_that_were_held_back(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    back = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    scored = quality.score(docs, quality.fit(docs, labels.where(~back)))
    rows = scored.join(labels.where(back), "doc_id").select("quality", "quality_score", "quality_keep").collect()
    good, bad = ([r for r in rows if r.quality == side] for side in (1, 0))
    wins = sum((a.quality_score > b.quality_score) + 0.5 * (a.quality_score == b.quality_score) for a in good for b in bad)
    assert good and bad and wins / (len(good) * len(bad)) > 0.9
    assert sum(r.quality_keep for r in good) / len(good) > 0.95


def test_base_scores_equal_counts(spark):
    docs = documents(spark).select("doc_id", "text").withColumn("held_out", language_id.held_out(F.col("doc_id"), 7))
    got = {r.doc_id: r for r in lm_score.score_texts(docs, docs.where(~F.col("held_out"))).collect()}
    count, n = Counter(), 0
    tokens = {r.doc_id: [*(r.text or "").encode().lower().split(), None] for r in docs.collect()}
    for i, t in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(t)
            n += len(t)
    for i, t in tokens.items():
        base = sum(math.log10((count[x] + 1) / (n + len(count) + 1)) for x in t)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(t), sum(count[x] > 0 for x in t), n)
        assert got[i].base_score == pytest.approx(base, rel=1e-9)


def test_attention_model_is_a_distribution():
    """Over all continuations of a context the model's probabilities add up to one."""
    rng = np.random.default_rng(6)
    counts = rng.integers(0, 30, (70, 70)).astype(np.float32)
    model = lm_score.Model(counts)
    model.train(rng.integers(0, 70, (200, lm_score.WINDOW + 1)), 0.02)
    head = rng.integers(1, 70, 40)
    texts = [np.append(head, x) for x in range(70)]
    flat = np.concatenate(texts).astype(np.int32)
    offsets = np.arange(0, 41 * 70 + 1, 41)
    before = model.log10_scores(head.astype(np.int32), np.array([0, 40]))[0]
    assert sum(10 ** (s - before) for s in model.log10_scores(flat, offsets)) == pytest.approx(1, rel=1e-3)


def test_scores_equal_attention_worked_out_place_by_place():
    rng = np.random.default_rng(21)
    model = lm_score.Model(rng.integers(0, 9, (50, 50)).astype(np.float32))
    model.train(rng.integers(0, 50, (300, lm_score.WINDOW + 1)), 0.02)
    texts = [np.append(rng.integers(1, 50, n), 0) for n in (0, 1, 23, 24, 70, 200)]
    got = model.log10_scores(np.concatenate(texts).astype(np.int32), np.cumsum([0, *map(len, texts)]))
    w = {k: x.astype(float) for k, x in model.weights.items()}
    embed, back = model.embed.astype(float), lm_score.WINDOW - lm_score.STRIDE
    for text, score in zip(texts, got, strict=True):
        last = np.append(0, text[:-1])
        total = 0.0
        for i, aim in enumerate(text):
            begin = i // lm_score.STRIDE * lm_score.STRIDE - back
            seen = np.array([last[j] if j >= 0 else 0 for j in range(begin, i + 1)])
            logit = embed[seen] @ w["key"] @ (embed[last[i]] @ w["query"]) / math.sqrt(lm_score.DIM) + w["distance"][np.arange(i - begin, -1, -1)]
            share = np.exp(logit - logit.max())
            z = (share / share.sum()) @ embed[seen] @ w["value"] @ w["out"] + w["bias"]
            chance = np.exp(model.log_group[last[i]].astype(float))
            total += model.log_next[last[i], aim] + z[model.group[aim]] - math.log((np.exp(z) * chance).sum())
        assert score == pytest.approx(total / math.log(10), rel=1e-4)


def test_gradient_of_attention():
    rng = np.random.default_rng(7)
    model = lm_score.Model(rng.integers(0, 9, (40, 40)).astype(np.float32))
    w = rng.integers(0, 40, (6, lm_score.WINDOW + 1))
    _, g = model.gradient(w[:, :-1], w[:, 1:])
    for name in model.weights:
        at = tuple(0 for _ in model.weights[name].shape)
        old = model.weights[name][at]
        loss = []
        for step in (1e-2, -1e-2):
            model.weights[name][at] = old + np.float32(step)
            loss.append(model.gradient(w[:, :-1], w[:, 1:], with_loss=True)[0])
        model.weights[name][at] = old
        assert (loss[0] - loss[1]) / 2e-2 == pytest.approx(float(g[name][at]), rel=0.1, abs=2e-4)


def test_training_reuses_the_memory_of_its_steps():
    """A new process has a few hundred page faults in 64 steps, not some hundred a step."""
    code = """if True:
        import resource
        import numpy as np
        from gridloom.llm import lm_score
        rng = np.random.default_rng(3)
        model = lm_score.Model(rng.integers(0, 9, (200, 200)).astype(np.float32))
        windows = rng.integers(0, 200, (4096, lm_score.WINDOW + 1))
        model.train(windows[:128], 0.02)
        before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
        model.train(windows, 0.02)
        print(resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before)
    """
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=120, env=os.environ | {"OMP_NUM_THREADS": "1", "PYTHONPATH": ":".join(sys.path)})
    assert int(said.stdout.split()[-1]) < 3000


def test_logits_beyond_the_limit_are_held():
    x = np.array([[-90.0, 3.0, 41.0]], np.float32)
    lm_score._limit(x)
    assert x.tolist() == [[-lm_score.LIMIT, 3.0, lm_score.LIMIT]]


def test_every_subword_has_a_place_and_a_share():
    counts = np.random.default_rng(2).integers(0, 50, 9000) * (np.arange(9000) < 5000)
    place, share = lm_score.places(counts)
    assert place[-1] == 0 and place[:-1].min() == 1 and place.max() == lm_score.OWN + lm_score.SHARED
    assert np.bincount(place[:-1], 10 ** share[:-1])[1:] == pytest.approx(np.ones(place.max()))
    assert np.bincount(place[:-1])[1 : lm_score.OWN + 1].max() == 1


def test_windows_cover_every_text_once():
    rng = np.random.default_rng(9)
    texts = [np.append(rng.integers(1, 900, n), 0) for n in (0, 1, 5, 23, 24, 31, 32, 33, 200, 2000)]
    x, offsets = np.concatenate(texts).astype(np.int32), np.cumsum([0, *map(len, texts)])
    windows = np.concatenate(list(lm_score.windows_of(x, offsets))).astype(np.int64)
    target = windows[:, 1:].ravel()
    assert target[target != lm_score.PAD].tolist() == x.tolist()
    one = np.concatenate(list(lm_score.windows_of(x[offsets[8] : offsets[9]], np.array([0, 201])))).astype(np.int64)
    assert any((windows[i : i + len(one)] == one).all() for i in range(len(windows) - len(one) + 1))


def test_short_texts_in_many_partitions_train_the_attention(spark, monkeypatch):
    rows = [(f"light house {i % 7} under the river of stone",) for i in range(60)]
    texts = spark.createDataFrame(rows, "text string").repartition(20)
    place = np.ones(lm_score.subwords(open(lm_score.VOCABULARY, "rb").read()).size + 1, np.int32)
    place[:3000] = np.arange(3000) % 40 + 2
    place[-1] = 0
    gathered = lm_score.gather(texts, place, open(lm_score.VOCABULARY, "rb").read())
    start = lm_score.Model(lm_score.neighbour_counts(gathered, 42)).weights
    assert {r.r for r in gathered.where("kind = 1").collect()} == {0, 1}
    whole = lm_score.neighbour_counts(gathered, 42)
    monkeypatch.setattr(lm_score, "MERGED", 3)  # 20 partitions in three turns
    assert (lm_score.neighbour_counts(gathered, 42) == whole).all() and whole.sum() > 400
    after = lm_score.fit(gathered, 42).weights
    assert all((start[k] != after[k]).any() for k in ("query", "key", "value", "out"))


def test_co_training_goes_through_all_documents_without_labels(spark, monkeypatch):
    order = [r.doc_id for r in documents(spark).orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id").collect()]
    docs = documents(spark).withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.concat(F.repeat(F.lit("BUY NOW!! "), 40), F.substring("text", 1, 50))))
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in order[:100]], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(quality, "POOL_ROWS", 100, raising=False)  # as before, when the labelled ones were all of the pool
    fitted = []

    class Seen(quality.Logistic):
        def __init__(self, x, y, *more, **named):
            super().__init__(x, y, *more, **named)
            fitted.append(len(y))

    monkeypatch.setattr(quality, "Logistic", Seen)
    quality.fit(docs, labels)
    assert max(fitted) > 100


def test_surest_documents_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quality, "PER_ROUND", 7)
    rng = np.random.default_rng(3)
    a, b = rng.standard_normal((300, 4)).astype(np.float32), rng.standard_normal((300, 3)).astype(np.float32)
    y = (rng.random(300) < 0.5).astype(float)
    models = [quality.Logistic(v + y[:, None].astype(np.float32), y) for v in (a, b)]
    for m in models:
        m.w *= 5
    pool = spark.createDataFrame([(i, a[i].tobytes(), b[i].tobytes()) for i in range(300)], "key long, a binary, b binary").repartition(5)
    taken = [np.arange(0, 300, 3), np.arange(0, 300, 4)]
    edge = math.log(quality.SURE / (1 - quality.SURE))
    for pupil, (keys, x, side) in enumerate(quality.surest(pool, models, taken)):
        odds = models[1 - pupil].odds((a, b)[1 - pupil])
        want = set()
        for s, sign in ((1.0, 1), (0.0, -1)):
            some = [i for i in range(300) if sign * odds[i] >= edge and i not in taken[pupil]]
            assert len(some) > 7
            want |= {(i, s) for i in sorted(some, key=lambda i: (-abs(odds[i]), i))[:7]}
        assert set(zip(keys.tolist(), side.tolist(), strict=True)) == want
        assert (x == (a, b)[pupil][keys]).all()


def test_units_of_any_length_are_summed_whole(monkeypatch):
    from pathlib import Path

    pieces = language_id.vocabulary(Path(language_id.MODEL).read_bytes())
    rng = np.random.default_rng(15)
    p = rng.random((len(pieces.pieces), 2))
    lengths = np.array([len(x) for x in pieces.pieces])
    table = language_id.scaled(pieces, p * 1e3, 0.1)
    words = [b" " + bytes(rng.choice(list(b"internationalthe"), 63).astype(np.uint8)), b" " + bytes(rng.choice(list(b"abcdeinothe   "), 400).astype(np.uint8)), b" the", b" " + b"x" * 1500]
    raw, size = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
    many = np.array([[2.0, 1], [1, 3], [5, 1], [1, 1]])
    monkeypatch.setattr(language_id, "POSITIONS", 37)
    results = []
    for short in (0, 2000):
        monkeypatch.setattr(language_id, "SHORT", short)
        results.append(language_id.sums(pieces, table, raw, np.cumsum(size) - size, size, many))
    assert results[0][0] == pytest.approx(results[1][0], rel=1e-9)
    assert results[0][1] == pytest.approx(results[1][1], rel=1e-6, abs=1e-9)
    assert (results[0][1] * lengths[:, None]).sum(0) == pytest.approx((size[:, None] * many).sum(0))
    assert max(lengths) > 16  # all of the vocabulary


def test_sums_of_unlikely_units_stay_finite():
    from pathlib import Path

    pieces = language_id.vocabulary(Path(language_id.MODEL).read_bytes())
    rng = np.random.default_rng(12)
    lengths = np.array([len(x) for x in pieces.pieces])
    p = rng.random((len(pieces.pieces), 3)) * np.array([1e-9, 1e-3, 1.0])
    p[lengths > 1, 0] *= 1e-9
    words = [bytes(rng.integers(128, 256, 64).astype(np.uint8)), b" " + b"q" * 63, b" internationalisation of everything in one unit of many letter", b" the"]
    size = np.array([len(w) for w in words])
    table = p * language_id.SCALE ** lengths.astype(float)[:, None]
    logs, expected = language_id.sums(pieces, table, np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size, np.ones((len(words), 3)))
    number = {x: i for i, x in enumerate(pieces.pieces)}
    for w, got in zip(words, logs, strict=True):
        for k in range(3):
            best = [0.0] + [-math.inf] * len(w)
            for b in range(1, len(w) + 1):
                terms = [best[b - n] + math.log(p[number[w[b - n : b]], k]) for n in range(1, min(b, int(lengths.max())) + 1) if w[b - n : b] in number]
                best[b] = max(terms) + math.log(sum(math.exp(x - max(terms)) for x in terms))
            assert got[k] == pytest.approx(best[-1], rel=1e-9)
    assert np.isfinite(expected).all()
    assert (expected * lengths[:, None]).sum(0) == pytest.approx([size.sum()] * 3)



def test_copies_of_a_long_text_edited_at_one_place_each_are_linked():
    """Each part from the others at a place of their own, one after another: a trie deeper than Python's stack."""
    sets = [np.delete(np.arange(3000), 2 * i) for i in range(1500)]
    n = len(sets)
    found = ngram_join.linked_sets(sets, np.full(n, 2999), np.full(n, 2), np.arange(n), 85)
    assert len(found) == n - 1 and len({x for pair in found for x in pair}) == n
