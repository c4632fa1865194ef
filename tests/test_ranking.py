from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from larkspur.operators import hybrid, paging, tfidf, vectors

SCHEMA = "id long, title string, text string, preprocessed_text string, url string, score int"


def stories(spark, texts):
    return spark.createDataFrame([(i, "t", "x", t, "", 1) for i, t in enumerate(texts)], SCHEMA)


def model(texts, query):
    docs = [Counter(w for w in (t or "").split() if len(w) > 1) for t in texts]
    df = Counter(w for d in docs for w in d)
    idf = {w: math.log((1 + len(texts)) / (1 + n)) + 1 for w, n in df.items()}

    def unit(counts):
        raw = {w: n * idf[w] for w, n in counts.items() if w in idf}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        return {w: v / norm for w, v in raw.items()} if norm else {}

    q = unit(Counter(w for w in query.split() if len(w) > 1))
    return [sum(q.get(w, 0) * v for w, v in unit(d).items()) for d in docs]


def test_three_documents_by_hand(spark):
    index = tfidf.TfIdfIndex(stories(spark, ["cat dog", "cat", ""]))
    idf = {r.term: r.idf for r in index.terms.collect()}
    assert idf["cat"] == pytest.approx(math.log(4 / 3) + 1)
    assert idf["dog"] == pytest.approx(math.log(4 / 2) + 1)
    scores = {r.id: r.score for r in index.scores("cat").collect()}
    assert scores[1] == pytest.approx(1)
    assert scores[0] == pytest.approx(idf["cat"] / math.hypot(idf["cat"], idf["dog"]))
    assert scores[2] == 0


def test_scores_match_model_and_zero_scores_fill_the_quota(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["aa", "bb", "cc", "dd", "e", "ff"], k=rng.randrange(8))) for _ in range(60)] + [None]
    index = tfidf.TfIdfIndex(stories(spark, texts))
    for query in ("aa bb", "cc cc e", "zz", ""):
        want = model(texts, query)
        got = {r.id: r.score for r in index.scores(query).collect()}
        assert got == pytest.approx(dict(enumerate(want)), abs=1e-9)
        top = [r.id for r in index.top(query, 15).collect()]
        assert top == sorted(range(len(texts)), key=lambda i: (-round(want[i], 10), -i))[:15]


def test_empty_corpus(spark):
    index = tfidf.TfIdfIndex(stories(spark, []))
    assert index.top("aa", 5).collect() == []
    assert index.weights().count() == 0


def test_corpus_keeps_one_of_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "a", "a", None, None, None)] * 3 + [(None, "b", "b", "b", "b", 1)], SCHEMA)
    assert tfidf.corpus(rows).collect() == [(1, "a", "a", None, None, None)]


def test_dense_scores(spark):
    rows = [(1, [1.0, 0.0]), (2, [3.0, 3.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0]), (None, [1.0, 1.0]), (2, [3.0, 3.0])]
    usable = vectors.usable(spark.createDataFrame(rows, "id long, embedding array<float>"))
    got = {r.id: r.score for r in vectors.scores(usable, [0.0, 2.0]).collect()}
    assert got == pytest.approx({1: 0, 2: math.sqrt(0.5), 3: 0, 5: 0}, abs=1e-9)
    assert [r.id for r in vectors.top(usable, [0.0, 2.0], 2).collect()] == [2, 5]


def test_embedder_fills_vectors(spark):
    rows = spark.createDataFrame([(1, "alpha beta gamma"), (2, None)], "id long, text string")
    got = {r.id: np.array(r.embedding) for r in vectors.embed(rows, vectors.HashingEmbedder(16)).collect()}
    assert got[2].tolist() == [0] * 16 and np.abs(got[1]).sum() > 0


def fused_model(sparse, dense, k):
    found = {}
    for name, top in (("t", sparse), ("v", dense)):
        for i, s in top:
            found.setdefault(i, {"t": 0.0, "v": 0.0})[name] = s
    final = {i: round(0.4 * s["t"] + 0.6 * s["v"], 10) for i, s in found.items()}
    return sorted(final, key=lambda i: -final[i])[:k]


@pytest.mark.parametrize("seed", range(4))
def test_fusion_with_ties(spark, seed):
    rng = random.Random(seed)
    tops = []
    for _ in range(2):
        scores = [(i, rng.choice([0.0, 0.25, 0.5])) for i in rng.sample(range(60), 40)]
        tops.append(sorted(scores, key=lambda x: (-x[1], -x[0]))[: hybrid.CANDIDATES])
    frames = [spark.createDataFrame(t, "id long, score double") for t in tops]
    got = hybrid.top(hybrid.fuse(hybrid.candidates(*frames)), 40).orderBy("place").collect()
    assert [r.id for r in got] == fused_model(*tops, 40)


def test_pages(spark):
    ranked = spark.createDataFrame([(i, 1.0, i) for i in range(1, 13)], "id long, final_score double, place int")
    assert [r.place for r in paging.page_rows(ranked, 3, 5).orderBy("place").collect()] == [11, 12]
    assert paging.page_rows(ranked, 9, 5).collect() == []
    assert paging.page_meta(ranked, 1, 5).first() == (1, 5, 5, 1)
    assert paging.page_meta(ranked, 2, 5).first() == (2, 5, 10, 2)
    assert paging.page_meta(ranked, 3, 5).first() == (3, 5, 12, 3)
    assert paging.page_buttons(paging.page_meta(ranked, 1, 5)).collect() == []
    assert paging.page_buttons(paging.page_meta(ranked, 2, 5)).collect() == [(1, False), (2, True)]
    for page, size in ((0, 5), (1, 0), (-1, 5)):
        with pytest.raises(ValueError):
            paging.page_rows(ranked, page, size)


def test_cards(spark):
    rows = spark.createDataFrame(
        [(1, 1, "t", "x" * 161, "u", 0.12345), (2, 2, None, "x" * 160, None, 0.0), (3, 3, "t", None, "", None)],
        "place int, id long, title string, text string, url string, final_score double",
    )
    got = {r.place: r for r in paging.result_cards(rows).collect()}
    assert got[1].snippet == "x" * 160 + "..." and got[1].score_label == "12.3"
    assert got[2].snippet == "x" * 160 and got[2].score_label is None
    assert got[3].snippet is None and got[3].score_label is None
