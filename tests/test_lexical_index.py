"""Search over stored blocks against scoring every text; what searches report; a batch of queries at once."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import search
from ledgerlight.sources import lexical_index as L

FIELDS = {"title": 6.0, "body": 1.5}


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(r.choices(words[:20], k=r.randint(0, 4))), " ".join(r.choices(words, weights=range(60, 0, -1), k=r.choice([0, 1, 3, 12, 60, 300])))) for i in range(400)]
    rows += [(400, None, None), (401, "W1 w1, w1!", None), (402, "", "é w2 rare")]
    return spark.createDataFrame(rows, "id long, title string, body string")


@pytest.fixture(scope="module")
def index(texts, tmp_path_factory):
    return L.build_index(texts, FIELDS, f"file://{tmp_path_factory.mktemp('index')}/i")


def best(scores, k):
    return [(r["id"], pytest.approx(r["score"], abs=1e-9)) for r in scores.orderBy(F.col("score").desc(), "id").limit(k).collect()]


@pytest.mark.parametrize("terms", [["w1"], ["w3", "w50", "w59"], ["rare", "w0"], ["w0", "w1", "w2", "w3", "w4", "w5"], ["absent"]])
def test_pruned_search_equals_scoring_everything(texts, index, terms):
    want = best(search.bm25(texts, FIELDS, terms), 7)
    assert best(L.bm25_candidates(index, terms, 7), 7) == want
    allowed = texts.where("id % 3 = 0").select("id")
    assert best(L.bm25_candidates(index, terms, 7, allowed), 7) == best(search.bm25(texts, FIELDS, terms).join(allowed, "id", "left_semi"), 7)


def test_places_that_cannot_reach_the_best_are_left_out(texts, index):
    assert L.bm25_candidates(index, ["w59", "w3"], 3).count() < search.bm25(texts, FIELDS, ["w59", "w3"]).count()


def test_tfidf_and_a_batch_of_queries(texts, index):
    rows = [r.asDict() for r in texts.collect()]
    held = {r["id"]: {t: sum(w for c, w in FIELDS.items() if t in re.findall("[a-z0-9]+", (r[c] or "").lower())) for t in set(re.findall("[a-z0-9]+", f"{r['title']} {r['body']}".lower()))} for r in rows}
    df = {}
    for p in held.values():
        for t, w in p.items():
            df[t] = df.get(t, 0) + w
    score = lambda p, terms: sum(p[t] * (math.log((len(rows) + 1) / (math.floor(df[t]) + 1)) + 1) for t in terms if t in p and p[t])
    asked = {"a": ["w1", "w40"], "b": ["rare"], "c": ["absent"], "d": ["w1", "w2", "w3"]}
    want = {(q, i): s for q, terms in asked.items() for i, p in held.items() if (s := score(p, terms))}
    pairs = texts.sparkSession.createDataFrame([(q, t) for q, terms in asked.items() for t in terms], "query string, term string")
    got = {(r["query"], r["id"]): r["score"] for r in L.batch_scores(index, pairs).collect()}
    assert got == pytest.approx(want)
    assert {r["id"]: r["score"] for r in L.tfidf_scores(index, asked["d"]).collect()} == pytest.approx({i: s for (q, i), s in want.items() if q == "d"})


def test_outcomes(texts, index, tmp_path):
    def said(*args, at=index, **more):
        hits, outcome = L.lexical_search(at, *args, **more)
        return hits.count(), tuple(outcome.first())

    n = texts.where("concat_ws(' ', title, body) rlike '(^| )w1($| )' or id = 401").count()
    assert said([], 5) == (0, ("empty_query", 0, "exact", 0))
    assert said(["w1", "w1"], 5) == (5, ("completed", 6, "lower_bound", 5))
    assert said(["rare"], 5) == (1, ("completed", 1, "exact", 1)) and said(["absent"], 5) == (0, ("completed", 0, "exact", 0))
    assert said(["w1"], 5, mode="fallback") == (5, ("fallback_completed", n, "exact", n))
    assert said(["w1"], 5, mode="fallback", work_limit=n - 1) == (0, ("work_limit_exceeded", n, "lower_bound", n - 1))
    plain = L.build_index(texts, FIELDS, f"file://{tmp_path}/plain", full_text=False)
    assert said(["w1"], 5, at=plain) == (5, ("full_text_unavailable", n, "exact", n))
    assert said(["w1"], 5, at=plain, mode="full_text") == (0, ("full_text_unavailable", 0, "lower_bound", 0))
    assert best(L.lexical_search(plain, ["w1"], 5)[0], 5) == best(L.lexical_search(index, ["w1"], 5, "fallback")[0], 5)
    with pytest.raises(ValueError):
        L.lexical_search(index, ["w1"], 5, "other")


def test_empty_texts(spark, tmp_path):
    index = L.build_index(spark.createDataFrame([], "id long, title string, body string"), FIELDS, f"file://{tmp_path}/e")
    assert L.bm25_candidates(index, ["w1"], 3).count() == 0 and L.tfidf_scores(index, ["w1"]).count() == 0


def test_an_index_of_some_words_scores_them_alike_and_holds_no_others(spark, texts, index, tmp_path):
    words = ["w1", "w30", "absent"]
    some = L.build_index(texts, FIELDS, f"file://{tmp_path}/some", words=words)
    assert {r["term"] for r in some.blocks.select("term").distinct().collect()} == {"w1", "w30"}
    assert some.totals.first() == index.totals.first()
    for scores in (lambda i: L.bm25_candidates(i, words, 1000), lambda i: L.tfidf_scores(i, words)):
        assert {r["id"]: pytest.approx(r["score"], abs=1e-9) for r in scores(index).collect()} == {r["id"]: r["score"] for r in scores(some).collect()}
