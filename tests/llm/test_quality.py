import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keelson.llm import quality, queries


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    hit = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 3)}
    lines, dup, seen = (text or "").split("\n"), 0, set()
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


@settings(max_examples=200, deadline=None)
@given(st.text("ab \n\t#|é\u00a0", max_size=60))
def test_counts(text):
    assert quality.text_counts(text.encode(), len(text))[:5] == brute(text)


def test_odd_rows_and_columns(spark, tables, odd_docs):
    folder = tables(documents=(odd_docs, "doc_id long, text string"))
    rows = queries.op1_quality_rules(spark, folder).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, *brute(t)) for r, t in [(r, dict_text(odd_docs, r)) for r in rows]) == sorted((d is None, d or 0, *brute(t)) for d, t in odd_docs)
    assert all(r.base_failed and not r.kept for r in rows if r.n_words < 50)
    clash = spark.createDataFrame([(1, "x y", 5, True)], "doc_id long, text string, N_WORDS int, kept boolean")
    out = quality.with_counts(clash)
    assert out.first()["n_words_2"] == 2 and out.first()["N_WORDS"] == 5
    empty = queries.op1_quality_rules(spark, tables(documents=([], "doc_id long, text string")))
    assert empty.collect() == []


def dict_text(docs, row):
    return next(t for d, t in docs if d == row.doc_id and len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) == row.n_words)


def test_model_weighs_rules_by_their_errors():
    rng = np.random.default_rng(3)
    good = rng.random(4000) < 0.85
    votes = np.where(good[:, None], np.where(rng.random((4000, 3)) < 0.98, 1, -1), np.where(rng.random((4000, 3)) < 0.7, -1, 1))
    noisy = np.where(rng.random((4000, 1)) < 0.5, 1, -1)
    patterns, counts = np.unique(np.hstack([votes, noisy, np.zeros((4000, 1), int)]), axis=0, return_counts=True)
    model = quality.fit_label_model(patterns, counts)
    yes, no = model.log_odds(3)
    assert abs(no) < 2.5 < abs(model.log_odds(0)[1])
    assert 0.7 < model.prior_good < 0.97
    assert quality.fit_label_model(np.zeros((0, 5)), np.zeros(0)).prior_good == pytest.approx(0.8)


def documents_em(votes):
    """The same estimation, document by document."""
    n, rules = len(votes), len(votes[0])
    good = [quality.START[min(2, sum(x == -1 for x in v))] for v in votes]
    for _ in range(400):
        prior = (sum(good) + quality.PSEUDO_DOCS * quality.SHARE_MEAN) / (n + quality.PSEUDO_DOCS)
        right = []
        for r in range(rules):
            yes, no = [g for g, v in zip(good, votes, strict=True) if v[r] == 1], [g for g, v in zip(good, votes, strict=True) if v[r] == -1]
            if_good = (sum(yes) + quality.PSEUDO_VOTES * quality.GOOD_MEAN) / (sum(yes) + sum(no) + quality.PSEUDO_VOTES)
            bad_yes, bad_no = len(yes) - sum(yes), len(no) - sum(no)
            right.append((if_good, (bad_no + quality.PSEUDO_VOTES * quality.BAD_MEAN) / (bad_yes + bad_no + quality.PSEUDO_VOTES)))
        good = []
        for v in votes:
            odds = prior / (1 - prior)
            for x, (g, b) in zip(v, right, strict=True):
                odds *= g / (1 - b) if x == 1 else (1 - g) / b if x == -1 else 1
            good.append(odds / (1 + odds))
    return prior, right, good


def test_estimates_are_those_of_single_documents():
    rng = np.random.default_rng(8)
    truth = rng.random(300) < 0.7
    votes = np.where(rng.random((300, 5)) < [0.95, 0.8, 0.7, 0.9, 0.6], np.where(truth[:, None], 1, -1), np.where(truth[:, None], -1, 1))
    votes[rng.random((300, 5)) < 0.3] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit_label_model(patterns, counts, rounds=400, tolerance=0)
    prior, right, good = documents_em(votes.tolist())
    assert model.prior_good == pytest.approx(prior, abs=1e-6)
    assert np.allclose(model.right_if_good, [g for g, _ in right], atol=1e-6) and np.allclose(model.right_if_bad, [b for _, b in right], atol=1e-6)
    odds = [np.log(model.prior_good / (1 - model.prior_good)) + sum(model.log_odds(r)[0] if x == 1 else model.log_odds(r)[1] if x == -1 else 0 for r, x in enumerate(v)) for v in votes]
    assert np.allclose(1 / (1 + np.exp(-np.array(odds))), good, atol=1e-6)


@pytest.mark.parametrize("n", [1000, 100_000])
def test_rules_that_are_always_right_are_found_so(n):
    bad = n // 5
    model = quality.fit_label_model(np.array([[1] * 4, [-1] * 4]), np.array([n - bad, bad]))
    assert min(model.right_if_good + model.right_if_bad) > 0.95 and model.prior_good == pytest.approx(0.8, abs=0.01)


def test_posteriors_of_the_query(spark, data):
    """Every posterior from the counts of all documents, without Spark's model code."""
    rows = quality.with_counts(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text"))
    names = quality.added_columns(["doc_id", "text"])
    votes = {r["doc_id"]: tuple(r[f"v{i}"] for i in range(10)) for r in rows.select("doc_id", *(v.alias(f"v{i}") for i, v in enumerate(quality.rule_votes(names).values()))).collect()}
    _, _, good = documents_em(list(votes.values()))
    want = dict(zip(votes, good, strict=True))
    for r in queries.op1_quality_rules(spark, data).collect():
        assert r.posterior == pytest.approx(want[r.doc_id], abs=1e-4) and r.kept == (not r.base_failed and r.posterior >= 0.5)


def test_agrees_with_labels(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    found = queries.op1_quality_rules(spark, data).join(labels, "doc_id").where(~F.col("base_failed"))
    right = found.where((F.col("quality") == 1) == F.col("kept")).count()
    assert right >= 0.93 * found.count() and docs.count() > 0
