"""The label model against all configurations, and what it learns."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import queries, toxicity as T


def drawn(rng, n, prior=0.3):
    """Votes of a known model: five voters, the second copies the first, the last two depend on each other."""
    y = rng.random(n) < prior
    pick = lambda p: np.where(rng.random(n) < p, 1, np.where(rng.random(n) < 0.7, -1, 0))
    one = pick(np.where(y, 0.8, 0.1))
    two = np.where(rng.random(n) < 0.95, one, pick(np.where(y, 0.5, 0.5)))
    three, four = pick(np.where(y, 0.7, 0.05)), pick(np.where(y, 0.6, 0.1))
    five = np.where(rng.random(n) < 0.8, four, pick(np.where(y, 0.6, 0.2)))
    return y, np.column_stack((one, two, three, four, five))


def brute_posterior(model: T.LabelModel, row) -> float:
    """Bayes' rule over the tree's joint distribution, voter by voter."""
    joint = []
    for c, p in enumerate((1 - model.prior, model.prior)):
        for i, v in enumerate(row):
            above = row[model.parent[i]] + 1 if model.parent[i] >= 0 else 0
            p *= model.chance[c][i][above][v + 1]
        joint.append(p)
    return joint[1] / sum(joint)


def test_posterior_equals_bayes_rule_and_chances_sum_to_one():
    rng = np.random.default_rng(3)
    y, votes = drawn(rng, 3000)
    model = T.fit_label_model(votes, np.where(votes.sum(1) > 0, 0.6, 0.1), np.ones(3000), 0.3)
    assert np.allclose(model.chance.sum(3), 1) and (model.parent == -1).sum() == 1
    every = np.array(list(itertools.product((-1, 0, 1), repeat=5)))
    assert model.posterior(every) == pytest.approx([brute_posterior(model, row) for row in every], abs=1e-9)
    # the joint distribution of all votes and classes sums to one
    total = 0.0
    for row in every:
        for c, p in enumerate((0.7, 0.3)):
            for i, v in enumerate(row):
                p *= model.chance[c][i][row[model.parent[i]] + 1 if model.parent[i] >= 0 else 0][v + 1]
            total += p
    assert total == pytest.approx(1)


def test_dependent_voters_are_joined_and_count_once():
    rng = np.random.default_rng(5)
    y, votes = drawn(rng, 6000)
    model = T.fit_label_model(votes, np.where(votes.sum(1) > 0, 0.6, 0.1), np.ones(6000), 0.3)
    joined = {frozenset((i, int(p))) for i, p in enumerate(model.parent) if p >= 0}
    assert frozenset((0, 1)) in joined and frozenset((3, 4)) in joined
    post = model.posterior(votes)
    assert ((post > 0.5) == y).mean() > 0.85
    assert abs(post.mean() - 0.3) < 0.08
    # copies of one voter say hardly more than it does (chances are smoothed)
    copies = np.column_stack([votes[:, 2]] * 4 + [votes[:, 0], votes[:, 3]])
    apart = T.fit_label_model(copies[:, 3:], np.where(votes.sum(1) > 0, 0.6, 0.1), np.ones(6000), 0.3).posterior(copies[:, 3:])
    together = T.fit_label_model(copies, np.where(votes.sum(1) > 0, 0.6, 0.1), np.ones(6000), 0.3).posterior(copies)
    assert np.abs(apart - together).mean() < 0.06


def test_few_rows_and_voters_that_never_vote():
    for votes in (np.zeros((4, 3), int), np.array([[1]]), np.array([[1, -1, 0], [-1, -1, 0]])):
        post = T.fit_label_model(votes, np.full(len(votes), 0.3), np.ones(len(votes)), 0.2).posterior(votes)
        assert np.isfinite(post).all() and ((post >= 0) & (post <= 1)).all()


def test_repeated_rows_null_ids_and_no_labels(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a vile blorg here", "nice day", None, "", "blorg blorg"] * 8)] + [(None, "blorg"), (3, "again"), (3, "again")], "doc_id long, text string")
    labels = docs.filter("doc_id IS NOT NULL").select("doc_id", F.coalesce(F.col("text").contains("blorg"), F.lit(False)).cast("int").alias("label"))
    model = T.fit_toxicity(docs, labels)
    got = T.score_toxicity(docs, model, ["doc_id", "text"]).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert min(r.score for r in got if "blorg" in (r.text or "")) > max(r.score for r in got if "blorg" not in (r.text or ""))
    none = T.fit_toxicity(docs, labels.limit(0))
    assert all(0 <= r.score <= 1 for r in T.score_toxicity(docs, none, ["doc_id"]).collect())
    assert T.score_toxicity(docs.limit(0), model, ["doc_id"]).collect() == []


def test_held_out_precision_and_recall(spark):
    sf = "/root/testdata/sf0.01"
    marks = spark.read.parquet(f"{sf}/labels.parquet").filter("toxic IS NOT NULL")
    got = queries.op8_toxicity(spark, sf).join(marks, "doc_id").filter("held_out").collect()
    hits = sum(r.predicted and r.toxic for r in got)
    assert hits >= 0.7 * sum(r.toxic for r in got) and hits >= 0.8 * sum(r.predicted for r in got)
