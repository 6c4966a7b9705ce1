"""Toxicity by weak supervision: lexicon and pattern voters, a label model, a linear classifier.

1. Lexicons are mined from labelled documents: words and word beginnings that
   occur far more often in toxic ones. A labelled document is voted on by a lexicon of
   the other folds' documents only (cross-fitting).
2. Voters look at a document's lexicon hits and at patterns, and vote toxic, not
   toxic, or abstain.
3. A generative label model (``LabelModel``) estimates, by expectation maximisation over
   labelled and other documents, how each voter votes for either class and which
   voters depend on each other: given the class, every voter's vote depends on one other's, along
   the tree of greatest conditional mutual information. Given labels start it and are then no evidence.
4. A linear classifier learns the posterior labels from lexicon hits and patterns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .session import bounded_sample, cut, ready

#: Documents of each label, and without one, that a fit uses at most (on average; see bounded_sample).
FIT_DOCS = 3000
#: Parts of the labelled sample; each is voted on by a lexicon of the others.
FOLDS = 8
#: Lengths of word beginnings in bytes; 0 is the whole word.
LENGTHS = (0, 5, 6, 7, 8)
PATTERNS = 6
_PLAIN = K.LOWER.copy()
_PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = 32


def _lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes in which all ASCII marks are spaces, and offsets."""
    raw, offs = K.buffer_of(pa.array([(t or "").lower() for t in texts.to_pylist()], pa.large_string()))
    return _PLAIN[raw], offs


def _terms(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each kind of term: its length, the words that have one, and the hashes."""
    for kind, size in enumerate(LENGTHS):
        own = np.arange(len(starts)) if not size else np.flatnonzero(ends - starts > size)
        stop = ends[own] if not size else starts[own] + size
        yield kind, own, K.mix(K.span_hash(raw, starts[own], stop) + K.U64(kind))


def _mined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text) to documents with each term, by class."""
    for batch in batches:
        raw, offs = _lowered(batch.column(1))
        labels = batch.column(0).to_numpy(zero_copy_only=False)
        starts, ends, counts = K.words(raw, offs)
        row = np.repeat(np.arange(len(counts)), counts)
        for kind, own, h in _terms(raw, starts, ends):
            pairs = np.unique(np.rec.fromarrays((h, row[own])))
            terms, at = np.unique(pairs["f0"], return_inverse=True)
            toxic = np.bincount(at, labels[pairs["f1"]] == 1, len(terms)).astype(np.int64)
            total = np.bincount(at, minlength=len(terms))
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(np.full(len(terms), kind, np.int32)), pa.array(toxic), pa.array(total - toxic)], ["term", "kind", "toxic", "clean"])


@dataclass
class Lexicon:
    """Sorted term hashes with their kinds and ranks (0: the strongest)."""

    terms: np.ndarray
    kinds: np.ndarray
    ranks: np.ndarray

    def __post_init__(self) -> None:
        self.screen = np.zeros(1 << 20, bool)
        self.screen[(self.terms & K.U64((1 << 20) - 1)).astype(np.int64)] = True

    def hits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, word) of every hit, and the patterns of each row."""
        raw, offs = _lowered(texts)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        stats = np.zeros((len(offs) - 1, PATTERNS))
        original, at = K.buffer_of(texts)
        solid = np.maximum(1, np.diff(at))
        count = lambda mask: np.add.reduceat(np.append(mask, 0).astype(np.int64), np.minimum(at[:-1], len(mask))) * (np.diff(at) > 0)
        if len(original):
            stats[:, 0] = np.minimum(1, 20 * count(original == ord("!")) / solid)
            upper = count((original >= 65) & (original <= 90))
            stats[:, 1] = upper / np.maximum(1, upper + count((original >= 97) & (original <= 122)))
            stats[:, 2] = np.minimum(1, 5 * count(np.isin(original, np.frombuffer(b"#$%&*@", np.uint8))) / solid)
            stats[:, 3] = np.minimum(1, 20 * count(original == ord("?")) / solid)
        for i, j in K.slices(offs):
            part, o = raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            starts, ends, counts = K.words(part, o)
            stats[i:j, 4] = np.log1p(counts)
            row = np.repeat(np.arange(i, j), counts)
            first = np.cumsum(counts) - counts
            for _, own, h in _terms(part, starts, ends):
                ok = np.flatnonzero(self.screen[(h & K.U64((1 << 20) - 1)).astype(np.int64)])
                place = np.minimum(np.searchsorted(self.terms, h[ok]), max(0, len(self.terms) - 1))
                ok, place = (ok[same], place[same]) if len(self.terms) and (same := self.terms[place] == h[ok]).any() else (ok[:0], place[:0])
                word = own[ok]
                found.append((row[word], place, word - first[row[word] - i]))
        stats[:, 5] = 1
        rows, terms, words = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        return rows, terms, words, stats


def mine_lexicon(labelled: DataFrame, prior: float) -> Lexicon:
    """Terms of ``labelled(label, text)`` in two toxic documents or more whose documents are mostly toxic at the given share of toxic documents.

    The sample is bounded by its documents (FIT_DOCS), and so are its terms; none is cut off.
    """
    sizes = {r[0]: r[1] for r in labelled.groupBy("label").count().collect()}
    n1, n0 = max(1, sizes.get(1, 0)), max(1, sizes.get(0, 0))
    counts = labelled.select("label", "text").mapInArrow(_mined, "term long, kind int, toxic long, clean long").groupBy("term", "kind").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    up, down = F.col("t") / n1 * prior, (F.col("c") + 0.7) / n0 * (1 - prior)
    best = counts.filter("t >= 2").withColumn("p", up / (up + down)).filter("p >= 0.8").orderBy(F.desc(F.col("t") * (F.col("p") - 0.5)), "term").collect()
    terms = np.array([r["term"] for r in best], np.int64).view(np.uint64)
    kinds = np.array([r["kind"] for r in best], np.int64)
    order = np.argsort(terms)
    return Lexicon(terms[order], kinds[order], np.arange(len(terms))[order])


def _summary(lexicon: Lexicon, rows: np.ndarray, terms: np.ndarray, words: np.ndarray, stats: np.ndarray) -> np.ndarray:
    """Numbers on each row: distinct terms, words hit, their share, and words hit by kind."""
    n = len(stats)
    out = np.zeros((n, 6 + 2 * len(LENGTHS)))
    total = np.expm1(stats[:, 4]) + 50
    if len(rows):
        pairs = np.unique(rows * (len(lexicon.terms) + 1) + terms)
        distinct = np.bincount(pairs // (len(lexicon.terms) + 1), minlength=n)
        hit = np.unique(np.rec.fromarrays((rows, words)))
        n_hit = np.bincount(hit["f0"], minlength=n)
        out[:, 0], out[:, 1] = np.log1p(distinct), np.log1p(n_hit)
        out[:, 2] = np.minimum(1, 10 * n_hit / np.maximum(1, np.expm1(stats[:, 4])))
        out[:, 3], out[:, 4] = n_hit >= 2, n_hit >= 3
        out[:, 5 + len(LENGTHS)] = np.log1p(500 * n_hit / total)
        for kind in range(len(LENGTHS)):
            own = pairs[lexicon.kinds[pairs % (len(lexicon.terms) + 1)] == kind] // (len(lexicon.terms) + 1)
            out[:, 5 + kind] = np.log1p(k := np.bincount(own, minlength=n))
            out[:, 6 + len(LENGTHS) + kind] = np.log1p(500 * k / total)
    return out


#: Votes of a document (see ``voters``).
N_VOTERS = 8 + (len(LENGTHS) - 1) + 4 + 2 + 3


def voters(lexicon: Lexicon, rows: np.ndarray, terms: np.ndarray, words: np.ndarray, stats: np.ndarray) -> np.ndarray:
    """Votes of each document: 1 toxic, -1 not, 0 abstains."""
    n, groups = len(stats), 8
    s = _summary(lexicon, rows, terms, words, stats)
    hit_words, share = np.expm1(s[:, 1]), s[:, 2]
    out = [np.bincount(rows[(lexicon.ranks[terms] % groups == g) & (lexicon.kinds[terms] == 0)], minlength=n) > 0 for g in range(groups)]
    votes = [x.astype(int) for x in out]
    for kind in range(1, len(LENGTHS)):
        k = np.expm1(s[:, 5 + kind])
        votes.append(np.where(k >= 2, 1, np.where(k == 0, -1, 0)))
    votes += [np.where(hit_words >= a, 1, np.where(hit_words == 0, -1, 0)) for a in (1, 2, 3, 5)]
    votes += [np.where(share >= a, 1, np.where(share == 0, -1, 0)) for a in (0.05, 0.2)]
    votes += [np.where((stats[:, 0] > 0.3) & (hit_words > 0), 1, 0), np.where((stats[:, 1] > 0.6) & (hit_words > 0), 1, 0), np.where((stats[:, 2] < 0.05) & (hit_words == 0), -1, 0)]
    return np.column_stack(votes)


@dataclass
class LabelModel:
    """P(class) and, along a tree of voters, P(vote | parent's vote, class); votes are numbered 0, 1, 2 for -1, 0, 1."""

    prior: float
    parent: np.ndarray  # of each voter; -1 at the root
    chance: np.ndarray  # class x voter x parent's vote x vote

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Chance to be toxic of each row of votes."""
        v = votes + 1
        above = np.where(self.parent >= 0, v[:, self.parent], 0)
        logs = np.log(self.chance[:, np.arange(v.shape[1]), above, v]).sum(2)
        odds = np.log(self.prior / (1 - self.prior)) + logs[1] - logs[0]
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _tree(joint: np.ndarray) -> np.ndarray:
    """Parents of the voters in the spanning tree of greatest mutual information given the class; joint[class, i, a, j, b] sums to 1."""
    m = joint.shape[1]
    one = np.stack([[np.diag(joint[c, i, :, i, :]) for i in range(m)] for c in range(2)])
    share = one.sum((1, 2))[:, None, None, None, None] / m
    ratio = joint * share / (one[:, :, :, None, None] * one[:, None, None, :, :])
    info = (joint * np.log(np.where(joint > 0, ratio, 1.0))).sum((0, 2, 4))
    np.fill_diagonal(info, -np.inf)
    parent, best, link, left = np.full(m, -1), info[0].copy(), np.zeros(m, int), set(range(1, m))
    while left:
        k = max(sorted(left), key=lambda x: best[x])
        parent[k] = link[k]
        left.discard(k)
        closer = info[k] > best
        best, link = np.where(closer, info[k], best), np.where(closer, k, link)
    return parent


def fit_label_model(votes: np.ndarray, start: np.ndarray, weight: np.ndarray, prior: float, rounds: int = 30, smooth: float = 1.0) -> LabelModel:
    """Expectation maximisation from the chances ``start``; the tree is chosen anew in every round until it stands."""
    n, m = votes.shape
    onehot = np.stack([votes == v for v in (-1, 0, 1)], 2).reshape(n, 3 * m).astype(np.float64)
    y, model = start, None
    for _ in range(rounds):
        counts = np.stack([(onehot * (weight * p)[:, None]).T @ onehot for p in (1 - y, y)]).reshape(2, m, 3, m, 3)
        total = np.array([(weight * (1 - y)).sum(), (weight * y).sum()])
        even = np.full((3, 3), 1 / 9)
        joint = (counts + smooth * even[None, None, :, None, :]) / (total.sum() + 2 * smooth)
        for i in range(m):
            own = np.stack([np.diag(counts[c, i, :, i, :]) + smooth / 3 for c in range(2)]) / (total.sum() + 2 * smooth)
            joint[:, i, :, i, :] = own[:, :, None] * np.eye(3)
        parent = _tree(joint) if m > 1 else np.array([-1])
        alone = np.stack([[np.diag(counts[c, i, :, i, :]) + smooth / 3 for i in range(m)] for c in range(2)])
        alone /= alone.sum(2, keepdims=True)
        chance = np.repeat(alone[:, :, None, :], 3, 2)  # a vote that its parent never cast tells as little as no parent
        for i in np.flatnonzero(parent >= 0):
            table = counts[:, parent[i], :, i, :] + 3 * smooth * alone[:, i, None, :]
            chance[:, i] = table / table.sum(2, keepdims=True)
        model = LabelModel(prior, parent, chance)
        new = model.posterior(votes)
        if np.abs(new - y).max() < 1e-4:
            break
        y = new
    return model


@dataclass
class Model:
    lexicon: Lexicon
    terms: np.ndarray
    dense: np.ndarray

    def scores(self, texts: pa.Array) -> np.ndarray:
        rows, terms, words, stats = self.lexicon.hits(texts)
        return 1 / (1 + np.exp(-np.clip(self._odds(rows, terms, words, stats), -30, 30)))

    def _odds(self, rows: np.ndarray, terms: np.ndarray, words: np.ndarray, stats: np.ndarray) -> np.ndarray:
        n = len(stats)
        key = np.unique(rows * (len(self.terms) + 1) + terms)
        own = np.bincount(key // (len(self.terms) + 1), self.terms[key % (len(self.terms) + 1)], n) if len(key) else np.zeros(n)
        return own + np.hstack((stats, _summary(self.lexicon, rows, terms, words, stats))) @ self.dense


def _linear(lexicon: Lexicon, rows: np.ndarray, terms: np.ndarray, dense: np.ndarray, target: np.ndarray, weight: np.ndarray, rounds: int = 250) -> tuple[np.ndarray, np.ndarray]:
    """Weights of terms and dense features: penalised logistic regression on soft labels (Rprop)."""
    size = len(lexicon.terms)
    key = np.unique(rows * (size + 1) + terms)
    r, t = key // (size + 1), key % (size + 1)
    theta = np.zeros(size + dense.shape[1])
    step, last = np.full_like(theta, 0.02), np.zeros_like(theta)
    penalty = np.concatenate((np.full(size, 1.0), np.full(dense.shape[1], 0.05)))
    for _ in range(rounds):
        odds = np.bincount(r, theta[:size][t], len(target)) + dense @ theta[size:]
        diff = weight * (target - 1 / (1 + np.exp(-np.clip(odds, -30, 30))))
        gradient = np.concatenate((np.bincount(t, diff[r], size), dense.T @ diff)) - penalty * theta
        turn = gradient * last
        step = np.clip(np.where(turn > 0, step * 1.2, np.where(turn < 0, step * 0.5, step)), 1e-6, 0.5)
        gradient = np.where(turn < 0, 0, gradient)
        theta, last = theta + np.sign(gradient) * step, gradient
    return theta[:size], theta[size:]


def _collected(batches: Iterator[pa.RecordBatch], lexicons: list[Lexicon]) -> Iterator[pa.RecordBatch]:
    """(fold, label, text) to label, votes by the fold's lexicon, and hits of the last lexicon."""
    for batch in batches:
        fold = batch.column(0).to_numpy(zero_copy_only=False)
        votes = np.zeros((batch.num_rows, N_VOTERS), np.int8)
        for k, lexicon in enumerate(lexicons):
            own = np.flatnonzero(fold == k)
            if len(own):
                votes[own] = voters(lexicon, *lexicon.hits(batch.column(2).take(pa.array(own))))
        rows, terms, words, stats = lexicons[-1].hits(batch.column(2))
        order = np.argsort(rows, kind="stable")
        at = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=batch.num_rows))))
        yield pa.RecordBatch.from_arrays([batch.column(1), K.fixed_rows(votes), K.binary_column(terms[order].astype(np.int64), at), K.binary_column(words[order].astype(np.int64), at), K.fixed_rows(stats)], ["label", "votes", "terms", "words", "stats"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_label: int = FIT_DOCS) -> Model:
    """Fit on ``docs(doc_id, text)`` with ``labels(doc_id, label 0 or 1)``, labelled or not.

    At most about ``per_label`` documents of each label and as many others are used;
    their votes and lexicon hits (no texts) reach the driver. A labelled document's fold is a hash of its text, so copies
    share one; it is voted on by the lexicon of the other folds, a document without label by that of all.
    """
    spark = docs.sparkSession
    ready(spark)
    marks = labels.filter("label IN (0, 1) AND doc_id IS NOT NULL")
    sizes = {r[0]: r[1] for r in marks.groupBy("label").count().collect()}
    prior = min(0.5, max(0.01, sizes.get(1, 0) / max(1, sum(sizes.values()))))
    sample = F.broadcast(bounded_sample(marks, "label", per_label).select("doc_id", "label"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("length(text) > 0")
    labelled = cut(texts.join(sample, "doc_id").select(F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"), "label", "text"))  # bounded, and read for every fold
    lexicons = [mine_lexicon(labelled.filter(F.col("fold") != k), prior) for k in range(FOLDS + 1)]  # the last: of all
    others = bounded_sample(texts.withColumn("all", F.lit(1)), "all", per_label).join(sample, "doc_id", "left_anti").select(F.lit(FOLDS).alias("fold"), F.lit(-1).alias("label"), "text")
    got = sorted(tuple(r) for r in labelled.union(others).mapInArrow(lambda it: _collected(it, lexicons), "label int, votes binary, terms binary, words binary, stats binary").collect())
    lexicon = lexicons[-1]
    if not got:
        return Model(lexicon, np.zeros(len(lexicon.terms)), np.zeros(PATTERNS + 6 + 2 * len(LENGTHS)))
    label = np.array([g[0] for g in got])
    votes = np.stack([np.frombuffer(g[1], np.int8) for g in got]).astype(np.int64)
    each = [np.frombuffer(g[2], np.int64) for g in got]
    rows = np.repeat(np.arange(len(got)), [len(x) for x in each])
    terms, words = np.concatenate(each), np.concatenate([np.frombuffer(g[3], np.int64) for g in got])
    stats = np.stack([np.frombuffer(g[4], np.float64) for g in got])
    # classes are sampled apart: weigh documents back to their shares
    share = np.where(label == 1, prior / max(1, (label == 1).sum()), np.where(label == 0, (1 - prior) / max(1, (label == 0).sum()), 1 / max(1, (label == -1).sum())))
    weight = share / share.mean()
    start = np.where(label == 1, 0.95, np.where(label == 0, 0.02, np.where(votes.sum(1) > 0, 0.5, 0.05)))
    posterior = fit_label_model(votes, start, weight, prior).posterior(votes)
    w_terms, w_dense = _linear(lexicon, rows, terms, np.hstack((stats, _summary(lexicon, rows, terms, words, stats))), posterior, weight)
    return Model(lexicon, w_terms, w_dense)


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.scores(batch.column(batch.num_columns - 1)), pa.float64())], [*batch.schema.names[:-1], "score"])


def score_toxicity(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` with score (0 to 1). A null or empty text has no hit and a low score. Other columns are ignored."""
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(lambda it: _scored(it, shared.value), f"{fields}, score double")
