"""Importance resampling, whitening and personal data against plain versions, and on hard tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import crcngrams, pii, queries, resampling, whitening

TINY = "/root/testdata/sf0.001"
HARD = [None, "", " \t\n ", "a", "é", "日本語 テスト", "x" * 60_000, "word " * 5000, "The same words 12 again, and again!", "The same words 12 again, and again!", "\x1c b c", "A\x0bB", "🎉 ok", "Ünder_score-dash"]
DOCS = "doc_id long, text string, score double, rank int, n_words long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 0.5, 7, 9) for i, t in enumerate(texts)], DOCS).repartition(3)


# ---------------------------------------------------------------- importance resampling


def plain_features(text: str | None) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)], len(w)


def plain_resampling(rows: list[tuple], target: list, percent: int, least: int, seed: int) -> dict:
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    own = [[bucket(f) for f in plain_features(t)[0]] for _, t in rows]
    s, t = Counter(b for x in own for b in x), Counter(bucket(f) for x in target for f in plain_features(x)[0])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    scored = []
    for (i, text), x in zip(rows, own, strict=True):
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, x))
        scored.append([i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), plain_features(text)[1]])
    able = sorted((r for r in scored if r[4] >= least), key=lambda r: (-r[3], r[0]))
    place = {id(r): k + 1 for k, r in enumerate(able[: len(able) * percent // 100])}
    return sorted((*r[:4], place.get(id(r))) for r in scored)


@pytest.mark.parametrize("lengths", [(1, 5), (40, 120), (1, 5000)])
def test_ngram_crcs_of_any_length(lengths):
    rng = random.Random(3)
    texts = [[bytes(rng.choices(b"abc\xc3\xa9", k=rng.randint(*lengths))) for _ in range(rng.randint(0, 6))] for _ in range(40)]
    flat = [w for t in texts for w in t]
    raw = np.frombuffer(b"".join(w + b" " for w in flat), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in flat]) - 1
    starts = ends - [len(w) for w in flat]
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    for n, (at, crc) in enumerate(crcngrams.ngram_crcs(raw, starts, ends, row, 4), 1):
        want = [(i, zlib.crc32(b" ".join(flat[i : i + n]))) for i in range(len(flat) - n + 1) if row[i] == row[i + n - 1]]
        assert list(zip(at.tolist(), crc.tolist(), strict=True)) == want


def test_resampling_equals_plain_version(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["été", "Straße", "x9"]
    texts = [" ".join(rng.choice(vocabulary) + rng.choice(["", ".", ","]) for _ in range(rng.randint(0, 60))) for _ in range(150)] + HARD
    target = [" ".join(rng.choice(vocabulary[:20]) for _ in range(30)) for _ in range(5)] + [None, ""]
    rows = list(enumerate(texts))
    for percent in (5, 40, 100):
        got = resampling.resample(docs(spark, texts), spark.createDataFrame([(t,) for t in target], "text string"), percent).collect()
        assert sorted(tuple(r) for r in got) == plain_resampling(rows, target, percent, 20, 42)


def test_resampling_of_repeats_nulls_and_empty_tables(spark):
    target = spark.createDataFrame([("a b c",)], "text string")
    text = "one two three " * 10
    repeated = spark.createDataFrame([(4, text), (4, text), (None, text), (2, text), (2, "x " * 30)] * 4, "doc_id long, text string")
    got = resampling.resample(repeated, target, 50).collect()
    assert len(got) == 20 and sorted(r.rank for r in got if r.rank is not None) == list(range(1, 11))
    by_rank = sorted((r for r in got if r.rank), key=lambda r: r.rank)
    assert all(a.score >= b.score for a, b in zip(by_rank, by_rank[1:], strict=False))
    assert min(r.score for r in by_rank) >= max(r.score for r in got if not r.rank)
    assert resampling.resample(repeated.limit(0), target).collect() == []
    assert len(resampling.resample(repeated, target.limit(0)).collect()) == 20


def test_resampling_equals_sql(spark):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{TINY}/{t}.parquet')")
    want = db.execute("SELECT doc_id, n_features, weight, score, rank FROM (" + resampling.oracle_sql() + ")").fetchall()
    got = queries.op12_importance_resampling(spark, TINY).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


# ---------------------------------------------------------------- whitening


VECTORS = "vec_id long, embedding array<float>, component int, n int"


def plain_whitening(vectors: list, k: int = 4):
    sound = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in sound}), object)
    n, sums = len(fit), fit.sum(0)
    centred = (n * fit - sums).astype(np.float64) / n
    values, own = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:k]
    out = {}
    for i, x in sound:
        z = np.array([n * int(c) - int(s) for c, s in zip(x, sums, strict=True)], object)
        out[i] = (int((z * z).sum()), (z.astype(np.float64) / n) @ own[:, order] / np.sqrt(values[order]), values[order] / values.sum())
    return n, out


def test_whitening_equals_plain_version(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(0, [3, 2, 1, 0.5, 0.2, 0.1], (300, 6))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)] + [(1000 + i, [float(c) for c in base[i % 3]]) for i in range(50)]
    bad = [(2001, None), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2003, [float("nan")] * 6), (2004, [float("inf")] * 6), (2005, []), (2006, [1.0, 2.0])]
    got = whitening.whiten(spark.createDataFrame([(i, v, 3, 4) for i, v in rows + bad], VECTORS).repartition(4)).collect()
    n, want = plain_whitening(rows)
    assert len(got) == 4 * len(rows) and {r.vec_id for r in got} == set(want)
    flip = {}
    for r in got:
        deviation, w, explained = want[r.vec_id]
        assert (r.n, r.deviation, int(r.deviation_wide)) == (n, deviation, deviation)
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        assert r.identity_error < 1e-9
        sign = flip.setdefault(r.component, 1 if abs(r.whitened - w[r.component - 1]) < 1e-6 else -1)
        assert r.whitened == pytest.approx(sign * w[r.component - 1], abs=1e-7)


def test_whitening_of_few_flat_large_and_no_vectors(spark):
    make = lambda rows: spark.createDataFrame([(i, v, 3, 4) for i, v in rows], VECTORS)
    assert whitening.whiten(make([])).collect() == []
    assert whitening.whiten(make([(1, None)])).columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    one = whitening.whiten(make([(None, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert sorted((str(r.vec_id), r.component, r.n, r.deviation, r.whitened, r.explained) for r in one) == [(i, c, 1, 0, 0.0, 0.0) for i in ("2", "None") for c in (1, 2)]
    large = whitening.whiten(make([(1, [1e12, 0.0]), (2, [-1e12, 0.0]), (3, [0.0, 1.0])])).collect()
    top = next(r for r in large if (r.vec_id, r.component) == (1, 1))
    x = math.floor(256 * float(np.float32(1e12)))
    assert top.deviation is None and int(top.deviation_wide) == (3 * x) ** 2 + 256**2
    assert abs(top.whitened) == pytest.approx(math.sqrt(1.5), rel=1e-6)


# ---------------------------------------------------------------- personal data


def plain_base(text: str) -> list:
    passes = lambda d: sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    only = lambda t: re.sub("[^0-9]", "", t)
    kinds = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(p) <= 255 for p in t.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda t: 12 <= len(only(t)) <= 19 and passes(only(t))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 9 <= len(only(t)) <= 15),
    ]
    found = [(m.start(), k, m.end()) for k, (pattern, fits) in enumerate(kinds) for m in re.finditer(pattern, text) if fits(m.group())]
    return [(s, pii.KINDS[k], e) for s, k, e in sorted(found)]


def test_base_spans_equal_plain_patterns():
    rng = random.Random(11)
    for trial in range(6000):
        text = "".join(rng.choices(["a", "é", "@", ".", "b.c", "1", "25", "255", "4465758382889437", "+1", " ", "-", "(", ")", "_", "%", "\n", "7 "], k=rng.randint(1, 40)))
        assert pii.base_spans(text) == plain_base(text), (trial, text)
    for text, _ in pii.built_texts(21, 300):
        assert pii.base_spans(text) == plain_base(text)


def test_messages_are_exact_on_trees_and_near_on_a_ring():
    rng = np.random.default_rng(2)
    for edges, close in (([(0, 1), (1, 2), (1, 3)], 1e-9), ([(0, 1), (1, 2), (2, 3), (0, 3)], 0.08)):
        a, b = np.array(edges).T
        unary, pairs = rng.normal(size=(4, 3)), rng.normal(size=(2, 3, 3)) * 0.7
        kind = np.arange(len(a)) % 2
        node, edge = pii.beliefs(unary, a, b, kind, pairs, 30)
        total, want = 0.0, np.zeros((4, 3))
        for state in np.ndindex(3, 3, 3, 3):
            p = math.exp(sum(unary[i, s] for i, s in enumerate(state)) + sum(pairs[k, state[i], state[j]] for i, j, k in zip(a, b, kind, strict=True)))
            total += p
            for i, s in enumerate(state):
                want[i, s] += p
        assert np.abs(node - want / total).max() < close
        assert np.allclose(edge.sum((1, 2)), 1)


def test_held_out_texts_and_consistency():
    field = pii.fitted()
    held = pii.built_texts(99, 600)
    right = wrong = missed = by_base = 0
    for (_, gold), (base, spans) in zip(held, pii.find_spans([t for t, _ in held], field), strict=True):
        assert set(base) <= set(spans)
        by_base += len(set(gold) & set(base))
        right, wrong, missed = right + len(set(gold) & set(spans)), wrong + len(set(spans) - set(gold)), missed + len(set(gold) - set(spans))
    assert right / (right + missed) > 0.97 and right / (right + wrong) > 0.96
    assert by_base / (right + missed) < 0.65  # the field finds over a third of them
    lone, linked = "order 743-5558 today", "call +1 (612) 743-5558 now, or just 743-5558 later"
    assert pii.find_spans([lone], field)[0][1] == []
    assert [linked[s:e] for s, k, e in pii.find_spans([linked], field)[0][1]] == ["+1 (612) 743-5558", "743-5558"]
    # documents of a batch do not touch each other
    assert pii.find_spans([linked, lone, linked], field) == [pii.find_spans([t], field)[0] for t in (linked, lone, linked)]
    clean = ["Version 2.0 of 2024-05-17, 1,299.00 paid, room 12", "token = \"908038b7daaf91e730d2f64001c52934d43d9336\"", "9807915762804490 of 12 units", None, ""]
    assert all(spans == [] for _, spans in pii.find_spans(clean, field))


def test_hostile_texts_take_linear_time():
    import time

    for text in ("x" * 300_000, "0" * 300_000, "1." * 150_000, "@" * 300_000, "a@" * 150_000, "((((((" * 50_000 + "1", "+" * 300_000, "+1" + "(" * 300_000, "a." * 100_000 + "@b"):
        start = time.perf_counter()
        pii.find_spans([text], pii.fitted())
        assert time.perf_counter() - start < 3, text[:10]


def test_personal_data_of_hard_tables(spark):
    texts = [*HARD, "mail a.b@c.de, +1 (612) 743-5558!", "1.2.3.4 é 4465758382889437"]
    rows = pii.find_personal_data(docs(spark, texts), ["doc_id"]).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id]
        assert [tuple(s) for s in r.base] == plain_base(text or "") and r.redacted == pii.redacted(text, [tuple(s) for s in r.spans])
    assert next(r for r in rows if r.doc_id == len(HARD)).redacted == "mail [EMAIL], [PHONE]!"
    assert pii.find_personal_data(docs(spark, texts).limit(0), ["doc_id"]).collect() == []


def test_personal_data_query_digests(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{TINY}/documents.parquet").collect()}
    for r in queries.op13_personal_data(spark, TINY).collect():
        base = plain_base(texts[r.doc_id] or "")
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[1] == k for s in base) for k in pii.KINDS)
        joined = ",".join(f"{k}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_whitening_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{TINY}/embeddings.parquet").collect()]
    n, want = plain_whitening(rows)
    got = queries.op11_whitening(spark, TINY).filter(F.col("component") == 1).collect()
    assert {(r.vec_id, r.n, r.deviation) for r in got} == {(i, n, d) for i, (d, _, _) in want.items()}
    assert all(abs(abs(r.whitened) - abs(want[r.vec_id][1][0])) < 1e-7 for r in got)
