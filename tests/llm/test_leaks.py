"""Decontamination of short items and repetitive texts."""

from __future__ import annotations

import random
import time
import tracemalloc

import pyarrow as pa
import pytest

from plumbline.llm import decontam


def vocabulary(rng, n=4000):
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n)]


@pytest.mark.parametrize("n", [1, 2, 4, 11, 12, 13, 30])
def test_recall_against_exhaustive_search(n):
    rng = random.Random(n)
    known = vocabulary(rng)
    some = lambda k: " ".join(rng.choice(known) for _ in range(k))
    items = [(i, t) for i in range(60) if len(t := some(n)) >= 5]
    for rate in (0, 0.1, 0.2):
        texts = []
        for _, t in items:
            places = {rng.randrange(len(t))} if not rate else {k for k in range(len(t)) if rng.random() < rate}
            texts.append(f"{some(12)} {''.join(rng.choice(['', c + 'x', 'q']) if k in places else c for k, c in enumerate(t))} {some(12)}")
        found = decontam.find_items(pa.array(texts), decontam.Index(items), 0.2)
        hits = set(zip(found["row"], found["item_id"], strict=True))
        plain = lambda t: " ".join(t.split())
        every = {(r, i) for r, text in enumerate(texts) for i, item in items if decontam.best_place(plain(item), plain(text)) <= int(0.2 * len(plain(item)))}
        assert hits <= every
        assert len(hits) >= (0.9 if rate == 0.2 else 0.97) * len(every)


REPETITIVE = [("ha " * 50, "ha " * 100_000), ("0" * 200, "0" * 300_000), ("lorem ipsum dolor sit amet " * 40, "lorem ipsum dolor sit amet " * 11_000), ("ab", "ab " * 100_000), ("a a a a a a", "a " * 150_000)]


@pytest.mark.parametrize(("item", "text"), REPETITIVE)
def test_repetitive_texts_take_little_time_and_memory(item, text):
    index = decontam.Index([(1, item), (2, "some other item of the benchmark that is not here")])
    tracemalloc.start()
    start = time.perf_counter()
    found = decontam.find_items(pa.array([text, "clean", text[len(text) // 2 :], None]), index, 0.2)
    assert time.perf_counter() - start < 10  # far less without the memory trace
    assert tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()
    assert set(zip(found["row"], found["item_id"], found["edits"], strict=True)) == {(0, 1, 0), (2, 1, 0)}


def test_repetitive_items_with_edits_are_found():
    rng = random.Random(8)
    for unit in ("ha ", "0", "tra la la ", "abc def ghij klmno "):
        item = (unit * 80)[:240].strip()
        broken = "".join(rng.choice(["", c + "x"]) if rng.random() < 0.12 else c for c in item)
        texts = [f"before this {broken} and after", "nothing like it here at all", unit * 2000]
        found = decontam.find_items(pa.array(texts), decontam.Index([(5, item)]), 0.2)
        assert sorted(found["row"]) == [0, 2], unit


def test_stretches_lose_nothing_where_they_meet(monkeypatch):
    rng = random.Random(2)
    known = vocabulary(rng)
    some = lambda k: " ".join(rng.choice(known) for _ in range(k))
    items = [(i, some(12)) for i in range(40)]
    text = " ".join(f"{some(7)} {t}" for _, t in items)
    whole = decontam.find_items(pa.array([text]), decontam.Index(items), 0.2)
    assert sorted(whole["item_id"]) == list(range(40))
    monkeypatch.setattr(decontam, "STRETCH", 64)
    monkeypatch.setattr(decontam, "HITS", 50)
    assert decontam.find_items(pa.array([text]), decontam.Index(items), 0.2) == whole


def test_items_met_many_times_are_one_row(spark):
    docs = spark.createDataFrame([(1, "say the magic words now " * 400), (1, "say the magic words now"), (2, "clean"), (None, "the magic words")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "the magic words"), (7, "the magic words"), (8, None), (None, "clean")], "item_id long, text string")
    assert sorted((str(r.doc_id), r.item_id, r.edits) for r in decontam.leaks(docs, bench).collect()) == [("1", 7, 0), ("None", 7, 0)]
    assert [r.doc_id for r in decontam.without_leaks(docs, bench, ["doc_id", "text"]).collect()] == [2]
