"""Language identification with hyperdimensional letter-trigram profiles.

Every letter (and the gap between words) has a pseudo-random +-1 vector. A
trigram is the elementwise product (binding) of its letters' vectors, the first
rotated twice and the second once. A document is the sum (bundle) of its
trigrams; a language's prototype is the sum of its documents scaled to length
one. A document gets the language whose prototype has the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import bounded_sample, ready

DIMENSIONS = 1024
#: Labelled documents per language that a fit uses at most (on average; see bounded_sample).
FIT_DOCS = 3000
#: Trigram vectors a worker keeps (1 KB each) before it starts afresh.
CACHED = 40_000
#: With at most this many letters seen, trigrams index a table directly.
DIRECT = 128


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Profiler:
    """Bundles of texts. Keeps the vectors of trigrams seen before; they depend on the letters only."""

    _gap = np.ones(1, np.int64)

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 7) -> None:
        self.dimensions, self.seed = dimensions, seed
        self.ids = np.zeros(0x110000, np.int64)  # 0: not a letter
        self.ids[32] = 1
        self.letters = [np.zeros(0, np.int8), self._letter(32)]
        self._fresh()

    def _letter(self, code: int) -> np.ndarray:
        bits = np.random.default_rng([self.seed, code]).integers(0, 2, self.dimensions, dtype=np.int8)
        return bits * np.int8(2) - np.int8(1)

    def _fresh(self) -> None:
        self.direct = np.full(DIRECT**3, -1, np.int32)
        self.known: dict[int, int] = {}
        self.vectors = np.zeros((1024, self.dimensions), np.int8)

    def _codes(self, text: str) -> np.ndarray:
        """Letter ids of the lower-cased text, with one gap (1) between words and at both ends; empty without letters."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _is_letter()[points]
        if not letter.any():
            return np.zeros(0, np.int64)
        ids = self.ids[points]
        if (new := letter & (ids == 0)).any():
            for code in np.unique(points[new]).tolist():
                self.ids[code] = len(self.letters)
                self.letters.append(self._letter(code))
            ids = self.ids[points]
        ids = np.where(letter, ids, 1)
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # the first of each run of other characters
        return np.concatenate((self._gap, ids[keep], self._gap[: int(letter[-1])]))

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Rows of self.vectors for trigram keys; new trigrams get theirs now."""
        small = len(self.letters) <= DIRECT
        slots = self.direct[keys] if small else np.fromiter((self.known.get(k, -1) for k in keys.tolist()), np.int32, len(keys))
        for at in np.flatnonzero(slots < 0).tolist():
            key = int(keys[at])
            slot = len(self.known)
            if slot == len(self.vectors):
                self.vectors = np.concatenate((self.vectors, np.zeros_like(self.vectors)))
            base = DIRECT if small else 1 << 20
            a, b, c = key // base // base, key // base % base, key % base
            self.vectors[slot] = np.roll(self.letters[a], 2) * np.roll(self.letters[b], 1) * self.letters[c]
            self.known[key] = slots[at] = slot
            if small:
                self.direct[key] = slot
        return slots

    def bundles(self, texts: list[str | None]) -> np.ndarray:
        """One row for each text; zero for a null text and one without letters."""
        rows, slots, counts = [], [], []
        for row, text in enumerate(texts):
            before = len(self.letters) <= DIRECT
            codes = self._codes(text) if text else np.zeros(0, np.int64)
            if before and len(self.letters) > DIRECT:  # keys change their form
                return self._restart(texts)
            if len(self.known) > CACHED:
                return self._restart(texts) if row else self._after_fresh(texts)
            if len(codes) < 3:
                continue
            base = DIRECT if len(self.letters) <= DIRECT else 1 << 20
            keys = (codes[:-2] * base + codes[1:-1]) * base + codes[2:]
            keys.sort()
            at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            own = self._slots(keys[at])
            rows.append(np.full(len(own), row))
            slots.append(own)
            counts.append(np.diff(np.append(at, len(keys))))
        out = np.zeros((len(texts), self.dimensions), np.float32)
        if rows:
            used, column = np.unique(np.concatenate(slots), return_inverse=True)
            dense = np.zeros((len(texts), len(used)), np.float32)
            dense[np.concatenate(rows), column] = np.concatenate(counts)
            for i in range(0, len(used), 4096):
                out += dense[:, i : i + 4096] @ self.vectors[used[i : i + 4096]].astype(np.float32)
        return out

    def _after_fresh(self, texts: list[str | None]) -> np.ndarray:
        self._fresh()
        return self.bundles(texts)

    def _restart(self, texts: list[str | None]) -> np.ndarray:
        """Empty the cache; take the texts in halves, so that one call's trigrams stay bounded."""
        self._fresh()
        if len(texts) == 1:
            return self.bundles(texts)
        half = len(texts) // 2
        return np.concatenate((self.bundles(texts[:half]), self.bundles(texts[half:])))


_profilers: dict[int, Profiler] = {}


def _profiler(dimensions: int) -> Profiler:
    return _profilers.setdefault(dimensions, Profiler(dimensions))


def _parts(texts: pa.Array, most: int = 256) -> Iterator[tuple[int, list[str | None]]]:
    for i in range(0, len(texts), most):
        yield i, texts[i : i + most].to_pylist()


def _bundled(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[pa.RecordBatch]:
    """(text, lang) to sums of unit bundles, in units of 2**-20, by language and dimension."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for i, texts in _parts(batch.column(0)):
            bundles = _profiler(dimensions).bundles(texts)
            norm = np.linalg.norm(bundles, axis=1, keepdims=True)
            unit = np.rint(bundles / np.where(norm > 0, norm, 1) * (1 << 20)).astype(np.int64)
            for k, row in enumerate(unit):
                total[langs[i + k]] = total.get(langs[i + k], 0) + row
    for lang, sums in total.items():
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(sums)), "dim": pa.array(np.arange(len(sums), dtype=np.int32)), "value": pa.array(sums)})


def fit_prototypes(labelled: DataFrame, dimensions: int = DIMENSIONS, per_language: int = FIT_DOCS) -> dict[str, np.ndarray]:
    """Unit prototypes from ``labelled(doc_id, text, lang)``; rows without text or lang teach nothing.

    Only the sums reach the driver: ``dimensions`` numbers for each language.
    """
    ready(labelled.sparkSession)
    rows = bounded_sample(labelled.filter("lang IS NOT NULL AND text IS NOT NULL"), "lang", per_language)
    sums = rows.select("text", "lang").mapInArrow(lambda it: _bundled(it, dimensions), "lang string, dim int, value long")
    out: dict[str, np.ndarray] = {}
    for lang, dim, value in sums.groupBy("lang", "dim").agg(F.sum("value")).collect():
        out.setdefault(lang, np.zeros(dimensions))[dim] = value
    return {lang: (v / n).astype(np.float32) for lang, v in sorted(out.items()) if (n := np.linalg.norm(v)) > 0}


def _identified(batches: Iterator[pa.RecordBatch], prototypes: dict[str, np.ndarray], dimensions: int) -> Iterator[pa.RecordBatch]:
    langs, matrix = list(prototypes), np.stack(list(prototypes.values())) if prototypes else np.zeros((0, dimensions), np.float32)
    for batch in batches:
        for i, texts in _parts(batch.column(batch.num_columns - 1)):
            bundles = _profiler(dimensions).bundles(texts)
            norm = np.linalg.norm(bundles, axis=1)
            cosines = bundles @ matrix.T / np.where(norm > 0, norm, 1)[:, None]
            best = cosines.argmax(1) if langs else np.zeros(len(texts), int)
            found = norm > 0 if langs else np.zeros(len(texts), bool)
            score = [float(min(1.0, max(0.0, cosines[k, b]))) if ok else 0.0 for k, (b, ok) in enumerate(zip(best, found, strict=True))]
            part = batch.slice(i, len(texts))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array([langs[b] if ok else "und" for b, ok in zip(best, found, strict=True)], pa.string()), pa.array(score, pa.float64())],
                [*part.schema.names[:-1], "lang_pred", "score"],
            )


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], keep: list[str], text: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """The columns ``keep`` of ``docs`` with lang_pred and score (cosine, at least 0).

    ``und`` with score 0 for a null text and one without letters, and for every
    text where no prototype was learnt. Equal cosines: the first language by name.
    Columns of ``docs`` that are not kept (a clashing lang_pred or score too) are ignored.
    """
    ready(docs.sparkSession)
    rows = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(lambda it: _identified(it, prototypes, dimensions), f"{fields}, lang_pred string, score double")
