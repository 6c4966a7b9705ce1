"""Context-triggered piecewise hashing of documents.

A rolling hash of the last WINDOW bytes ends a chunk wherever its lowest k bits
are zero, so that chunks are 2**k bytes long on average and depend on their own
neighbourhood only. The block level k of a text is the lowest that gives at most
CHUNKS boundaries; its fingerprint holds a signature (12 bits a chunk, two
letters) for each of the levels k to k + 3. Two fingerprints are compared at the
finest level they share, by edit distance of their chunk sequences (insertions
and deletions): likeness = 1 - distance / total chunks, after runs of more than
three equal chunks are cut to three.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textkernel as K
from .session import cut, ready

WINDOW, CHUNKS, LEVELS = 7, 63, 4
_LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", np.uint8)


def _fingerprints(raw: np.ndarray, offsets: np.ndarray) -> list[str]:
    rows = len(offsets) - 1
    sizes = np.diff(offsets)
    n = len(raw)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + K.U64(1)) * K._power(K._BASE, n + 1)[:n], out=sums[1:])
    back = K._power(K._BASE_INV, n + 1)
    span = lambda s, e: K.mix((sums[e] - sums[s]) * back[s])
    level = np.zeros(rows, np.int64)
    ends, zeros, row = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n >= WINDOW:
        least = np.maximum(0, np.floor(np.log2(np.maximum(1, sizes) / CHUNKS)).astype(np.int64) - 2)
        rolling = K.mix((sums[WINDOW:] - sums[:-WINDOW]) * back[: n - WINDOW + 1])
        masks = np.repeat(((K.U64(1) << least.astype(np.uint64)) - K.U64(1)), sizes)[WINDOW - 1 :]
        at = np.flatnonzero((rolling & masks) == 0)
        ends = at + WINDOW  # a chunk ends behind this byte
        row = np.searchsorted(offsets, ends - 1, "right") - 1
        inside = (ends - offsets[row] >= WINDOW) & (ends < offsets[row + 1])
        ends, row, low = ends[inside], row[inside], rolling[at[inside]]
        low = low & (~low + K.U64(1))
        zeros = np.where(low == 0, 63, np.log2(np.maximum(low, K.U64(1)).astype(np.float64))).astype(np.int64)
        reach = np.bincount(row * 64 + zeros, minlength=rows * 64).reshape(rows, 64)[:, ::-1].cumsum(1)[:, ::-1]
        reach[np.arange(64)[None, :] < least[:, None]] = n + 1
        level = (reach <= CHUNKS).argmax(1)
    parts = [[str(k)] for k in level.tolist()]
    for step in range(LEVELS):
        use = zeros >= level[row] + step
        e, r = ends[use], row[use]
        tail = np.flatnonzero(sizes > 0)  # the last chunk ends with its text
        e, r = np.concatenate((e, offsets[1:][tail])), np.concatenate((r, tail))
        order = np.argsort(e, kind="stable")
        e, r = e[order], r[order]
        s = np.concatenate(([0], e[:-1])) if len(e) else e
        s = np.maximum(s, offsets[r])
        value = (span(s, e) >> K.U64(52)).astype(np.int64)
        text = np.column_stack((_LETTERS[value >> 6], _LETTERS[value & 63])).tobytes().decode("ascii")
        stops = np.concatenate(([0], np.cumsum(np.bincount(r, minlength=rows)))) * 2
        for i in range(rows):
            parts[i].append(text[stops[i] : stops[i + 1]])
    return [":".join(p) for p in parts]


def fingerprint(texts: list[str]) -> list[str]:
    """Fingerprints ``level:signature:signature:signature:signature``; empty signatures for an empty text."""
    raw, offsets = K.buffer_of(pa.array(texts, pa.large_string()))
    out: list[str] = []
    for i, j in K.slices(offsets, 1 << 19):
        out += _fingerprints(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
    return out


def _tokens(signature: str) -> list[str]:
    tokens = [signature[i : i + 2] for i in range(0, len(signature), 2)]
    return [t for i, t in enumerate(tokens) if i < 3 or not t == tokens[i - 1] == tokens[i - 2] == tokens[i - 3]]


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    places: dict[str, int] = {}
    for i, t in enumerate(a):
        places[t] = places.get(t, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for t in b:
        hit = row & places.get(t, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def likeness(a: str, b: str) -> float:
    """0 to 1; 1 for equal fingerprints (two empty texts too), 0 where no level is shared."""
    if a == b:
        return 1.0
    (ka, *sa), (kb, *sb) = a.split(":"), b.split(":")
    level = max(int(ka), int(kb))
    i, j = level - int(ka), level - int(kb)
    if i >= LEVELS or j >= LEVELS:
        return 0.0
    x, y = _tokens(sa[i]), _tokens(sb[j])
    return 2 * common_length(x, y) / (len(x) + len(y)) if x and y else 0.0


def edited(text: str, following: str) -> str:
    """The last half (rounded down) of the code points replaced by the first as many, or all, of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(ids: list, texts: list[str], prints: list[str], nexts: list[str], next_prints: list[str]) -> dict[str, list]:
    changed = [edited(t, n) for t, n in zip(texts, nexts, strict=True)]
    changed_prints = fingerprint(changed)
    return {
        "doc_id": ids,
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
        "fingerprint": prints,
        "edited_fingerprint": changed_prints,
        "near_edited": [likeness(a, b) for a, b in zip(prints, changed_prints, strict=True)],
        "near_next": [likeness(a, b) for a, b in zip(prints, next_prints, strict=True)],
    }


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_EDGE = pa.schema([*_OUT, ("part", pa.int32()), ("is_last", pa.bool_()), ("text", pa.string())])


def _edge(part: int, doc_id: int | None, text: str, print_: str, last: bool) -> pa.RecordBatch:
    row = {"doc_id": [doc_id], "n_chars": [len(text)], "edited_sha256": [None], "fingerprint": [print_], "edited_fingerprint": [None], "near_edited": [None], "near_next": [None], "part": [part], "is_last": [last], "text": [text]}
    return pa.RecordBatch.from_pydict(row, schema=_EDGE)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range, in order: each with its next row; the range's first and last row as they are."""
    part, carried = TaskContext.get().partitionId(), None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        prints = fingerprint(texts)
        if carried is None:
            yield _edge(part, ids[0], texts[0], prints[0], False)
        else:
            ids, texts, prints = [carried[0], *ids], [carried[1], *texts], [carried[2], *prints]
        carried = ids[-1], texts[-1], prints[-1]
        done = _compared(ids[:-1], texts[:-1], prints[:-1], texts[1:], prints[1:])
        n = len(ids) - 1
        yield pa.RecordBatch.from_pydict({**done, "part": [part] * n, "is_last": [None] * n, "text": [None] * n}, schema=_EDGE)
    if carried is not None:
        yield _edge(part, *carried, True)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        col = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        yield pa.RecordBatch.from_pydict(_compared(col["doc_id"], col["text"], col["fingerprint"], col["next_text"], col["next_print"]), schema=_OUT)


#: Bytes of text that a range holds, about.
RANGE_BYTES = 16 << 20


def fingerprint_documents(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Fingerprint every text and its edit with the next document's beginning.

    Returns (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next). Documents follow each other by doc_id (nulls first),
    equal ids by text; after the last comes the first, and a lone document follows
    itself. A null text counts as empty. Other columns are ignored.

    One range shuffle brings neighbours together, in as many ranges as the texts' bytes ask for; a task streams through its range.
    Only the first and last rows of the ranges, two for each, are paired afterwards.
    """
    spark = docs.sparkSession
    ready(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // range_bytes + 1)
    ordered = texts.repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id", "text")
    all_rows = cut(ordered.mapInArrow(_in_order, f"{_FIELDS}, part int, is_last boolean, text string"))
    ends = all_rows.filter("is_last IS NOT NULL").select("part", "is_last", "doc_id", "text", "fingerprint")
    firsts = ends.filter("NOT is_last").select(F.col("part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    parts = firsts.select("part")
    following = parts.select("part", F.coalesce(F.lead("part").over(W.orderBy("part")), F.min("part").over(W.partitionBy())).alias("next"))
    paired = ends.filter("is_last").join(following, "part").join(firsts.withColumnRenamed("part", "next"), "next")
    fixed = paired.select("doc_id", "text", "fingerprint", "next_text", "next_print").mapInArrow(_edges, _FIELDS)
    return all_rows.filter("is_last IS NULL").select(*_OUT.names).union(fixed)
