"""MinHash near-duplicate groups with sequential Bayesian verification.

Texts become sets of five-word shingles. Texts with equal sets form a class
(found by a 128-bit digest of the set), and only one document of each class
goes on. Banded MinHash finds candidates; each pair's signatures are compared
in batches, and the pair is dropped as soon as the posterior chance that its
similarity reaches the threshold falls under ``miss``; what survives is checked
on the full sets. Links are gathered in two rounds, so that a large group never
yields all its pairs:

1. every member of a bucket is compared with the bucket's smallest member;
2. buckets that still hold several components are gathered around their largest
   component; the signatures of the members outside it are compared with those of
   all members of other components, block by block inside a task. Members of surviving
   pairs come again with their full sets, and each block emits only confirmed links
   that join two components.

Every pair that shares a band is thus compared or already connected. With 24
bands of 4 rows, a pair at similarity 0.75 shares none with probability 1.1e-4
(at 0.8, 3e-6).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .components import connected_components
from .session import cut, ready

BANDS, ROWS, HASHES, STEP = 24, 4, 128, 16
#: Members of a block in the second round: at most BLOCK * BLOCK signature comparisons in memory at once.
BLOCK = 128
#: Pairs of full sets handed to Python at once; the sets of a long text take some 100 KB each.
PAIRS_PER_BATCH = 32
#: Set elements that are counted at once in the second round.
ELEMENTS = 1 << 20


def _hash_family(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * K.U64(2) + K.U64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


_ODD, _XOR = _hash_family(HASHES)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The 128 minima of a set under independent hash functions."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(shingles), 2048):
        part = shingles[i : i + 2048, None]
        np.minimum(low, (((part ^ _XOR) * _ODD) >> K.U64(32)).astype(np.uint32).min(0), out=low)
    return low


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature; the band's number is part of it."""
    bands = sigs[:, : BANDS * ROWS].reshape(len(sigs), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), bands.shape[:2])
    for k in range(ROWS):
        key = K.mix(key * K.U64(0x9E3779B97F4A7C15) ^ bands[:, :, k])
    return key


def least_matches(threshold: float, miss: float) -> list[int]:
    """For each number of compared hashes (STEP, 2 STEP, ...), the fewest matches that keep a pair.

    With a uniform prior, the similarity after k of m matches is Beta(k + 1, m - k + 1),
    and P(similarity >= t) = P(Binomial(m + 1, t) <= k).
    """
    out = []
    for m in range(STEP, HASHES + 1, STEP):
        tail, k = 0.0, -1
        while tail < miss:
            k += 1
            tail += comb(m + 1, k) * threshold**k * (1 - threshold) ** (m + 1 - k)
        out.append(k)
    return out


def _signatures(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.stack([signature(sets[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)])


def _described(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offs = K.buffer_of(batch.column(1))
        for i, j in K.slices(offs, 1 << 19):
            sets, at = K.shingle_sets(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], size)
            n = np.diff(at)
            sums = np.concatenate(([0], np.cumsum(sets, dtype=np.uint64)))
            more = np.concatenate(([0], np.cumsum(K.mix(sets ^ K.U64(0x5851F42D4C957F2D)), dtype=np.uint64)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0)[i:j],
                    pa.array(n),
                    pa.array((sums[at[1:]] - sums[at[:-1]]).view(np.int64)),
                    pa.array((more[at[1:]] - more[at[:-1]]).view(np.int64)),
                    K.long_lists(band_keys(_signatures(sets, at))),
                ],
                ["doc_id", "n", "h1", "h2", "bands"],
            )


def _full(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offs = K.buffer_of(batch.column(1))
        for i, j in K.slices(offs, 1 << 19):
            sets, at = K.shingle_sets(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], size)
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], K.fixed_rows(_signatures(sets, at)), K.binary_column(sets, at)], ["id", "sig", "set"])


def _matrix(column: pa.Array, dtype: type) -> np.ndarray:
    raw, offs = K.buffer_of(column.cast(pa.large_binary()))
    return np.ascontiguousarray(raw).view(dtype).reshape(len(offs) - 1, -1)


def _pruned(batches: Iterator[pa.RecordBatch], least: list[int]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose signatures survive every batch of hashes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        equal = _matrix(batch.column(2), np.uint32) == _matrix(batch.column(3), np.uint32)
        alive = np.arange(len(equal))
        score = np.zeros(len(equal), np.int64)
        for k, need in enumerate(least):
            score[alive] += equal[alive, k * STEP : (k + 1) * STEP].sum(1)
            alive = alive[score[alive] >= need]
        yield batch.select([0, 1]).take(pa.array(alive))


def _confirmed(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets have den * |intersection| >= num * |union|."""
    for batch in batches:
        left, lo = K.buffer_of(batch.column(2))
        right, ro = K.buffer_of(batch.column(3))
        left, right, lo, ro = np.ascontiguousarray(left).view(np.uint64), np.ascontiguousarray(right).view(np.uint64), lo // 8, ro // 8
        keep = []
        for r in range(batch.num_rows):
            x, y = left[lo[r] : lo[r + 1]], right[ro[r] : ro[r + 1]]
            both = len(x) + len(y)
            if den * min(len(x), len(y)) < num * max(len(x), len(y)):
                continue
            merged = np.concatenate((x, y))
            merged.sort()
            common = int((merged[1:] == merged[:-1]).sum())
            if den * common >= num * (both - common):
                keep.append(r)
        yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))


def common_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of each left set with each right set, as products of 0/1 matrices.

    The sets are sorted; equal ranges of the hash space, at most about ELEMENTS elements each, are counted one after the other.
    """
    both = left + right
    ranges = max(1, -(-sum(map(len, both)) // ELEMENTS))
    edges = [int(k * 2**64 // ranges) for k in range(1, ranges)]
    cuts = [[0, *np.searchsorted(x, np.array(edges, np.uint64)).tolist(), len(x)] for x in both]
    out = np.zeros((len(left), len(right)), np.float64)
    for r in range(ranges):
        parts = [x[c[r] : c[r + 1]] for x, c in zip(both, cuts, strict=True)]
        values, column = np.unique(np.concatenate(parts), return_inverse=True)
        row = np.repeat(np.arange(len(both)), [len(x) for x in parts])
        order = np.argsort(column, kind="stable")
        column, row = column[order], row[order]
        for c in range(0, len(values), columns):
            i, j = np.searchsorted(column, (c, c + columns))
            dense = np.zeros((len(both), columns), np.float32)
            dense[row[i:j], column[i:j] - c] = 1
            out += dense[: len(left)] @ dense[len(left) :].T
    return np.rint(out).astype(np.int64)


def _alive(table: pa.Table, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of outside members and of members of other components whose signatures survive as pairs."""
    side, comp = table["outside"].to_numpy(), table["component"].to_numpy()
    sigs = _matrix(table["sig"].combine_chunks(), np.uint32)
    a, b = (x.ravel() for x in np.meshgrid(np.flatnonzero(side), np.flatnonzero(~side), indexing="ij"))
    apart = comp[a] != comp[b]
    a, b = a[apart], b[apart]
    score = np.zeros(len(a), np.int32)
    for k, need in enumerate(least):
        part = slice(k * STEP, (k + 1) * STEP)
        score += np.concatenate([(sigs[a[i : i + 8192], part] == sigs[b[i : i + 8192], part]).sum(1) for i in range(0, len(a), 8192)] or [np.zeros(0, int)]).astype(np.int32)
        alive = score >= need
        a, b, score = a[alive], b[alive], score[alive]
    return a, b


def _likely(table: pa.Table, least: list[int]) -> pa.Table:
    """The rows of one pair of blocks that are in any surviving pair, without their signatures."""
    a, b = _alive(table, least)
    return table.drop_columns(["sig"]).take(pa.array(np.union1d(a, b)))


def _blocks(table: pa.Table, least: list[int], num: int, den: int) -> pa.Table:
    """Confirmed links between outside members of a group and members of other components, for one pair of blocks.

    A link is left out where earlier links of this block join its components already.
    """
    nothing = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    ids, comp = table["id"].to_numpy(), table["component"].to_numpy()
    a, b = _alive(table, least)
    if not len(a):
        return nothing
    raw, offs = K.buffer_of(table["set"].combine_chunks().cast(pa.large_binary()))
    sets, offs = np.ascontiguousarray(raw).view(np.uint64), offs // 8
    rows, ra = np.unique(a, return_inverse=True)
    cols, cb = np.unique(b, return_inverse=True)
    own = lambda r: sets[offs[r] : offs[r + 1]]
    common = common_counts([own(r) for r in rows], [own(c) for c in cols])[ra, cb]
    size = np.diff(offs)
    good = np.flatnonzero(den * common >= num * (size[a] + size[b] - common))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            x = up
        return x

    links = []
    for k in good.tolist():
        x, y = root(int(comp[a[k]])), root(int(comp[b[k]]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            links.append(k)
    return pa.table({"a": ids[a[links]], "b": ids[b[links]]}) if links else nothing


def near_duplicates(docs: DataFrame, threshold: tuple[int, int] = (75, 100), shingle: int = 5, miss: float = 1e-5) -> DataFrame:
    """Near-duplicate component of every row of ``docs(doc_id, text, ...)``.

    Returns (doc_id, n_shingles, component_id, kept). Rows link when
    ``threshold[1] * |intersection| >= threshold[0] * |union|`` of their shingle sets;
    component_id is the smallest doc_id reachable. A null or empty text, or one of
    white space only, has no shingle and links with nothing. Rows that repeat a
    doc_id are one document: they get one component. A null doc_id is returned
    with a null component and not kept. Other columns are ignored.
    """
    spark = docs.sparkSession
    ready(spark)
    num, den = threshold
    least = least_matches(num / den, miss)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = cut(texts.mapInArrow(lambda it: _described(it, shingle), "doc_id long, n long, h1 long, h2 long, bands array<long>"))
    full = described.filter("n > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"))
    reps = full.join(classes.hint("merge"), (F.col("doc_id") == F.col("rep")) & (full["n"] == classes["n"]) & (full["h1"] == classes["h1"]) & (full["h2"] == classes["h2"]), "left_semi")
    member = reps.select(F.col("doc_id").alias("id"), F.posexplode("bands").alias("band", "key"))
    buckets = member.groupBy("band", "key").agg(F.min("id").alias("pivot"), F.count("*").alias("size")).filter("size > 1")
    inside = cut(member.join(buckets.hint("merge"), ["band", "key"]).select("band", "key", "id", "pivot"))
    # text moves once; a merge join at every size, as the ids grow with the documents
    active = cut(texts.join(inside.select(F.col("id").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi").mapInArrow(lambda it: _full(it, shingle), "id long, sig binary, set binary").filter("octet_length(set) > 0"))

    def beside(pairs: DataFrame, column: str) -> DataFrame:
        one = lambda side: active.select(F.col("id").alias(side), F.col(column).alias(f"x{side}"))
        return pairs.join(one("b"), "b").join(one("a"), "a").select("a", "b", "xa", "xb")

    stars = inside.filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    likely = beside(stars, "sig").mapInArrow(lambda it: _pruned(it, least), "a long, b long")
    ready(spark, PAIRS_PER_BATCH)
    confirmed = beside(likely, "set").mapInArrow(lambda it: _confirmed(it, num, den), "a long, b long")
    # rows that repeat a doc_id with other sets are one document: their classes are linked
    several = full.groupBy("doc_id").agg(F.min(F.struct("n", "h1", "h2")).alias("lo"), F.max(F.struct("n", "h1", "h2")).alias("hi")).filter("lo <> hi").select("doc_id")
    mine = full.select("doc_id", "n", "h1", "h2").join(several, "doc_id", "left_semi").join(classes, ["n", "h1", "h2"]).groupBy("doc_id", "rep").agg(F.count("*").alias("rows"))
    same = mine.join(mine.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").filter("a <> rep").select("a", F.col("rep").alias("b"))
    links = cut(confirmed.union(same))
    ready(spark)
    labels = connected_components(links)

    # second round: buckets that hold several components, gathered around their largest
    placed = cut(inside.join(labels.withColumnRenamed("node", "id"), "id", "left").select("band", "key", "id", F.coalesce("component", "id").alias("component")))
    sizes = placed.groupBy("band", "key", "component").agg(F.count("*").alias("size"))
    mixed = cut(
        sizes.groupBy("band", "key")
        .agg(F.max(F.struct("size", "component")).alias("top"), F.sum("size").alias("total"), F.count("*").alias("parts"))
        .filter("parts > 1")
        .select("band", "key", F.col("top.component").alias("main"), "total", (F.col("total") - F.col("top.size")).alias("out"))
    )
    rows = placed.join(mixed, ["band", "key"]).withColumn("outside", F.col("component") != F.col("main"))
    # one group for all buckets of a main component, unless that means many more comparisons than bucket by bucket
    by_main = rows.groupBy("main", "id").agg(F.max("outside").alias("outside")).groupBy("main").agg(F.count("*").alias("n_all"), F.count_if("outside").alias("n_out"))
    by_bucket = mixed.groupBy("main").agg(F.sum(F.col("total") * F.col("out")).alias("one_by_one"))
    joint = by_main.join(by_bucket, "main").filter("n_all * n_out <= 4 * one_by_one").select("main", F.lit(True).alias("joint"))
    # decided for each bucket, so that a large component's rows stay dealt by bucket
    group = F.when(F.col("joint"), F.col("main")).otherwise(F.xxhash64("band", "key"))
    dealt = mixed.join(joint, "main", "left").select("band", "key", "main", group.alias("g"), F.coalesce("joint", F.lit(False)).alias("joint"))
    keyed = placed.join(dealt, ["band", "key"]).select("g", "joint", "id", "component", (F.col("component") != F.col("main")).alias("outside"))
    single = cut(keyed.groupBy("g", "joint", "id").agg(F.first("component").alias("component"), F.max("outside").alias("outside")))
    blocks = single.groupBy("g", "joint").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_all"), F.ceil(F.count_if("outside") / BLOCK).cast("int").alias("n_out"))
    whole = single.join(blocks, ["g", "joint"]).join(active.select("id", "sig"), "id")
    fields = ["g", "joint", "id", "component", "sig"]
    as_out = whole.filter("outside").select(*fields, F.lit(True).alias("outside"), F.pmod(F.hash("id"), "n_out").alias("i"), F.explode(F.sequence(F.lit(0), F.col("n_all") - 1)).alias("j"))
    as_any = whole.select(*fields, F.lit(False).alias("outside"), F.explode(F.sequence(F.lit(0), F.col("n_out") - 1)).alias("i"), F.pmod(F.hash("id"), "n_all").alias("j"))
    block = ["g", "joint", "i", "j"]
    plain = [f for f in as_out.schema.fields if f.name != "sig"]
    likely = cut(as_out.union(as_any).groupBy(*block).applyInArrow(lambda t: _likely(t, least), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain)))
    # full sets move only for members of surviving pairs
    full_rows = likely.join(active, "id").select(*block, "id", "component", "outside", "sig", "set")
    found = cut(full_rows.groupBy(*block).applyInArrow(lambda t: _blocks(t, least, num, den), "a long, b long"))
    if not found.isEmpty():
        old = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
        joins = cut(found.join(old("a"), "a", "left").join(old("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).distinct())
        newer = connected_components(joins).select(F.col("node").alias("component"), F.col("component").alias("newer"))
        # a node of its own until now is its component's name; it has no row in labels
        alone = newer.join(labels.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("node"), F.col("newer").alias("component"))
        labels = cut(labels.join(newer, "component", "left").select("node", F.coalesce("newer", "component").alias("component")).union(alone))

    owner = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("n", "h1", "h2", F.coalesce("component", "rep").alias("group"))
    grouped = described.select("doc_id", "n", "h1", "h2").join(owner, ["n", "h1", "h2"], "left")
    return grouped.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("group", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("group", "doc_id"), F.lit(False)).alias("kept"),
    )


#: The same over ``documents`` as DuckDB SQL, by counting common shingles of all pairs of distinct sets.
ORACLE_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END)) AS sh FROM w),
d AS (SELECT doc_id, len(sh) AS n, md5(array_to_string(sh, chr(10))) AS digest, sh FROM s),
c AS (SELECT n, digest, min(doc_id) AS rep, any_value(sh) AS sh FROM d WHERE n > 0 GROUP BY n, digest),
x AS (SELECT rep, n, unnest(sh) AS g FROM c),
e AS (SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
u AS (SELECT a AS p, b AS q FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT p AS node, p AS seen FROM u UNION SELECT r.node, u.q FROM r JOIN u ON u.p = r.seen),
k AS (SELECT node, min(seen) AS component FROM r GROUP BY node)
SELECT d.doc_id, d.n::BIGINT AS n_shingles, coalesce(k.component, c.rep, d.doc_id) AS component_id, d.doc_id = coalesce(k.component, c.rep, d.doc_id) AS kept
FROM d LEFT JOIN c ON c.n = d.n AND c.digest = d.digest LEFT JOIN k ON k.node = c.rep"""
