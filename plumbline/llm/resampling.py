"""Importance resampling towards a target text: hashed n-gram features, gains of their buckets, Gumbel top-k.

A feature is a run of 1 to 3 words; its bucket is the CRC-32 of its bytes, composed
from the words' CRCs (``crcngrams``). The buckets of all documents and of all target
texts are counted; a bucket's gain is the log ratio of its smoothed shares. A
document's weight is the sum of its features' gains; with Gumbel noise from a hash
of its id, the highest scores are a draw without replacement.

Both passes read each text once, and what leaves a task is one count per bucket, or
three numbers per document. Ranks come from a range partitioning of the documents
that can be drawn, with the sizes of the ranges summed up, so no task sorts all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textkernel as K
from .crcngrams import ngram_crcs
from .session import cut, ready

BUCKETS = 10_000
#: Longest runs of words that are features.
WORDS = 3
_WORD = np.zeros(256, bool)
_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of ASCII digits and letters and of characters beyond ASCII, and its row."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = _WORD[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """Slices of rows (first, past the last) with the row of every word and, for each n, its words that begin a feature and the buckets."""
    raw, offsets = K.buffer_of(texts)
    for i, j in K.slices(offsets):
        part, at = K.LOWER[raw[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        starts, ends, row = _words(part, at)
        yield i, j, row, [(own, (crc % BUCKETS).astype(np.int64)) for own, crc in ngram_crcs(part, starts, ends, row, WORDS)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, _, kinds in _features(batch.column(0)):
            for _, bucket in kinds:
                total += np.bincount(bucket, minlength=BUCKETS)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])


def bucket_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(bucket, n) over all features of a column of texts; a null text has none. Every task sends at most one row a bucket."""
    ready(texts.sparkSession)
    return texts.select(F.col(text).cast("string")).mapInArrow(_counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame) -> np.ndarray:
    """Gain of every bucket from two tables (bucket, n): floor of 1000 times the log of the ratio of smoothed shares.

    The buckets are fixed in number, so 10,000 longs reach the driver whatever the texts' size. Without texts all gains are 0.
    """
    spark = source.sparkSession
    side = lambda df, name: df.select("bucket", F.col("n").alias(name))
    both = spark.range(BUCKETS).withColumnRenamed("id", "bucket").join(side(source, "s"), "bucket", "left").join(side(target, "t"), "bucket", "left").fillna(0, ["s", "t"])
    everything = W.partitionBy(F.lit(0))  # one row a bucket
    d = lambda c: c.cast("double")
    up = (d(F.col("t")) + 1) * (d(F.sum("s").over(everything)) + BUCKETS)
    down = (d(F.col("s")) + 1) * (d(F.sum("t").over(everything)) + BUCKETS)
    rows = both.select("bucket", F.floor(F.log(up / down) * 1000).alias("gain")).collect()
    out = np.zeros(BUCKETS, np.int64)
    out[[r["bucket"] for r in rows]] = [r["gain"] for r in rows]
    return out


def _weighed(batches: Iterator[pa.RecordBatch], gains: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        words, features, weight = (np.zeros(n, np.int64) for _ in range(3))
        for i, j, row, kinds in _features(batch.column(batch.num_columns - 1)):
            words[i:j] = np.bincount(row, minlength=j - i)
            for own, bucket in kinds:
                at = row[own]
                features[i:j] += np.bincount(at, minlength=j - i)
                sums = np.concatenate(([0], np.cumsum(gains[bucket])))
                weight[i:j] += sums[np.searchsorted(at, np.arange(j - i), "right")] - sums[np.searchsorted(at, np.arange(j - i))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(words), pa.array(features), pa.array(weight)], [*batch.schema.names[:-1], "n_words", "n_features", "weight"])


def weigh(docs: DataFrame, gains: np.ndarray, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with n_words, n_features and weight (0 without words). Other columns are ignored."""
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(gains)
    rows = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(lambda it: _weighed(it, shared.value), f"{fields}, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """Noise of an id in thousandths: floor(-1000 ln(-ln u)), u from the first 32 bits of sha256(``seed:id``); a null id counts as empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000)


def draw(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """``scored(doc_id, n_words, score, ...)``, a written table, with rank: 1, 2, 3... for the drawn documents by falling score, null for the rest.

    Of the N documents with at least ``least_words`` words, floor(percent * N / 100) are drawn; ties go to the smaller doc_id
    (a null id first), equal rows are told apart by their other columns. A quantile's guaranteed error bounds the rows that can be drawn from above, so about
    ``percent`` of them are partitioned by range and sorted; the exact counts of the ranges give the ranks.
    """
    able = scored.filter(F.col("n_words") >= least_words)
    accuracy = 10_000
    top, n = able.agg(F.percentile_approx("score", F.lit(max(0.0, 1 - percent / 100 - 2 / accuracy)), F.lit(accuracy)), F.count("*")).first()
    wanted = n * percent // 100
    if not wanted:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    likely = (F.col("n_words") >= least_words) & (F.col("score") >= top)
    if scored.filter(likely).count() < wanted:  # never seen; the bound is guaranteed by the sketch
        likely = F.col("n_words") >= least_words
    rest = [c for c in scored.columns if c not in ("score", "doc_id")]
    order = [F.col("score").desc(), F.col("doc_id").asc(), *(F.col(c).asc() for c in rest)]
    ranges = max(1, int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut(scored.filter(likely).repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()))
    before = dealt.groupBy("__range").agg(F.count("*").alias("n")).withColumn("__before", F.sum("n").over(W.orderBy("__range")) - F.col("n")).select("__range", "__before")  # a row a range
    placed = dealt.join(F.broadcast(before), "__range").withColumn("rank", F.col("__before") + F.row_number().over(W.partitionBy("__range").orderBy(*order)))
    drawn = placed.select(*scored.columns, F.when(F.col("rank") <= wanted, F.col("rank")).cast("long").alias("rank"))
    return drawn.union(scored.filter(~F.coalesce(likely, F.lit(False))).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """Draw ``percent`` of ``docs(doc_id, text)`` towards ``target(text)``: (doc_id, n_features, weight, score, rank), one row per document.

    A text that is null, empty or without words has no features, weight 0 and is never drawn, as no text under
    ``least_words`` words is. Repeated rows are rows of their own. An empty table gives an empty result; without target
    texts the target's shares are even. Columns of ``docs`` other than doc_id and text are ignored.
    """
    gains = bucket_gains(bucket_counts(docs), bucket_counts(target))
    weighed = weigh(docs, gains, ["doc_id"])
    scored = cut(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))
    return draw(scored, percent, least_words).select("doc_id", "n_features", "weight", "score", "rank")


def oracle_sql(percent: int = 5, least_words: int = 20, seed: int = 42) -> str:
    """The same in DuckDB SQL, with strings and a byte-wise CRC: small tables only."""
    return f"""WITH RECURSIVE t8 AS (SELECT i AS i, i AS c, 0 AS k FROM range(256) AS r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM t8 WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM t8 WHERE k = 8),
txt AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM txt),
f AS (SELECT side, id, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i+1]), list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]))) AS f FROM w),
u AS (SELECT DISTINCT f FROM f),
b AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(hex(f)) // 2), lambda i: ('0x' || substr(hex(f), 2 * i + 1, 2))::BIGINT)), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM u, tab),
n AS (SELECT side, id, bucket, count(*) AS n FROM f JOIN b USING (f) GROUP BY ALL),
c AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE side = 1), 0)::DOUBLE AS t FROM n GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM c) + {BUCKETS}) / ((s + 1) * ((SELECT sum(t) FROM c) + {BUCKETS}))))::BIGINT AS gain FROM c),
d AS (SELECT id AS doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM n JOIN g USING (bucket) WHERE side = 0 GROUP BY id),
a AS (SELECT w.id AS doc_id, len(w.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || w.id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM w LEFT JOIN d ON d.doc_id = w.id WHERE side = 0),
r AS (SELECT *, CASE WHEN n_words >= {least_words} THEN row_number() OVER (PARTITION BY n_words >= {least_words} ORDER BY score DESC, doc_id) END AS place, (count(*) FILTER (WHERE n_words >= {least_words}) OVER ()) * {percent} // 100 AS wanted FROM a)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN place <= wanted THEN place END AS rank FROM r"""
