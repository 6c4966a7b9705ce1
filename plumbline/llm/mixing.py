"""Mixing sources to target weights: a token budget down a domain - language - source tree.

DataFrame functions only. Every node has a weight and a capacity (the tokens
under it times the permitted epochs). A parent's budget goes to its children in
proportion to their weights; what a child can't take goes to its siblings, again
by weight. As a parent never gets more than its children can take together, a
shortage reaches the parent's siblings only when the parent's own children are
full. Budgets are whole tokens, and each level gives out exactly its parent's.

A leaf with budget b and t tokens uses each document b div t times; one more
epoch gives the rest, as the longest prefix of a seeded order whose tokens fit
into b mod t.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .session import cut

LEVELS = ("domain", "lang", "source")
#: Documents in one bucket of a leaf's order, at most about so many.
BUCKET = 512
WORD = r"[^\x20\x09-\x0D]+"


def weight_of(level: str, weights: dict[str, int], default: int = 1) -> Column:
    """The weight of a node by its name at a level."""
    out = F.lit(default)
    for name, weight in sorted(weights.items()):
        out = F.when(F.col(level) == name, weight).otherwise(out)
    return out.cast("long")


def share_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Add ``budget`` to nodes (weight, capacity > 0, parent_budget <= sum of capacities).

    In the order of capacity / weight, the nodes that can't take their part come
    first and get their capacity; the others get the rest by weight, rounded down,
    and the tokens left by rounding go one each to the first by name.
    """
    own = W.partitionBy(*parent)
    before = own.orderBy(F.col("capacity") / F.col("weight"), name).rowsBetween(W.unboundedPreceding, -1)
    ranked = nodes.select(
        "*",
        (F.col("parent_budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))).alias("left_b"),
        (F.sum("weight").over(own) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("left_w"),
    ).withColumn("full", F.col("capacity") * F.col("left_w") <= F.col("weight") * F.col("left_b"))
    rest = ranked.select(
        "*",
        (F.col("parent_budget") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(own)).alias("rest_b"),
        F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(own).alias("rest_w"),
    )
    part = rest.withColumn("part", F.when(F.col("full"), F.col("capacity")).otherwise(F.expr("weight * rest_b div rest_w")))
    left = F.col("parent_budget") - F.sum("part").over(own)
    turn = F.row_number().over(W.partitionBy(*parent, "full").orderBy(name))
    return part.withColumn("budget", F.col("part") + F.when(~F.col("full") & (turn <= left), 1).otherwise(0)).drop("left_b", "left_w", "full", "rest_b", "rest_w", "part")


def leaf_budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], share: float, epochs: int) -> DataFrame:
    """(domain, lang, source, tokens, n_docs, budget) of every leaf with tokens and weights above 0."""
    nodes = leaves.filter("tokens > 0")
    for level in LEVELS:
        nodes = nodes.withColumn(f"w_{level}", weight_of(level, weights.get(level, {})))
    nodes = nodes.filter("w_domain > 0 AND w_lang > 0 AND w_source > 0").withColumn("capacity", F.col("tokens") * epochs)
    out = None
    for depth, level in enumerate(LEVELS):
        parent, keys = list(LEVELS[:depth]), list(LEVELS[: depth + 1])
        here = nodes.groupBy(*keys).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"), F.sum("n_docs").alias("n_docs"), F.first(f"w_{level}").alias("weight"))
        if out is None:
            target = F.floor(F.sum("tokens").over(W.partitionBy()) * F.lit(share)).cast("long")
            here = here.withColumn("parent_budget", F.least(target, F.sum("capacity").over(W.partitionBy())))
        else:
            here = here.join(out.select(*parent, F.col("budget").alias("parent_budget")), parent)
        out = share_out(here, parent, level)
    return out.select(*LEVELS, "tokens", "n_docs", "budget")


def mix_sources(docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], share: float = 0.5, epochs: int = 4, seed: str = "mix") -> DataFrame:
    """Documents to train on: (doc_id, domain, lang, source, n_tokens, repeats), repeats > 0.

    Tokens are words (runs without white space). The total budget is ``share`` of
    all tokens that carry weight, at most what ``epochs`` passes give. Weights are
    whole numbers by level and name, 1 if not given; 0 takes nothing. A null domain,
    language or source is the node ``none``. Texts that are null, empty or of white
    space have no tokens and are never chosen. Rows that repeat a doc_id count
    each; ties in the order go by doc_id, then by fewer tokens. Other columns are ignored.

    A leaf's order is cut into buckets by the leading digits of the order key, as
    many as its size asks for, so that no leaf is sorted in one task.
    """
    name = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    counted = cut(docs.select("doc_id", name(domain).alias("domain"), name(F.col("lang")).alias("lang"), name(F.col("source")).alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens")).filter("n_tokens > 0"))
    leaves = counted.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs"))
    plan = cut(leaf_budgets(leaves, weights, share, epochs).select(*LEVELS, F.expr("budget div tokens").alias("whole"), (F.col("budget") % F.col("tokens")).alias("rest"), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n_docs") / BUCKET) / 4)).cast("int").alias("digits")))
    order_key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("whole").cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = counted.join(plan, list(LEVELS)).withColumn("key", order_key).withColumn("bucket", F.expr("substring(key, 1, digits)"))
    leaf_order = W.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = rows.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("size")).withColumn("before", F.coalesce(F.sum("size").over(leaf_order), F.lit(0))).drop("size")
    inside = W.partitionBy(*LEVELS, "bucket").orderBy("key", "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, 0)
    summed = rows.withColumn("upto", F.sum("n_tokens").over(inside)).join(offsets, [*LEVELS, "bucket"])
    repeats = F.col("whole") + F.when(F.col("before") + F.col("upto") <= F.col("rest"), 1).otherwise(0)
    return summed.select("doc_id", *LEVELS, "n_tokens", repeats.cast("long").alias("repeats")).filter("repeats > 0")


def oracle_sql(documents: str, domain: str, weights: dict[str, dict[str, int]], share: float, epochs: int, seed: str) -> str:
    """The same as DuckDB SQL."""
    case = lambda level: " ".join(["CASE", *(f"WHEN {level} = '{k}' THEN {v}" for k, v in sorted(weights.get(level, {}).items(), reverse=True)), "ELSE 1 END"]) if weights.get(level) else "1"

    def level(k: int, parent_rows: str) -> str:
        keys, parent, own = ", ".join(LEVELS[: k + 1]), ", ".join(LEVELS[:k]), LEVELS[k]
        part = f"PARTITION BY {parent}" if parent else ""
        also = f"PARTITION BY {parent}, is_full" if parent else "PARTITION BY is_full"
        frame = f"{part} ORDER BY capacity::DOUBLE / weight, {own} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
        return f"""a{k} AS ({parent_rows}),
b{k} AS (SELECT *, parent_budget - coalesce(sum(capacity) OVER ({frame}), 0) AS left_b, sum(weight) OVER ({part}) - coalesce(sum(weight) OVER ({frame}), 0) AS left_w FROM a{k}),
c{k} AS (SELECT *, capacity * left_w <= weight * left_b AS is_full FROM b{k}),
d{k} AS (SELECT *, parent_budget - sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER ({part}) AS rest_b, sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({part}) AS rest_w FROM c{k}),
e{k} AS (SELECT *, CASE WHEN is_full THEN capacity ELSE (weight * rest_b) // rest_w END AS part FROM d{k}),
f{k} AS (SELECT {keys}, tokens, part + CASE WHEN NOT is_full AND row_number() OVER ({also} ORDER BY {own}) <= parent_budget - sum(part) OVER ({part}) THEN 1 ELSE 0 END AS budget FROM e{k})"""

    group = lambda k: f"SELECT {', '.join(f'n.{x}' for x in LEVELS[: k + 1])}, sum(n.capacity) AS capacity, sum(n.tokens) AS tokens, any_value(n.w_{LEVELS[k]}) AS weight"
    top = f"SELECT *, least(floor(sum(tokens) OVER () * {share}::DOUBLE)::BIGINT, sum(capacity) OVER ()) AS parent_budget FROM ({group(0)} FROM n GROUP BY ALL)"
    below = lambda k: f"{group(k)}, any_value(p.budget) AS parent_budget FROM n JOIN f{k - 1} p USING ({', '.join(LEVELS[:k])}) GROUP BY {', '.join(f'n.{x}' for x in LEVELS[: k + 1])}"
    return f"""WITH counted AS (SELECT doc_id, coalesce({domain}, 'none') AS domain, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
  len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM {documents}),
doc AS (SELECT * FROM counted WHERE n_tokens > 0),
n0 AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::BIGINT * {epochs} AS capacity FROM doc GROUP BY ALL),
n AS (SELECT * FROM (SELECT *, {case("domain")} AS w_domain, {case("lang")} AS w_lang, {case("source")} AS w_source FROM n0) WHERE w_domain > 0 AND w_lang > 0 AND w_source > 0),
{level(0, top)},
{level(1, below(1))},
{level(2, below(2))},
plan AS (SELECT domain, lang, source, (budget // tokens)::BIGINT AS whole, (budget % tokens)::BIGINT AS rest FROM f2),
summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{seed}:' || whole || ':' || doc_id), doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS upto FROM doc JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens::BIGINT AS n_tokens, (whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::BIGINT AS repeats FROM summed WHERE whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END > 0"""
