"""Layer rules: tokens that tell the wanted layers from all others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut
from . import spatial as S


def project_keys(layers: DataFrame, keys: list[str]) -> DataFrame:
    """The project of every drawing (keys, project_key, n): the leading field of the most frequent prefix of its distinct layers (two at least, else null); ties by the first layer."""
    named = layers.select(*keys, "layer").distinct().filter(F.col("layer").contains("|"))
    mode = S.first_mode(named.withColumn("prefix", F.split_part("layer", F.lit("|"), F.lit(1))), keys, "prefix", "layer")
    lead = F.nullif(F.trim(F.split_part("prefix", F.lit("-"), F.lit(1))), F.lit(""))
    return mode.select(*keys, F.when(F.col("n") >= 2, F.coalesce(lead, "prefix")).alias("project_key"), "n")


def token_candidates(layers: DataFrame, most_fields: int = 3, most_chars: int = 16) -> DataFrame:
    """Delimited fields of layer names (layer, wanted): (token, n_fields, covered, negatives).

    A token begins and ends at a delimiter ('-' or '|', one stands around every name), spans at most ``most_fields``
    fields, and is at most ``most_chars`` long; it comes from wanted layers only.
    """
    # written first: what is asked of a name's fields would else be moved below the step that makes names distinct, to every path
    marked = cut(layers.filter("layer <> ''").withColumn("name", F.concat(F.lit("|"), "layer", F.lit("|"))))
    places = F.filter(F.sequence(F.lit(1), F.length("name")), lambda i: F.substring("name", i, F.lit(1)).isin("-", "|"))
    spans = marked.filter("wanted").withColumn("places", places).select("name", F.posexplode("places").alias("p", "start"), "places")
    ends = spans.withColumn("end", F.explode(F.slice("places", F.col("p") + 2, F.lit(most_fields))))
    tokens = ends.select(F.substring("name", F.col("start"), F.col("end") - F.col("start") + 1).alias("token")).filter((F.length("token") <= most_chars) & F.col("token").rlike("[^-|]")).distinct()
    # tokens are few (bounded by the layers' fields); each is held against all names
    fields = F.greatest(F.lit(1), F.size(F.filter(F.split(F.regexp_replace("token", r"^[-|]+|[-|]+$", ""), "-"), lambda f: f != "")))
    pairs = marked.select("name", "wanted").withColumn("parts", F.array_distinct(_spans(most_fields, most_chars)))
    held = pairs.select("wanted", F.explode("parts").alias("token"))
    return held.join(tokens, "token").groupBy("token").agg(F.count_if("wanted").alias("covered"), F.count_if(~F.col("wanted")).alias("negatives")).withColumn("n_fields", fields)


def _spans(most_fields: int, most_chars: int):
    """All delimited tokens of ``name`` as an array."""
    places = F.filter(F.sequence(F.lit(1), F.length("name")), lambda i: F.substring("name", i, F.lit(1)).isin("-", "|"))
    every = F.flatten(F.transform(places, lambda s: F.transform(F.filter(places, lambda e: e > s), lambda e: F.struct(s.alias("s"), e.alias("e")))))
    near = F.filter(every, lambda x: F.size(F.filter(places, lambda q: (q > x["s"]) & (q <= x["e"]))) <= most_fields)
    return F.filter(F.transform(near, lambda x: F.substring("name", x["s"], x["e"] - x["s"] + 1)), lambda t: (F.length(t) <= most_chars) & t.rlike("[^-|]"))


def induce(layers: DataFrame, rounds: int = 20) -> list[str]:
    """Tokens that cover the wanted layers: one that covers all with the fewest other layers, else a greedy cover without others.

    Ties: fewer fields, then shorter, then by name. Layer names are a drawing set's vocabulary; only chosen tokens reach the driver.
    """
    distinct = cut(layers.groupBy("layer").agg(F.max("wanted").alias("wanted")))
    n = distinct.filter("wanted AND layer <> ''").count()
    if not n:
        return []
    best = token_candidates(distinct).filter(F.col("covered") == n).orderBy("negatives", "n_fields", F.length("token"), "token").first()
    if best:
        return [best["token"]]
    chosen: list[str] = []
    left = distinct
    for _ in range(rounds):
        best = token_candidates(left).filter("negatives = 0").orderBy(F.desc("covered"), "n_fields", F.length("token"), "token").first()
        if not best:
            break
        chosen.append(best["token"])
        left = left.filter(~(F.col("wanted") & F.concat(F.lit("|"), "layer", F.lit("|")).contains(best["token"])))
    return chosen


def calibrate(layers: DataFrame, excluded: DataFrame) -> dict:
    """A layer rule from ``layers(layer, wanted)``: tokens, and whether they may be used.

    ``excluded(layer)`` are layers known to be no pipes (text, hatch, frame). A rule whose tokens touch one of
    them is returned as not valid, with the reason; so is one without tokens.
    """
    tokens = induce(layers)
    if not tokens:
        return {"tokens": [], "valid": False, "reason": "no token tells the wanted layers from the others"}
    hit = F.lit(False)
    for t in tokens:
        hit = hit | F.concat(F.lit("|"), "layer", F.lit("|")).contains(t)
    leaks = [r["layer"] for r in excluded.filter(hit).select("layer").distinct().orderBy("layer").limit(3).collect()]
    return {"tokens": tokens, "valid": not leaks, "reason": f"also matches {', '.join(leaks)}" if leaks else ""}
