"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tokens import TOKENIZER, token_count
from tessera.storage import materialize


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n): the tokens of every document, counted once and stored."""
    return materialize(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), token_count(F.col(f"`{text}`"), tokenizer).cast("bigint").alias("n")), "sized")


def source_rates(counted: DataFrame, weights: DataFrame) -> DataFrame:
    """(source, weight_bp, max_repeat, tokens, goal, short, rate, full_rate): one row per source of
    ``weights``; ``counted`` as by ``sized``.

    ``goal`` is the weight's share of the tokens of all documents; ``short`` marks sources that miss
    it even when every document is used ``max_repeat`` times.  ``full_rate`` is how often each document
    is used on average to come as near to the goal as the cap allows: shares of other sources then
    exceed their weight.  ``rate`` is solved again for the largest total at which every source with
    tokens keeps its weight, so that the shares hold.  A source without tokens has rate 0.  Null
    weights count as 0.
    """
    per_source = materialize(counted.groupBy("source").agg(F.sum("n").alias("tokens")), "sources")
    total = per_source.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    wanted = weights.where("source is not null").groupBy("source").agg(F.coalesce(F.max("weight_bp"), F.lit(0)).alias("weight_bp"), F.coalesce(F.max("max_repeat"), F.lit(0)).alias("max_repeat"))
    rows = wanted.join(per_source, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)).cast("bigint"))
    rows = rows.withColumn("goal", F.col("weight_bp").cast("bigint") * F.lit(total).cast("bigint") / 10000)
    most = F.col("tokens") * F.col("max_repeat")
    share = rows.where("weight_bp > 0 and tokens > 0 and max_repeat > 0").agg(F.min(F.least(F.lit(1.0), most / F.col("goal")))).first()[0] or 0.0
    rate = lambda goal: F.when(F.col("tokens") > 0, F.least(F.col("max_repeat").cast("double"), goal / F.col("tokens"))).otherwise(0.0)
    return rows.select("source", "weight_bp", "max_repeat", "tokens", "goal", (most < F.col("goal")).alias("short"), rate(F.col("goal") * F.lit(share)).alias("rate"), rate(F.col("goal")).alias("full_rate"))


def mix(docs: DataFrame, rates: DataFrame, doc_id: str = "doc_id", source: str = "source", rate: str = "rate", seed: int = 29) -> DataFrame:
    """Rows of ``docs`` of the sources in ``rates``, each ``floor(rate)`` times and once more when a
    hash of its id falls below the fraction; ``copy`` numbers the uses from 1.  A column ``copy`` of
    ``docs`` is replaced."""
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(f"`{doc_id}`")), 11).cast("double") / F.lit(float(1 << 53))
    whole = F.floor("__rate").cast("int")
    uses = whole + F.when(uniform < F.col("__rate") - whole, 1).otherwise(0)
    known = rates.select(F.col("source").alias("__source"), F.col(rate).alias("__rate"))
    joined = docs.drop("copy").join(known, F.col(f"`{source}`") == F.col("__source"))
    repeated = joined.withColumn("__uses", uses).where("__uses > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__uses"))))
    return repeated.drop("__source", "__rate", "__uses")


def shares(counted: DataFrame, rates: DataFrame) -> DataFrame:
    """(source, weight_bp, max_repeat, short, docs, tokens, share_bp, full_docs, full_tokens,
    full_share_bp): what the mixtures at ``rate`` and at ``full_rate`` reach."""
    rows = rates.select("source", "weight_bp", "max_repeat", "short")
    for prefix, rate in (("", "rate"), ("full_", "full_rate")):
        got = materialize(mix(counted, rates, rate=rate).groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens")), "mixed")
        total = got.agg(F.sum("tokens")).first()[0]
        part = got.select("source", F.col("docs").alias(f"{prefix}docs"), F.col("tokens").alias(f"{prefix}tokens"), (F.col("tokens") * 10000 / F.nullif(F.lit(total), F.lit(0))).alias(f"{prefix}share_bp"))
        rows = rows.join(part, "source", "left")
    return rows.fillna(0)
