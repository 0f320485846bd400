"""Entity resolution: classes by shared external ids, similar labels and close life spans, and merging.

Results are classes and pairs of class representatives with membership, so copies never become all
pairs.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import components
from tessera.storage import materialize


def external_id_classes(nodes: DataFrame, uid: str = "uid", ids: str = "external_ids") -> DataFrame:
    """(uid, class_id, n_links): nodes that share a (source, id) pair, directly or through others, with
    the smallest uid of the class and the number of other nodes that share an id directly.

    Nodes that share no id are left out; null maps, keys and values do not match.
    """
    rows = nodes.select(F.col(f"`{uid}`").alias("uid"), F.explode(F.col(f"`{ids}`")).alias("k", "v")).where("uid is not null and v is not null").distinct()
    keys = rows.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("first")).where("n > 1")
    shared = materialize(rows.join(keys, ["k", "v"]), "shared")
    classes = components(shared.select("first", "uid"), "first", "uid")
    links = shared.groupBy("uid").agg(F.sum(F.col("n") - 1).cast("bigint").alias("n_links"))
    return links.join(classes, F.col("uid") == F.col("node")).select("uid", F.col("root").alias("class_id"), "n_links")


def indel_ratio(a: str, b: str) -> float:
    """1 - (insertions + deletions) / total length; 1 for two empty texts."""
    total = len(a) + len(b)
    if not total:
        return 1.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], (last + 1 if x == y else max(row[j], row[j - 1]))
    return 2 * row[-1] / total


def label_pairs(nodes: DataFrame, label: str = "label", node_type: str = "node_type", threshold: float = 0.85) -> DataFrame:
    """(node_type, label_a, label_b, similarity): pairs of different labels of one node type whose indel
    ratio is at least ``threshold``; each label stands for all nodes that bear it.

    Candidates share one of their rarest character pairs: with ratio t, d = (1 - t)(len a + len b)
    insertions and deletions spoil at most 2 d pairs of a label, and len b <= len a * t' with
    t' = (2 - t) / t, so a label needs only its 2 (1 - t)(1 + t') len + 1 rarest pairs and no match is
    missed.
    """
    labels = nodes.select(F.col(f"`{node_type}`").alias("node_type"), F.lower(F.trim(F.col(f"`{label}`"))).alias("label")).where("label <> ''").distinct()

    def grams(batches):
        for pdf in batches:
            found = [sorted({(f" {s} "[i : i + 2], f" {s} "[: i + 2].count(f" {s} "[i : i + 2])) for i in range(len(s) + 1)}) for s in pdf["label"]]
            yield pdf.assign(gram=[[f"{g}{n}" for g, n in f] for f in found]).explode("gram")

    rows = materialize(labels.mapInPandas(grams, "node_type string, label string, gram string"), "grams")
    df = rows.groupBy("node_type", "gram").agg(F.count(F.lit(1)).alias("df"))
    widest = (2 - threshold) / threshold
    keep = F.floor(F.length("label") * (2 * (1 - threshold) * (1 + widest))).cast("int") + 1
    rare = rows.join(df, ["node_type", "gram"]).groupBy("node_type", "label").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("g"))
    prefix = rare.select("node_type", "label", F.explode(F.slice("g", F.lit(1), keep)).alias("g")).select("node_type", "label", "g.gram")
    x, y = prefix.withColumnRenamed("label", "label_a"), prefix.withColumnRenamed("label", "label_b")
    met = x.join(y, ["node_type", "gram"]).where((F.col("label_a") < F.col("label_b")) & (F.length("label_b") <= F.length("label_a") * widest) & (F.length("label_a") <= F.length("label_b") * widest))

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([round(indel_ratio(x, y), 6) for x, y in zip(a, b, strict=True)], dtype="float64")

    return met.select("node_type", "label_a", "label_b").distinct().withColumn("similarity", ratio("label_a", "label_b")).where(F.col("similarity") >= threshold)


def band_pairs(lives: DataFrame, birth: str, death: str, tolerance: int = 2, score: float = 0.8) -> DataFrame:
    """(birth_a, death_a, n_a, birth_b, death_b, n_b, pairs, score): classes of equal life spans whose
    births and deaths both differ by at most ``tolerance``; a class meets itself when it has several
    members.  Null and zero years do not take part.  Joined on buckets of the birth year."""
    known = lives.select(F.col(f"`{birth}`").cast("int").alias("birth"), F.col(f"`{death}`").cast("int").alias("death")).where("birth is not null and death is not null and birth <> 0 and death <> 0")
    spans = known.groupBy("birth", "death").agg(F.count(F.lit(1)).alias("n"))
    width = tolerance + 1
    a = spans.select(F.col("birth").alias("birth_a"), F.col("death").alias("death_a"), F.col("n").alias("n_a"), F.explode(F.array(*[F.floor(F.col("birth") / width) + i for i in (0, 1)])).alias("bucket"))
    b = spans.select(F.col("birth").alias("birth_b"), F.col("death").alias("death_b"), F.col("n").alias("n_b"), F.floor(F.col("birth") / width).alias("bucket"))
    order = F.struct("birth_a", "death_a") <= F.struct("birth_b", "death_b")
    met = a.join(b, "bucket").where(order & (F.col("birth_b") - F.col("birth_a") <= tolerance) & (F.abs(F.col("death_b") - F.col("death_a")) <= tolerance))
    same = (F.col("birth_a") == F.col("birth_b")) & (F.col("death_a") == F.col("death_b"))
    pairs = F.when(same, F.col("n_a") * (F.col("n_a") - 1) / 2).otherwise(F.col("n_a") * F.col("n_b")).cast("bigint")
    return met.select("birth_a", "death_a", "n_a", "birth_b", "death_b", "n_b", pairs.alias("pairs"), F.lit(score).alias("score")).where("pairs > 0")


def best_pairs(pairs: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """(a, b, score): unordered pairs once, with their best score."""
    x, y = F.col(f"`{a}`"), F.col(f"`{b}`")
    return pairs.where(x != y).groupBy(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).agg(F.max(score).alias("score"))


def merge_maps(old: Column, new: Column) -> Column:
    """Union of two maps; entries of the second win; null maps are empty."""
    o, n = F.coalesce(old, F.create_map().cast("map<string,string>")), F.coalesce(new, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(o, lambda k, _: ~F.map_contains_key(n, k)), n)


def merge_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keyed merge of (uid, label, labels_i18n, external_ids, provenance): new map entries override,
    provenance is a union, single values of known nodes stay."""
    n = new.select("uid", F.struct("label", "labels_i18n", "external_ids", "provenance").alias("n"))
    o = old.select("uid", F.struct("label", "labels_i18n", "external_ids", "provenance").alias("o"))
    joined = o.join(n, "uid", "full")
    return joined.select(
        "uid",
        F.coalesce("o.label", "n.label").alias("label"),
        merge_maps(F.col("o.labels_i18n"), F.col("n.labels_i18n")).alias("labels_i18n"),
        merge_maps(F.col("o.external_ids"), F.col("n.external_ids")).alias("external_ids"),
        F.array_sort(F.array_union(F.coalesce("o.provenance", F.array().cast("array<string>")), F.coalesce("n.provenance", F.array().cast("array<string>")))).alias("provenance"),
    )
