"""Filters, lookups and summaries of collections, interpretations and merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.lexicons import SCHOOLS
from tessera.functions.vectors import composite, cosine_eps
from tessera.operators.entities import band_pairs, best_pairs, external_id_classes, label_pairs, merge_nodes


def filter_by(df: DataFrame, **wanted: str | list[str] | None) -> DataFrame:
    """Rows that agree with all of ``wanted``: column=value, or column=list of values.  Null, empty
    texts and empty lists do not filter; null cells agree with nothing."""
    tests = [F.col(f"`{c}`").isin(*v) if isinstance(v, list) else F.col(f"`{c}`") == v for c, v in wanted.items() if v]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def select_keys(df: DataFrame, keys: list[str], keytype: str, columns: list[str] | None = None) -> DataFrame:
    """The ``columns`` of rows whose ``keytype`` is one of ``keys``; unknown columns raise."""
    names = {c.lower(): c for c in df.columns}
    missing = [c for c in (keytype, *(columns or [])) if c.lower() not in names]
    if missing:
        raise ValueError(f"no columns {missing}")
    kept = [names[c.lower()] for c in (columns or df.columns)]
    return df.where(F.col(f"`{names[keytype.lower()]}`").isin(*keys)).select(*[f"`{c}`" for c in kept])


def info(df: DataFrame, key: str, value: str) -> DataFrame:
    """The first row (by all columns in order) with that key; no row where there is none."""
    return df.where(F.col(f"`{key}`") == value).orderBy(*[f"`{c}`" for c in df.columns]).limit(1)


def commentaries(df: DataFrame, ref: str | None = None, commentator: str | None = None) -> DataFrame:
    """Commentaries on a reference, by a commentator, or both."""
    return filter_by(df, source_ref=ref, commentator=commentator)


def interpreters_for(df: DataFrame, ref: str) -> DataFrame:
    """(interpreter): distinct interpreters of a reference."""
    return df.where(F.col("source_ref") == ref).select("interpreter").where("interpreter is not null").distinct()


def with_tradition(df: DataFrame, school: str, known: dict[str, list[str]] | None = None) -> DataFrame:
    """``df`` with tradition: that of the school, or Unknown.  A column tradition is replaced."""
    rows = [(s, t) for t, schools in (known or SCHOOLS).items() for s in schools]
    table = df.sparkSession.createDataFrame(rows, "__school string, __tradition string")
    joined = df.drop("tradition").join(F.broadcast(table), F.col(f"`{school}`") == F.col("__school"), "left")
    return joined.withColumn("tradition", F.coalesce("__tradition", F.lit("Unknown"))).drop("__school", "__tradition")


def collection_summary(cells: DataFrame, assay: str = "assay_name", concept: str = "concept_idx", text: str = "text_idx") -> DataFrame:
    """(assay_name, n_concepts, n_texts, n_cells): one row per assay of a long collection."""
    return cells.groupBy(F.col(f"`{assay}`").alias("assay_name")).agg(F.countDistinct(concept).alias("n_concepts"), F.countDistinct(text).alias("n_texts"), F.count(F.lit(1)).alias("n_cells"))


def distinct_values(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """(by..., values): sorted distinct values of a column per group, without null and empty ones."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_set(F.nullif(F.col(f"`{column}`"), F.lit("")))).alias("values"))


def text_statistics(df: DataFrame, text: str) -> DataFrame:
    """``df`` with char_count and line_count (line feeds); null texts count nothing."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return df.withColumn("char_count", F.length(t)).withColumn("line_count", F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))))


def merge_statistics(old_nodes: DataFrame, new_nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(nodes_added, nodes_merged, edges_added) of an ingest into a graph."""
    new, old = new_nodes.select("uid").where("uid is not null").distinct(), old_nodes.select("uid").distinct().withColumn("held", F.lit(1))
    counts = new.join(old, "uid", "left").agg(F.count(F.when(F.col("held").isNull(), 1)).alias("nodes_added"), F.count("held").alias("nodes_merged"))
    return counts.withColumn("one", F.lit(1)).join(edges.agg(F.count(F.lit(1)).alias("edges_added")).withColumn("one", F.lit(1)), "one").drop("one")


def _corr(x: str, y: str) -> Column:
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlations(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by..., n, pearson, spearman) of two columns per group, ranks of ties averaged; null where a side
    is constant.  Rows with a null on either side do not count.

    Ranks come from counts of distinct values, so a group is never sorted as a whole."""
    rows = df.select(*by, F.col(f"`{x}`").cast("double").alias("x"), F.col(f"`{y}`").cast("double").alias("y")).where("x is not null and y is not null")
    for c in ("x", "y"):
        counts = rows.groupBy(*by, c).agg(F.count(F.lit(1)).alias("n"))
        below = Window.partitionBy(*by).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
        ranks = counts.withColumn(f"r{c}", F.coalesce(F.sum("n").over(below), F.lit(0)) + (F.col("n") + 1) / 2).drop("n")
        rows = rows.join(ranks, [*by, c])
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(_corr("x", "y"), 6).alias("pearson"), F.round(_corr("rx", "ry"), 6).alias("spearman"))


def mean_of(columns: list[str]) -> Column:
    """Mean of several columns without the null ones; null where all are."""
    known = F.array_compact(F.array(*[F.col(f"`{c}`").cast("double") for c in columns]))
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.size(known))


def date_ranges(df: DataFrame, term: str, date: str) -> DataFrame:
    """(term, first, last, usages): span of the dates of each term, regardless of its case; null dates
    count as usages only."""
    return df.groupBy(F.lower(F.col(f"`{term}`")).alias("term")).agg(F.min(date).alias("first"), F.max(date).alias("last"), F.count(F.lit(1)).alias("usages"))


def label_maps(labels: Column) -> Column:
    """struct(label_map, alternatives): an array of (lang, text, primary) as a map of primary labels and
    a map of arrays of the others; the last primary label of a language holds."""
    primary = F.filter(labels, lambda x: x["primary"])
    others = F.filter(labels, lambda x: ~x["primary"])
    langs = lambda xs: F.array_distinct(F.transform(xs, lambda x: x["lang"]))
    last = F.transform(langs(primary), lambda k: F.struct(k.alias("lang"), F.element_at(F.transform(F.filter(primary, lambda x: x["lang"] == k), lambda x: x["text"]), -1).alias("text")))
    grouped = F.transform(langs(others), lambda k: F.struct(k.alias("lang"), F.transform(F.filter(others, lambda x: x["lang"] == k), lambda x: x["text"]).alias("texts")))
    return F.struct(F.map_from_entries(last).alias("label_map"), F.map_from_entries(grouped).alias("alternatives"))


def tag(spans: DataFrame, rows: list[tuple[str, str, int, int]]) -> DataFrame:
    """Spans with manual ones (concept_id, text_id, start, end) added, at confidence 1."""
    more = spans.sparkSession.createDataFrame(rows, "concept_id string, text_id string, start int, end int").withColumn("confidence", F.lit(1.0))
    return spans.unionByName(more, allowMissingColumns=True)


def disambiguate(mentions: DataFrame, candidates: DataFrame, threshold: float = 0.55) -> DataFrame:
    """(mention_id, concept_id, confidence): the concept each mention means.

    ``mentions``: (mention_id, surface, vec) with a vector of the context; ``candidates``: (surface,
    concept_id, vec) with a vector of the definition.  A single candidate has 0.8, else the nearest one
    has its cosine, ties to the smaller id; below ``threshold`` a mention means nothing."""
    named = candidates.select(F.lower("surface").alias("s"), "concept_id", F.col("vec").alias("d")).distinct()
    counts = named.groupBy("s").agg(F.countDistinct("concept_id").alias("n"))
    met = mentions.select("mention_id", F.lower("surface").alias("s"), F.col("vec").alias("c")).join(named.join(counts, "s"), "s")
    scored = met.select("mention_id", "concept_id", F.when(F.col("n") == 1, 0.8).otherwise(F.round(cosine_eps(F.col("c"), F.col("d")), 6)).alias("score"))
    best = scored.groupBy("mention_id").agg(F.max(F.struct("score")).alias("m"), F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("score"), "concept_id")))[0].alias("b"))
    return best.select("mention_id", F.col("b.concept_id").alias("concept_id"), F.col("m.score").alias("confidence")).where(F.col("confidence") >= threshold)


def analogues(concepts: DataFrame, anchor: str, tradition: str, top_k: int = 5) -> DataFrame:
    """(concept_id, score, rank): the concepts of a tradition most like ``anchor`` by the composite of
    their facets, without itself.  ``concepts``: (concept_id, tradition, definition, usage, relational)."""
    whole = concepts.select("concept_id", "tradition", composite(F.col("definition"), F.col("usage"), F.col("relational")).alias("w"))
    own = whole.where(F.col("concept_id") == anchor).select(F.col("w").alias("own")).limit(1)
    others = whole.where((F.col("tradition") == tradition) & (F.col("concept_id") != anchor))
    scored = others.withColumn("one", F.lit(1)).join(F.broadcast(own.withColumn("one", F.lit(1))), "one").select("concept_id", F.round(cosine_eps(F.col("w"), F.col("own")), 6).alias("score"))
    best = scored.orderBy(F.desc("score"), "concept_id").limit(top_k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "concept_id")))


def preceding_novelty(pairs: DataFrame, usages: DataFrame, term: str, order: str) -> DataFrame:
    """(id, novelty): one less the greatest similarity of each usage to any earlier one of its term; 1
    for the first.  ``pairs``: (query_id, other_id, similarity); ``usages``: (id, term, order)."""
    place = lambda c: usages.select(F.col("id").alias(c), F.col(f"`{term}`").alias(f"{c}_term"), F.col(f"`{order}`").alias(f"{c}_at"))
    met = pairs.join(place("query_id"), "query_id").join(place("other_id"), "other_id").where("query_id_term = other_id_term and other_id_at < query_id_at")
    best = met.groupBy(F.col("query_id").alias("id")).agg(F.max("similarity").alias("s"))
    return usages.select("id").join(best, "id", "left").select("id", F.round(1 - F.greatest(F.coalesce("s", F.lit(0.0)), F.lit(0.0)), 6).alias("novelty"))


def resolution(nodes: DataFrame, merge_at: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(pairs, classes) of nodes (uid, node_type, label, external_ids, birth_year, death_year) that are
    one entity: by shared external ids (score 1), like labels and close life spans (0.8).

    ``pairs``: (kind, a, b, score) between class representatives: the first uid of an external-id class
    or label, the life spans as ``birth-death``.  ``classes``: (uid, class_id) of the nodes that reach
    ``merge_at``; scores of labels count, life spans alone never do."""
    ids = external_id_classes(nodes)
    by_id = ids.where("uid <> class_id").select(F.lit("external_id").alias("kind"), F.col("class_id").alias("a"), F.col("uid").alias("b"), F.lit(1.0).alias("score"))
    first = nodes.groupBy("node_type", F.lower(F.trim("label")).alias("l")).agg(F.min("uid").alias("uid"))
    like = label_pairs(nodes)
    named = like.join(first.select("node_type", F.col("l").alias("label_a"), F.col("uid").alias("x")), ["node_type", "label_a"]).join(first.select("node_type", F.col("l").alias("label_b"), F.col("uid").alias("y")), ["node_type", "label_b"])
    by_label = best_pairs(named, "x", "y", "similarity").select(F.lit("label").alias("kind"), "a", "b", "score")
    same = nodes.join(first.withColumnRenamed("uid", "a"), (nodes["node_type"] == first["node_type"]) & (F.lower(F.trim(nodes["label"])) == first["l"])).where(F.col("uid") != F.col("a")).select(F.lit("label").alias("kind"), "a", F.col("uid").alias("b"), F.lit(1.0).alias("score"))
    span = lambda b, d: F.concat_ws("-", F.col(b).cast("string"), F.col(d).cast("string"))
    lives = band_pairs(nodes, "birth_year", "death_year").select(F.lit("life_span").alias("kind"), span("birth_a", "death_a").alias("a"), span("birth_b", "death_b").alias("b"), "score")
    pairs = by_id.unionByName(by_label).unionByName(same).unionByName(lives)
    from tessera.operators.components import components

    strong = by_id.unionByName(by_label).unionByName(same).where(F.col("score") >= merge_at)
    return pairs, components(strong, "a", "b").select(F.col("node").alias("uid"), F.col("root").alias("class_id"))


def resolved(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """One node per entity: members are merged into the first of their class in order of uid."""
    to = nodes.join(classes, "uid", "left").withColumn("into", F.coalesce("class_id", "uid"))
    heads = to.where(F.col("uid") == F.col("into")).drop("class_id", "into")
    rest = to.where(F.col("uid") != F.col("into"))
    maps = rest.groupBy(F.col("into").alias("uid")).agg(
        F.min_by("label", "uid").alias("label"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("provenance", F.array().cast("array<string>")))))).alias("provenance"),
    )
    entries = lambda c: rest.select(F.col("into").alias("uid"), F.explode(c).alias("k", "v")).groupBy("uid", "k").agg(F.max("v").alias("v")).groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias(c))
    more = maps.join(entries("labels_i18n"), "uid", "left").join(entries("external_ids"), "uid", "left")
    return merge_nodes(heads, more)
