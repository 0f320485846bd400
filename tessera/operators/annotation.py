"""Spans, annotations, interpretations and commentary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlapping(spans: DataFrame, text_id: str, start: int, end: int) -> DataFrame:
    """Spans of a text that overlap [start, end); touching is no overlap."""
    return spans.where((F.col("text_id") == text_id) & (F.col("start") < end) & (F.col("end") > start))


def overlap_join(spans: DataFrame, queries: DataFrame, width: int = 256) -> DataFrame:
    """(query_id, text_id, concept_id, start, end): spans that overlap the ranges of ``queries``
    (query_id, text_id, q_start, q_end).  Both sides are cut into cells of ``width`` so that the join is
    on equal cells; a match counts in the cell where the later of both starts lies.  Empty ranges and
    spans overlap nothing."""
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width)))
    s = spans.where("start < end").select("text_id", "concept_id", "start", "end", cells("start", "end").alias("cell"))
    q = queries.where("q_start < q_end").select("query_id", "text_id", "q_start", "q_end", cells("q_start", "q_end").alias("cell"))
    met = s.join(q, ["text_id", "cell"]).where((F.col("start") < F.col("q_end")) & (F.col("end") > F.col("q_start")) & (F.col("cell") == F.floor(F.greatest("start", "q_start") / width)))
    return met.select("query_id", "text_id", "concept_id", "start", "end")


def filter_spans(spans: DataFrame, texts: list[str] | None = None, concepts: list[str] | None = None, interpretations: list[str] | None = None) -> DataFrame:
    """Spans in the given texts, of the given concepts and interpretations; null or empty lists do not filter."""
    tests = [F.col(c).isin(*v) for c, v in (("text_id", texts), ("concept_id", concepts), ("interpretation_id", interpretations)) if v]
    return spans.where(reduce(lambda a, b: a & b, tests)) if tests else spans


def count_matrix(spans: DataFrame) -> DataFrame:
    """(concept_id, text_id, n): the count matrix in long form; absent cells are 0."""
    return spans.groupBy("concept_id", "text_id").agg(F.count(F.lit(1)).alias("n"))


def wide(counts: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """Long counts as a table with one column for each of ``columns``; absent cells are 0."""
    return counts.groupBy(row).pivot(column, columns).agg(F.sum(value)).fillna(0)


def reading_conflicts(df: DataFrame, ref: str, reading: str) -> DataFrame:
    """(ref, reading_a, reading_b, n_a, n_b, conflicts): pairs of different readings of one reference,
    with how many interpretations hold each; membership is the input itself.  Nulls conflict with
    nothing."""
    counts = df.select(F.col(f"`{ref}`").alias("ref"), F.col(f"`{reading}`").alias("reading")).where("ref is not null and reading is not null").groupBy("ref", "reading").agg(F.count(F.lit(1)).alias("n"))
    a = counts.select("ref", F.col("reading").alias("reading_a"), F.col("n").alias("n_a"))
    b = counts.select("ref", F.col("reading").alias("reading_b"), F.col("n").alias("n_b"))
    return a.join(b, "ref").where("reading_a < reading_b").withColumn("conflicts", F.col("n_a") * F.col("n_b"))


def debate_summary(df: DataFrame, ref: str, school: str, reading: str) -> DataFrame:
    """(ref, interpretations, schools, readings, conflicts): one row per reference; an empty or null
    school is unspecified.  Conflicts are pairs of interpretations whose readings differ."""
    rows = df.select(F.col(f"`{ref}`").alias("ref"), F.coalesce(F.nullif(F.col(f"`{school}`").cast("string"), F.lit("")), F.lit("unspecified")).alias("school"), F.col(f"`{reading}`").alias("reading")).where("ref is not null")
    counts = rows.groupBy("ref", "reading").agg(F.count(F.lit(1)).alias("n"))
    pairs = counts.groupBy("ref").agg(F.sum("n").alias("interpretations"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.array_sort(F.collect_set("reading")).alias("readings"))
    schools = rows.groupBy("ref").agg(F.countDistinct("school").alias("schools"))
    conflicts = ((F.col("interpretations") * F.col("interpretations") - F.col("squares")) / 2).cast("bigint")
    return pairs.join(schools, "ref").select("ref", F.col("interpretations").cast("bigint").alias("interpretations"), "schools", "readings", conflicts.alias("conflicts"))


def label_agreement(df: DataFrame, item: str, label: str) -> DataFrame:
    """(pairs, agreeing, observed, expected, alpha) over all pairs within items; chance is one over the
    number of labels; alpha is 0 where chance is certain.  From counts, never from pairs."""
    rows = df.select(F.col(f"`{item}`").alias("item"), F.col(f"`{label}`").alias("label")).where("item is not null and label is not null")
    counts = rows.groupBy("item", "label").agg(F.count(F.lit(1)).alias("n"))
    items = counts.groupBy("item").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same"))
    total = items.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1)) / 2, F.lit(0)).cast("bigint").alias("pairs"), F.coalesce(F.sum("same") / 2, F.lit(0)).cast("bigint").alias("agreeing"))
    kinds = counts.agg(F.countDistinct("label").alias("labels"))
    observed, expected = F.coalesce(F.try_divide("agreeing", "pairs"), F.lit(0.0)), F.coalesce(F.try_divide(F.lit(1.0), "labels"), F.lit(1.0))
    joined = total.withColumn("one", F.lit(1)).join(kinds.withColumn("one", F.lit(1)), "one").withColumns({"o": observed, "e": expected})
    return joined.select("pairs", "agreeing", F.round("o", 6).alias("observed"), F.round("e", 6).alias("expected"), F.round(F.when(F.col("e") == 1, 0.0).otherwise(1 - (1 - F.col("o")) / (1 - F.col("e"))), 6).alias("alpha"))


def rating_agreement(df: DataFrame, item: str, rating: str) -> DataFrame:
    """(pairs, mean_difference): mean absolute difference of ratings over all pairs within items, from
    running sums over the distinct ratings of an item."""
    rows = df.select(F.col(f"`{item}`").alias("item"), F.col(f"`{rating}`").cast("double").alias("x")).where("item is not null and x is not null")
    counts = rows.groupBy("item", "x").agg(F.count(F.lit(1)).alias("n"))
    below = Window.partitionBy("item").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.select("item", "n", "x", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("k"), F.coalesce(F.sum(F.col("n") * F.col("x")).over(below), F.lit(0.0)).alias("s"))
    apart = sums.groupBy("item").agg(F.sum(F.col("n") * (F.col("k") * F.col("x") - F.col("s"))).alias("d"), F.sum("n").alias("n"))
    total = apart.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1)) / 2, F.lit(0)).cast("bigint").alias("pairs"), F.coalesce(F.sum("d"), F.lit(0.0)).alias("d"))
    return total.select("pairs", F.round(F.coalesce(F.try_divide("d", "pairs"), F.lit(0.0)), 6).alias("mean_difference"))


def annotator_counts(df: DataFrame, annotator: str) -> DataFrame:
    """(annotator, n); a missing name is unknown."""
    return df.groupBy(F.coalesce(F.col(f"`{annotator}`").cast("string"), F.lit("unknown")).alias("annotator")).agg(F.count(F.lit(1)).alias("n"))


def commentary_coverage(refs: DataFrame, commentaries: DataFrame, ref: str, source_ref: str) -> DataFrame:
    """(total, covered, pct): how many of all references have a commentary; repeated references count."""
    known = commentaries.select(F.col(f"`{source_ref}`").alias("r")).where("r is not null").distinct().withColumn("hit", F.lit(1))
    rows = refs.select(F.col(f"`{ref}`").alias("r")).join(known, "r", "left")
    totals = rows.agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("covered"))
    return totals.select("total", "covered", F.round(F.col("covered") * 100.0 / F.greatest("total", F.lit(1)), 6).alias("pct"))


def localised(labels: Column, lang: str, fallback: Column) -> Column:
    """Label in a language, else in English, else the fallback."""
    return F.coalesce(labels[lang], labels["en"], fallback)


def search_labels(df: DataFrame, labels: str, alternatives: str, text: str) -> DataFrame:
    """Rows one of whose labels contains ``text`` regardless of case, or else one of the alternatives."""
    has = lambda values: F.exists(values, lambda v: F.contains(F.lower(v), F.lit(text.lower())))
    return df.where(F.coalesce(has(F.map_values(F.col(labels))), F.lit(False)) | F.coalesce(has(F.flatten(F.map_values(F.col(alternatives)))), F.lit(False)))


def accepted_corners(corners: Column) -> Column:
    """Keys of a four-corner map whose value is true; null is not."""
    return F.array_sort(F.map_keys(F.map_filter(corners, lambda _, v: F.coalesce(v, F.lit(False)))))


def belnap_value(formula: Column) -> Column:
    """T, F, Both or Neither where the text names one of them, else null."""
    return F.nullif(F.regexp_extract(formula, r"^(T|F|Both|Neither)$", 1), F.lit(""))
