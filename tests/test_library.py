"""Lookups, backends, builds and pipelines on small worked fixtures."""

import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import backends
from tessera.functions.phrases import Phrases
from tessera.operators import graph, lookup, rhetoric, similarity
from tessera.pipeline import Knowledge, Pipeline
from tessera.sources import builds, readers


def test_phrases_as_regular_expressions():
    patterns = [r"\bkant\b", r"\bphenomenolog", "道", r"merleau\-ponty", r"a.c", "kant", "gone"]
    phrases = Phrases(patterns)
    for text in ("kant and kantian", "phenomenology", "xkant", "道家", "merleau-ponty abc", "", "kant"):
        assert phrases.found(text) == [i for i, p in enumerate(patterns) if re.search(p, text)]
    assert Phrases([]).found("x") == []


def test_mentions_as_by_brute_force(spark):
    labels = {"a": "mind", "b": "mind-body", "c": "mind", "d": "aa aa", "e": "心", "f": ""}
    docs = [(1, "Mind, mind-body and a remind; MIND"), (2, "aa aa aa aa aa"), (3, "心と心"), (4, ""), (5, None)]
    df = spark.createDataFrame(docs, "id int, t string")
    want = {(i, c, m.start(), m.end()) for i, t in docs if t for c, x in labels.items() if x for m in re.finditer(rf"\b{re.escape(x)}\b", t.lower())}
    table = spark.createDataFrame([*labels.items(), (None, "x"), ("g", None)], "concept_id string, label string")
    for given in (labels, table):
        assert {(r.id, r.concept_id, r.start, r.end) for r in rhetoric.keyword_spans(df, "t", "id", given).collect()} == want
    first = {(r.id, r.concept_id, r.start) for r in rhetoric.first_mentions(df, "t", "id", labels).collect()}
    assert first == {(i, c, t.lower().find(x)) for i, t in docs if t for c, x in labels.items() if x and x in t.lower()}
    assert rhetoric.keyword_spans(df, "t", "id", table.limit(0)).count() == 0 and rhetoric.keyword_spans(df.limit(0), "t", "id", labels).count() == 0


def test_mentions_are_handed_on_in_bounded_parts(spark, monkeypatch):
    monkeypatch.setattr(rhetoric, "MENTIONS", 50)
    texts = pd.DataFrame({"id": [1, 2, 3], "t": ["mind and body " * 200, "", "no mind " * 7]})
    parts = list(rhetoric._places(iter([texts, texts[2:]]), "id", ["mind", "body"], True))
    assert max(map(len, parts)) <= 50 and sum(map(len, parts)) == 414
    # Many concepts of one label do not go through Python.
    labels = spark.range(3000).selectExpr("cast(id as string) as concept_id", "if(id % 2 = 0, 'Mind', 'body') as label")
    spans = rhetoric.keyword_spans(spark.createDataFrame(texts), "t", "id", labels)
    assert spans.count() == 1500 * 407 and spans.distinct().count() == 1500 * 407


def test_filters_and_keys(spark):
    df = spark.createDataFrame([("1", "de", "s"), ("2", "en", None), ("3", None, "s")], "id string, lang string, school string")
    assert [r.id for r in lookup.filter_by(df, lang="de", school="").collect()] == ["1"]
    assert lookup.filter_by(df, lang=None, school=[]).count() == 3
    assert [r.ID for r in lookup.select_keys(df.withColumnRenamed("id", "ID"), ["1", "9"], "id", ["id"]).collect()] == ["1"]
    with pytest.raises(ValueError):
        lookup.select_keys(df, ["1"], "id; drop", ["id"])
    assert lookup.info(df, "id", "none").count() == 0
    rows = {r.id: r.tradition for r in lookup.with_tradition(df.withColumn("school", F.lit("Jain")).unionByName(df), "school").where("school = 'Jain' or id = '2'").collect()}
    assert rows == {"1": "South Asian", "2": "Unknown", "3": "South Asian"} or rows["1"] == "South Asian"


def test_correlations_of_ties_and_constants(spark):
    rows = [("g", 1.0, 1.0), ("g", 2.0, 2.0), ("g", 2.0, 8.0), ("g", None, 3.0), ("c", 1.0, 5.0), ("c", 1.0, 6.0)]
    got = {r.k: r for r in lookup.correlations(spark.createDataFrame(rows, "k string, x double, y double"), "x", "y", ["k"]).collect()}
    assert got["g"].n == 3 and got["g"].spearman == pytest.approx(0.866025) and got["c"].pearson is None


def test_novelty_against_the_preceding(spark):
    usages = spark.createDataFrame([(1, "t", 1), (2, "t", 2), (3, "u", 3)], "id bigint, term string, at int")
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 1, 0.9), (3, 1, 0.5)], "query_id bigint, other_id bigint, similarity double")
    assert {r.id: r.novelty for r in lookup.preceding_novelty(pairs, usages, "term", "at").collect()} == {1: 1.0, 2: 0.1, 3: 1.0}


def test_resolution(spark):
    schema = "uid string, node_type string, label string, labels_i18n map<string,string>, external_ids map<string,string>, provenance array<string>, birth_year int, death_year int"
    rows = [("a", "T", "Immanuel Kant", {"en": "Kant"}, {"w": "Q1"}, ["x"], 1724, 1804), ("b", "T", "Kant, I.", {"de": "Kant"}, {"w": "Q1"}, ["y"], None, None), ("c", "T", "Immanuel Kant ", None, None, None, 1725, 1804), ("d", "T", "Hegel", None, None, ["z"], 1770, 1831)]
    nodes = spark.createDataFrame(rows, schema)
    pairs, classes = lookup.resolution(nodes)
    assert {(r.kind, r.a, r.b) for r in pairs.collect()} == {("external_id", "a", "b"), ("label", "a", "c"), ("life_span", "1724-1804", "1725-1804")}
    merged = {r.uid: r for r in lookup.resolved(nodes, classes).collect()}
    assert set(merged) == {"a", "d"} and merged["a"].labels_i18n == {"en": "Kant", "de": "Kant"} and merged["a"].provenance == ["x", "y"]
    assert lookup.resolution(nodes.limit(0))[0].count() == 0


def test_embedding_cache_and_registries(spark, tmp_path):
    docs = spark.createDataFrame([(1, "being and time"), (2, "being and time"), (3, None), (4, "")], "id int, t string")
    path = str(tmp_path / "cache")
    first = {r.id: r.embedding for r in backends.embed_cached(docs, "t", path, dim=16).collect()}
    again = {r.id: r.embedding for r in backends.embed_cached(docs, "t", path, dim=16).collect()}
    assert first == again and first[1] == first[2] and first[3] is None and spark.read.parquet(path).count() == 2
    backends.EMBEDDERS.register("hashing", None)
    backends.EMBEDDERS.register("other", backends.hashing)
    assert backends.EMBEDDERS.get("hashing") is backends.hashing and "other" in backends.EMBEDDERS.available()
    with pytest.raises(ValueError):
        backends.EMBEDDERS.get("none")
    f = docs.select(backends.faceted(F.col("t"), F.col("t"), F.lit("x"), dim=8).alias("f")).first().f
    assert len(f.definition) == 8 and f.definition == f.usage


def test_fetch_from_several_sources(spark):
    one = spark.createDataFrame([("a", "T"), ("b", "U"), (None, "V")], "id string, title string")

    def broken(limit):
        raise OSError("unreachable")

    registry = spark.createDataFrame([("b", "x", None)], "id string, source string, fetched_at timestamp")
    docs, after = builds.fetch_all({"one": lambda n: one, "broken": broken, "two": lambda n: one.where("id = 'a'").drop("title")}, registry)
    assert sorted((r.id or "", r.source) for r in docs.collect()) == [("", "one"), ("a", "one"), ("a", "two")]
    assert {r.id for r in after.collect()} == {"a", "b"}
    assert builds.fetch_all({"broken": broken}, registry)[0] is None
    assert len(builds.collection_plan(["daoism", "kyoto_school"], ["ja"])) == 5


def test_builds(spark):
    groups = spark.createDataFrame([(1, "west", "Western", None, None, None), (2, "greek", "Greek", None, "west", "greece")], "seq int, id string, name_en string, name_ja string, parent string, region string")
    schools = spark.createDataFrame([(1, "stoic", "Stoic", None, "greek", "-300 ~ 200", None), (2, "stoic", "Again", None, "west", "", None), (3, "greek", "No", None, "west", None, None)], "seq int, id string, name_en string, name_ja string, parent string, era string, region string")
    rows = {r.tradition_id: r for r in builds.traditions_table(groups, schools).collect()}
    assert set(rows) == {"west", "greek", "stoic"} and rows["stoic"].era_start == -300 and rows["stoic"].name_en == "Stoic" and rows["greek"].name_en == "Greek"
    concepts = spark.createDataFrame([("c", " a ", ""), ("c", " a ", ""), (None, "x", "y")], "concept_id string, label_en string, era string")
    (c,) = builds.concepts_table(concepts).collect()
    assert (c.label_en, c.era, c.inpho_id) == ("a", None, None)
    assert builds.read(spark, "daodejing").shape() == (3, 1)
    with pytest.raises(ValueError):
        builds.read(spark, "nothing")
    with pytest.raises(ValueError):
        builds.export(concepts, "rds", "/tmp/x")


def test_pipeline_and_knowledge(spark):
    docs = spark.createDataFrame([(1, "being and time"), (2, "time and being"), (3, "a stone")], "id bigint, t string")
    made = Pipeline(docs).embed("t", dim=32).quantify("t", ["plain"])
    assert {r.id: r.plain_n_tokens for r in made.result.collect()} == {1: 3, 2: 3, 3: 2}
    (hit,) = made.search(made.result.where("id = 1"), k=1).result.collect()
    assert hit.other_id == 2 and hit.similarity == pytest.approx(1.0)
    nodes = spark.createDataFrame([(x, "Concept") for x in "abc"], "uid string, node_type string")
    edges = spark.createDataFrame([("a", "b", "extends"), ("b", "c", "extends"), ("a", "c", "extends")], "src string, dst string, edge_type string")
    graph_ = Knowledge(nodes, edges)
    assert [r.hops for r in graph_.paths("a", "c").collect()] == [1, 2] and graph_.neighbours("b").count() == 2
    assert graph_.node("a").count() == 1 and graph_.cluster("a").count() == 3 and graph_.summary().count() > 0


def test_large_groups_are_null_not_made_up(spark):
    edges = spark.createDataFrame([("a", f"n{i}", "extends") for i in range(5)], "src string, dst string, edge_type string")
    root = spark.createDataFrame([("a",)], "uid string")
    assert {r.centrality for r in graph.concept_cluster(edges, root, most_edges=4).collect()} == {None}
    assert {r.centrality for r in graph.concept_cluster(edges, root).collect()} == {0.0, 1.0}
    vecs = spark.createDataFrame([(i, "t", [1.0, float(i % 2)]) for i in range(6)], "seq bigint, term string, v array<double>")
    assert {r.cluster for r in similarity.meaning_clusters(vecs, "term", "seq", "v", most=5).collect()} == {None}
    assert {r.seq: r.cluster for r in similarity.meaning_clusters(vecs, "term", "seq", "v", 0.1).collect()} == {0: 0, 1: 1, 2: 0, 3: 1, 4: 0, 5: 1}


def test_more_labels_than_one_task_holds(spark):
    df = spark.createDataFrame([(i, [float(i == j) for j in range(6)]) for i in range(6)], "id int, v array<double>")
    prototypes = df.select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("label"), F.col("v").alias("centroid"))
    few, similarity.PROTOTYPES = similarity.PROTOTYPES, 2
    try:
        got = {(r.id, r["rank"], r.label) for r in similarity.classify(df, "id", "v", prototypes, 1).collect()}
    finally:
        similarity.PROTOTYPES = few
    assert got == {(i, 1, f"p{i}") for i in range(6)} == {(r.id, r["rank"], r.label) for r in similarity.classify(df, "id", "v", prototypes, 1).collect()}


def test_tags_and_date_ranges(spark):
    spans = spark.createDataFrame([("c", "t", 0, 3, 0.6)], "concept_id string, text_id string, start int, end int, confidence double")
    assert sorted(r.confidence for r in lookup.tag(spans, [("d", "t", 5, 9)]).collect()) == [0.6, 1.0]
    (r,) = lookup.date_ranges(spark.createDataFrame([("Dao", "2"), ("dao", "1"), ("DAO", None)], "term string, d string"), "term", "d").collect()
    assert (r["first"], r["last"], r.usages) == ("1", "2", 3)
    assert readers.catalogue(spark, builds.CLASSIC_WORKS, "id int, title string, author string, tradition string", "plato", ["author"]).count() == 4
