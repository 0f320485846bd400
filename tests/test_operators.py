"""Operators on small worked fixtures."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.functions import lexicons, text, vectors
from tessera.operators import alignment, annotation, entities, graph, rhetoric, similarity
from tessera.operators.components import components
from tessera.sources import readers, sinks


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_lexical(spark):
    f = one(spark, "the cat sat on the mat", lambda t: text.lexical_features(t, lexicons.ARGUMENT_MARKERS))
    assert (f.n_tokens, f.n_types, f.n_sentences) == (6, 5, 1)
    assert math.isclose(f.ttr, 5 / 6) and math.isclose(f.hapax_ratio, 4 / 5) and math.isclose(f.mean_length, 17 / 6)
    for empty in ("", None):
        assert set(one(spark, empty, lambda t: text.lexical_features(t, lexicons.ARGUMENT_MARKERS))) == {0}


def test_normalise(spark):
    rows = spark.createDataFrame([("  Hello World  ", "en"), ("λόγος", "grc"), ("道可道非常道。名可名非常名。", "lzh"), (None, "en")], "t string, l string")
    got = [r.x for r in rows.select(text.normalise(F.col("t"), F.col("l")).alias("x")).collect()]
    assert got[0] == "Hello World" and got[1] == "λογος" and "\n" in got[2] and got[3] is None


def test_eras_html_tei(spark):
    assert one(spark, "-427 ~ -347", text.era_years) == (-427, -347)
    assert one(spark, "1900 ~ present", text.era_years) == (1900, 2026)
    assert one(spark, "soon", text.era_years) is None
    assert one(spark, "<p>a &amp;lt; b</p><aside>c</aside><nav>d</nav>", text.html_text) == "a < b c"
    assert one(spark, "<TEI><head>H</head><p>a <l>b</l></p></TEI>", text.tei_text) == "H\na b\nb"
    assert one(spark, "<p>broken", text.tei_text) == "broken"


def test_argument(spark):
    docs = spark.createDataFrame([(1, "Since all men are mortal, and since Socrates is a man, therefore Socrates is mortal."), (2, ""), (3, None)], "id int, t string")
    (row,) = rhetoric.extract_arguments(docs, "t", "id", lexicons.ARGUMENT_INDICATORS["en"]).collect()
    assert row.premises == ["Since all men are mortal, and since Socrates is a man"] and row.conclusion == "Socrates is mortal"
    form = spark.createDataFrame([(["x", "y"], "z", "deductive")], "p array<string>, c string, k string").select(rhetoric.standard_form(F.col("p"), F.col("c"), F.col("k"))).first()[0]
    assert form == "P1. x\nP2. y\n---\nC.  z  [deductive]"


def test_mapping_and_relevance(spark):
    df = spark.createDataFrame([("Sublime", "aesthetics", "Design"), ("x", "a", "b")], "c string, s string, t string")
    assert [r.confidence for r in rhetoric.practical_mapping(df, "c", "s", "t").orderBy("c").collect()] == [0.85, 0.0]
    papers = spark.createDataFrame([("Kant on ethics and reason", "truth " * 50, "en"), ("Nursing", None, None), (None, "無 " * 30, "ja")], "title string, abstract string, language string")
    rows = rhetoric.relevance(papers, "title", "abstract", "language").collect()
    assert rows[0].traditions == ["kantian"] and rows[0].is_core and rows[1].excluded and rows[2].score == 35


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0])], "a array<double>, b array<double>, c array<double>")
    c = df.select(vectors.composite(F.col("a"), F.col("b"), F.col("c")).alias("x"), vectors.cosine(F.col("a"), F.expr("transform(a, x -> 0D)")).alias("z")).first()
    assert [round(v, 6) for v in c.x] == [round(v / math.sqrt(0.38), 6) for v in (0.5, 0.3, 0.2, 0.0)] and c.z == 0.0


def test_search_blocks_agree(spark):
    import random

    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(90)] + [(90, [0.0] * 5), (91, None)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    queries = df.where("id % 20 = 0")
    whole = sorted(map(tuple, similarity.search(queries, df, "id", "v", k=4).collect()))
    assert whole == sorted(map(tuple, similarity.search(queries, df, "id", "v", k=4, block=17).collect())) and len(whole) == 20


def test_monotone(spark):
    left = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0])], "k int, s bigint, v array<double>")
    right = spark.createDataFrame([(1, 0, [0.2, 0.98]), (1, 1, [0.99, 0.1])], "k int, s bigint, v array<double>")
    assert [(r.left_seq, r.right_seq) for r in similarity.monotone_align(left, right, ["k"], "s", "v").collect()] == [(0, 1)]


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, edge_type string")


def uids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "uid string")


def test_graph(spark):
    e = edges_of(spark, [("a", "b", "extends"), ("b", "c", "extends"), ("a", "c", "extends"), ("c", "a", "opposes"), ("x", "y", "extends")])
    paths = [r.path for r in graph.simple_paths(e, uids(spark, "a"), uids(spark, "c")).orderBy("hops").collect()]
    assert paths == [["a", "c"], ["a", "b", "c"]]
    assert graph.simple_paths(e, uids(spark, "q"), uids(spark, "c")).count() == 0
    assert {(r.uid, r.depth) for r in graph.bfs(e, uids(spark, "a"), None, "out").collect()} == {("a", 0), ("b", 1), ("c", 1)}
    assert graph.shortest_paths(e, uids(spark, "b"), "a").first().path == ["b", "c", "a"]
    assert graph.shortest_paths(e, uids(spark, "b"), "y").count() == 0
    assert {r.uid: r.depth for r in graph.depth_from_roots(e).collect()} == {"a": -1, "b": -1, "c": -1, "x": 0, "y": 1}
    assert {r.neighbour for r in graph.neighbours(e, uids(spark, "a"), "in").collect()} == {"c"}
    assert graph.induced_edges(e, uids(spark, "a", "b")).count() == 1
    assert math.isclose(sum(r.rank for r in graph.pagerank(e, 30).collect()), 1.0, abs_tol=1e-9)
    nodes, kept = graph.remove_nodes(spark.createDataFrame([("a",), ("b",)], "uid string"), e, uids(spark, "a"))
    assert nodes.count() == 1 and kept.count() == 2
    assert graph.bfs(edges_of(spark, []), uids(spark, "a")).count() == 1


def test_constraints_and_bins(spark):
    nodes = spark.createDataFrame([("a", "Concept"), ("t", "Text")], "uid string, node_type string")
    e = edges_of(spark, [("a", "t", "extends"), ("a", "gone", "extends"), ("a", "t", "free")])
    assert graph.constraint_violations(nodes, e).count() == 1 and graph.dangling_edges(nodes, e).count() == 1
    lives = spark.createDataFrame([("t", 1950, 1950), ("z", 0, 1)], "id string, a int, b int")
    assert [r.year_start for r in graph.temporal_bins(lives, "a", "b", 1900, 2000, 50).orderBy("year_start").collect()] == [1900, 1950]
    assert graph.temporal_bins(lives, "a", "b", 1900, 2000, 50, closed=False).count() == 1


def test_centrality_and_communities():
    line = [(0, 1), (1, 2), (2, 3)]
    assert graph.betweenness(line) == pytest.approx({0: 0, 1: 2 / 3, 2: 2 / 3, 3: 0})
    two = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)]
    assert sorted(map(sorted, graph.modularity_communities(two))) == [[0, 1, 2], [3, 4, 5]]


def test_measures_of_large_balls_take_little_time():
    began = time.time()
    hubs = [("r", f"n{i}") for i in range(5)] + [(f"n{i}", f"s{i * 2400 + j}") for i in range(5) for j in range(2400)]
    central = graph.betweenness(hubs)
    n = 12_006
    assert central["s7"] == 0 and central["r"] == pytest.approx(((n - 1) ** 2 - 5 * 2401**2) / (n - 1) / (n - 2))
    assert central["n3"] == pytest.approx(((n - 1) ** 2 - 2400 - (n - 2401) ** 2) / (n - 1) / (n - 2))
    assert sorted(map(len, graph.modularity_communities(hubs))) == [2401, 2401, 2401, 2401, 2402]
    assert time.time() - began < 60


def test_balls_of_any_size_are_measured(spark):
    n = 20_100
    rows = [("r", f"n{i}") for i in range(n)] + [(f"n{i}", f"n{i + 1}") for i in range(3)]
    edges = spark.createDataFrame(rows, "src string, dst string").withColumn("edge_type", F.lit("extends"))
    found = {r.uid: r for r in graph.concept_cluster(edges, spark.createDataFrame([("r",)], "uid string")).collect()}
    assert len(found) == n + 1 and None not in {r.community for r in found.values()} | {r.centrality for r in found.values()}
    # Between n0 and n2, and n1 and n3, one of two paths leads through the root; between others than neighbours all do.
    assert found["r"].centrality == round(1 - 2 * (3 + 1) / n / (n - 1), 6) and found["n9"].centrality == 0
    assert len({found[f"n{i}"].community for i in range(4)}) == 1 != len({r.community for r in found.values()})


def test_paths_of_a_ball_are_followed_in_shares(spark):
    rng = random.Random(4)
    rows = sorted({(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(60)} | {("r", f"n{i}") for i in range(0, 30, 3)} | {("n1", "leaf"), ("s", "n2")})
    edges = spark.createDataFrame(rows, "src string, dst string").withColumn("edge_type", F.lit("extends"))
    roots = spark.createDataFrame([("r",), ("s",)], "uid string")
    whole = sorted(graph.concept_cluster(edges, roots).collect())
    work, graph.SHARE_WORK = graph.SHARE_WORK, 100
    try:
        assert sorted(graph.concept_cluster(edges, roots).collect()) == whole
    finally:
        graph.SHARE_WORK = work
    for root in ("r", "s"):
        inside = {r.uid for r in whole if r.root == root}
        pairs = [p for p in rows if inside.issuperset(p)]
        central, groups = graph.betweenness(pairs), graph.modularity_communities(pairs)
        assert {r.uid: r.centrality for r in whole if r.root == root} == pytest.approx(central, abs=1e-6)
        assert {r.uid: r.community for r in whole if r.root == root} == {x: i for i, g in enumerate(groups) for x in g}


def test_communities_join_what_gains_most():
    rng = random.Random(6)
    for _ in range(60):
        n = rng.randint(2, 14)
        links = {tuple(sorted((rng.randrange(n), rng.randrange(n)))) for _ in range(rng.randint(1, 3 * n))}
        groups = {x: {x} for p in links for x in p}
        links = {(a, b) for a, b in links if a != b}
        between = lambda x, y, links=links: sum((a in x and b in y) or (a in y and b in x) for a, b in links)
        ends = lambda x, links=links: sum((a in x) + (b in x) for a, b in links)
        while True:
            gains = [(ends(groups[a]) * ends(groups[b]) - 2 * len(links) * between(groups[a], groups[b]), a, b) for a in groups for b in groups if a < b]
            least, a, b = min(gains, default=(0, 0, 0))
            if least >= 0:
                break
            groups[a] |= groups.pop(b)
        assert sorted(map(sorted, graph.modularity_communities(list(links) + [(x, x) for g in groups.values() for x in g]))) == sorted(map(sorted, groups.values()))


def test_betweenness_counts_paths():
    rng = random.Random(8)
    for _ in range(40):
        n = rng.randint(3, 12)
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(n // 2, 2 * n))] + [(n + i, rng.randrange(n)) for i in range(3)]
        nodes = sorted({x for p in pairs for x in p})
        near = {v: {b for a, b in pairs + [(b, a) for a, b in pairs] if a == v != b} for v in nodes}

        def shortest(s, t, near=near):
            paths = [[s]]
            while paths and not any(p[-1] == t for p in paths):
                paths = [[*p, w] for p in paths for w in near[p[-1]] if w not in p]
            return [p for p in paths if p[-1] == t]

        want = dict.fromkeys(nodes, 0.0)
        for s in nodes:
            for t in nodes:
                found = shortest(s, t) if s != t else []
                for v in nodes:
                    if found and v not in (s, t):
                        want[v] += sum(v in p for p in found) / len(found)
        scale = (len(nodes) - 1) * (len(nodes) - 2)
        assert graph.betweenness(pairs) == pytest.approx({v: x / scale for v, x in want.items()})


def test_entities(spark):
    nodes = spark.createDataFrame([("a", {"wd": "1"}), ("b", {"wd": "1", "x": "2"}), ("c", {"x": "2"}), ("d", {"wd": "9"}), ("e", None)], "uid string, external_ids map<string,string>")
    assert {r.uid: (r.class_id, r.n_links) for r in entities.external_id_classes(nodes).collect()} == {"a": ("a", 1), "b": ("a", 2), "c": ("a", 1)}
    lives = spark.createDataFrame([(1900, 1970), (1902, 1969), (0, 50), (1, 51)], "b int, d int")
    (pair,) = entities.band_pairs(lives, "b", "d").collect()
    assert (pair.birth_a, pair.birth_b, pair.score) == (1900, 1902, 0.8)
    names = ["immanuel kant", "imanuel kant", "immanuel kants", "plato", "platon", "hegel", ""]
    rows = spark.createDataFrame([("Thinker", n) for n in names], "node_type string, label string")
    brute = {(a, b) for a in names for b in names if a and a < b and entities.indel_ratio(a, b) >= 0.85}
    assert {(r.label_a, r.label_b) for r in entities.label_pairs(rows).collect()} == brute
    old = spark.createDataFrame([("a", "A", {"en": "x"}, {"k": "1"}, ["m"])], "uid string, label string, labels_i18n map<string,string>, external_ids map<string,string>, provenance array<string>")
    new = spark.createDataFrame([("a", "B", {"en": "y", "de": "z"}, None, ["w"])], old.schema)
    merged = entities.merge_nodes(old, new).first()
    assert merged.label == "A" and merged.labels_i18n == {"en": "y", "de": "z"} and merged.provenance == ["m", "w"]


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (7, 7), (None, 3)], "a bigint, b bigint")
    found = {r.node: r.root for r in components(links, "a", "b").collect()}
    assert found == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100}
    assert components(links.limit(0), "a", "b").count() == 0


def test_annotation(spark):
    spans = spark.createDataFrame([("t", "C1", 0, 10), ("t", "C2", 15, 25), ("u", "C1", 0, 5)], "text_id string, concept_id string, start int, end int")
    assert annotation.overlapping(spans, "t", 5, 20).count() == 2 and annotation.overlapping(spans, "t", 10, 15).count() == 0
    ranges = spark.createDataFrame([(1, "t", 5, 20), (2, "t", 10, 15)], "query_id int, text_id string, q_start int, q_end int")
    assert sorted(r.concept_id for r in annotation.overlap_join(spans, ranges, 4).collect()) == ["C1", "C2"]
    assert annotation.wide(annotation.count_matrix(spans), "concept_id", "text_id", "n", ["t", "u"]).where("concept_id = 'C2'").first().u == 0
    labels = spark.createDataFrame([(1, "A"), (1, "A"), (1, "B")], "i int, l string")
    agreement = annotation.label_agreement(labels, "i", "l").first()
    assert (agreement.pairs, agreement.observed, agreement.expected) == (3, round(1 / 3, 6), 0.5) and agreement.alpha == round(-1 / 3, 6)
    ratings = spark.createDataFrame([(1, 1.0), (1, 3.0), (1, 5.0)], "i int, r double")
    assert annotation.rating_agreement(ratings, "i", "r").first().mean_difference == round(8 / 3, 6)
    assert annotation.label_agreement(labels.limit(0), "i", "l").first().alpha == 0.0
    refs, notes = spark.createDataFrame([("a",), ("b",), ("c",)], "r string"), spark.createDataFrame([("a",), ("a",)], "r string")
    assert annotation.commentary_coverage(refs, notes, "r", "r").first().covered == 1


def test_alignment(spark):
    roles = spark.createDataFrame([("x", "a", "s"), ("x", "b", "s"), ("y", "b", "s"), ("y", "c", "s")], "concept_id string, role string, structure string")
    pairs = spark.createDataFrame([("x", "y"), ("x", "q")], "a string, b string")
    assert {r.b: r.score for r in alignment.argumentative_scores(pairs, roles).collect()} == {"y": 0.6, "q": 0.0}
    bench = spark.createDataFrame([(1, "i1", "Aidagara", "i2", "Mitsein", 0.82)], "seq int, a_id string, a_label string, b_id string, b_label string, expected_similarity double")
    asked = spark.createDataFrame([("mitsein", "I1"), ("x", "y")], "a string, b string")
    assert {r.a: r.expected_similarity for r in alignment.benchmark_lookup(asked, bench).collect()} == {"mitsein": 0.82, "x": None}
    sig = alignment.structural_signatures(edges_of(spark, [("a", "b", "extends"), ("b", "c", "opposes")]), uids(spark, "a", "c"))
    scores = alignment.structural_scores(spark.createDataFrame([("a", "c"), ("a", "a")], "a string, b string"), sig, sig)
    assert {r.b: r.score for r in scores.collect()}["a"] == pytest.approx(1.0, abs=1e-4)
    mapping = spark.createDataFrame([("c", "c", "t", "exact", "same"), ("d", "e", "t", "partial", "same")], "source_id string, target_id string, target_tradition string, confidence string, relation string")
    assert alignment.mapping_query(mapping, "c").count() == 1 and alignment.mapping_query(mapping, min_rank=3).count() == 1


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"concepts": [{"concept_id": "ren"}], "texts": [{"text_id": "t1"}, {"text_id": "t2"}], "assay": [[3, 0]]}')
    corpus = readers.read_corpus(spark, str(tmp_path / "c.json"))
    assert corpus.shape() == (1, 2) and corpus.assay.count() == 1 and corpus.issues().count() == 0
    assert corpus.subset(texts=[1, 0, 0]).texts.count() == 3
    with pytest.raises(ValueError):
        readers.read_corpus(spark, "what.xyz")
    log = tmp_path / "log.jsonl"
    log.write_text('{"item_id": "1"}\n\nbroken{\n{"item_id": "2"}\n')
    assert readers.read_annotations(spark, str(log), "item_id string").count() == 2
    assert readers.read_annotations(spark, str(tmp_path / "none.jsonl"), "item_id string").count() == 0
    (tmp_path / "g.yaml").write_text("nodes:\n- {uid: a, type: Concept, label: A}\n- {uid: q, type: Odd}\nedges:\n- {source: a, target: a, type: extends}\n")
    nodes, edges = readers.read_graph(spark, str(tmp_path / "g.yaml"))
    assert nodes.count() == 1 and nodes.first().provenance == ["manual"]
    assert sinks.cypher(nodes, edges).count() == 2 and sinks.n_triples(nodes, edges).count() == 3 and sinks.graphml(nodes, edges).count() == 4
    assert sinks.reified(edges).count() == 7 and '"@id":"a"' in sinks.json_ld(nodes).first().value


def test_connectors(spark, tmp_path):
    from tessera.sources.connectors import register_connectors

    register_connectors(spark)
    (tmp_path / "p1.xml").write_text("<feed xmlns='http://www.w3.org/2005/Atom'><entry><id>1</id><title>T</title><author><name>A; B</name></author><published>1999-01-01</published></entry></feed>")
    row = spark.read.format("landed_feed").option("path", str(tmp_path / "*.xml")).option("source", "jstage").load().first()
    assert (row.title, row.authors, row.year) == ("T", ["A", "B"], 1999)
    (tmp_path / "l.html").write_text('<li class="entry"><a href="/x">Title</a> <span class="name">A, B &amp; C</span> 2001</li>')
    row = spark.read.format("landed_pages").option("path", str(tmp_path / "*.html")).load().first()
    assert (row.id, row.title, row.year) == ("/x", "Title", 2001)


def test_streaming(spark, tmp_path):
    from tessera.streaming.incremental import first_arrivals, upsert, windowed_counts

    source = tmp_path / "in"
    spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:01:00"), ("b", "2024-01-01 00:02:00")], "id string, ts string").write.parquet(str(source))
    stream = spark.readStream.schema("id string, ts string").parquet(str(source)).withColumn("ts", F.to_timestamp("ts"))
    got = []
    upsert(first_arrivals(stream, "id", "ts"), lambda df, _: got.extend(r.id for r in df.collect()), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(got) == ["a", "b"]
    assert windowed_counts(spark.read.parquet(str(source)).withColumn("ts", F.to_timestamp("ts")), "ts", ["id"]).count() == 2
