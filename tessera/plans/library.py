"""Queries of lookups, summaries, builds, sinks and steps of alignment, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import backends as B
from tessera.functions import text as T
from tessera.operators import alignment as L
from tessera.operators import annotation as A
from tessera.operators import entities as E
from tessera.operators import graph as G
from tessera.operators import lookup as K
from tessera.operators import rhetoric as R
from tessera.operators import similarity as S
from tessera.plans.corpus import ORACLES as _CORPUS
from tessera.plans.knowledge import _ALL, _EDGES, _NODES, _edges, _nations, _nodes, _vectors
from tessera.sources import builds, sinks
from tessera.storage import read_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL if there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _table(name: str):
    return lambda spark, sf_dir: read_table(spark, sf_dir, name)


_docs, _concepts, _raw, _lineitem = (_table(t) for t in ("documents", "concepts", "raw_documents", "lineitem"))


# ---- lookups and summaries -----------------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE lang = 'de' AND source = 'openalex'")
def document_filter(spark, sf_dir):
    """German documents of one source; the empty tradition does not filter."""
    return K.filter_by(_docs(spark, sf_dir), lang="de", source="openalex", tradition="").select("doc_id")


@query("SELECT DISTINCT concept_id, label_en FROM concepts WHERE tradition IN ('kantian', 'daoism')")
def key_select(spark, sf_dir):
    """Columns of the concepts whose key is one of several."""
    return K.select_keys(_concepts(spark, sf_dir), ["kantian", "daoism"], "TRADITION", ["CONCEPT_ID", "LABEL_EN"]).distinct()


@query("SELECT DISTINCT concept_id, label_en, label_de, era FROM concepts WHERE concept_id = 'phil:C00001'")
def concept_info(spark, sf_dir):
    """One concept by its id."""
    return K.info(_concepts(spark, sf_dir), "concept_id", "phil:C00001").select("concept_id", "label_en", "label_de", "era")


@query(
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), s AS (SELECT q.vec_id AS query_id, b.vec_id AS other_id, round(list_cosine_similarity(q.v, b.v), 6) AS similarity FROM e q JOIN e b ON q.vec_id <> b.vec_id WHERE q.vec_id % 20 = 0 AND b.label IN (1, 2))
SELECT query_id, other_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, other_id) AS r FROM s) WHERE r <= 5"""
)
def filtered_search(spark, sf_dir):
    """Nearest vectors among those of some labels, filtered before they are ranked."""
    vecs = _vectors(spark, sf_dir)
    return S.search(vecs.where("vec_id % 20 = 0"), K.filter_by(vecs, label=[1, 2]), "vec_id", "embedding", k=5)


def _readings(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("source_ref"), F.col("user_id").cast("string").alias("commentator"), F.col("user_id").cast("string").alias("interpreter"), "event_type")


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '3' AND user_id = 7 UNION ALL SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '5'")
def commentary_lookup(spark, sf_dir):
    """Commentaries on one reference by one commentator, and all on another."""
    rows = _readings(spark, sf_dir)
    return K.commentaries(rows, "3", "7").select("event_id").unionByName(K.commentaries(rows, "5").select("event_id"))


@query("SELECT DISTINCT user_id::VARCHAR AS interpreter FROM events WHERE json_extract_string(props, '$.k') = '3'")
def interpreters(spark, sf_dir):
    """Who interprets a reference."""
    return K.interpreters_for(_readings(spark, sf_dir), "3")


@query(
    """WITH c AS (SELECT DISTINCT concept_id, list_reduce(list_transform(string_split(tradition, '_'), lambda w: upper(w[1]) || w[2:]), lambda a, b: a || ' ' || b) AS school FROM concepts WHERE tradition IS NOT NULL)
SELECT concept_id, school, CASE WHEN school IN ('Presocratic', 'Platonic', 'Aristotelian', 'Stoic', 'Epicurean', 'Neoplatonic', 'Scholastic', 'Rationalist', 'Empiricist', 'Kantian', 'German Idealism', 'Phenomenology', 'Existentialism', 'Analytic', 'Pragmatism',
  'Critical Theory', 'Poststructuralism', 'Process Philosophy') THEN 'Western' WHEN school IN ('Confucian', 'Daoist', 'Legalist', 'Mohist', 'Chan/Zen Buddhist', 'Neo-Confucian', 'Kyoto School', 'New Confucianism') THEN 'East Asian'
  WHEN school IN ('Nyaya', 'Vaisheshika', 'Samkhya', 'Yoga', 'Mimamsa', 'Vedanta', 'Buddhist (Madhyamaka)', 'Buddhist (Yogacara)', 'Jain') THEN 'South Asian' WHEN school IN ('Kalam', 'Falsafa', 'Sufi Philosophy', 'Illuminationist') THEN 'Islamic' ELSE 'Unknown' END AS tradition FROM c"""
)
def school_traditions(spark, sf_dir):
    """Tradition of the school of each concept, or Unknown."""
    rows = _concepts(spark, sf_dir).where("tradition is not null").select("concept_id", F.initcap(F.replace("tradition", F.lit("_"), F.lit(" "))).alias("school")).distinct()
    return K.with_tradition(rows, "school")


@query("SELECT l_returnflag AS assay_name, count(DISTINCT l_partkey) AS n_concepts, count(DISTINCT l_suppkey) AS n_texts, count(*) AS n_cells FROM lineitem GROUP BY 1")
def collection_summary(spark, sf_dir):
    """Concepts, texts and cells of each assay of a long collection."""
    return K.collection_summary(_lineitem(spark, sf_dir), "l_returnflag", "l_partkey", "l_suppkey")


@query("SELECT source, array_to_string(list_sort(list(DISTINCT tradition) FILTER (tradition <> '')), ',') AS traditions FROM documents GROUP BY 1")
def result_traditions(spark, sf_dir):
    """Traditions that the documents of each source name."""
    return K.distinct_values(_docs(spark, sf_dir), "tradition", ["source"]).select("source", F.array_join("values", ",").alias("traditions"))


@query("SELECT doc_id, length(coalesce(text, ''))::INT AS char_count, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')))::INT AS line_count FROM documents")
def text_statistics(spark, sf_dir):
    """Characters and line feeds of every document."""
    return K.text_statistics(_docs(spark, sf_dir), "text").select("doc_id", "char_count", "line_count")


@query(
    """WITH o AS (SELECT DISTINCT id FROM registry WHERE id IS NOT NULL), n AS (SELECT DISTINCT id FROM raw_documents WHERE id IS NOT NULL)
SELECT (SELECT count(*) FROM n WHERE id NOT IN (SELECT id FROM o)) AS nodes_added, (SELECT count(*) FROM n WHERE id IN (SELECT id FROM o)) AS nodes_merged, (SELECT count(*) FROM manifest) AS edges_added"""
)
def ingest_statistics(spark, sf_dir):
    """How many ids an ingest adds and merges."""
    return K.merge_statistics(read_table(spark, sf_dir, "registry").select(F.col("id").alias("uid")), _raw(spark, sf_dir).select(F.col("id").alias("uid")), read_table(spark, sf_dir, "manifest"))


@query(
    """WITH r AS (SELECT l_returnflag, l_quantity AS x, l_extendedprice AS y, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS rx,
rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2 AS ry FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY 1"""
)
def score_correlations(spark, sf_dir):
    """Linear and rank correlation of two scores per group."""
    return K.correlations(_lineitem(spark, sf_dir), "l_quantity", "l_extendedprice", ["l_returnflag"])


@query("SELECT doc_id, CASE WHEN year IS NULL AND n_chars IS NULL THEN NULL ELSE round((coalesce(year, 0) + coalesce(n_chars, 0)) / ((year IS NOT NULL)::INT + (n_chars IS NOT NULL)::INT), 6) END AS mean FROM documents")
def aspect_means(spark, sf_dir):
    """Mean of the aspects that are known."""
    return _docs(spark, sf_dir).select("doc_id", F.round(K.mean_of(["year", "n_chars"]), 6).alias("mean"))


@query("SELECT event_type AS term, min(ts) AS first, max(ts) AS last, count(*) AS usages FROM events GROUP BY 1")
def date_ranges(spark, sf_dir):
    """First and last usage of each term."""
    return K.date_ranges(read_table(spark, sf_dir, "events"), "event_type", "ts")


@query("SELECT doc_id, md5(text) AS text_key, md5('hashing:' || text) AS model_key FROM documents WHERE text IS NOT NULL")
def hash_keys(spark, sf_dir):
    """Cache keys of texts, with and without a model."""
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", F.md5("text").alias("text_key"), F.md5(F.concat(F.lit("hashing:"), "text")).alias("model_key"))


@query("SELECT DISTINCT concept_id, label_de AS de, array_to_string(list_filter([label_ja, label_zh], lambda x: x IS NOT NULL), ',') AS other FROM concepts WHERE concept_id IS NOT NULL")
def concept_label_maps(spark, sf_dir):
    """Primary German label and the alternative ones of each concept."""
    label = lambda lang, c, primary: F.when(F.col(c).isNotNull(), F.struct(F.lit(lang).alias("lang"), F.col(c).alias("text"), F.lit(primary).alias("primary")))
    rows = _concepts(spark, sf_dir).where("concept_id is not null").select("concept_id", K.label_maps(F.array_compact(F.array(label("de", "label_de", True), label("x", "label_ja", False), label("x", "label_zh", False)))).alias("m"))
    other = F.coalesce(F.array_join(F.try_element_at("m.alternatives", F.lit("x")), ","), F.lit(""))
    return rows.select("concept_id", F.try_element_at("m.label_map", F.lit("de")).alias("de"), other.alias("other")).distinct()


@query("SELECT DISTINCT id, strftime(fetched_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS fetched FROM registry WHERE id IS NOT NULL")
def fetch_times(spark, sf_dir):
    """ISO times at which ids were registered."""
    rows = read_table(spark, sf_dir, "registry").where("id is not null")
    return rows.select("id", F.concat(F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("fetched")).distinct()


@query("SELECT event_id, coalesce(nullif(json_extract_string(props, '$.missing'), ''), nullif(json_extract_string(props, '$.k'), ''), 'none') AS k, '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' AS line FROM events WHERE event_type IS NOT NULL")
def nested_json(spark, sf_dir):
    """A nested value with a default where it is missing or empty, and rows as JSON."""
    some = lambda p: F.nullif(F.get_json_object("props", p), F.lit(""))
    return read_table(spark, sf_dir, "events").where("event_type is not null").select("event_id", F.coalesce(some("$.missing"), some("$.k"), F.lit("none")).alias("k"), F.to_json(F.struct("event_id", "event_type")).alias("line"))


@query("SELECT src, dst FROM (" + f"WITH {_EDGES} SELECT * FROM edges" + ") WHERE src = 'n:1' AND edge_type IN ('extends', 'subsumes')")
def edge_filter(spark, sf_dir):
    """Edges of some types from one node."""
    return G.filter_edges(_edges(spark, sf_dir), "n:1", None, ["extends", "subsumes"]).select("src", "dst")


@query(f"WITH {_EDGES}, {_NODES}, c AS (SELECT uid FROM nodes WHERE node_type = 'Thinker') SELECT c.uid, count(e.src) AS n FROM c LEFT JOIN edges e ON e.src = c.uid GROUP BY 1")
def thinkers(spark, sf_dir):
    """Nodes of one type with the number of their edges."""
    from tessera.pipeline import Knowledge

    graph = Knowledge(_nodes(spark, sf_dir), _edges(spark, sf_dir))
    edges = graph.edges_of().groupBy(F.col("src").alias("uid")).agg(F.count(F.lit(1)).alias("n"))
    return graph.of_type("Thinker").select("uid").join(edges, "uid", "left").fillna(0)


# ---- text ----------------------------------------------------------------------------------------


@query(
    """WITH w AS (SELECT doc_id, md5(unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}]+'))) AS d FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, ('0x' || d[1:4])::INT % 64 AS dim, sum(CASE WHEN d[5] < '8' THEN 1 ELSE -1 END)::DOUBLE AS x FROM w GROUP BY ALL), n AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM s GROUP BY 1)
SELECT doc_id, count(*) AS dims, round(sum(x * (dim + 1)) / any_value(n.n), 4) AS moment FROM s JOIN n USING (doc_id) WHERE x <> 0 GROUP BY 1""".replace("\\p{M}", "")
)
def embed_texts(spark, sf_dir):
    """Hashed vectors of English documents: places in use and their first moment."""
    rows = B.embed_texts(_docs(spark, sf_dir).where("text is not null").select("doc_id", "text"), "text", dim=64)
    cells = rows.select("doc_id", F.posexplode("embedding").alias("i", "x")).where("x <> 0")
    return cells.groupBy("doc_id").agg(F.count(F.lit(1)).alias("dims"), F.round(F.sum(F.col("x") * (F.col("i") + 1)), 4).alias("moment"))


@query(
    r"""WITH t AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(w)::BIGINT AS plain_n_tokens, len(list_distinct(w))::BIGINT AS plain_n_types, len(list_filter(string_split_regex(text, '[.!?]+'), lambda s: s <> ''))::BIGINT AS structural_n_sentences FROM t"""
)
def quantified(spark, sf_dir):
    """Features of two kinds chosen by name."""
    rows = B.quantify(_docs(spark, sf_dir).where("text is not null").select("doc_id", "text"), "text", ["plain", "structural"])
    return rows.select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("plain_n_tokens", "plain_n_types", "structural_n_sentences")])


@query(
    r"""SELECT doc_id, CASE WHEN lang IN ('zh', 'ja') THEN length(regexp_replace(text, '\s', '', 'g')) ELSE len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) END::BIGINT AS n FROM documents WHERE text IS NOT NULL AND lang IN ('zh', 'ja', 'de')"""
)
def tokens_by_language(spark, sf_dir):
    """Tokens by the tokenizer of each language."""
    docs = _docs(spark, sf_dir).where("text is not null")
    count = lambda lang: F.size(B.tokenizer_for(lang)(F.col("text")))
    return docs.where("lang in ('zh', 'ja', 'de')").select("doc_id", F.when(F.col("lang") == "zh", count("zh")).when(F.col("lang") == "ja", count("ja")).otherwise(count("de")).cast("bigint").alias("n"))


@query(
    """SELECT DISTINCT tradition_id, era_start AS "start", coalesce(era_end, 2026) AS "end" FROM traditions WHERE era_start IS NOT NULL AND tradition_id IS NOT NULL
UNION SELECT tradition_id, NULL, NULL FROM traditions WHERE era_start IS NULL AND tradition_id IS NOT NULL"""
)
def eras(spark, sf_dir):
    """Years of eras written as text."""
    text = F.concat(F.col("era_start").cast("string"), F.lit(" ~ "), F.coalesce(F.col("era_end").cast("string"), F.lit("present")))
    rows = read_table(spark, sf_dir, "traditions").where("tradition_id is not null").select("tradition_id", T.era_years(text).alias("e"))
    return rows.select("tradition_id", F.col("e.start").alias("start"), F.col("e.end").alias("end")).distinct()


@query("SELECT p_partkey, trunc(p_retailprice)::INT AS year FROM part UNION ALL SELECT -1, NULL")
def years(spark, sf_dir):
    """Whole years of numbers written as text."""
    rows = read_table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").cast("string").alias("t")).union(spark.sql("select -1L, 'soon'"))
    return rows.select("p_partkey", T.year_of(F.col("t")).alias("year"))


_THESES = _CORPUS["thesis_scores"]


@query(
    _THESES[: _THESES.index("SELECT doc_id, sentence_no, (least")]
    + ", scored AS (SELECT doc_id, sentence_no, s, least(("
    + _THESES[_THESES.index("(least(len(hits), 5)") + 1 : _THESES.index(")::DOUBLE AS score")]
    + """) / 5.0, 1.0)::DOUBLE AS confidence FROM h WHERE len(hits) >= 2),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, substring(lower(s), 1, 50) ORDER BY confidence DESC, sentence_no) AS k FROM scored) WHERE k = 1)
SELECT doc_id, rank::INT AS rank, sentence_no, confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, sentence_no) AS rank FROM once) WHERE rank <= 20"""
)
def top_theses(spark, sf_dir):
    """The twenty most confident theses of each English document."""
    return R.top_theses(R.score_theses(_docs(spark, sf_dir).where("lang = 'en'"), "text", "doc_id"), "doc_id").select("doc_id", "rank", "sentence_no", "confidence")


# ---- annotation and merging ----------------------------------------------------------------------


@query("SELECT concept_id, coalesce(label_de, label_en, concept_id) AS label FROM (SELECT DISTINCT concept_id, label_de, label_en FROM concepts WHERE concept_id IS NOT NULL)")
def localised_labels(spark, sf_dir):
    """German label of each concept, else the English one, else the id."""
    rows = _concepts(spark, sf_dir).where("concept_id is not null").select("concept_id", "label_de", "label_en").distinct()
    return rows.select("concept_id", A.localised(F.create_map(F.lit("de"), "label_de", F.lit("en"), "label_en"), "de", F.col("concept_id")).alias("label"))


@query("SELECT DISTINCT concept_id FROM concepts WHERE concept_id IS NOT NULL AND (label_en ILIKE '%truth%' OR label_de ILIKE '%truth%' OR label_sa ILIKE '%truth%')")
def label_search(spark, sf_dir):
    """Concepts of which a label, or else an alternative, holds a text."""
    some = lambda lang, c: F.when(F.col(c).isNotNull(), F.struct(F.lit(lang).alias("k"), F.col(c).alias("v")))
    labels = F.map_from_entries(F.array_compact(F.array(some("en", "label_en"), some("de", "label_de"))))
    others = F.create_map(F.lit("sa"), F.array_compact(F.array("label_sa")))
    rows = _concepts(spark, sf_dir).where("concept_id is not null").select("concept_id", labels.alias("labels"), others.alias("others"))
    return A.search_labels(rows, "labels", "others", "Truth").select("concept_id").distinct()


@query("SELECT event_id, concat_ws(',', CASE WHEN value > 50 THEN 'affirmed' END, CASE WHEN value > 90 THEN 'both' END, CASE WHEN value <= 20 THEN 'denied' END) AS corners FROM events WHERE value IS NOT NULL")
def accepted_corners(spark, sf_dir):
    """Corners of a four-cornered judgement that are true; null is not."""
    m = F.create_map(F.lit("affirmed"), F.col("value") > 50, F.lit("denied"), F.col("value") <= 20, F.lit("both"), F.col("value") > 90, F.lit("neither"), F.lit(None).cast("boolean"))
    return read_table(spark, sf_dir, "events").where("value is not null").select("event_id", F.array_join(A.accepted_corners(m), ",").alias("corners"))


@query("SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, max(l_quantity) AS score FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY ALL")
def best_pairs(spark, sf_dir):
    """Unordered pairs with their best score."""
    return E.best_pairs(_lineitem(spark, sf_dir), "l_partkey", "l_suppkey", "l_quantity")


@query(
    """WITH c AS (SELECT DISTINCT concept_id AS uid, label_en, label_ja, label_de, label_sa, wikidata_qid FROM concepts WHERE concept_id IS NOT NULL)
SELECT uid, coalesce(label_en, label_ja) AS label, coalesce(label_sa, label_de) AS de, label_ja AS ja, wikidata_qid AS qid, 'first,second' AS provenance FROM c"""
)
def merged_nodes(spark, sf_dir):
    """Concept nodes merged with a second table of them."""
    c = _concepts(spark, sf_dir).where("concept_id is not null").select(F.col("concept_id").alias("uid"), "label_en", "label_ja", "label_de", "label_sa", "wikidata_qid").distinct()
    some = lambda k, v: F.when(F.col(v).isNotNull(), F.struct(F.lit(k).alias("k"), F.col(v).alias("v")))
    entries = lambda *xs: F.map_from_entries(F.array_compact(F.array(*xs)))
    old = c.select("uid", F.col("label_en").alias("label"), entries(some("de", "label_de")).alias("labels_i18n"), F.lit(None).cast("map<string,string>").alias("external_ids"), F.array(F.lit("first")).alias("provenance"))
    new = c.select("uid", F.col("label_ja").alias("label"), entries(some("de", "label_sa"), some("ja", "label_ja")).alias("labels_i18n"), entries(some("wikidata", "wikidata_qid")).alias("external_ids"), F.array(F.lit("second")).alias("provenance"))
    m = E.merge_nodes(old, new)
    at = lambda c, k: F.try_element_at(c, F.lit(k))
    return m.select("uid", "label", at("labels_i18n", "de").alias("de"), at("labels_i18n", "ja").alias("ja"), at("external_ids", "wikidata").alias("qid"), F.array_join("provenance", ",").alias("provenance"))


# ---- alignment -----------------------------------------------------------------------------------


@query(
    f"""WITH {_ALL}, near AS (SELECT query_id AS anchor, other_id AS concept_id, similarity AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, other_id) AS r FROM s) WHERE r <= 10),
k AS (SELECT anchor, concept_id FROM near WHERE score >= 0.4 UNION SELECT anchor, anchor FROM near), d AS (SELECT anchor, concept_id, CASE WHEN concept_id % 7 = 0 THEN 9999 ELSE 1500 + concept_id % 300 END AS a, 1530 + concept_id % 300 AS b FROM k)
SELECT x.anchor, x.concept_id AS earlier, y.concept_id AS later FROM d x JOIN d y ON x.anchor = y.anchor AND x.b <= y.a AND x.concept_id <> y.concept_id"""
)
def genealogies(spark, sf_dir):
    """Which of the concepts like an anchor end before another begins."""
    vecs = _vectors(spark, sf_dir)
    similar = S.search(vecs.where("vec_id % 20 = 0"), vecs, "vec_id", "embedding", k=10).select(F.col("query_id").alias("anchor"), F.col("other_id").alias("concept_id"), F.col("similarity").alias("score"))
    at = F.col("vec_id") % 300
    concepts = vecs.select(F.col("vec_id").alias("concept_id"), F.when(F.col("vec_id") % 7 != 0, 1500 + at).alias("start"), (1530 + at).alias("end"))
    return G.genealogy(concepts, similar)


@query(
    f"""WITH {_EDGES}, r AS (SELECT src AS uid, edge_type AS k, count(*)::DOUBLE AS n FROM edges GROUP BY ALL UNION ALL SELECT dst, 'inv_' || edge_type, count(*) FROM edges GROUP BY ALL), o AS (SELECT src AS uid, count(DISTINCT dst)::DOUBLE AS o FROM edges GROUP BY 1),
i AS (SELECT dst AS uid, count(DISTINCT src)::DOUBLE AS i FROM edges GROUP BY 1), g AS (SELECT uid, coalesce(i, 0) AS i, coalesce(o, 0) AS o FROM o FULL JOIN i USING (uid)), p AS (SELECT 'n:' || n_nationkey AS a, 'n:' || (n_nationkey + 1) AS b FROM nation),
h AS (SELECT p.a, p.b, sum(x.n * y.n) AS both FROM p JOIN r x ON x.uid = p.a JOIN r y ON y.uid = p.b AND y.k = x.k GROUP BY ALL), z AS (SELECT uid, sqrt(sum(n * n)) AS n FROM r GROUP BY 1)
SELECT p.a, p.b, round(greatest(0, least(1, 0.5 * (x.i * y.i + x.o * y.o) / (sqrt(x.i * x.i + x.o * x.o) * sqrt(y.i * y.i + y.o * y.o) + 1e-9) + 0.5 * coalesce(h.both, 0) / (u.n * v.n + 1e-9))), 6) AS score
FROM p JOIN g x ON x.uid = p.a JOIN g y ON y.uid = p.b JOIN z u ON u.uid = p.a JOIN z v ON v.uid = p.b LEFT JOIN h ON h.a = p.a AND h.b = p.b"""
)
def structural_alignment(spark, sf_dir):
    """Likeness of neighbouring nations by degrees and relations."""
    edges, nations = _edges(spark, sf_dir), _nations(spark, sf_dir)
    histogram = G.edge_type_distribution(edges).join(nations, "uid", "left_semi").groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("relation", "n"))).alias("histogram"))
    signatures = G.degrees(edges).join(histogram, "uid").select("uid", F.array(F.col("in_degree").cast("double"), F.col("out_degree").cast("double")).alias("signature"), "histogram")
    key = F.regexp_extract("uid", "([0-9]+)", 1).cast("int")
    pairs = nations.select(F.col("uid").alias("a"), F.concat(F.lit("n:"), (key + 1).cast("string")).alias("b"))
    return L.structural_scores(pairs, signatures, signatures)


@query(
    """WITH k AS (SELECT n_nationkey AS a, n_nationkey + 1 AS b, (n_nationkey % 7) / 10.0::DOUBLE AS x, (n_nationkey % 5) / 10.0::DOUBLE AS y, (n_nationkey % 3) / 10.0::DOUBLE AS z FROM nation)
SELECT a, b, CASE WHEN a % 2 = 0 THEN x ELSE 0 END AS semantic, y AS structural, CASE WHEN a % 3 = 0 THEN z ELSE 0 END AS argumentative, round(0.4 * CASE WHEN a % 2 = 0 THEN x ELSE 0 END + 0.35 * y + 0.25 * CASE WHEN a % 3 = 0 THEN z ELSE 0 END, 6) AS score FROM k"""
)
def hybrid_alignment(spark, sf_dir):
    """Weighted sum of three scores, of which some are missing."""
    n = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"), (F.col("n_nationkey") + 1).alias("b"))
    part = lambda m: n.withColumn("score", F.col("a") % m / 10.0)
    return L.hybrid_scores(part(7).where("a % 2 = 0"), part(5), part(3).where("a % 3 = 0"))


@query(
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT x.vec_id, x.label AS la, y.label AS lb, list_inner_product(x.v, y.v) / (sqrt(list_inner_product(x.v, x.v)) * sqrt(list_inner_product(y.v, y.v)) + 1e-9) AS s FROM e x JOIN e y ON y.vec_id = x.vec_id + 1)
SELECT vec_id, 'c' || vec_id || ' (' || la || ') and c' || (vec_id + 1) || ' (' || lb || ') are ' || CASE WHEN s > 0.8 THEN 'strongly analogous' WHEN s > 0.6 THEN 'moderately similar' WHEN s > 0.4 THEN 'loosely related' ELSE 'largely distinct' END AS told FROM p"""
)
def difference_narratives(spark, sf_dir):
    """How close each concept and the next are, in words."""
    from tessera.functions.vectors import cosine_eps

    vecs = _vectors(spark, sf_dir).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    pairs = vecs.join(vecs.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("other"), F.col("v").alias("w")), "vec_id")
    name = lambda c: F.concat(F.lit("c"), c.cast("string"))
    told = L.diff_narrative(name(F.col("vec_id")), F.col("label").cast("string"), name(F.col("vec_id") + 1), F.col("other").cast("string"), cosine_eps(F.col("v"), F.col("w")))
    return pairs.select("vec_id", F.regexp_replace(told, r" \(composite similarity: [-0-9.]+\)\.$", "").alias("told"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN o_orderdate::VARCHAR < l_shipdate::VARCHAR THEN 0.9 WHEN o_orderdate::VARCHAR > l_shipdate::VARCHAR THEN 0.1 ELSE 0.5 END::DOUBLE AS likelihood FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def influence_directions(spark, sf_dir):
    """Likelihood that the earlier of two influenced the later."""
    rows = _lineitem(spark, sf_dir).join(read_table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select("l_orderkey", "l_linenumber", S.influence_direction(F.col("o_orderdate").cast("string"), F.col("l_shipdate").cast("string")).cast("double").alias("likelihood"))


@query(
    """WITH c AS (SELECT r_regionkey, ['Sublime', 'QUALIA', 'wabi-sabi', 'karma', 'care ethics'][r_regionkey + 1] AS concept, ['aesthetics', 'philosophy of mind', 'Aesthetics', 'ethics', 'Ethics'][r_regionkey + 1] AS s, ['design', 'ai', 'ai', 'policy', 'policy'][r_regionkey + 1] AS t FROM region)
SELECT r_regionkey, CASE r_regionkey WHEN 0 THEN 'awe-inducing UX, scale in data visualization' WHEN 1 THEN 'sensor grounding, embodied perception' WHEN 4 THEN 'vulnerability-responsive policy design' ELSE 'No mapping for ' || concept || ' from ' || s || ' to ' || t END AS practical,
CASE WHEN r_regionkey IN (0, 1, 4) THEN 0.85 ELSE 0.0 END::DOUBLE AS confidence FROM c"""
)
def practical_meanings(spark, sf_dir):
    """What concepts mean in another domain."""
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), F.col("r_regionkey") + 1)
    rows = read_table(spark, sf_dir, "region").select("r_regionkey", pick("Sublime", "QUALIA", "wabi-sabi", "karma", "care ethics").alias("concept"), pick("aesthetics", "philosophy of mind", "Aesthetics", "ethics", "Ethics").alias("s"), pick("design", "ai", "ai", "policy", "policy").alias("t"))
    return R.practical_mapping(rows, "concept", "s", "t").select("r_regionkey", "practical", "confidence")


@query(
    """WITH f AS (SELECT DISTINCT f.concept_id, c.tradition, definition AS d, usage AS u, relational AS r FROM facets f JOIN (SELECT DISTINCT concept_id, tradition FROM concepts) c USING (concept_id) WHERE len(definition) = 64 AND len(usage) = 64 AND len(relational) = 64),
w AS (SELECT concept_id, tradition, list_transform(range(1, 65), lambda i: 0.5 * d[i] + 0.3 * u[i] + 0.2 * r[i]) AS w FROM f), o AS (SELECT w AS o FROM w WHERE concept_id = 'phil:C00001'),
s AS (SELECT concept_id, round(list_inner_product(w, o) / (sqrt(list_inner_product(w, w)) * sqrt(list_inner_product(o, o)) + 1e-9), 6) AS score FROM w, o WHERE tradition = 'daoism' AND concept_id <> 'phil:C00001')
SELECT concept_id, score, row_number() OVER (ORDER BY score DESC, concept_id)::INT AS rank FROM s ORDER BY score DESC, concept_id LIMIT 5"""
)
def analogue_search(spark, sf_dir):
    """The five concepts of a tradition most like a concept of another."""
    full = " and ".join(f"size({c}) = 64" for c in ("definition", "usage", "relational"))
    facets = read_table(spark, sf_dir, "facets").where(full).select("concept_id", "definition", "usage", "relational").distinct()
    rows = facets.join(_concepts(spark, sf_dir).select("concept_id", "tradition").distinct(), "concept_id")
    return K.analogues(rows, "phil:C00001", "daoism")


@query(
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), f AS (SELECT label, min(vec_id) AS vec_id FROM e GROUP BY 1), c AS (SELECT f.label AS concept, f.label // 2 AS s, e.v FROM f JOIN e USING (vec_id)), n AS (SELECT s, count(*) AS n FROM c GROUP BY 1),
m AS (SELECT e.vec_id, c.concept, CASE WHEN n.n = 1 THEN 0.8 ELSE round(list_inner_product(e.v, c.v) / (sqrt(list_inner_product(e.v, e.v)) * sqrt(list_inner_product(c.v, c.v)) + 1e-9), 6) END AS score FROM e JOIN c ON c.s = e.label // 2 JOIN n ON n.s = c.s)
SELECT vec_id AS mention_id, concept::VARCHAR AS concept_id, score::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, concept::VARCHAR) AS r FROM m) WHERE r = 1 AND score >= 0.55"""
)
def disambiguation(spark, sf_dir):
    """Which of the concepts of its surface each mention means."""
    vecs = _vectors(spark, sf_dir).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))
    surface = F.floor(F.col("label") / 2).cast("string")
    first = vecs.groupBy("label").agg(F.min_by("vec", "vec_id").alias("vec"))
    return K.disambiguate(vecs.select(F.col("vec_id").alias("mention_id"), surface.alias("surface"), "vec"), first.select(surface.alias("surface"), F.col("label").cast("string").alias("concept_id"), "vec"))


@query(
    """WITH RECURSIVE e AS (SELECT vec_id, label // 2 AS pair, label % 2 AS side, embedding::DOUBLE[] AS v FROM embeddings), l AS (SELECT pair, vec_id, v, row_number() OVER (PARTITION BY pair ORDER BY vec_id) AS i FROM e WHERE side = 0), r AS (SELECT pair, vec_id, v, row_number() OVER (PARTITION BY pair ORDER BY vec_id) AS j FROM e WHERE side = 1),
s AS (SELECT l.pair, i, j, l.vec_id AS a, r.vec_id AS b, list_inner_product(l.v, r.v) / (sqrt(list_inner_product(l.v, l.v)) * sqrt(list_inner_product(r.v, r.v)) + 1e-9) AS x FROM l JOIN r USING (pair)),
w AS (SELECT DISTINCT pair, 0::BIGINT AS i, 0::BIGINT AS j, -1::BIGINT AS a, -1::BIGINT AS b, 0::DOUBLE AS x FROM s UNION ALL SELECT pair, i, j, a, b, x FROM (SELECT s.*, row_number() OVER (PARTITION BY s.pair ORDER BY s.x DESC, s.j) AS k FROM w JOIN s ON s.pair = w.pair AND s.i = w.i + 1 AND s.j > w.j) WHERE k = 1)
SELECT pair::INT AS pair, a AS left_seq, b AS right_seq, round(x, 6) AS score FROM w WHERE i > 0 AND round(x, 6) >= 0"""
)
def monotone_alignment(spark, sf_dir):
    """Greedy alignment of the segments of neighbouring labels."""
    vecs = _vectors(spark, sf_dir)
    side = lambda k: vecs.where(F.col("label") % 2 == k).select(F.floor(F.col("label") / 2).cast("int").alias("pair"), "vec_id", "embedding")
    return S.monotone_align(side(0), side(1), ["pair"], "vec_id", "embedding")


# ---- builds and sinks ----------------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('daodejing', 'zh', 3), ('heidegger_sein_und_zeit', 'de', 3), ('nagarjuna_mmk', 'sa', 3), ('nishida_zen_no_kenkyu', 'ja', 3), ('watsuji_rinrigaku', 'ja', 3)) t(text_id, lang, n_concepts)")
def known_sources(spark, sf_dir):
    """The corpora known by name."""
    parts = [c.texts.select("text_id", "lang").withColumn("n_concepts", F.lit(c.shape()[0])) for c in (builds.read(spark, name) for name in builds.KNOWN_SOURCES)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


@query("SELECT * FROM (VALUES (1497, 'Republic', 'Plato'), (1656, 'Apology', 'Plato'), (1636, 'Symposium', 'Plato'), (1658, 'Phaedo', 'Plato')) t(id, title, author)")
def classic_works(spark, sf_dir):
    """Works of the catalogue by a name."""
    return builds.classic_works(spark, "pLaTo").select("id", "title", "author")


@query("SELECT DISTINCT concept_id, nullif(trim(label_en), '') AS label_en, nullif(trim(tradition), '') AS tradition, nullif(trim(wikidata_qid), '') AS wikidata_qid FROM concepts WHERE concept_id IS NOT NULL")
def concepts_build(spark, sf_dir):
    """The concept table with one row per id."""
    return builds.concepts_table(_concepts(spark, sf_dir)).select("concept_id", "label_en", "tradition", "wikidata_qid")


@query(
    """WITH g AS (SELECT DISTINCT region AS id FROM traditions WHERE region IS NOT NULL), t AS (SELECT DISTINCT tradition_id, name_en, region, era_start, era_end FROM traditions WHERE tradition_id IS NOT NULL)
SELECT id AS tradition_id, NULL AS parent, NULL::INT AS era_start, NULL::INT AS era_end, 'Top-level tradition: ' || id AS description FROM g
UNION ALL SELECT tradition_id, region, CASE WHEN era_end IS NOT NULL THEN era_start END, CASE WHEN era_start IS NOT NULL THEN era_end END, 'School within ' || region FROM t WHERE tradition_id NOT IN (SELECT id FROM g)"""
)
def traditions_build(spark, sf_dir):
    """The tradition table of groups and the schools within them."""
    rows = read_table(spark, sf_dir, "traditions").select("tradition_id", "name_en", "name_ja", "region", "era_start", "era_end").distinct()
    groups = rows.where("region is not null").select("region").distinct().select(F.col("region").alias("id"), F.col("region").alias("name_en"), F.lit(None).cast("string").alias("name_ja"), F.lit(None).cast("string").alias("parent"), "region", F.lit(0).alias("seq"))
    era = F.concat(F.col("era_start").cast("string"), F.lit(" ~ "), F.col("era_end").cast("string"))
    schools = rows.select(F.col("tradition_id").alias("id"), "name_en", "name_ja", F.col("region").alias("parent"), era.alias("era"), "region", F.lit(1).alias("seq"))
    return builds.traditions_table(groups, schools).select("tradition_id", "parent", "era_start", "era_end", "description")


@query("SELECT 'x:' || nullif(id, '') AS id, coalesce(nullif(title, ''), nullif(abstract, '')) AS label, NULL::VARCHAR AS note FROM raw_documents WHERE nullif(id, '') IS NOT NULL")
def imported_records(spark, sf_dir):
    """Rows of an export under other field names."""
    return builds.import_records(_raw(spark, sf_dir), {"id": ["id"], "label": ["name", "title", "abstract"], "note": ["nothing"]}, "x")


@query("SELECT rec, source FROM (SELECT id AS rec, source FROM raw_documents WHERE source IN ('openalex', 'philarchive')) d WHERE NOT EXISTS (SELECT 1 FROM registry g WHERE g.id = d.rec)")
def fetched_union(spark, sf_dir):
    """Documents of several sources of which one fails, without those registered."""
    raw = _raw(spark, sf_dir)

    def broken(limit: int) -> DataFrame:
        raise OSError("unreachable")

    sources = {s: (lambda limit, s=s: raw.where(F.col("source") == s)) for s in ("openalex", "philarchive")} | {"broken": broken}
    docs, _ = builds.fetch_all(sources, read_table(spark, sf_dir, "registry"), 1_000_000_000)
    return docs.select(F.col("id").alias("rec"), "source")


@query("SELECT p_name || ' & ' || printf('%.3f', p_retailprice) || ' & ' || p_size || ' \\\\' AS value FROM part")
def latex_rows(spark, sf_dir):
    """Rows of a LaTeX table."""
    return sinks.latex_rows(read_table(spark, sf_dir, "part"), ["p_name", "p_retailprice", "p_size"])


_NAMED = f"WITH {_EDGES}, {_NODES}"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).withColumn("label", F.concat(F.lit("the "), F.col("uid")))


@query(_NAMED + """ SELECT 'MERGE (n:' || node_type || ' {uid: "' || uid || '"}) SET n.label = "the ' || uid || '";' AS value FROM nodes UNION ALL SELECT 'MATCH (a {uid: "' || src || '"}), (b {uid: "' || dst || '"}) MERGE (a)-[:' || upper(edge_type) || ']->(b);' FROM edges""")
def cypher_script(spark, sf_dir):
    """The graph as statements."""
    return sinks.cypher(_named(spark, sf_dir), _edges(spark, sf_dir))


@query(
    _NAMED
    + """ SELECT '<http://example.org/' || replace(uid, ':', '/') || '> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://example.org/' || node_type || '> .' AS value FROM nodes
UNION ALL SELECT '<http://example.org/' || replace(uid, ':', '/') || '> <http://www.w3.org/2004/02/skos/core#prefLabel> "the ' || uid || '" .' FROM nodes
UNION ALL SELECT '<http://example.org/' || replace(src, ':', '/') || '> <http://example.org/' || edge_type || '> <http://example.org/' || replace(dst, ':', '/') || '> .' FROM edges"""
)
def graph_triples(spark, sf_dir):
    """The graph as N-Triples."""
    return sinks.n_triples(_named(spark, sf_dir), _edges(spark, sf_dir))


@query(_NAMED + """ SELECT '{"@id":"' || uid || '","@type":"' || node_type || '","label":"the ' || uid || '"}' AS value FROM nodes""")
def json_ld_nodes(spark, sf_dir):
    """Nodes as JSON-LD."""
    return sinks.json_ld(_named(spark, sf_dir))


@query(_NAMED + """ SELECT uid AS id, 'the ' || uid AS label, CASE WHEN node_type = 'Thinker' THEN '#112233' ELSE '#888888' END AS colour FROM nodes""")
def force_layout(spark, sf_dir):
    """Nodes with the colour of their first tradition."""
    colours = spark.createDataFrame([("Thinker", "#112233")], "tradition string, colour string")
    return sinks.d3(_named(spark, sf_dir).withColumn("tradition_uids", F.array("node_type")), _edges(spark, sf_dir), colours)[0]


@query(_NAMED + """ SELECT md5(src || '|' || edge_type || '|' || dst) AS node, '<http://example.org/' || src || '>' AS subject FROM edges""")
def reified_relations(spark, sf_dir):
    """Relations as statements about statements."""
    facts = sinks.reified(_edges(spark, sf_dir).withColumn("confidence", F.lit(1.0)))
    return facts.where(F.col("p").endswith("#subject>")).select(F.replace("s", F.lit("_:r"), F.lit("")).alias("node"), F.col("o").alias("subject"))


@query(_NAMED + """ SELECT 0 AS part, count(*) AS n FROM (SELECT 1) UNION ALL SELECT 1, count(*) FROM nodes UNION ALL SELECT 2, count(*) FROM edges UNION ALL SELECT 3, 1""")
def graphml_parts(spark, sf_dir):
    """Elements of a GraphML file by part."""
    none = F.lit(None).cast("int")
    nodes = _named(spark, sf_dir).withColumns({"labels_i18n": F.create_map(F.lit("en"), "label"), "birth_year": none, "death_year": none, "year": none})
    return sinks.graphml(nodes, _edges(spark, sf_dir)).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
