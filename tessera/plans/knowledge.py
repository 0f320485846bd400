"""Vector, graph, entity and alignment queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.vectors import composite, norm
from tessera.operators import alignment as L
from tessera.operators import entities as E
from tessera.operators import graph as G
from tessera.operators import similarity as S
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


# ---- vectors -------------------------------------------------------------------------------------


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings")


_ALL = """e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
s AS (SELECT q.vec_id AS query_id, b.vec_id AS other_id, q.label AS query_label, b.label AS other_label, round(list_cosine_similarity(q.v, b.v), 6) AS similarity FROM e q JOIN e b ON q.vec_id <> b.vec_id WHERE q.vec_id % 20 = 0)"""


@query(f"WITH {_ALL} SELECT query_id, other_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, other_id) AS r FROM s) WHERE r <= 10")
def knn_search(spark, sf_dir):
    """Ten nearest vectors of every twentieth vector."""
    vecs = _vectors(spark, sf_dir)
    return S.search(vecs.where("vec_id % 20 = 0"), vecs, "vec_id", "embedding", k=10)


@query(f"WITH {_ALL} SELECT query_id AS vec_id, round(1 - greatest(max(similarity), 0), 6) AS novelty FROM s GROUP BY 1")
def novelty(spark, sf_dir):
    """One less the greatest similarity to any other vector."""
    vecs = _vectors(spark, sf_dir)
    best = S.search(vecs.where("vec_id % 20 = 0"), vecs, "vec_id", "embedding", k=1)
    return best.select(F.col("query_id").alias("vec_id"), F.round(1 - F.greatest("similarity", F.lit(0.0)), 6).alias("novelty"))


@query(
    f"""WITH {_ALL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_label, other_label ORDER BY similarity DESC) AS r FROM s WHERE similarity > 0.3),
m AS (SELECT query_label, other_label, round(avg(similarity), 6) AS strength FROM r WHERE r <= 5 GROUP BY ALL)
SELECT query_label, other_label, strength, CASE WHEN strength > 0.9 THEN 'direct_citation' WHEN strength > 0.75 THEN 'paraphrase' WHEN strength > 0.6 THEN 'conceptual' ELSE 'structural' END AS influence_type FROM m"""
)
def influence_links(spark, sf_dir):
    """Mean of the five best similarities above 0.3 between labels."""
    vecs = _vectors(spark, sf_dir)
    means = S.label_strengths(vecs.where("vec_id % 20 = 0"), vecs, "vec_id", "embedding", "label", 0.3)
    return means.withColumn("influence_type", S.influence_type(F.col("strength")))


@query(
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), s AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a JOIN e b ON a.label = 0 AND b.label = 1)
SELECT a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r FROM s) WHERE r <= 3 AND score >= 0.2"""
)
def bridge_topk(spark, sf_dir):
    """Three best partners in one collection of each concept of another, above a threshold."""
    vecs = _vectors(spark, sf_dir)
    scored = S.search(vecs.where("label = 0"), vecs.where("label = 1"), "vec_id", "embedding", k=3)
    return L.bridge(scored.select(F.col("query_id").alias("a"), F.col("other_id").alias("b"), F.col("similarity").alias("score")), 3, 0.2)


@query(
    """WITH x AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings),
c AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM x WHERE r <= 3) GROUP BY ALL),
p AS (SELECT label AS school, list(x ORDER BY i) AS m, sqrt(sum(x * x)) AS n FROM c GROUP BY 1),
s AS (SELECT vec_id, school, round(list_inner_product(v, list_transform(m, lambda y: y / n)), 6) AS score FROM x, p)
SELECT vec_id, school AS label, score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, school) AS r FROM s) WHERE r = 1"""
)
def prototype_classify(spark, sf_dir):
    """Best label of every vector by prototypes of three examples each."""
    from pyspark.sql import Window

    vecs = _vectors(spark, sf_dir)
    examples = vecs.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where("r <= 3")
    found = S.classify(vecs, "vec_id", "embedding", S.centroids(examples, "label", "embedding"), 1)
    return found.select(F.col("id").alias("vec_id"), "label", "score")


@query(
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
j AS (SELECT a.vec_id, list_transform(range(1, len(a.v) + 1), lambda i: 0.5 * a.v[i] + 0.3 * b.v[i] + 0.2 * c.v[i]) AS w FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 JOIN e c ON c.vec_id = a.vec_id + 2)
SELECT vec_id, 1.0::DOUBLE AS size, round(w[1] / sqrt(list_inner_product(w, w)), 6) AS head FROM j"""
)
def facet_composite(spark, sf_dir):
    """Composite of three neighbouring vectors."""
    vecs = _vectors(spark, sf_dir).select("vec_id", "embedding")
    joined = vecs
    for i, name in ((1, "usage"), (2, "relational")):
        joined = joined.join(vecs.select((F.col("vec_id") - i).alias("vec_id"), F.col("embedding").alias(name)), "vec_id")
    whole = joined.select("vec_id", composite(F.col("embedding"), F.col("usage"), F.col("relational")).alias("w"))
    return whole.select("vec_id", F.round(norm(F.col("w")), 6).alias("size"), F.round(F.col("w")[0], 6).alias("head"))


@query(
    """WITH l AS (SELECT label, vec_id AS seq, embedding::DOUBLE[] AS v, lag(vec_id) OVER w AS previous, lag(embedding::DOUBLE[]) OVER w AS u FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id))
SELECT label::VARCHAR AS term, seq, previous, round(list_inner_product(v, u) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(u, u)) + 1e-9), 6) AS similarity,
  round(list_inner_product(v, u) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(u, u)) + 1e-9), 6) < 0.7 AS shifted FROM l WHERE previous IS NOT NULL"""
)
def term_shift(spark, sf_dir):
    """Similarity of consecutive usages of each term."""
    rows = _vectors(spark, sf_dir).select(F.col("label").cast("string").alias("label"), "vec_id", "embedding", F.lit(None).cast("string").alias("date"))
    return S.usage_shifts(rows, "label", "date", "vec_id", "embedding")


@query()
def meaning_clusters(spark, sf_dir):
    """Clusters of the usages of each term."""
    return S.meaning_clusters(_vectors(spark, sf_dir).withColumn("term", F.col("label").cast("string")), "term", "vec_id", "embedding", 0.8)


_F = """f AS (SELECT DISTINCT concept_id, definition, usage, relational FROM facets WHERE len(definition) = 64 AND len(usage) = 64 AND len(relational) = 64),
n AS (SELECT *, regexp_extract(concept_id, '([0-9]+)$', 1)::INT AS i FROM f)"""


@query(
    f"""WITH {_F}, c AS (SELECT *, list_transform(range(1, 65), lambda k: 0.5 * definition[k] + 0.3 * usage[k] + 0.2 * relational[k]) AS w FROM n),
p AS (SELECT a.concept_id AS a, b.concept_id AS b, a.definition AS d1, b.definition AS d2, a.usage AS u1, b.usage AS u2, a.relational AS r1, b.relational AS r2, a.w AS w1, b.w AS w2 FROM c a JOIN c b ON b.i = a.i + 1)
SELECT a, b, {', '.join(f"round(list_inner_product({x}1, {x}2) / (sqrt(list_inner_product({x}1, {x}1)) * sqrt(list_inner_product({x}2, {x}2)) + 1e-9), 6) AS {n}" for x, n in (('d', 'definition'), ('u', 'usage'), ('r', 'relational')))} FROM p"""
)
def semantic_alignment(spark, sf_dir):
    """Facet similarities of each concept and the next one."""
    full = [f"size({c}) = 64" for c in ("definition", "usage", "relational")]
    rows = read_table(spark, sf_dir, "facets").select("concept_id", "definition", "usage", "relational").where(" and ".join(full)).distinct()
    order = rows.select("concept_id", F.regexp_extract("concept_id", "([0-9]+)$", 1).cast("int").alias("i"))
    pairs = order.select(F.col("concept_id").alias("a"), "i").join(order.select(F.col("concept_id").alias("b"), (F.col("i") - 1).alias("i")), "i").select("a", "b")
    scored = L.semantic_scores(pairs, rows)
    return scored.select("a", "b", "definition", "usage", "relational")


# ---- graphs --------------------------------------------------------------------------------------


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, customer, supplier, lineitem = (read_table(spark, sf_dir, t) for t in ("nation", "customer", "supplier", "lineitem"))
    uid = lambda p, c: F.concat(F.lit(f"{p}:"), F.col(c).cast("string"))
    parts = [
        nation.select(uid("r", "n_regionkey").alias("src"), uid("n", "n_nationkey").alias("dst"), F.lit("subsumes").alias("edge_type")),
        supplier.select(uid("n", "s_nationkey"), uid("s", "s_suppkey"), F.lit("extends")),
        customer.select(uid("n", "c_nationkey"), uid("c", "c_custkey"), F.lit("influences")),
        lineitem.select(uid("s", "l_suppkey"), uid("p", "l_partkey"), F.lit("extends")).distinct(),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole


_EDGES = """edges AS (SELECT 'r:' || n_regionkey AS src, 'n:' || n_nationkey AS dst, 'subsumes' AS edge_type FROM nation UNION ALL SELECT 'n:' || s_nationkey, 's:' || s_suppkey, 'extends' FROM supplier
UNION ALL SELECT 'n:' || c_nationkey, 'c:' || c_custkey, 'influences' FROM customer UNION ALL SELECT DISTINCT 's:' || l_suppkey, 'p:' || l_partkey, 'extends' FROM lineitem)"""
_VERTICES = "v AS (SELECT src AS uid FROM edges UNION SELECT dst FROM edges)"


def _regions(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "region").select(F.concat(F.lit("r:"), F.col("r_regionkey").cast("string")).alias("uid"))


def _nations(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "nation").select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("uid"))


@query(f"WITH {_EDGES} SELECT src AS uid, dst AS neighbour FROM edges WHERE src LIKE 'n:%' UNION SELECT dst, src FROM edges WHERE dst LIKE 'n:%'")
def neighbours(spark, sf_dir):
    """Neighbours of every nation in both directions."""
    return G.neighbours(_edges(spark, sf_dir), _nations(spark, sf_dir), "both")


@query(
    f"""WITH RECURSIVE {_EDGES}, w AS (SELECT 'r:' || r_regionkey AS root, 'r:' || r_regionkey AS uid, 0 AS depth FROM region UNION SELECT root, dst, depth + 1 FROM w JOIN edges ON src = uid WHERE depth < 3 AND edge_type <> 'influences')
SELECT root, depth, count(DISTINCT uid) AS n FROM w GROUP BY ALL"""
)
def influence_bfs(spark, sf_dir):
    """Nodes within three steps of every region, by depth."""
    return G.bfs(_edges(spark, sf_dir), _regions(spark, sf_dir), 3, "out", ["subsumes", "extends"]).groupBy("root", "depth").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_EDGES}, b AS (SELECT 'r:' || r_regionkey AS uid FROM region UNION SELECT 'n:' || n_nationkey FROM nation UNION SELECT 's:' || s_suppkey FROM supplier) SELECT edge_type, count(*) AS n FROM edges SEMI JOIN b ON src = b.uid SEMI JOIN b b2 ON dst = b2.uid GROUP BY 1")
def induced_subgraph(spark, sf_dir):
    """Edges inside the ball of two steps around the regions, by type."""
    _, edges = G.influence_network(_edges(spark, sf_dir), _regions(spark, sf_dir), 2, "out", ["subsumes", "extends"])
    return edges.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_EDGES} SELECT a.src, c.dst, count(*) AS paths, 3 AS hops FROM edges a JOIN edges b ON a.dst = b.src JOIN edges c ON b.dst = c.src WHERE a.src LIKE 'r:%' AND c.dst LIKE 'p:%' GROUP BY ALL")
def simple_paths(spark, sf_dir):
    """Paths from regions to parts."""
    parts = read_table(spark, sf_dir, "part").select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("uid"))
    found = G.simple_paths(_edges(spark, sf_dir), _regions(spark, sf_dir), parts, 4, ["subsumes", "extends"])
    return found.groupBy("src", "dst", "hops").agg(F.count(F.lit(1)).alias("paths"))


@query(f"WITH RECURSIVE {_EDGES}, w AS (SELECT 'n:' || n_nationkey AS root, 'n:' || n_nationkey AS uid FROM nation UNION SELECT root, dst FROM w JOIN edges ON src = uid) SELECT root, count(*) - 1 AS n FROM w GROUP BY 1")
def reachability(spark, sf_dir):
    """How many nodes can be reached from each nation."""
    return G.broader_closure(_edges(spark, sf_dir), _nations(spark, sf_dir)).groupBy("root").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH RECURSIVE {_EDGES}, w AS (SELECT 'r:' || r_regionkey AS root, 'r:' || r_regionkey AS uid, 0 AS hops FROM region UNION SELECT root, dst, hops + 1 FROM w JOIN edges ON src = uid) SELECT root, min(hops) AS hops FROM w WHERE uid = 'p:1' GROUP BY 1")
def shortest_paths(spark, sf_dir):
    """Length of a shortest path from each region to one part."""
    return G.shortest_paths(_edges(spark, sf_dir), _regions(spark, sf_dir), "p:1").select("root", "hops")


@query(f"WITH RECURSIVE {_EDGES}, {_VERTICES}, w AS (SELECT uid, 0 AS depth FROM v WHERE uid NOT IN (SELECT dst FROM edges) UNION SELECT dst, depth + 1 FROM w JOIN edges ON src = uid) SELECT uid, min(depth) AS depth FROM w GROUP BY 1")
def depth_from_roots(spark, sf_dir):
    """Depth of every node below the nearest root."""
    return G.depth_from_roots(_edges(spark, sf_dir))


@query(f"WITH {_EDGES}, {_VERTICES}, o AS (SELECT src AS uid, count(DISTINCT dst) AS n FROM edges GROUP BY 1), i AS (SELECT dst AS uid, count(DISTINCT src) AS n FROM edges GROUP BY 1) SELECT uid, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM v LEFT JOIN i USING (uid) LEFT JOIN o USING (uid)")
def degree_signature(spark, sf_dir):
    """Degrees of every node."""
    return G.degrees(_edges(spark, sf_dir))


@query(f"WITH {_EDGES} SELECT src AS uid, edge_type AS relation, count(*) AS n FROM edges GROUP BY ALL UNION ALL SELECT dst, 'inv_' || edge_type, count(*) FROM edges GROUP BY ALL")
def edge_type_distribution(spark, sf_dir):
    """Edges of every node by relation and direction."""
    return G.edge_type_distribution(_edges(spark, sf_dir))


def _pagerank_sql(rounds: int) -> str:
    parts = [_EDGES, "g AS (SELECT DISTINCT src, dst FROM edges)", _VERTICES, "o AS (SELECT src, count(*) AS n FROM g GROUP BY 1)", "z AS (SELECT count(*)::DOUBLE AS n FROM v)", "k0 AS (SELECT uid, 1 / z.n AS rank FROM v, z)"]
    for i in range(rounds):
        parts.append(f"l{i} AS (SELECT coalesce(sum(rank), 0) AS x FROM k{i} WHERE uid NOT IN (SELECT src FROM o))")
        parts.append(f"s{i} AS (SELECT g.dst AS uid, sum(k{i}.rank / o.n) AS got FROM g JOIN k{i} ON k{i}.uid = g.src JOIN o ON o.src = g.src GROUP BY 1)")
        parts.append(f"k{i + 1} AS (SELECT v.uid, 0.15 / z.n + 0.85 * (coalesce(got, 0) + l{i}.x / z.n) AS rank FROM v CROSS JOIN z CROSS JOIN l{i} LEFT JOIN s{i} ON s{i}.uid = v.uid)")
    return "WITH " + ", ".join(parts) + f" SELECT uid, round(rank * 1000, 6) AS rank FROM k{rounds}"


@query(_pagerank_sql(4))
def pagerank(spark, sf_dir):
    """PageRank in thousandths after four rounds."""
    return G.pagerank(_edges(spark, sf_dir), 4).select("uid", F.round(F.col("rank") * 1000, 6).alias("rank"))


@query()
def concept_clusters(spark, sf_dir):
    """Communities and centrality around every region."""
    return G.concept_cluster(_edges(spark, sf_dir).where("edge_type <> 'influences'"), _regions(spark, sf_dir), 2, ["subsumes", "extends"])


_NODES = "nodes AS (SELECT 'r:' || r_regionkey AS uid, 'Tradition' AS node_type FROM region UNION ALL SELECT 'n:' || n_nationkey, 'Concept' FROM nation UNION ALL SELECT 's:' || s_suppkey, 'Thinker' FROM supplier UNION ALL SELECT 'c:' || c_custkey, 'Concept' FROM customer UNION ALL SELECT 'p:' || p_partkey, 'Text' FROM part)"


def _nodes(spark, sf_dir) -> DataFrame:
    kinds = (("region", "r", "r_regionkey", "Tradition"), ("nation", "n", "n_nationkey", "Concept"), ("supplier", "s", "s_suppkey", "Thinker"), ("customer", "c", "c_custkey", "Concept"), ("part", "p", "p_partkey", "Text"))
    parts = [read_table(spark, sf_dir, t).select(F.concat(F.lit(f"{p}:"), F.col(k).cast("string")).alias("uid"), F.lit(n).alias("node_type")) for t, p, k, n in kinds]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole


@query(
    f"""WITH {_EDGES}, {_NODES} SELECT e.src, e.dst, e.edge_type, a.node_type AS src_type, b.node_type AS dst_type FROM edges e JOIN nodes a ON a.uid = e.src JOIN nodes b ON b.uid = e.dst
WHERE NOT ((edge_type = 'subsumes' AND a.node_type = 'Concept' AND b.node_type = 'Concept') OR (edge_type = 'extends' AND ((a.node_type = 'Concept' AND b.node_type = 'Concept') OR (a.node_type = 'Argument' AND b.node_type = 'Argument')))
OR (edge_type = 'influences' AND ((a.node_type = b.node_type AND a.node_type IN ('Thinker', 'Concept', 'Tradition')) OR (a.node_type = 'Text' AND b.node_type = 'Thinker'))))"""
)
def edge_constraint_violations(spark, sf_dir):
    """Edges between node types that their type does not allow."""
    return G.constraint_violations(_nodes(spark, sf_dir), _edges(spark, sf_dir))


@query(f"WITH {_EDGES}, {_NODES} SELECT 'nodes' AS part, node_type AS kind, count(*) AS n FROM nodes GROUP BY ROLLUP (node_type) UNION ALL SELECT 'edges', edge_type, count(*) FROM edges GROUP BY ROLLUP (edge_type)")
def graph_summary(spark, sf_dir):
    """Nodes and edges in all and by type."""
    return G.graph_summary(_nodes(spark, sf_dir), _edges(spark, sf_dir))


@query(
    """WITH m AS (SELECT DISTINCT c_nationkey AS k, l_partkey AS m FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_nationkey IN (0, 1)),
s AS (SELECT m, max((k = 0)::INT) AS a, max((k = 1)::INT) AS b FROM m GROUP BY 1) SELECT 'part' AS member_type, sum(a)::BIGINT AS n_a, sum(b)::BIGINT AS n_b, sum(a * b)::BIGINT AS n_shared, round(sum(a * b) / count(*), 6) AS jaccard, 0::BIGINT AS analogous FROM s"""
)
def tradition_overlap(spark, sf_dir):
    """Parts that the customers of two nations share."""
    customer, orders, lineitem = (read_table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    bought = customer.join(orders, F.col("o_custkey") == F.col("c_custkey")).join(lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    members = bought.select(F.col("c_nationkey").cast("string").alias("collection"), F.col("l_partkey").alias("member"), F.lit("part").alias("member_type"))
    return G.overlap(members, None, "0", "1")


def _lives(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("birth"), F.max(F.year("o_orderdate")).alias("death"))


_LIVES = "l AS (SELECT o_custkey, min(year(o_orderdate))::INT AS birth, max(year(o_orderdate))::INT AS death FROM orders GROUP BY 1)"


@query(f"WITH {_LIVES}, b AS (SELECT unnest(range(1990, 2004, 2)) AS y) SELECT y::INT AS year_start, least(y + 2, 2004)::INT AS year_end, count(*) AS n FROM b JOIN l ON birth <= least(y + 2, 2004) AND death >= y GROUP BY ALL")
def temporal_bins(spark, sf_dir):
    """Customers alive in each bin of two years."""
    return G.temporal_bins(_lives(spark, sf_dir), "birth", "death", 1990, 2004, 2).groupBy("year_start", "year_end").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_LIVES}, s AS (SELECT birth, death, count(*) AS n FROM l GROUP BY ALL)
SELECT a.birth AS birth_a, a.death AS death_a, a.n AS n_a, b.birth AS birth_b, b.death AS death_b, b.n AS n_b, (CASE WHEN a.birth = b.birth AND a.death = b.death THEN a.n * (a.n - 1) / 2 ELSE a.n * b.n END)::BIGINT AS pairs, 0.8::DOUBLE AS score
FROM s a JOIN s b ON (a.birth < b.birth OR (a.birth = b.birth AND a.death <= b.death)) AND b.birth - a.birth <= 2 AND abs(a.death - b.death) <= 2 WHERE CASE WHEN a.birth = b.birth AND a.death = b.death THEN a.n > 1 ELSE TRUE END"""
)
def lifespan_band_match(spark, sf_dir):
    """Classes of life spans that differ by at most two years."""
    return E.band_pairs(_lives(spark, sf_dir), "birth", "death")


@query(
    """WITH u AS (SELECT 'c:' || c_custkey AS uid, c_nationkey || '/' || floor(c_acctbal / 100)::BIGINT AS k FROM customer UNION ALL SELECT 's:' || s_suppkey, s_nationkey || '/' || floor(s_acctbal / 100)::BIGINT FROM supplier),
g AS (SELECT k, count(*) AS n, min(uid) AS first FROM u GROUP BY 1 HAVING count(*) > 1) SELECT uid, first AS class_id, n - 1 AS n_links FROM u JOIN g USING (k)"""
)
def external_id_match(spark, sf_dir):
    """Customers and suppliers that share an outside key."""
    key = lambda n, b: F.create_map(F.lit("key"), F.concat(F.col(n).cast("string"), F.lit("/"), F.floor(F.col(b) / 100).cast("string")))
    customer = read_table(spark, sf_dir, "customer").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("uid"), key("c_nationkey", "c_acctbal").alias("external_ids"))
    supplier = read_table(spark, sf_dir, "supplier").select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("uid"), key("s_nationkey", "s_acctbal").alias("external_ids"))
    return E.external_id_classes(customer.unionByName(supplier))


@query()
def fuzzy_label_match(spark, sf_dir):
    """Names of traditions that nearly agree."""
    names = read_table(spark, sf_dir, "traditions").select(F.lit("Tradition").alias("node_type"), F.col("name_en").alias("label"))
    return E.label_pairs(names)


@query(
    """WITH r AS (SELECT DISTINCT c_nationkey AS k, o_orderpriority AS role, c_mktsegment AS structure FROM customer JOIN orders ON o_custkey = c_custkey),
s AS (SELECT k, list(DISTINCT role) AS roles, list(DISTINCT structure) AS structures FROM r GROUP BY 1),
n AS (SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1)
SELECT a, b, round(CASE WHEN x.k IS NULL OR y.k IS NULL THEN 0.0 ELSE 0.6 * len(list_intersect(x.roles, y.roles)) / len(list_distinct(list_concat(x.roles, y.roles))) + 0.4 * len(list_intersect(x.structures, y.structures)) / len(list_distinct(list_concat(x.structures, y.structures))) END, 6)::DOUBLE AS score
FROM n LEFT JOIN s x ON x.k = a LEFT JOIN s y ON y.k = b"""
)
def argumentative_alignment(spark, sf_dir):
    """Shared roles and structures of neighbouring nations."""
    customer, orders, nation = (read_table(spark, sf_dir, t) for t in ("customer", "orders", "nation"))
    roles = customer.join(orders, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("concept_id"), F.col("o_orderpriority").alias("role"), F.col("c_mktsegment").alias("structure"))
    pairs = nation.select(F.col("n_nationkey").alias("a")).join(nation.select(F.col("n_nationkey").alias("b"), (F.col("n_nationkey") - 1).alias("a")), "a")
    return L.argumentative_scores(pairs, roles)
