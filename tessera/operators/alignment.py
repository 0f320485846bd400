"""Concept alignment: semantic, structural, argumentative and hybrid scores of pairs, bridges.

A pair table (a, b) goes in, the scored table comes out; which pairs to score is the caller's choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import composite, cosine_eps
from tessera.operators.graph import bfs, degrees, depth_from_roots, pagerank

HYBRID_WEIGHTS = (0.4, 0.35, 0.25)


def semantic_scores(pairs: DataFrame, facets: DataFrame) -> DataFrame:
    """(a, b, definition, usage, relational, score): cosines of the facets and of their composites;
    ``facets``: (concept_id, definition, usage, relational)."""
    side = lambda c: facets.select(F.col("concept_id").alias(c), F.struct("definition", "usage", "relational", composite(F.col("definition"), F.col("usage"), F.col("relational")).alias("all")).alias(f"f{c}"))
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    sims = {name: F.round(cosine_eps(F.col(f"fa.{name}"), F.col(f"fb.{name}")), 6) for name in ("definition", "usage", "relational")}
    return joined.select("a", "b", *[c.alias(n) for n, c in sims.items()], F.round(cosine_eps(F.col("fa.all"), F.col("fb.all")), 6).alias("score"))


def map_cosine(a: Column, b: Column) -> Column:
    """Cosine of two maps of counts over the union of their keys; 0 where one is empty."""
    both = F.aggregate(F.map_entries(a), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at(b, e["key"]), F.lit(0)))
    size = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, v: s + v * v))
    return F.coalesce(F.when((F.size(a) > 0) & (F.size(b) > 0), both / (size(a) * size(b) + 1e-9)), F.lit(0.0))


def structural_signatures(edges: DataFrame, roots: DataFrame, radius: int = 2, rounds: int = 20) -> DataFrame:
    """(uid, signature, histogram): in- and out-degree, PageRank and depth of each root, and the edges of
    its neighbourhood by relation.  Betweenness, which needs the whole graph in one place, is 0 here."""
    ranks, deg, depth = pagerank(edges, rounds), degrees(edges), depth_from_roots(edges)
    ball = bfs(edges, roots, radius, "both").select("root", "uid")
    inside = edges.join(ball.select("root", F.col("uid").alias("src")), "src").join(ball.select("root", F.col("uid").alias("dst")), ["root", "dst"])
    counts = inside.groupBy("root", F.coalesce("edge_type", F.lit("unknown")).alias("relation")).agg(F.count(F.lit(1)).alias("n"))
    histogram = counts.groupBy(F.col("root").alias("uid")).agg(F.map_from_entries(F.collect_list(F.struct("relation", "n"))).alias("histogram"))
    base = roots.select("uid").distinct().join(deg, "uid", "left").join(ranks, "uid", "left").join(depth, "uid", "left").join(histogram, "uid", "left")
    values = [F.coalesce("in_degree", F.lit(0)), F.coalesce("out_degree", F.lit(0)), F.lit(0), F.coalesce("rank", F.lit(0.0)), F.greatest(F.coalesce("depth", F.lit(-1)), F.lit(0))]
    return base.select("uid", F.array(*[v.cast("double") for v in values]).alias("signature"), F.coalesce("histogram", F.create_map().cast("map<string,bigint>")).alias("histogram"))


def structural_scores(pairs: DataFrame, signatures_a: DataFrame, signatures_b: DataFrame) -> DataFrame:
    """(a, b, score): half cosine of the signatures, half of the neighbourhoods, within 0 and 1."""
    side = lambda s, c: s.select(F.col("uid").alias(c), F.struct("signature", "histogram").alias(f"s{c}"))
    joined = pairs.select("a", "b").join(side(signatures_a, "a"), "a").join(side(signatures_b, "b"), "b")
    score = 0.5 * cosine_eps(F.col("sa.signature"), F.col("sb.signature")) + 0.5 * map_cosine(F.col("sa.histogram"), F.col("sb.histogram"))
    return joined.select("a", "b", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6).alias("score"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 for two empty arrays."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def argumentative_scores(pairs: DataFrame, roles: DataFrame, usage: DataFrame | None = None) -> DataFrame:
    """(a, b, score): 0.6 Jaccard of roles and 0.4 of structures; without roles on either side 0.7 of the
    usage cosine in ``usage`` (a, b, usage), or 0.  ``roles``: (concept_id, role, structure)."""
    sets = roles.groupBy("concept_id").agg(F.collect_set("role").alias("roles"), F.collect_set("structure").alias("structures"))
    side = lambda c: sets.select(F.col("concept_id").alias(c), F.struct("roles", "structures").alias(f"r{c}"))
    joined = pairs.select("a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left")
    if usage is not None:
        joined = joined.join(usage.select("a", "b", "usage"), ["a", "b"], "left")
    else:
        joined = joined.withColumn("usage", F.lit(0.0))
    own = 0.6 * jaccard(F.col("ra.roles"), F.col("rb.roles")) + 0.4 * jaccard(F.col("ra.structures"), F.col("rb.structures"))
    known = F.col("ra").isNotNull() & F.col("rb").isNotNull()
    return joined.select("a", "b", F.round(F.when(known, own).otherwise(0.7 * F.coalesce("usage", F.lit(0.0))), 6).alias("score"))


def hybrid_scores(semantic: DataFrame, structural: DataFrame, argumentative: DataFrame, weights: tuple[float, float, float] = HYBRID_WEIGHTS) -> DataFrame:
    """(a, b, semantic, structural, argumentative, score): weighted sum; a missing score is 0."""
    parts = [df.select("a", "b", F.col("score").alias(n)) for df, n in ((semantic, "semantic"), (structural, "structural"), (argumentative, "argumentative"))]
    joined = parts[0].join(parts[1], ["a", "b"], "full").join(parts[2], ["a", "b"], "full").fillna(0.0)
    total = sum((F.col(n) * w for n, w in zip(("semantic", "structural", "argumentative"), weights, strict=True)), F.lit(0.0))
    return joined.withColumn("score", F.round(total, 6))


def bridge(scored: DataFrame, top_k: int = 3, threshold: float = 0.5) -> DataFrame:
    """(a, b, score): the ``top_k`` best partners of each a, then those at ``threshold`` or above, each
    pair once with its best score; ties to the smaller b."""
    best = scored.groupBy("a", "b").agg(F.max("score").alias("score"))
    ranked = best.withColumn("__r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b")))
    return ranked.where((F.col("__r") <= top_k) & (F.col("score") >= threshold)).drop("__r")


def diff_narrative(term_a: Column, tradition_a: Column, term_b: Column, tradition_b: Column, similarity: Column) -> Column:
    """Sentence on how close two concepts are."""
    relation = F.when(similarity > 0.8, "strongly analogous").when(similarity > 0.6, "moderately similar").when(similarity > 0.4, "loosely related").otherwise("largely distinct")
    return F.format_string("%s (%s) and %s (%s) are %s (composite similarity: %.3f).", term_a, tradition_a, term_b, tradition_b, relation, similarity)


def benchmark_lookup(pairs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the expected similarity of the first benchmark row that names both, by id or
    label, in either order and case; null where there is none.

    ``benchmark``: (seq, a_id, a_label, b_id, b_label, expected_similarity).  Both orders and both ways
    of naming become equal keys, so the lookup is one equi-join.
    """
    names = F.explode(F.flatten(F.transform(F.array("a_id", "a_label"), lambda x: F.transform(F.array("b_id", "b_label"), lambda y: F.struct(F.lower(x).alias("x"), F.lower(y).alias("y"))))))
    rows = benchmark.select("seq", "expected_similarity", names.alias("n")).select("seq", "expected_similarity", F.least("n.x", "n.y").alias("x"), F.greatest("n.x", "n.y").alias("y"))
    first = rows.groupBy("x", "y").agg(F.min_by("expected_similarity", "seq").alias("expected_similarity"))
    keyed = pairs.withColumn("x", F.least(F.lower("a"), F.lower("b"))).withColumn("y", F.greatest(F.lower("a"), F.lower("b")))
    return keyed.join(first, ["x", "y"], "left").drop("x", "y")


def mapping_query(mappings: DataFrame, concept: str | None = None, tradition: str | None = None, min_rank: int = 0, relations: list[str] | None = None) -> DataFrame:
    """Mappings with the concept at either end, into the tradition, of at least the confidence rank
    (exact 4, close 3, partial 2, speculative 1) and of one of the relations; each once."""
    rank = F.when(F.col("confidence") == "exact", 4).when(F.col("confidence") == "close", 3).when(F.col("confidence") == "partial", 2).when(F.col("confidence") == "speculative", 1).otherwise(0)
    if concept is not None:
        mappings = mappings.where((F.col("source_id") == concept) | (F.col("target_id") == concept))
    if tradition is not None:
        mappings = mappings.where(F.col("target_tradition") == tradition)
    mappings = mappings.where(rank >= min_rank)
    return mappings.where(F.col("relation").isin(*relations)) if relations else mappings
