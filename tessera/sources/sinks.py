"""Sinks: every export is a table of rendered rows, so that ``write`` stays distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Prefixes of the vocabularies used in exports.
RDF_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
SKOS = "http://www.w3.org/2004/02/skos/core#"


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(F.coalesce(c, F.lit("")), '(["\\\\])', "\\\\$1"), F.lit('"'))


def _xml(c: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c


def json_ld(nodes: DataFrame) -> DataFrame:
    """One JSON-LD object per node; absent fields are left out."""
    kept = F.struct(F.col("uid").alias("@id"), F.col("node_type").alias("@type"), "label")
    return nodes.select(F.to_json(kept).alias("value"))


def cypher(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """MERGE statements of nodes and edges, each ended by a semicolon."""
    n = nodes.select(F.format_string("MERGE (n:%s {uid: %s}) SET n.label = %s;", F.col("node_type"), _quoted(F.col("uid")), _quoted(F.col("label"))).alias("value"))
    e = edges.select(F.format_string("MATCH (a {uid: %s}), (b {uid: %s}) MERGE (a)-[:%s]->(b);", _quoted(F.col("src")), _quoted(F.col("dst")), F.upper("edge_type")).alias("value"))
    return n.unionByName(e)


def n_triples(nodes: DataFrame, edges: DataFrame, base: str = "http://example.org/") -> DataFrame:
    """Types, labels and relations as N-Triples."""
    uri = lambda c: F.concat(F.lit(f"<{base}"), F.regexp_replace(c, ":", "/"), F.lit(">"))
    line = lambda s, p, o: F.concat(s, F.lit(" "), p, F.lit(" "), o, F.lit(" ."))
    facts = F.array(line(uri(F.col("uid")), F.lit(RDF_TYPE), F.concat(F.lit(f"<{base}"), F.col("node_type"), F.lit(">"))), line(uri(F.col("uid")), F.lit(f"<{SKOS}prefLabel>"), _quoted(F.col("label"))))
    return nodes.select(F.explode(facts).alias("value")).unionByName(edges.select(line(uri(F.col("src")), F.concat(F.lit(f"<{base}"), F.col("edge_type"), F.lit(">")), uri(F.col("dst"))).alias("value")))


def reified(relations: DataFrame, base: str = "http://example.org/") -> DataFrame:
    """Each relation (src, dst, edge_type, confidence) as a direct triple and six about it."""
    uri = lambda c: F.concat(F.lit(f"<{base}"), c, F.lit(">"))
    node = F.concat(F.lit("_:r"), F.md5(F.concat_ws("|", "src", "edge_type", "dst")))
    rdf = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    facts = [
        (uri(F.col("src")), uri(F.col("edge_type")), uri(F.col("dst"))),
        (node, F.lit(RDF_TYPE), F.lit(f"<{rdf}Statement>")),
        (node, F.lit(f"<{rdf}subject>"), uri(F.col("src"))),
        (node, F.lit(f"<{rdf}predicate>"), uri(F.col("edge_type"))),
        (node, F.lit(f"<{rdf}object>"), uri(F.col("dst"))),
        (node, F.lit(f"<{base}relationType>"), _quoted(F.col("edge_type"))),
        (node, F.lit(f"<{base}confidence>"), _quoted(F.col("confidence").cast("string"))),
    ]
    return relations.select(F.explode(F.array(*[F.struct(s.alias("s"), p.alias("p"), o.alias("o")) for s, p, o in facts])).alias("t")).select("t.*")


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, value): the elements of a GraphML file; part orders header, nodes, edges and footer."""
    spark = nodes.sparkSession
    labels = F.array_join(F.transform(F.map_entries(F.coalesce("labels_i18n", F.create_map().cast("map<string,string>"))), lambda e: F.concat(F.lit('<data key="label_'), _xml(e["key"]), F.lit('">'), _xml(e["value"]), F.lit("</data>"))), "")
    years = F.concat(*[F.when(F.coalesce(F.col(c), F.lit(0)) != 0, F.concat(F.lit(f'<data key="{c}">'), F.col(c).cast("string"), F.lit("</data>"))).otherwise("") for c in ("birth_year", "death_year", "year")])
    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), _xml(F.col("uid")), F.lit('"><data key="node_type">'), F.col("node_type"), F.lit("</data>"), labels, years, F.lit("</node>")).alias("value"))
    e = edges.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), _xml(F.col("src")), F.lit('" target="'), _xml(F.col("dst")), F.lit('"><data key="edge_type">'), F.col("edge_type"), F.lit("</data></edge>")).alias("value"))
    ends = spark.createDataFrame([(0, '<graphml><graph edgedefault="directed">'), (3, "</graph></graphml>")], "part int, value string")
    return ends.unionByName(n).unionByName(e)


def d3(nodes: DataFrame, edges: DataFrame, colours: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with the colour of their first tradition, links) for a force layout."""
    keyed = nodes.select(F.col("uid").alias("id"), "label", F.get("tradition_uids", F.lit(0)).alias("tradition")).join(colours, "tradition", "left")
    return keyed.select("id", "label", F.coalesce("colour", F.lit("#888888")).alias("colour")), edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("edge_type").alias("type"))


def latex_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of a LaTeX table, numbers with three decimals."""
    cells = [F.format_string("%.3f", F.col(c).cast("double")) if df.schema[c].dataType.simpleString() in ("double", "float") else F.col(c).cast("string") for c in columns]
    return df.select(F.concat(F.concat_ws(" & ", *cells), F.lit(" \\\\")).alias("value"))


def append_log(df: DataFrame, path: str) -> None:
    """Append rows to a log of JSON lines."""
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Rows as CSV with a header from the schema."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_corpus(corpus, path: str) -> None:
    """The three tables of a corpus below ``path``."""
    for name in ("concepts", "texts", "assay"):
        getattr(corpus, name).write.mode("overwrite").parquet(f"{path}/{name}")
