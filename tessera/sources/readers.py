"""Readers of corpora, graphs, annotation logs and landed records, all with explicit schemas."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_DOCUMENT = (
    "id string, title string, authors array<string>, year int, language string, tradition string, source string, url string, fulltext_url string, license string, "
    "abstract string, fulltext string, metadata map<string,string>"
)
CONCEPT = "concept_id string, primary_label string, tradition_ids array<string>"
TEXT = "text_id string, primary_label string, lang string"
CORPUS = f"struct<concepts:array<struct<{CONCEPT.replace(' string', ':string').replace(' array', ':array')}>>,texts:array<struct<{TEXT.replace(' string', ':string')}>>,assay:array<array<double>>>"
NODE = "uid string, node_type string, label string, labels_i18n map<string,string>, external_ids map<string,string>, provenance array<string>, birth_year int, death_year int, year int, definition string, tradition_uids array<string>"
EDGE = "src string, dst string, edge_type string, confidence double, evidence_sources array<string>, consensus string, temporal_start int, temporal_end int, notes string, provenance string"
PLACES = ("concept_idx", "text_idx", "value")


class Corpus:
    """Concepts, texts and the cells of one or several assays, each a table."""

    def __init__(self, concepts: DataFrame, texts: DataFrame, assay: DataFrame, metadata: dict | None = None):
        self.concepts, self.texts, self.assay, self.metadata = concepts, texts, assay, metadata or {}

    def shape(self) -> tuple[int, int]:
        return self.concepts.count(), self.texts.count()

    def subset(self, concepts: list[int] | None = None, texts: list[int] | None = None) -> Corpus:
        """Rows at the given positions, in the given order and as often as given, renumbered."""
        return Corpus(_pick(self.concepts, "concept_idx", concepts), _pick(self.texts, "text_idx", texts), _pick(_pick(self.assay, "concept_idx", concepts), "text_idx", texts), self.metadata)

    def issues(self) -> DataFrame:
        """(issue, n): cells that point at no concept or text, and repeated positions."""
        lost = [self.assay.join(df.select(c), c, "left_anti").agg(F.lit(f"cells without {c}").alias("issue"), F.count(F.lit(1)).alias("n")) for df, c in ((self.concepts, "concept_idx"), (self.texts, "text_idx"))]
        twice = [df.groupBy(c).count().where("count > 1").agg(F.lit(f"repeated {c}").alias("issue"), F.count(F.lit(1)).alias("n")) for df, c in ((self.concepts, "concept_idx"), (self.texts, "text_idx"))]
        return lost[0].unionByName(lost[1]).unionByName(twice[0]).unionByName(twice[1]).where("n > 0")

    def validate(self) -> Corpus:
        """This corpus; raises where ``issues`` finds any."""
        if found := [r.issue for r in self.issues().collect()]:
            raise ValueError(", ".join(found))
        return self


def _pick(df: DataFrame, column: str, positions: list[int] | None) -> DataFrame:
    if positions is None:
        return df
    order = df.sparkSession.createDataFrame(list(enumerate(positions)), "__new int, __old int")
    return df.join(order, F.col(column) == F.col("__old")).withColumn(column, F.col("__new")).drop("__new", "__old")


def corpus_from_tables(concepts: DataFrame, texts: DataFrame, assay: DataFrame | None = None) -> Corpus:
    """A corpus from entity tables that carry concept_idx and text_idx; without an assay all cells are
    absent, which counts as zero."""
    empty = concepts.sparkSession.createDataFrame([], "concept_idx int, text_idx int, value double")
    return Corpus(concepts, texts, assay if assay is not None else empty)


def read_json_corpus(spark: SparkSession, path: str) -> Corpus:
    """A file {"concepts": [...], "texts": [...], "assay": [[...]]} as tables; a missing assay is all
    zero, zero cells are left out."""
    doc = spark.read.schema(f"concepts array<struct<{CONCEPT.replace(' ', ':').replace(',:', ',')}>>, texts array<struct<{TEXT.replace(' ', ':').replace(',:', ',')}>>, assay array<array<double>>").json(path, multiLine=True)
    concepts = doc.select(F.posexplode("concepts").alias("concept_idx", "c")).select("concept_idx", "c.*")
    texts = doc.select(F.posexplode("texts").alias("text_idx", "t")).select("text_idx", "t.*")
    cells = doc.select(F.posexplode("assay").alias("concept_idx", "row")).select("concept_idx", F.posexplode("row").alias("text_idx", "value"))
    return Corpus(concepts, texts, cells.where("value <> 0"), {"path": path})


def read_csv_corpus(spark: SparkSession, path: str, columns: list[str]) -> Corpus:
    """A CSV file with a header: rows become concepts row:i, the numeric ``columns`` texts."""
    schema = ", ".join(f"`{c}` string" for c in spark.read.option("header", True).csv(path).columns)
    rows = spark.read.schema(schema).option("header", True).csv(path).withColumn("concept_idx", F.monotonically_increasing_id())
    values = F.array(*[F.col(f"`{c}`").try_cast("double") for c in columns])
    concepts = rows.select("concept_idx", F.concat(F.lit("row:"), F.col("concept_idx").cast("string")).alias("concept_id"))
    texts = spark.createDataFrame(list(enumerate(columns)), "text_idx int, text_id string")
    return Corpus(concepts, texts, rows.select("concept_idx", F.posexplode(values).alias("text_idx", "value")).where("value <> 0"), {"path": path})


def read_corpus(spark: SparkSession, path: str, section: str | None = None, columns: list[str] | None = None) -> Corpus:
    """A corpus by the kind of its file; unknown kinds raise.  ``section`` keeps texts of that section."""
    kind = os.path.splitext(path)[1].lower()
    if kind in (".json", ".rds"):
        corpus = read_json_corpus(spark, path)
    elif kind == ".csv":
        corpus = read_csv_corpus(spark, path, columns or [])
    elif kind == ".parquet":
        corpus = Corpus(*[spark.read.parquet(f"{path}/{t}") for t in ("concepts", "texts", "assay")], {"path": path})
    elif kind in (".yaml", ".yml"):
        corpus = _yaml_corpus(spark, path)
    else:
        raise ValueError(f"no reader for {path}")
    if section is not None:
        kept = corpus.texts.where(F.col("section") == section) if "section" in corpus.texts.columns else corpus.texts.limit(0)
        corpus = Corpus(corpus.concepts, kept, corpus.assay.join(kept.select("text_idx"), "text_idx", "left_semi"), corpus.metadata | {"section": section})
    return corpus


def _yaml(path: str) -> dict:
    try:
        import yaml
    except ImportError as missing:
        raise ValueError("reading YAML needs the yaml package") from missing
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def _yaml_corpus(spark: SparkSession, path: str) -> Corpus:
    doc = _yaml(path)
    concepts = [(i, c.get("concept_id"), c.get("primary_label"), c.get("tradition_ids", [])) for i, c in enumerate(doc.get("concepts", []))]
    texts = [(i, t.get("text_id"), t.get("primary_label"), t.get("lang")) for i, t in enumerate(doc.get("texts", []))]
    cells = [(i, j, float(v)) for i, row in enumerate(doc.get("assay", [])) for j, v in enumerate(row) if v]
    return Corpus(spark.createDataFrame(concepts, f"concept_idx int, {CONCEPT}"), spark.createDataFrame(texts, f"text_idx int, {TEXT}"), spark.createDataFrame(cells, "concept_idx int, text_idx int, value double"), {"path": path})


def read_texts(spark: SparkSession, path: str, language: str) -> DataFrame:
    """One row per text file: id local:<stem>, the whole text and the language."""
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)
    return spark.read.text(path, wholetext=True).select(F.concat(F.lit("local:"), stem).alias("id"), F.col("value").alias("fulltext"), F.lit(language).alias("language"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Landed records as JSON lines in the raw-document schema; malformed lines are skipped."""
    return spark.read.schema(RAW_DOCUMENT).option("mode", "DROPMALFORMED").json(path)


def read_annotations(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An annotation log of JSON lines; blank and malformed lines are skipped, a missing file is empty."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], schema)
        raise


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a YAML file with the lists nodes and edges; nodes of unknown type are skipped,
    edges of unknown type raise; provenance gets "manual"."""
    from tessera.functions.lexicons import EDGE_CONSTRAINTS

    doc = _yaml(path)
    kinds = {k for pairs in EDGE_CONSTRAINTS.values() for p in pairs for k in p}
    bad = [e for e in doc.get("edges", []) if e.get("type") not in EDGE_CONSTRAINTS]
    if bad:
        raise ValueError(f"unknown edge types in {bad[:3]}")
    nodes = [
        (n["uid"], n["type"], n.get("label"), n.get("labels_i18n") or {}, n.get("external_ids") or {}, [*(n.get("provenance") or []), "manual"], n.get("birth_year"), n.get("death_year"), n.get("year"), n.get("definition"), n.get("tradition_uids") or [])
        for n in doc.get("nodes", [])
        if n.get("type") in kinds
    ]
    edges = [(e["source"], e["target"], e["type"], float(e.get("confidence", 1.0)), e.get("evidence_sources") or [], e.get("consensus", "established"), e.get("temporal_start"), e.get("temporal_end"), e.get("notes"), "manual") for e in doc.get("edges", [])]
    return spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)


def read_bindings(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Nodes from landed SPARQL result bindings of one kind (m and its labels): uid <kind>:wd:<qid>."""
    cell = "struct<type:string,value:string>"
    rows = spark.read.schema(f"results struct<bindings:array<struct<m:{cell},mLabel:{cell},mLabel_ja:{cell},birthYear:{cell},deathYear:{cell}>>>").json(path, multiLine=True)
    b = rows.select(F.explode("results.bindings").alias("b")).select("b.*")
    qid = F.regexp_extract("m.value", "(Q[0-9]+)$", 1)
    year = lambda c: F.col(f"{c}.value").try_cast("double").try_cast("int")
    return b.where(qid != "").select(F.concat(F.lit(f"{kind}:wd:"), qid).alias("uid"), F.col("mLabel.value").alias("label"), F.col("mLabel_ja.value").alias("label_ja"), year("birthYear").alias("birth_year"), year("deathYear").alias("death_year"), F.create_map(F.lit("wikidata"), qid).alias("external_ids"))


def openalex_documents(works: DataFrame) -> DataFrame:
    """Landed works (id, title, display_name, publication_year, language, abstract_inverted_index,
    open_access, best_oa_location, authorships, concepts) as raw documents; empty strings fall through."""
    from tessera.functions.text import abstract_of

    some = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])
    authors: Column = F.filter(F.transform("authorships", lambda a: a["author"]["display_name"]), lambda n: n.isNotNull() & (n != ""))
    return works.select(
        "id", some(F.col("title"), F.col("display_name")).alias("title"), authors.alias("authors"), F.col("publication_year").cast("int").alias("year"), "language", F.lit("openalex").alias("source"),
        F.col("id").alias("url"), some(F.col("best_oa_location.pdf_url"), F.col("open_access.oa_url")).alias("fulltext_url"), F.col("best_oa_location.license").alias("license"),
        abstract_of(F.col("abstract_inverted_index")).alias("abstract"), F.slice(F.transform("concepts", lambda c: c["display_name"]), 1, 5).alias("concepts"),
    )


def catalogue(spark: SparkSession, rows: list[tuple], schema: str, query: str, columns: list[str], limit: int | None = None) -> DataFrame:
    """A constant catalogue filtered by a substring in any of ``columns`` regardless of case."""
    low = query.lower()
    tests = [F.contains(F.lower(F.col(c)), F.lit(low)) for c in columns]
    test = tests[0]
    for t in tests[1:]:
        test = test | t
    found = spark.createDataFrame(rows, schema).where(test)
    return found.limit(limit) if limit else found


def new_records(records: DataFrame, registry: DataFrame) -> DataFrame:
    """Records whose id the registry does not hold; records without an id are new."""
    return records.join(registry.select("id").where("id is not null").distinct(), "id", "left_anti")


def register(registry: DataFrame, records: DataFrame) -> DataFrame:
    """The registry with the ids of ``records`` added; the latest entry of an id holds."""
    more = records.select("id", "source", F.current_timestamp().alias("fetched_at")).where("id is not null")
    whole = registry.select("id", "source", "fetched_at").unionByName(more)
    return whole.groupBy("id").agg(F.max_by(F.struct("source", "fetched_at"), "fetched_at").alias("r")).select("id", "r.*")
