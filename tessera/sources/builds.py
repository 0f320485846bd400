"""Reference tables built from source rows, constant catalogues, and fetching from several sources."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import era_years
from tessera.sources.readers import RAW_DOCUMENT, Corpus, catalogue, new_records, read_corpus, register

log = logging.getLogger(__name__)

# Sources known by name: title, author, tradition, language and concepts.
KNOWN_SOURCES = {
    "watsuji_rinrigaku": ("倫理学 (Rinrigaku: Ethics in Japan)", "和辻哲郎", "watsuji_ethics", "ja", [("phil:C00142", "間柄 (aidagara)"), ("phil:C00143", "人間 (ningen)"), ("phil:C00144", "風土 (fudo)")]),
    "nishida_zen_no_kenkyu": ("善の研究 (An Inquiry into the Good)", "西田幾多郎", "kyoto_school", "ja", [("phil:C00045", "場所 (basho)"), ("phil:C00046", "純粋経験 (junsui keiken)"), ("phil:C00047", "絶対無 (zettai mu)")]),
    "heidegger_sein_und_zeit": ("Sein und Zeit", "Martin Heidegger", "phenomenology", "de", [("phil:C00056", "Dasein"), ("phil:C00089", "Mitsein"), ("phil:C00091", "Lichtung")]),
    "daodejing": ("道德經 (Tao Te Ching)", "老子", "daoism", "zh", [("phil:C00012", "道 (dao)"), ("phil:C00178", "wu wei (無為)"), ("phil:C00179", "德 (de)")]),
    "nagarjuna_mmk": ("Mūlamadhyamakakārikā", "Nāgārjuna", "madhyamaka", "sa", [("phil:C00034", "空 (sunyata)"), ("phil:C00145", "pratityasamutpada"), ("phil:C00146", "svabhāva")]),
}

# Works of the public-domain catalogue: number, title, author, tradition.
CLASSIC_WORKS = [
    (1497, "Republic", "Plato", "greek"),
    (1656, "Apology", "Plato", "greek"),
    (1636, "Symposium", "Plato", "greek"),
    (1658, "Phaedo", "Plato", "greek"),
    (5827, "Critique of Pure Reason", "Immanuel Kant", "german"),
    (4280, "Critique of Practical Reason", "Immanuel Kant", "german"),
    (5740, "Meditations", "Marcus Aurelius", "roman"),
    (3600, "An Essay Concerning Human Understanding", "John Locke", "british"),
    (4705, "A Treatise of Human Nature", "David Hume", "british"),
    (10615, "Meditations on First Philosophy", "Rene Descartes", "continental"),
    (1232, "The Prince", "Niccolo Machiavelli", "italian"),
    (7370, "Beyond Good and Evil", "Friedrich Nietzsche", "german"),
    (38427, "Thus Spake Zarathustra", "Friedrich Nietzsche", "german"),
    (30821, "On Liberty", "John Stuart Mill", "british"),
    (11224, "Leviathan", "Thomas Hobbes", "british"),
    (9662, "The Nicomachean Ethics", "Aristotle", "greek"),
    (8438, "Politics", "Aristotle", "greek"),
]
# Authors of the Japanese catalogue.
AOZORA_AUTHORS = {"西田幾多郎": "Kitaro Nishida", "和辻哲郎": "Tetsuro Watsuji", "九鬼周造": "Shuzo Kuki", "三木清": "Kiyoshi Miki", "田辺元": "Hajime Tanabe"}

CONCEPT_ROW = "concept_id string, label_en string, label_ja string, label_de string, label_zh string, label_sa string, definition_en string, tradition string, era string, related_concepts string, wikidata_qid string, inpho_id string"
TRADITION_ROW = "tradition_id string, name_en string, name_ja string, parent string, era_start int, era_end int, region string, description string"


def known_corpus(spark: SparkSession, name: str) -> Corpus:
    """The corpus of a known source: its concepts, one text and no cells."""
    title, author, tradition, language, concepts = KNOWN_SOURCES[name]
    rows = [(i, c, label, [tradition]) for i, (c, label) in enumerate(concepts)]
    texts = spark.createDataFrame([(0, name, title, language, author)], "text_idx int, text_id string, primary_label string, lang string, author string")
    return Corpus(spark.createDataFrame(rows, "concept_idx int, concept_id string, primary_label string, tradition_ids array<string>"), texts, spark.createDataFrame([], "concept_idx int, text_idx int, value double"), {"source": name})


def read(spark: SparkSession, source: str, section: str | None = None, columns: list[str] | None = None) -> Corpus:
    """A known source by its name, else a file by its kind; anything else raises."""
    return known_corpus(spark, source) if source in KNOWN_SOURCES else read_corpus(spark, source, section, columns)


def classic_works(spark: SparkSession, query: str = "", limit: int | None = None) -> DataFrame:
    """(id, title, author, tradition) of the catalogue whose title or author holds ``query``."""
    return catalogue(spark, CLASSIC_WORKS, "id int, title string, author string, tradition string", query, ["title", "author"], limit)


def author_works(index: DataFrame, authors: dict[str, str] | None = None, limit: int | None = None) -> DataFrame:
    """Rows of a landed catalogue index (author, title, url) by the target authors, with author_roman."""
    names = AOZORA_AUTHORS if authors is None else authors
    table = index.sparkSession.createDataFrame(list(names.items()), "author string, author_roman string")
    found = index.join(F.broadcast(table), "author")
    return found.limit(limit) if limit else found


def concepts_table(rows: DataFrame) -> DataFrame:
    """The concept table: one row per concept_id (the first in order of all columns), empty texts null."""
    names = [c.strip().split()[0] for c in CONCEPT_ROW.split(",")]
    clean = rows.select(*[F.nullif(F.trim(F.col(c)), F.lit("")).alias(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in names])
    first = clean.where("concept_id is not null").groupBy("concept_id").agg(F.min(F.struct(*names[1:])).alias("r"))
    return first.select("concept_id", "r.*")


def traditions_table(groups: DataFrame, schools: DataFrame) -> DataFrame:
    """The tradition table of group rows (id, name_en, name_ja, parent, region) and school rows (id,
    name_en, name_ja, parent, era, region): groups come first, the first row of an id holds.  Both have
    a column seq that orders them."""
    years = era_years(F.col("era"))
    about = F.when(F.col("parent").isNull(), F.concat(F.lit("Top-level tradition: "), F.col("name_en"))).otherwise(F.concat(F.lit("Sub-tradition of "), F.col("parent")))
    top = groups.select(F.lit(0).alias("k"), "seq", F.col("id").alias("tradition_id"), "name_en", "name_ja", "parent", F.lit(None).cast("int").alias("era_start"), F.lit(None).cast("int").alias("era_end"), "region", about.alias("description"))
    leaf = schools.withColumn("y", years).select(F.lit(1).alias("k"), "seq", F.col("id").alias("tradition_id"), "name_en", "name_ja", "parent", F.col("y").getField("start").alias("era_start"), F.col("y").getField("end").alias("era_end"), "region", F.concat(F.lit("School within "), F.col("parent")).alias("description"))
    rows = top.unionByName(leaf).where("tradition_id is not null")
    names = [c.strip().split()[0] for c in TRADITION_ROW.split(",")]
    first = rows.groupBy("tradition_id").agg(F.min_by(F.struct(*names[1:]), F.struct("k", "seq")).alias("r"))
    return first.select("tradition_id", "r.*")


def import_records(rows: DataFrame, mapping: dict[str, list[str]], prefix: str) -> DataFrame:
    """Rows of an export with other field names: each target column is the first of its source columns
    that is neither null nor empty, ids get ``prefix``; columns that are missing count as null."""
    present = set(rows.columns)
    some = lambda cs: F.coalesce(*[F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")) for c in cs if c in present], F.lit(None).cast("string"))
    taken = rows.select(*[some(cs).alias(target) for target, cs in mapping.items()])
    return taken.withColumn("id", F.concat(F.lit(f"{prefix}:"), F.col("id"))).where("id is not null")


def fetch_all(sources: dict[str, Callable[[int], DataFrame]], registry: DataFrame, limit_per_source: int = 100, skip_fetched: bool = True) -> tuple[DataFrame | None, DataFrame]:
    """(documents, registry) of several sources: at most ``limit_per_source`` documents of each, without
    those already registered; the new ones are registered.  A source that fails is logged and left out.
    No source gives no documents (null)."""
    found = None
    names = [c.strip().split()[0] for c in RAW_DOCUMENT.replace("map<string,string>", "map").split(",")]
    for name, fetch in sources.items():
        try:
            docs = fetch(limit_per_source).limit(limit_per_source).withColumn("source", F.lit(name))
            docs.schema  # noqa: B018
        except Exception as error:  # noqa: BLE001
            log.warning("source %s failed: %s", name, error)
            continue
        docs = docs.select(*[c for c in names if c in docs.columns])
        found = docs if found is None else found.unionByName(docs, allowMissingColumns=True)
    if found is None:
        return None, registry
    fresh = new_records(found, registry) if skip_fetched else found
    return fresh, register(registry, fresh)


def collection_plan(traditions: list[str], languages: list[str], names: dict[str, str] | None = None) -> list[tuple[str, str | None, str | None, str]]:
    """(entry_type, tradition, language, query) of a collection: by tradition, by language, and both."""
    spoken = lambda t: (names or {}).get(t, t.replace("_", " "))
    plan: list[tuple[str, str | None, str | None, str]] = [("tradition", t, None, spoken(t)) for t in traditions]
    plan += [("language", None, x, "philosophy") for x in languages]
    return plan + [("tradition_language", t, x, spoken(t)) for t in traditions for x in languages]


def write_collection(raw: DataFrame, core: DataFrame, coverage: DataFrame, manifest: DataFrame, path: str) -> None:
    """The outputs of a collection as JSON lines below ``path``: raw, filtered, coverage, manifest."""
    for name, df in (("raw", raw), ("filtered", core), ("coverage", coverage), ("manifest", manifest)):
        df.write.mode("overwrite").json(f"{path}/{name}")


def export(df: DataFrame, kind: str, path: str) -> None:
    """``df`` as json, csv or parquet; other kinds raise."""
    if kind not in ("json", "csv", "parquet"):
        raise ValueError(f"no export as {kind}")
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else getattr(writer, kind)(path)
