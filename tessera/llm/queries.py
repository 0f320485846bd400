"""Queries of the training-data problems, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.history import History
from tessera.llm.langid import label_languages, mislabelled
from tessera.llm.languages import NAMES
from tessera.llm.mixing import shares, sized, source_rates
from tessera.llm.neighbours import nearest, pairs, vectors
from tessera.llm.packing import pack, pieces
from tessera.llm.proportions import sample_to_targets
from tessera.llm.residue import residue
from tessera.llm.scans import read_scans, repair
from tessera.storage import read_table

CAPACITY = 4096


def _sampled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return sample_to_targets(*[read_table(spark, sf_dir, t) for t in ("manifest", "runs", "coverage_targets")])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, kind, category, missing): targets that a run cannot fill."""
    return _sampled(spark, sf_dir)[1].where("missing > 0").select("run_id", "kind", "category", "missing")


def p1_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers drawn from each entry: run_id, tradition, language, entry_id, papers."""
    return _sampled(spark, sf_dir)[0].fillna("", ["tradition", "language"])


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, kind, category, need, supply, filled): how far the sample fills each target."""
    return _sampled(spark, sf_dir)[1].select("run_id", "kind", "category", "need", "supply", F.least("need", "drawn").alias("filled"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id): documents that had to be cut into several containers."""
    packed = pack(pieces(read_table(spark, sf_dir, "documents"), "doc_id", "text", CAPACITY), CAPACITY)
    return packed.where("piece > 1").select(F.col("item").alias("doc_id")).distinct()


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, container, items, used, slack) of every container."""
    packed = pack(pieces(read_table(spark, sf_dir, "documents"), "doc_id", "text", CAPACITY), CAPACITY)
    per = packed.groupBy("grp", "container").agg(F.count(F.lit(1)).alias("items"), F.sum("size").alias("used"))
    return per.withColumn("slack", F.lit(CAPACITY) - F.col("used"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source): sources that miss their weight even at full repetition."""
    rates = source_rates(sized(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "mix_weights"))
    return rates.where("short").select("source")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mixtures reach per source."""
    counted = sized(read_table(spark, sf_dir, "documents"))
    return shares(counted, source_rates(counted, read_table(spark, sf_dir, "mix_weights")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id): documents that hold residue."""
    return residue(read_table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_no, segment_no, lang): abstracts with a missing or wrong label or several languages."""
    docs = read_table(spark, sf_dir, "raw_documents").select("rec_no", "language", "abstract").where("abstract is not null")
    found = mislabelled(label_languages(docs, read_table(spark, sf_dir, "documents"), "abstract", "language", "text", "lang"), "language")
    return found.select("rec_no", F.explode("segments").alias("s")).select("rec_no", "s.segment_no", "s.lang")


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_no, text): full texts as continuous paragraphs."""
    raw = read_table(spark, sf_dir, "raw_documents")
    return repair(raw, read_scans(raw))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(facet, concept_a, concept_b): pairs of which either is among the other's five nearest."""
    vecs = vectors(read_table(spark, sf_dir, "facets"), "concept_id", ["definition", "usage", "relational"], 64)
    return pairs(nearest(vecs, 64, 5)).select(F.col("name").alias("facet"), F.col("a").alias("concept_a"), F.col("b").alias("concept_b"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kept_rec_no, rec_no): records of works already held, with the record that was kept.

    The accepted history and then every batch is ingested on its own, in order of arrival; records
    without a batch come last."""
    raw = read_table(spark, sf_dir, "raw_documents")
    history = History(spark)
    numbers = [r["batch_no"] for r in raw.select("batch_no").distinct().collect()]
    for number in sorted(numbers, key=lambda n: (n is None, n)):
        history.ingest(raw.where(F.col("batch_no").eqNullSafe(F.lit(number))))
    return history.works()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_no, line_no, kind, word): furniture, split words and misread words of scanned texts."""
    found = read_scans(read_table(spark, sf_dir, "raw_documents"))
    return found.select("rec_no", "line_no", "kind", "word").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_sample, p1_report, p2_found, p2_repaired, p4_found, p5_found, p6_found, p8_found, p8_containers, p9_found, p9_shares, p10_found)}


def _language_sql(c: str) -> str:
    tests = " ".join(f"WHEN x IN ({', '.join(repr(n) for n in (code, *names))}) THEN '{code}'" for code, names in NAMES.items())
    return f"(SELECT CASE {tests} END FROM (SELECT regexp_extract(lower(trim({c})), '^[^-_]*') AS x))"


def _name_sql(c: str) -> str:
    stripped = f"regexp_replace({c}, '^[\\s\\x{{a0}}\\x{{3000}}]+|[\\s\\x{{a0}}\\x{{3000}}]+$', '', 'g')"
    return f"regexp_replace(lower({stripped}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', '_', 'g')"


_SUPPLY_SQL = f"""WITH e AS (SELECT entry_id, any_value(run_id) AS run_id, any_value(tradition) AS tradition, any_value(language) AS language, any_value("count") AS n FROM manifest GROUP BY 1),
k AS (SELECT run_id, 'tradition' AS kind, {_name_sql('tradition')} AS key, n FROM e WHERE n > 0 UNION ALL SELECT run_id, 'language', {_language_sql('language')}, n FROM e WHERE n > 0),
s AS (SELECT run_id, kind, key, sum(n) AS supply FROM k WHERE key IS NOT NULL GROUP BY ALL),
t AS (SELECT run_id, kind, category, greatest(min_rows, (share_bp * sample_size::BIGINT + 9999) // 10000) AS need, CASE WHEN kind = 'language' THEN {_language_sql('category')} ELSE {_name_sql('category')} END AS key FROM runs, coverage_targets)"""

ORACLES: dict[str, str] = {
    "p1_found": f"{_SUPPLY_SQL} SELECT t.run_id, t.kind, t.category, (need - coalesce(supply, 0))::BIGINT AS missing FROM t LEFT JOIN s USING (run_id, kind, key) WHERE coalesce(supply, 0) < need",
    "p1_report": f"{_SUPPLY_SQL} SELECT t.run_id, t.kind, t.category, need::BIGINT AS need, coalesce(supply, 0)::BIGINT AS supply, least(need, coalesce(supply, 0))::BIGINT AS filled FROM t LEFT JOIN s USING (run_id, kind, key)",
    "p4_found": " UNION ALL ".join(
        f"""SELECT DISTINCT '{f}' AS facet, least(a, b) AS concept_a, greatest(a, b) AS concept_b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS r FROM (
SELECT x.concept_id AS a, y.concept_id AS b, round(list_cosine_similarity(x.{f}, y.{f}), 6) AS sim FROM (SELECT DISTINCT concept_id, {f} FROM facets WHERE len({f}) = 64 AND list_aggregate(list_transform({f}, lambda v: abs(v)), 'max') > 0) x
JOIN (SELECT DISTINCT concept_id, {f} FROM facets WHERE len({f}) = 64 AND list_aggregate(list_transform({f}, lambda v: abs(v)), 'max') > 0) y ON x.concept_id <> y.concept_id)) WHERE r <= 5"""
        for f in ("definition", "usage", "relational")
    ),
}

# Words and signs, or the letters of scripts without blanks: the results are the same under any tokenizer.
_SIZE_SQL = r"coalesce(greatest(len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')), len(regexp_extract_all(text, '[\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}]'))), 0)"
ORACLES["p8_found"] = f"SELECT DISTINCT doc_id FROM documents WHERE {_SIZE_SQL} > 4096"
ORACLES["p9_found"] = f"""WITH d AS (SELECT source, sum({_SIZE_SQL}) AS n FROM documents GROUP BY 1), t AS (SELECT sum(n) AS total FROM d)
SELECT w.source FROM mix_weights w CROSS JOIN t LEFT JOIN d USING (source) WHERE coalesce(d.n, 0) * w.max_repeat < w.weight_bp / 10000 * t.total"""
