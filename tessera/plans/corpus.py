"""Text, collection and annotation queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import lexicons as L
from tessera.functions import text as T
from tessera.operators import annotation as A
from tessera.operators import rhetoric as R
from tessera.operators.packed import explode_packed
from tessera.plans.general import PACKED_SQL
from tessera.sources.readers import new_records
from tessera.storage import read_table
from tessera.streaming.incremental import session_counts, windowed_counts

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


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def _listed(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _rounded(features: dict) -> list:
    return [F.round(c, 6).alias(n) if n in ("ttr", "hapax_ratio", "mean_length", "marker_density", "long_share") else c.alias(n) for n, c in features.items()]


_SPLIT = r"string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(
    rf"""WITH u AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS w FROM documents),
c AS (SELECT doc_id, w, count(*) AS n FROM u GROUP BY ALL),
a AS (SELECT doc_id, sum(n) AS n_tokens, count(*) AS n_types, count(*) FILTER (n = 1) AS once, sum(n * length(w)) AS letters,
  coalesce(sum(n) FILTER (w IN ({_listed(L.ARGUMENT_MARKERS)})), 0) AS marks, coalesce(sum(n) FILTER (length(w) > 10), 0) AS longs FROM c GROUP BY 1)
SELECT d.doc_id, coalesce(n_tokens, 0)::BIGINT AS n_tokens, coalesce(n_types, 0)::BIGINT AS n_types, coalesce(round(n_types / n_tokens, 6), 0.0) AS ttr,
  coalesce(round(once / n_types, 6), 0.0) AS hapax_ratio, coalesce(round(letters / n_tokens, 6), 0.0) AS mean_length, coalesce(round(marks / n_tokens, 6), 0.0) AS marker_density,
  len(list_filter(string_split_regex(coalesce(text, ''), '[.!?]+'), lambda s: trim(s) <> ''))::BIGINT AS n_sentences, coalesce(round(longs / n_tokens, 6), 0.0) AS long_share
FROM documents d LEFT JOIN a USING (doc_id)"""
)
def lexical_features(spark, sf_dir):
    """Eight lexical features of every document."""
    found = _docs(spark, sf_dir).select("doc_id", T.lexical_features(F.col("text"), L.ARGUMENT_MARKERS).alias("f")).select("doc_id", "f.*")
    return found.select("doc_id", *_rounded({c: F.col(c) for c in found.columns[1:]}))


@query(
    r"""WITH t AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(w)::BIGINT AS n_tokens, len(list_distinct(w))::BIGINT AS n_types, CASE WHEN len(w) > 0 THEN round(len(list_distinct(w)) / len(w), 6) ELSE 0.0 END AS ttr,
  CASE WHEN len(w) > 0 THEN round(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) / len(w), 6) ELSE 0.0 END AS mean_length FROM t"""
)
def plain_lexical_features(spark, sf_dir):
    """Counts over whitespace tokens, case and signs kept."""
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", *_rounded(T.plain_features(F.col("text"))))


@query(
    rf"""WITH t AS (SELECT doc_id, text, list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(list_filter(string_split_regex(text, '[.!?]+'), lambda s: s <> ''))::BIGINT AS n_sentences,
  CASE WHEN len(w) > 0 THEN round(len(list_filter(w, lambda x: x IN ({_listed(L.STRUCTURE_MARKERS)}))) / len(w), 6) ELSE 0.0 END AS marker_density FROM t"""
)
def structural_features(spark, sf_dir):
    """Sentence pieces and marker density of every document."""
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", *_rounded(T.structural_features(F.col("text"), L.STRUCTURE_MARKERS)))


@query(
    r"""WITH t AS (SELECT regexp_extract(substring(text, 1, 100), '[\x{4e00}-\x{9fff}\x{0900}-\x{097f}\x{0370}-\x{03ff}]') AS c FROM documents WHERE text IS NOT NULL)
SELECT CASE WHEN c = '' THEN 'default' WHEN c >= '一' THEN 'cjk' WHEN c >= 'ऀ' THEN 'indic' ELSE 'greek' END AS script, count(*) AS n FROM t GROUP BY 1"""
)
def script_counts(spark, sf_dir):
    """Documents by the script of their first telling letter."""
    return _docs(spark, sf_dir).where("text is not null").groupBy(T.script(F.col("text")).alias("script")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, md5(regexp_replace(text, '([。！？])', '\\1' || chr(10), 'g')) AS h FROM documents WHERE lang IN ('zh', 'ja') AND text IS NOT NULL")
def kanbun_segments(spark, sf_dir):
    """Chinese and Japanese texts with a line for each sentence, as a digest."""
    return _docs(spark, sf_dir).where("lang in ('zh', 'ja') and text is not null").select("doc_id", F.md5(T.kanbun_lines(F.col("text"))).alias("h"))


@query(rf"SELECT doc_id, len(list_filter(list_transform({_SPLIT}, lambda s: {_STRIP.format('s')}), lambda s: s <> ''))::BIGINT AS n FROM documents WHERE text IS NOT NULL")
def sentence_counts(spark, sf_dir):
    """Sentences of every document."""
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", F.size(T.sentences(F.col("text"))).cast("bigint").alias("n"))


_SEGMENTS = rf"list_filter(list_transform(string_split_regex(text, '\n'), lambda s: {_STRIP.format('s')}), lambda s: length(s) > 20)"


@query(f"SELECT doc_id, len({_SEGMENTS})::BIGINT AS n FROM documents WHERE text IS NOT NULL")
def segment_counts(spark, sf_dir):
    """Paragraph segments of every document."""
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", F.size(T.paragraphs(F.col("text"), "\n")).cast("bigint").alias("n"))


@query(f"WITH t AS (SELECT doc_id, {_SEGMENTS} AS s FROM documents WHERE text IS NOT NULL) SELECT doc_id, generate_subscripts(s, 1)::INT AS segment_no, md5(unnest(s)) AS h, 1.0::DOUBLE AS value FROM t")
def onehot_segments(spark, sf_dir):
    """Membership of segments in documents in long form."""
    rows = _docs(spark, sf_dir).where("text is not null").select("doc_id", F.posexplode(T.paragraphs(F.col("text"), "\n")).alias("i", "s"))
    return rows.select("doc_id", (F.col("i") + 1).alias("segment_no"), F.md5("s").alias("h"), F.lit(1.0).alias("value"))


@query(
    r"""WITH t AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, w, unnest(range(0, len(w), 192)) AS a FROM t)
SELECT doc_id, (a / 192)::INT AS chunk_no, md5(array_to_string(w[a + 1 : a + 256], ' ')) AS h FROM r"""
)
def word_chunks(spark, sf_dir):
    """Overlapping windows of 256 words."""
    return T.word_windows(_docs(spark, sf_dir), "text", ["doc_id"]).select("doc_id", "chunk_no", F.md5("chunk").alias("h"))


_INDICATORS = {"premise": [r"\bif\b", r"\bneither\b"], "conclusion": [r"\bit follows that\b", r"\bwe argue that\b"]}
_CUT = r"regexp_replace(regexp_replace({}, '^\s+|\s+$', '', 'g'), '^[,;.]+|[,;.]+$', '', 'g')"
_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(s, '(?i){}', '', 'g'), '(?i){}', '', 'g'), '^[ ,.;:]+|[ ,.;:]+$', '', 'g')"


@query(
    rf"""WITH p AS (SELECT doc_id, list_filter(list_transform({_SPLIT}, lambda s: {_STRIP.format('s')}), lambda s: s <> '') AS l FROM documents WHERE lang = 'en' AND text IS NOT NULL),
x AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM p),
f AS (SELECT *, regexp_matches(s, '(?i)\bit follows that\b|\bwe argue that\b') AS c, regexp_matches(s, '(?i)\bif\b|\bneither\b') AS a FROM x),
h AS (SELECT *, CASE WHEN regexp_matches(s, '(?i)\bit follows that\b') THEN regexp_extract(s, '(?is)^(.*?)\bit follows that\b', 1) ELSE regexp_extract(s, '(?is)^(.*?)\bwe argue that\b', 1) END AS before,
  CASE WHEN regexp_matches(s, '(?i)\bit follows that\b') THEN regexp_extract(s, '(?is)\bit follows that\b(.*)$', 1) ELSE regexp_extract(s, '(?is)\bwe argue that\b(.*)$', 1) END AS after FROM f WHERE c OR a),
g AS (SELECT doc_id, i, CASE WHEN c AND a THEN {_CUT.format('before')} WHEN a THEN {_CLEAN.format(*_INDICATORS['premise'])} END AS pr,
  CASE WHEN c AND a THEN {_CUT.format('after')} WHEN c THEN {_CLEAN.format(*_INDICATORS['conclusion'])} END AS co FROM h)
SELECT doc_id, count(*) FILTER (length(pr) > 15) AS n_premises, md5(string_agg(trim(pr), '|' ORDER BY i) FILTER (length(pr) > 15)) AS premises, md5(trim(max_by(co, i) FILTER (length(co) > 15))) AS conclusion
FROM g GROUP BY doc_id HAVING count(*) FILTER (length(pr) > 15) > 0 AND count(*) FILTER (length(co) > 15) > 0"""
)
def argument_extract(spark, sf_dir):
    """The argument of each English document by a lexicon that occurs in these texts."""
    found = R.extract_arguments(_docs(spark, sf_dir).where("lang = 'en'"), "text", "doc_id", _INDICATORS)
    return found.select("doc_id", F.size("premises").cast("bigint").alias("n_premises"), F.md5(F.array_join("premises", "|")).alias("premises"), F.md5("conclusion").alias("conclusion"))


def _any_sql(column: str, patterns: list[str]) -> str:
    joined = "|".join(f"(?:{p})" for p in patterns).replace("'", "''")
    return f"regexp_matches({column}, '(?i){joined}')"


_TERMS = "|".join(L.THESIS_TERMS["en"])
_EN_NEGATION = r"\b(not|no|never|neither|nor|cannot|impossible)\b"


@query(
    rf"""WITH p AS (SELECT doc_id, list_filter(list_transform({_SPLIT}, lambda s: {_STRIP.format('s')}), lambda s: s <> '') AS l FROM documents WHERE lang = 'en' AND text IS NOT NULL),
x AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1)::INT AS sentence_no FROM p),
h AS (SELECT *, list_transform(regexp_extract_all(s, '(?i)\b({_TERMS})\b', 1), lambda w: lower(w)) AS hits FROM x WHERE length(s) BETWEEN 30 AND 500 AND NOT {_any_sql('s', L.THESIS_EXCLUSIONS['en'])})
SELECT doc_id, sentence_no, (least(len(hits), 5) + CASE WHEN {_any_sql('s', L.THESIS_ASSERTIONS['en'])} THEN 1.5 ELSE 0 END + CASE WHEN {_any_sql('s', [L.UNIVERSAL])} THEN 1 ELSE 0 END
  + CASE WHEN {_any_sql('s', [L.DEFINITION])} THEN 1 ELSE 0 END)::DOUBLE AS score,
  CASE {' '.join(f"WHEN list_has_any(hits, [{_listed(words)}]) THEN '{name}'" for name, words in L.THESIS_TYPES)} END AS thesis_type, {_any_sql('s', [_EN_NEGATION])} AS is_negation
FROM h WHERE len(hits) >= 2"""
)
def thesis_scores(spark, sf_dir):
    """Sentences of English documents that read like theses."""
    found = R.score_theses(_docs(spark, sf_dir).where("lang = 'en'"), "text", "doc_id")
    return found.select("doc_id", "sentence_no", "score", "thesis_type", "is_negation")


def _relevance_sql() -> str:
    count = lambda words: " + ".join(f"contains(t, '{w}')::INT" for w in words).replace("kant's", "kant''s")
    own = "CASE " + " ".join(f"WHEN lang = '{k}' THEN {count(ws)}" for k, ws in L.KEYWORDS.items()) + " ELSE 0 END"

    def hit(patterns):
        tests = [f"regexp_matches(t, '{p.replace('(?!on' + chr(92) + 'b)', '')}')" if p.startswith(r"\b") else f"contains(t, '{p}')" for p in (q.replace("'", "''") for q in patterns)]
        return f"({' OR '.join(tests)})::INT"

    barred = " OR ".join(f"contains(t, '{w}')" for w in L.EXCLUDED_DOMAINS)
    return f"""WITH d AS (SELECT rec_no, lower(coalesce(title, '')) || ' ' || lower(coalesce(abstract, '')) AS t, length(lower(coalesce(abstract, ''))) AS size, coalesce(language, 'unknown') AS lang FROM raw_documents),
k AS (SELECT *, {count(L.KEYWORDS_EN)} AS en, {own} AS own, (lang IN ('en', 'unknown') AND ({barred})) AS excluded, {' + '.join(hit(ps) for ps in L.TRADITION_PATTERNS.values())} AS n FROM d),
s AS (SELECT rec_no, greatest(0, least((en + own) * 10, 50) + CASE WHEN lang NOT IN ('en', 'unknown') AND own > 0 THEN 25 WHEN lang NOT IN ('en', 'unknown') AND en + own = 0 AND length(t) > 50 THEN 15 ELSE 0 END
  - CASE WHEN excluded THEN 30 ELSE 0 END + CASE WHEN size > 200 THEN 10 ELSE 0 END + 15 * n)::INT AS score, excluded, n::INT AS n_traditions FROM k)
SELECT rec_no, score, excluded, n_traditions, (score >= 40 AND NOT excluded) AS is_core FROM s"""


@query(_relevance_sql())
def relevance_scores(spark, sf_dir):
    """Relevance of every raw document."""
    found = R.relevance(read_table(spark, sf_dir, "raw_documents").select("rec_no", "title", "abstract", "language"), "title", "abstract", "language")
    return found.select("rec_no", "score", "excluded", F.size("traditions").alias("n_traditions"), "is_core")


@query(
    """SELECT t.category, t.min_rows::BIGINT AS target, coalesce(a.n, 0)::BIGINT AS actual, coalesce(round(a.n / t.min_rows, 6), 0.0) AS ratio, coalesce(a.n, 0) >= t.min_rows AS met
FROM coverage_targets t LEFT JOIN (SELECT tradition, count(*) AS n FROM documents GROUP BY 1) a ON t.category = a.tradition WHERE t.kind = 'tradition'"""
)
def coverage_report(spark, sf_dir):
    """Documents per tradition against the least numbers wanted."""
    targets = read_table(spark, sf_dir, "coverage_targets").where("kind = 'tradition'").select(F.col("category").alias("tradition"), "min_rows")
    return R.coverage(_docs(spark, sf_dir), targets, "tradition", "min_rows").withColumn("ratio", F.round("ratio", 6))


@query("SELECT CASE WHEN year < 1900 THEN 'pre_1900' WHEN year < 1950 THEN '1900_1950' WHEN year < 2000 THEN '1950_2000' ELSE '2000_present' END AS era, count(*) AS n FROM documents WHERE year IS NOT NULL AND year <> 0 GROUP BY 1")
def temporal_coverage(spark, sf_dir):
    """Documents per era."""
    return _docs(spark, sf_dir).select(R.era(F.col("year")).alias("era")).where("era is not null").groupBy("era").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT rec_no, id FROM (SELECT rec_no, id, row_number() OVER (PARTITION BY coalesce(nullif(id, ''), md5(title)) ORDER BY rec_no) AS r FROM raw_documents) WHERE r = 1")
def dedup_first(spark, sf_dir):
    """First record of each id, or of each title where the id is missing."""
    rows = read_table(spark, sf_dir, "raw_documents").select("rec_no", "id", "title")
    return R.first_per_key(rows, F.coalesce(F.nullif(F.col("id"), F.lit("")), F.md5("title")), "rec_no").select("rec_no", "id")


_PHRASES = r"list_distinct(list_transform(list_filter(string_split_regex(lower({}), '\s+'), lambda w: length(w) > 3), lambda w: regexp_replace(w, '^[.,;:()]+|[.,;:()]+$', '', 'g')))"


@query(
    f"""WITH p AS (SELECT doc_id, {_PHRASES.format('text')} AS w FROM documents WHERE text IS NOT NULL)
SELECT a.doc_id, len(list_intersect(a.w, b.w))::BIGINT AS shared, len(list_filter(a.w, lambda x: NOT list_contains(b.w, x)))::BIGINT AS only_a, len(list_filter(b.w, lambda x: NOT list_contains(a.w, x)))::BIGINT AS only_b
FROM p a JOIN p b ON b.doc_id = a.doc_id + 1"""
)
def token_set_diff(spark, sf_dir):
    """Words that each document shares with the next."""
    docs = _docs(spark, sf_dir).where("text is not null").select("doc_id", "text")
    pairs = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other")), "doc_id")
    diff = R.phrase_diff(F.col("text"), F.col("other"))
    return pairs.select("doc_id", *[F.size(c).cast("bigint").alias(n) for n, c in diff.items()])


_LABELS = {f"L{i}": label for i, label in enumerate(L.KEYWORD_LABELS, 1)}
_LABELS_SQL = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _LABELS.items()) + ") AS l(concept_id, label)"
_SPANS_SQL = rf"""s AS (SELECT doc_id, concept_id, length(label) AS n, list_transform(string_split_regex(lower(text), '\b' || label || '\b'), lambda g: length(g)) AS lens FROM documents, {_LABELS_SQL} WHERE text IS NOT NULL),
e AS (SELECT doc_id, concept_id, n, lens, unnest(range(1, len(lens))) AS i FROM s),
spans AS (SELECT doc_id, concept_id, (list_sum(lens[1:i]) + (i - 1) * n)::INT AS start, (list_sum(lens[1:i]) + i * n)::INT AS "end" FROM e)"""


@query(f'WITH {_SPANS_SQL} SELECT doc_id, concept_id, start, "end", 0.6::DOUBLE AS confidence FROM spans')
def keyword_spans(spark, sf_dir):
    """All whole-word mentions of the labels of the keyword annotator."""
    return R.keyword_spans(_docs(spark, sf_dir).where("text is not null"), "text", "doc_id", _LABELS)


def _spans(spark, sf_dir) -> DataFrame:
    return keyword_spans(spark, sf_dir).withColumnRenamed("doc_id", "text_id")


@query(f"WITH {_SPANS_SQL} SELECT concept_id, doc_id AS text_id, count(*) AS n FROM spans GROUP BY ALL")
def span_counts(spark, sf_dir):
    """Count matrix of mentions in long form."""
    return A.count_matrix(_spans(spark, sf_dir))


@query(f'WITH {_SPANS_SQL} SELECT d.doc_id AS query_id, d.doc_id AS text_id, concept_id, start, "end" FROM documents d JOIN spans s USING (doc_id) WHERE s.start < 400 AND s."end" > 100')
def span_overlap(spark, sf_dir):
    """Mentions that overlap characters 100 to 400 of their document."""
    ranges = _docs(spark, sf_dir).select(F.col("doc_id").alias("query_id"), F.col("doc_id").alias("text_id"), F.lit(100).alias("q_start"), F.lit(400).alias("q_end"))
    return A.overlap_join(_spans(spark, sf_dir), ranges)


@query(f"""SELECT doc_id, concept_id, (strpos(lower(text), label) - 1)::INT AS start, (strpos(lower(text), label) - 1 + length(label))::INT AS "end" FROM documents, {_LABELS_SQL} WHERE strpos(lower(text), label) > 0""")
def first_mentions(spark, sf_dir):
    """First mention of each of these labels as a substring."""
    return R.first_mentions(_docs(spark, sf_dir), "text", "doc_id", _LABELS)


@query(
    f"""WITH m AS (SELECT doc_id, concept_id, text, strpos(lower(text), label) - 1 AS a FROM documents, {_LABELS_SQL} WHERE strpos(lower(text), label) > 0),
p AS (SELECT doc_id, concept_id, string_split(substring(text, 1, a), '.')[-1] AS before, substring(text, a + 1) AS rest FROM m)
SELECT doc_id, concept_id, md5(ltrim(before) || rtrim(CASE WHEN strpos(rest, '.') > 0 THEN substring(rest, 1, strpos(rest, '.')) ELSE rest END)) AS h FROM p"""
)
def mention_contexts(spark, sf_dir):
    """The sentence around each first mention."""
    docs = _docs(spark, sf_dir)
    found = R.first_mentions(docs, "text", "doc_id", _LABELS).join(docs.select("doc_id", "text"), "doc_id")
    return found.select("doc_id", "concept_id", F.md5(R.mention_context(F.col("text"), F.col("start"))).alias("h"))


_HEAD, _TAIL = '<html><head><title>t</title><script>var a = "</p>";</script></head><nav>menu</nav><p>', "</p><aside>A &amp;lt; B &nbsp;&quot;q&quot;</aside><footer>end</footer></html>"


@query(
    "WITH t0 AS (SELECT doc_id, '" + _HEAD + "' || text || '" + _TAIL + "' AS h FROM documents WHERE text IS NOT NULL), "
    + ", ".join(f"t{i + 1} AS (SELECT doc_id, regexp_replace(h, '(?is)<{tag}[^>]*>.*?</{tag}>', '', 'g') AS h FROM t{i})" for i, tag in enumerate(("script", "style", "nav", "header", "footer")))
    + r""", u AS (SELECT doc_id, regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(h, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '[ \t]+', ' ', 'g') AS h FROM t5)
SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split_regex(h, '\r\n|[\n\r]'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> ''), chr(10))) AS h FROM u"""
)
def html_text(spark, sf_dir):
    """Text of pages built around every document."""
    page = F.concat(F.lit(_HEAD), F.col("text"), F.lit(_TAIL))
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", F.md5(T.html_text(page)).alias("h"))


@query("SELECT rec_no, md5(abstract) AS h FROM raw_documents WHERE abstract IS NOT NULL")
def inverted_abstract(spark, sf_dir):
    """Abstracts taken apart into word positions and put together again."""
    words = read_table(spark, sf_dir, "raw_documents").where("abstract is not null").select("rec_no", F.posexplode(F.split("abstract", " ")).alias("i", "w"))
    places = words.groupBy("rec_no", "w").agg(F.collect_list("i").alias("p")).groupBy("rec_no").agg(F.map_from_entries(F.collect_list(F.struct("w", "p"))).alias("m"))
    return places.select("rec_no", F.md5(T.abstract_of(F.col("m"))).alias("h"))


@query("SELECT rec_no FROM raw_documents r WHERE NOT EXISTS (SELECT 1 FROM registry g WHERE g.id = r.id)")
def registry_new(spark, sf_dir):
    """Records whose id was never registered."""
    return new_records(read_table(spark, sf_dir, "raw_documents").select("rec_no", "id"), read_table(spark, sf_dir, "registry")).select("rec_no")


@query("SELECT concept_id, label_en FROM (SELECT DISTINCT concept_id, label_en FROM concepts) WHERE label_en ILIKE '%truth%'")
def concept_search(spark, sf_dir):
    """Concepts whose English label is like a pattern."""
    return read_table(spark, sf_dir, "concepts").select("concept_id", "label_en").where(F.ilike("label_en", F.lit("%truth%"))).distinct()


@query(f"SELECT DISTINCT r.concept_id, r.related, c.label_en AS related_label FROM ({PACKED_SQL}) r LEFT JOIN (SELECT DISTINCT concept_id, label_en FROM concepts) c ON c.concept_id = r.related")
def related_expansion(spark, sf_dir):
    """Related concepts with their labels, one step, kept where the target is missing."""
    concepts = read_table(spark, sf_dir, "concepts").select("concept_id", "label_en", "related_concepts").distinct()
    related = explode_packed(concepts.select("concept_id", "related_concepts"), "related_concepts", "related").select("concept_id", "related").distinct()
    return related.join(concepts.select(F.col("concept_id").alias("related"), F.col("label_en").alias("related_label")), "related", "left").select("concept_id", "related", "related_label").distinct()


@query()
def concept_mentions(spark, sf_dir):
    """Whole-word mentions of every English concept label in every document."""
    labels = read_table(spark, sf_dir, "concepts").select("concept_id", F.col("label_en").alias("label"))
    return R.keyword_spans(_docs(spark, sf_dir), "text", "doc_id", labels).select("doc_id", "concept_id", "start", "end")


def _events(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))


_EVENTS = "e AS (SELECT *, json_extract_string(props, '$.k') AS k FROM events)"


@query(
    f"""WITH {_EVENTS}, c AS (SELECT k, event_type, count(*) AS n FROM e WHERE k IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL)
SELECT a.k AS ref, a.event_type AS reading_a, b.event_type AS reading_b, a.n AS n_a, b.n AS n_b, (a.n * b.n)::BIGINT AS conflicts FROM c a JOIN c b ON a.k = b.k AND a.event_type < b.event_type"""
)
def interpretation_conflicts(spark, sf_dir):
    """Pairs of different readings of one reference."""
    return A.reading_conflicts(_events(spark, sf_dir), "k", "event_type")


@query(
    f"""WITH {_EVENTS} SELECT k AS ref, count(*) AS interpretations, count(DISTINCT user_id % 7) AS schools, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS readings,
((count(*) * count(*) - (SELECT sum(n * n) FROM (SELECT count(*) AS n FROM e x WHERE x.k = e.k GROUP BY x.event_type))) / 2)::BIGINT AS conflicts FROM e WHERE k IS NOT NULL GROUP BY k"""
)
def debate_summary(spark, sf_dir):
    """Interpretations, schools, readings and conflicts of each reference."""
    rows = _events(spark, sf_dir).withColumn("school", (F.col("user_id") % 7).cast("string"))
    return A.debate_summary(rows, "k", "school", "event_type").withColumn("readings", F.array_join("readings", ","))


@query(
    f"""WITH {_EVENTS}, c AS (SELECT k, event_type, count(*) AS n FROM e WHERE k IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL),
i AS (SELECT k, sum(n) AS n, sum(n * (n - 1)) AS same FROM c GROUP BY 1), t AS (SELECT sum(n * (n - 1)) / 2 AS pairs, sum(same) / 2 AS agreeing FROM i), l AS (SELECT count(DISTINCT event_type) AS labels FROM c)
SELECT pairs::BIGINT AS pairs, agreeing::BIGINT AS agreeing, round(agreeing / pairs, 6) AS observed, round(1.0::DOUBLE / labels, 6) AS expected, round(1 - (1 - agreeing / pairs) / (1 - 1.0::DOUBLE / labels), 6) AS alpha FROM t, l"""
)
def label_agreement(spark, sf_dir):
    """Agreement on labels over all pairs within items."""
    return A.label_agreement(_events(spark, sf_dir), "k", "event_type")


@query(
    f"""WITH {_EVENTS}, r AS (SELECT k, value, row_number() OVER (PARTITION BY k ORDER BY value) AS i, count(*) OVER (PARTITION BY k) AS n FROM e WHERE k IS NOT NULL AND value IS NOT NULL)
SELECT (sum(n - 1) / 2)::BIGINT AS pairs, round(sum((2 * i - n - 1) * value) / (sum(n - 1) / 2), 6) AS mean_difference FROM r"""
)
def rating_agreement(spark, sf_dir):
    """Mean difference of ratings over all pairs within items."""
    return A.rating_agreement(_events(spark, sf_dir), "k", "value")


@query("SELECT user_id::VARCHAR AS annotator, count(*) AS n FROM events GROUP BY 1")
def annotator_counts(spark, sf_dir):
    """Annotations of each annotator."""
    return A.annotator_counts(_events(spark, sf_dir), "user_id")


@query("SELECT count(*) AS total, count(l.p) AS covered, round(count(l.p) * 100.0::DOUBLE / count(*), 6) AS pct FROM part LEFT JOIN (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_quantity > 48) l ON p_partkey = l.p")
def commentary_coverage(spark, sf_dir):
    """Share of references that have a commentary."""
    return A.commentary_coverage(read_table(spark, sf_dir, "part"), read_table(spark, sf_dir, "lineitem").where("l_quantity > 48"), "p_partkey", "l_partkey")


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def annotation_windows(spark, sf_dir):
    """Events per day and type."""
    return windowed_counts(_events(spark, sf_dir), "ts", ["event_type"])


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*) AS n FROM s GROUP BY user_id, k"""
)
def annotation_sessions(spark, sf_dir):
    """Sessions of each user."""
    return session_counts(_events(spark, sf_dir), "ts", ["user_id"])
