"""Arguments, theses, concept mentions, relevance and coverage: lexicon-driven text operators.

Every operator takes its lexicon as a parameter and is one narrow stage of built-in expressions, save
for the grouping that its result asks for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import lexicons as L
from tessera.functions.phrases import phrase_ids, stands_alone
from tessera.functions.text import sentences


def _flags(p: str) -> str:
    return f"(?iU){p}"


def matches_any(text: Column, patterns: list[str]) -> Column:
    """Whether any pattern occurs, regardless of case; false for null."""
    if not patterns:
        return F.lit(False)
    return F.coalesce(text.rlike(_flags("|".join(f"(?:{p})" for p in patterns))), F.lit(False))


def _strip(c: Column, signs: str) -> Column:
    return F.regexp_replace(c, f"^[{signs}]+|[{signs}]+$", "")


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _without(c: Column, patterns: list[str]) -> Column:
    return _strip(reduce(lambda x, p: F.regexp_replace(x, _flags(p), ""), patterns, c), " ,.;:")


def extract_arguments(docs: DataFrame, text: str, key: str, indicators: dict[str, list[str]], lang: str = "en") -> DataFrame:
    """(key, premises, conclusion, inference_type, confidence): at most one argument of each text.

    A sentence with both kinds of indicators is cut at the first conclusion indicator in list order;
    otherwise its indicators are removed.  Pieces of up to 15 characters do not count, the last
    conclusion holds.  Texts without both parts, null and empty texts give no row.
    """
    premise, conclusion = indicators.get("premise", []), indicators.get("conclusion", [])
    rows = docs.select(F.col(f"`{key}`").alias(key), F.posexplode(sentences(F.col(f"`{text}`"), lang)).alias("i", "s"))
    s = F.col("s")
    concludes, assumes = matches_any(s, conclusion), matches_any(s, premise)
    rows = rows.where(concludes | assumes)

    def cut(p: str) -> Column:
        at = F.regexp_instr(s, F.lit(_flags(p)))
        size = F.length(F.regexp_extract(s, _flags(p), 0))
        return F.when(at > 0, F.struct(F.substring(s, F.lit(1), at - 1).alias("before"), F.substring(s, at + size, F.length(s)).alias("after")))

    halves = F.coalesce(*[cut(p) for p in conclusion]) if conclusion else F.lit(None).cast("struct<before:string,after:string>")
    both = concludes & assumes
    part = lambda name: _strip(_trim(F.get(F.array(halves), F.lit(0))[name]), ",;.")
    p = F.when(both, part("before")).when(assumes, _without(s, premise))
    c = F.when(both, part("after")).when(concludes, _without(s, conclusion))
    found = rows.select(key, "i", F.when(F.length(p) > 15, p).alias("p"), F.when(F.length(c) > 15, c).alias("c"))
    grouped = found.groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(F.col("p").isNotNull(), F.struct("i", "p")))).alias("ps"), F.max_by("c", F.when(F.col("c").isNotNull(), F.col("i"))).alias("c")
    )
    kept = grouped.where((F.size("ps") > 0) & F.col("c").isNotNull())
    return kept.select(key, F.transform("ps", lambda x: _trim(x["p"])).alias("premises"), _trim(F.col("c")).alias("conclusion"), F.lit("deductive").alias("inference_type"), F.lit(0.5).alias("confidence"))


def argument_passages(docs: DataFrame, text: str, key: str, indicators: dict[str, list[str]], least: int = 2) -> DataFrame:
    """(key, passage_no, passage): paragraphs with indicators of at least ``least`` kinds; the whole
    text as passage 0 where there is none."""
    rows = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("t")).where("t is not null")
    kinds = lambda p: reduce(lambda a, b: a + b, [matches_any(p, ps).cast("int") for ps in indicators.values()])
    numbered = F.transform(F.split("t", r"\n\s*\n"), lambda p, i: F.struct((i + 1).alias("passage_no"), p.alias("passage")))
    good = F.filter(numbered, lambda x: kinds(x["passage"]) >= least)
    whole = F.array(F.struct(F.lit(0).alias("passage_no"), F.col("t").alias("passage")))
    return rows.select(key, F.explode(F.when(F.size(good) > 0, good).otherwise(whole)).alias("x")).select(key, "x.*")


def standard_form(premises: Column, conclusion: Column, inference_type: Column) -> Column:
    """Numbered premises, a line and the conclusion with its kind in brackets."""
    listed = F.transform(premises, lambda p, i: F.concat(F.lit("P"), (i + 1).cast("string"), F.lit(". "), p))
    return F.concat(F.array_join(listed, "\n"), F.lit("\n---\nC.  "), conclusion, F.lit("  ["), inference_type, F.lit("]"))


def _terms(terms: list[str], lang: str) -> str:
    joined = "|".join(terms)
    return f"({joined})" if lang in ("ja", "zh") else rf"\b({joined})\b"


def score_theses(
    docs: DataFrame, text: str, key: str, lang: str = "en", terms: list[str] | None = None, assertions: list[str] | None = None, exclusions: list[str] | None = None,
    types: list[tuple[str, list[str]]] | None = None, min_terms: int = 2, min_length: int | None = None, max_length: int = 500,
) -> DataFrame:
    """(key, sentence_no, thesis, score, confidence, thesis_type, is_negation, universality): sentences
    that read like theses.  Score: up to five vocabulary hits, 1.5 for an assertion, 1 for a universal
    word, 1 for a definition; sentences too short, too long, excluded or with few hits do not count."""
    terms = terms if terms is not None else L.THESIS_TERMS.get(lang, L.THESIS_TERMS["en"])
    assertions = L.THESIS_ASSERTIONS.get(lang, []) if assertions is None else assertions
    exclusions = L.THESIS_EXCLUSIONS.get(lang, []) if exclusions is None else exclusions
    types = L.THESIS_TYPES if types is None else types
    least = min_length if min_length is not None else (10 if lang in ("ja", "zh") else 30)
    rows = docs.select(F.col(f"`{key}`").alias(key), F.posexplode(sentences(F.col(f"`{text}`"), lang)).alias("n", "s"))
    s = F.col("s")
    fits = F.length(s).between(least, max_length) & ~matches_any(s, exclusions)
    hits = F.transform(F.regexp_extract_all(s, F.lit(_flags(_terms(terms, lang))), F.lit(1)), F.lower)
    rows = rows.where(fits).withColumn("hits", hits).where(F.size("hits") >= min_terms)
    score = F.least(F.size("hits"), F.lit(5)) + F.when(matches_any(s, assertions), 1.5).otherwise(0.0) + matches_any(s, [L.UNIVERSAL]).cast("int") + matches_any(s, [L.DEFINITION]).cast("int")
    kind = F.coalesce(*[F.when(F.arrays_overlap("hits", F.array(*map(F.lit, words))), name) for name, words in types])
    universal = F.regexp_count(s, F.lit(_flags(L.UNIVERSAL_WORDS)))
    total = universal + F.regexp_count(s, F.lit(_flags(L.PARTICULAR_WORDS)))
    return rows.select(
        key, (F.col("n") + 1).alias("sentence_no"), s.alias("thesis"), score.cast("double").alias("score"), F.least(score / 5.0, F.lit(1.0)).alias("confidence"), kind.alias("thesis_type"),
        matches_any(s, [L.NEGATION]).alias("is_negation"), F.when(total == 0, 0.5).otherwise(universal / total).alias("universality"),
    )


def top_theses(theses: DataFrame, key: str, k: int = 20, prefix: int = 50) -> DataFrame:
    """The k most confident theses of each key, one per ``prefix`` of lower-case letters; ties to the
    earlier sentence."""
    first = theses.groupBy(key, F.substring(F.lower("thesis"), 1, prefix).alias("__p")).agg(F.max_by(F.struct("sentence_no", "thesis", "confidence"), F.struct("confidence", -F.col("sentence_no"))).alias("x"))
    ranked = first.select(key, "x.*").withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("confidence"), "sentence_no")))
    return ranked.where(F.col("rank") <= k)


Labels = dict[str, str] | DataFrame
#: Labels of one automaton; more of them are searched in several passes.
LABELS = 200_000
#: Mentions that a task holds before it hands them on.
MENTIONS = 20_000


def _label_parts(spark: SparkSession, labels: Labels) -> list[tuple[list[str], DataFrame]]:
    """Distinct lower-case labels and the rows (concept_id, __label) that have them, in parts of about
    ``LABELS`` rows; ``labels`` is a map of ids to labels or a table (concept_id, label).  Null and empty
    labels do not occur."""
    if isinstance(labels, dict):
        labels = spark.createDataFrame(list(labels.items()), "concept_id string, label string")
    rows = labels.select(F.col("concept_id").cast("string").alias("concept_id"), F.lower("label").alias("label")).where("concept_id is not null and label <> ''").distinct()
    parts = max(1, -(-rows.count() // LABELS))
    split = []
    for i in range(parts):
        part = rows.where(F.pmod(F.xxhash64("label"), F.lit(parts)) == i)
        counts = part.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()
        # Only a label of very many concepts makes a part larger than can be broadcast.
        named = part.select("concept_id", F.col("label").alias("__label"))
        split.append(([r["label"] for r in counts], F.broadcast(named) if sum(r["n"] for r in counts) <= 2 * LABELS else named))
    return split


def _places(batches: Iterator[pd.DataFrame], key: str, words: list[str], whole: bool) -> Iterator[pd.DataFrame]:
    """(key, __label, start, end) of the ``words`` in texts t, at most ``MENTIONS`` at a time."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for label in words:
        automaton.add_word(label, label)
    if words:
        automaton.make_automaton()
    columns, out = [key, "__label", "start", "end"], []
    for pdf in batches:
        for k, t in zip(pdf[key].tolist(), pdf["t"], strict=True) if words else ():
            after: dict[str, int] = {}
            for last, label in automaton.iter(t):
                start, end = last + 1 - len(label), last + 1
                if start >= after.get(label, 0) and (whole or label not in after) and (not whole or stands_alone(t, start, end)):
                    after[label] = end
                    out.append((k, label, start, end))
                    if len(out) >= MENTIONS:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
    yield pd.DataFrame(out, columns=columns)


def _mentions(docs: DataFrame, text: str, key: str, labels: Labels, whole: bool) -> DataFrame:
    """(key, concept_id, start, end): occurrences of labels regardless of case, those of one label
    without overlap; only whole words, or only the first as a substring.

    Tasks hand on which label occurs where, a bounded number at a time; the concepts of a label, of
    which there may be many, are joined afterwards."""
    rows = docs.select(F.col(f"`{key}`").alias(key), F.lower(F.col(f"`{text}`")).alias("t")).where("t <> ''")
    kind = rows.schema[key].dataType.simpleString()
    found = []
    for words, concepts in _label_parts(docs.sparkSession, labels):
        shared = docs.sparkSession.sparkContext.broadcast(words)
        places = rows.mapInPandas(lambda batches, shared=shared: _places(batches, key, shared.value, whole), f"`{key}` {kind}, __label string, start int, end int")
        found.append(places.join(concepts, "__label").select(f"`{key}`", "concept_id", "start", "end"))
    return reduce(DataFrame.unionByName, found)


def first_mentions(docs: DataFrame, text: str, key: str, labels: Labels) -> DataFrame:
    """(key, concept_id, start, end): first occurrence of each label as a substring, regardless of
    case; half-open offsets from 0."""
    return _mentions(docs, text, key, labels, False)


def mention_context(text: Column, start: Column) -> Column:
    """The stretch from the last full stop before ``start`` to the next one, stripped; to the end of
    the text where none follows."""
    before = F.substring_index(F.substring(text, F.lit(1), start), ".", -1)
    rest = F.substring(text, start + 1, F.length(text))
    stop = F.instr(rest, ".")
    return F.concat(F.ltrim(before), F.rtrim(F.when(stop > 0, F.substring(rest, F.lit(1), stop)).otherwise(rest)))


def keyword_spans(docs: DataFrame, text: str, key: str, labels: Labels, confidence: float = 0.6) -> DataFrame:
    """(key, concept_id, start, end, confidence): every whole-word occurrence of each label regardless
    of case, half-open offsets from 0 in characters."""
    return _mentions(docs, text, key, labels, True).withColumn("confidence", F.lit(confidence))


def relevance(docs: DataFrame, title: str, abstract: str, lang: str, keywords: list[str] | None = None, native: dict[str, list[str]] | None = None, excluded: list[str] | None = None, traditions: dict[str, list[str]] | None = None) -> DataFrame:
    """``docs`` with score, excluded, traditions and is_core.

    10 per keyword (as substrings) up to 50; outside English 25 for a native keyword or 15 for a text
    of more than 50 characters without any; 30 off once for an excluded domain in English or unknown
    text; 15 per tradition; 10 for an abstract of more than 200 characters; never below 0.  Core is a
    score of 40 or more that is not excluded.  Nulls count as empty.
    """
    keywords, native = keywords or L.KEYWORDS_EN, L.KEYWORDS if native is None else native
    excluded, traditions = excluded or L.EXCLUDED_DOMAINS, L.TRADITION_PATTERNS if traditions is None else traditions
    low = lambda c: F.lower(F.coalesce(F.col(f"`{c}`"), F.lit("")))
    # The text is a column of its own, so that it is built once and not for every pattern.
    docs = docs.withColumn("__text", F.concat(low(title), F.lit(" "), low(abstract)))
    text = F.col("__text")
    code = F.coalesce(F.col(f"`{lang}`"), F.lit("unknown"))
    patterns: list[str] = []

    def number(words: list[str], plain: bool = True) -> tuple[int, int]:
        start = len(patterns)
        patterns.extend(re.escape(w.lower()).replace("\\ ", " ").replace("\\-", "-") if plain else w.replace(r"(?!on\b)", "") for w in words)
        return start, len(patterns)

    spans = {"keywords": number(keywords), "excluded": number(excluded)}
    own_spans = {k: number(words) for k, words in native.items()}
    named_spans = {t: number(ps, False) for t, ps in traditions.items()}
    docs = docs.withColumn("__ids", phrase_ids(text, patterns))
    count = lambda span: F.size(F.filter("__ids", lambda i: (i >= span[0]) & (i < span[1])))
    own = F.lit(0)
    for k, span in own_spans.items():
        own = F.when(code == k, count(span)).otherwise(own)
    hits = count(spans["keywords"]) + own
    foreign = ~code.isin("en", "unknown")
    base = F.when(foreign & (own > 0), 25).when(foreign & (hits == 0) & (F.length(text) > 50), 15).otherwise(0)
    barred = ~foreign & (count(spans["excluded"]) > 0)
    named = F.array_compact(F.array(*[F.when(count(span) > 0, F.lit(t)) for t, span in named_spans.items()])) if traditions else F.array().cast("array<string>")
    total = F.least(hits * 10, F.lit(50)) + base - F.when(barred, 30).otherwise(0) + F.when(F.length(low(abstract)) > 200, 10).otherwise(0)
    scored = docs.drop("score", "excluded", "traditions", "is_core").withColumns({"excluded": barred, "traditions": named, "__total": total})
    scored = scored.withColumn("score", F.greatest(F.lit(0), F.col("__total") + 15 * F.size("traditions"))).drop("__total", "__text", "__ids")
    return scored.withColumn("is_core", (F.col("score") >= 40) & ~F.col("excluded"))


def coverage(actual: DataFrame, targets: DataFrame, category: str, target: str) -> DataFrame:
    """(category, target, actual, ratio, met): rows of ``actual`` per category against the targets;
    a category without rows has 0."""
    counts = actual.groupBy(F.col(f"`{category}`").alias("category")).agg(F.count(F.lit(1)).alias("actual"))
    rows = targets.select(F.col(f"`{category}`").alias("category"), F.col(f"`{target}`").cast("bigint").alias("target")).join(counts, "category", "left")
    rows = rows.select("category", "target", F.coalesce("actual", F.lit(0)).cast("bigint").alias("actual"))
    return rows.select("*", F.coalesce(F.try_divide("actual", "target"), F.lit(0.0)).alias("ratio"), (F.col("actual") >= F.col("target")).alias("met"))


def era(year: Column) -> Column:
    """pre_1900, 1900_1950, 1950_2000 or 2000_present; null for a null or zero year."""
    return F.when(year.isNull() | (year == 0), F.lit(None)).when(year < 1900, "pre_1900").when(year < 1950, "1900_1950").when(year < 2000, "1950_2000").otherwise("2000_present")


def first_per_key(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The row with the least ``order`` of each key; null keys are one key."""
    packed = df.withColumn("__key", key).groupBy("__key").agg(F.min_by(F.struct(*df.columns), F.col(f"`{order}`")).alias("__row"))
    return packed.select("__row.*")


def key_phrases(text: Column) -> Column:
    """Distinct lower-case words of more than three characters, counted with the signs that are then
    stripped from their ends, sorted."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.length(w) > 3)
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.regexp_replace(w, r"^[.,;:()]+|[.,;:()]+$", ""))))


def phrase_diff(a: Column, b: Column) -> dict[str, Column]:
    """Words of two texts that are shared, only in the first and only in the second."""
    x, y = key_phrases(a), key_phrases(b)
    return {"shared": F.array_sort(F.array_intersect(x, y)), "only_a": F.array_sort(F.array_except(x, y)), "only_b": F.array_sort(F.array_except(y, x))}


def translate_term(term: Column, definition: Column) -> Column:
    """struct of a term rendered without a model: the original and a caveat."""
    caveats = F.array(F.lit("Automated translation not available; showing original."))
    return F.struct(term.alias("original_term"), definition.alias("original_definition"), term.alias("translated_term"), definition.alias("explanation"), caveats.alias("caveats"))


def render_term(translated: Column) -> Column:
    """Original and translated term with the explanation below."""
    return F.concat(translated["original_term"], F.lit(" -> "), translated["translated_term"], F.lit("\n"), translated["explanation"])


def practical_mapping(df: DataFrame, concept: str, source: str, target: str) -> DataFrame:
    """``df`` with practical and confidence: what a concept means in another domain; 0.85 for a known
    meaning, 0.0 and a message otherwise."""
    rows = [(a, b, c.lower(), meaning) for (a, b), concepts in L.DOMAIN_MAP.items() for c, meaning in concepts.items()]
    known = df.sparkSession.createDataFrame(rows, "__a string, __b string, __c string, __m string")
    low = lambda c: F.lower(F.col(f"`{c}`"))
    joined = df.drop("practical", "confidence").join(known, (low(source) == F.col("__a")) & (low(target) == F.col("__b")) & (low(concept) == F.col("__c")), "left")
    told = F.coalesce("__m", F.format_string("No mapping for %s from %s to %s", F.col(f"`{concept}`"), F.col(f"`{source}`"), F.col(f"`{target}`")))
    return joined.withColumn("practical", told).withColumn("confidence", F.when(F.col("__m").isNotNull(), 0.85).otherwise(0.0)).drop("__a", "__b", "__c", "__m")
