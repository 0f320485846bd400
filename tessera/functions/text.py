"""Column functions on texts.  All are built-in expressions except the Unicode normalisations."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD = r"[\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    """Lower-case word tokens; empty for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _is_in(words: list[str]):
    return lambda t: t.isin(*words)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def lexical_features(text: Column, markers: list[str]) -> Column:
    """struct of the eight lexical features; all 0 for an empty or null text.

    One pass over the sorted tokens counts runs, so types and words that occur once need no shuffle.
    """
    zero = F.lit(0).cast("bigint")
    start = F.struct(F.lit(None).cast("string").alias("last"), zero.alias("run"), zero.alias("n"), zero.alias("types"), zero.alias("once"), zero.alias("letters"), zero.alias("marks"), zero.alias("longs"))

    def step(s: Column, t: Column) -> Column:
        again = s["last"].eqNullSafe(t)
        return F.struct(
            t.alias("last"),
            F.when(again, s["run"] + 1).otherwise(F.lit(1).cast("bigint")).alias("run"),
            (s["n"] + 1).alias("n"),
            (s["types"] + F.when(again, 0).otherwise(1)).alias("types"),
            (s["once"] + F.when(~again & (s["run"] == 1), 1).otherwise(0)).alias("once"),
            (s["letters"] + F.length(t)).alias("letters"),
            (s["marks"] + F.when(t.isin(*markers), 1).otherwise(0)).alias("marks"),
            (s["longs"] + F.when(F.length(t) > 10, 1).otherwise(0)).alias("longs"),
        )

    n_sentences = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[.!?]+"), lambda x: F.trim(x) != "")).cast("bigint")

    def finish(s: Column) -> Column:
        once = s["once"] + F.when(s["run"] == 1, 1).otherwise(0)
        return F.struct(
            s["n"].alias("n_tokens"), s["types"].alias("n_types"), _ratio(s["types"], s["n"]).alias("ttr"), _ratio(once, s["types"]).alias("hapax_ratio"), _ratio(s["letters"], s["n"]).alias("mean_length"),
            _ratio(s["marks"], s["n"]).alias("marker_density"), n_sentences.alias("n_sentences"), _ratio(s["longs"], s["n"]).alias("long_share"),
        )

    return F.aggregate(F.array_sort(tokens(text)), start, step, finish)


def plain_features(text: Column, lower: bool = False) -> dict[str, Column]:
    """Counts over whitespace tokens with signs attached; ``lower`` folds case first."""
    words = F.filter(F.split(F.lower(text) if lower else text, r"\s+"), lambda t: t != "")
    n, types = F.size(words), F.size(F.array_distinct(words))
    letters = F.aggregate(words, F.lit(0).cast("bigint"), lambda a, t: a + F.length(t))
    return {"n_tokens": n.cast("bigint"), "n_types": types.cast("bigint"), "ttr": _ratio(types, n), "mean_length": _ratio(letters, n)}


def structural_features(text: Column, markers: list[str]) -> dict[str, Column]:
    """Sentence pieces and density of markers; a sign attached to a marker hides it."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")
    pieces = F.filter(F.split(text, r"[.!?]+"), lambda s: s != "")
    return {"n_sentences": F.size(pieces).cast("bigint"), "marker_density": _ratio(F.size(F.filter(words, _is_in(markers))), F.size(words))}


def script(text: Column) -> Column:
    """cjk, indic, greek or default by the first such letter among the first 100 characters."""
    first = F.regexp_extract(F.substring(text, 1, 100), "[\\x{4e00}-\\x{9fff}\\x{0900}-\\x{097f}\\x{0370}-\\x{03ff}]", 0)
    return F.when(first == "", "default").when(first >= "一", "cjk").when(first >= "ऀ", "indic").otherwise("greek")


def kanbun_lines(text: Column) -> Column:
    """A line feed after each full stop, exclamation or question mark of CJK text."""
    return F.regexp_replace(text, "([。！？])", "$1\n")


def sentences(text: Column, lang: str = "en") -> Column:
    """Sentences of a text, stripped and non-empty; ja and zh split at their own marks."""
    if lang in ("ja", "zh"):
        parts = F.split(text, "[。！？]" if lang == "ja" else "[。！？；]")
    else:
        parts = F.split(text, r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def paragraphs(text: Column, delimiter: str = r"\n\s*\n", longer_than: int = 20) -> Column:
    """Paragraphs with more than ``longer_than`` characters after stripping."""
    return F.filter(F.transform(F.split(text, delimiter), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: F.length(s) > longer_than)


def word_windows(df: DataFrame, text: str, keep: list[str], size: int = 256, overlap: int = 64) -> DataFrame:
    """(keep..., chunk_no, chunk): windows of ``size`` whitespace words, from 0; a tail may lie wholly
    inside the window before.  Null and blank texts give no row."""
    step = max(size - overlap, 1)
    words = df.select(*keep, F.filter(F.split(F.col(f"`{text}`"), r"\s+"), lambda t: t != "").alias("__w")).where(F.size("__w") > 0)
    starts = words.select(*keep, "__w", F.posexplode(F.sequence(F.lit(0), F.size("__w") - 1, F.lit(step))).alias("chunk_no", "__a"))
    return starts.select(*keep, "chunk_no", F.array_join(F.slice("__w", F.col("__a") + 1, F.lit(size)), " ").alias("chunk"))


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Stripped text in composed Unicode form."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t.strip()))


@F.pandas_udf(StringType())
def bare_greek(texts: pd.Series) -> pd.Series:
    """Lower-case text without combining accents, in composed form."""

    def strip(t):
        if t is None:
            return None
        parts = re.sub("[̀-ͯ]", "", unicodedata.normalize("NFD", t))
        return unicodedata.normalize("NFC", parts.lower())

    return texts.map(strip)


def normalise(text: Column, lang: Column) -> Column:
    """Text normalised by language: Greek accents dropped, classical Chinese broken after sentences."""
    return F.when(lang.isin("grc", "el"), bare_greek(text)).when(lang.isin("lzh", "zh-classical"), kanbun_lines(text)).otherwise(nfc(text))


def html_text(html: Column) -> Column:
    """Text of an HTML page: five kinds of blocks and all tags dropped, entities decoded with the
    ampersand first, blank lines removed."""
    text = F.regexp_replace(html, r"(?is)<(script|style|nav|header|footer)[^>]*>.*?</\1>", "")
    text = F.regexp_replace(text, "<[^>]+>", " ")
    for entity, sign in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    lines = F.transform(F.split(F.regexp_replace(text, "[ \t]+", " "), r"\r\n|[\n\r]"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.array_join(F.filter(lines, lambda s: s != ""), "\n")


@F.pandas_udf(StringType())
def tei_text(pages: pd.Series) -> pd.Series:
    """Text of the p, l, sp, head and ab elements of TEI XML in document order; nested ones repeat
    their text; malformed XML loses its tags only."""
    from xml.etree import ElementTree

    wanted = {"p", "l", "sp", "head", "ab"}

    def read(xml):
        if xml is None:
            return None
        try:
            root = ElementTree.fromstring(xml)
        except ElementTree.ParseError:
            return " ".join(re.sub(r"<[^>]+>", " ", xml).split())
        found = [" ".join("".join(e.itertext()).split()) for e in root.iter() if isinstance(e.tag, str) and e.tag.rsplit("}", 1)[-1] in wanted]
        return "\n".join(t for t in found if t)

    return pages.map(read)


def abstract_of(inverted: Column) -> Column:
    """Text of an inverted index (word -> positions); words at one position in alphabetical order."""
    pairs = F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def era_years(era: Column) -> Column:
    """struct<start,end> of 'from ~ to'; 'present' is 2026; what cannot be read is null."""
    parts = F.split(F.regexp_replace(era, r"\s", ""), "~")
    year = lambda c: F.when(F.lower(c) == "present", F.lit(2026)).otherwise(c.try_cast("int"))
    return F.when(F.size(parts) == 2, F.struct(year(parts[0]).alias("start"), year(parts[1]).alias("end")))


def year_of(value: Column) -> Column:
    """Integer part of a number written as text, null where it is none."""
    return value.try_cast("double").try_cast("int")
