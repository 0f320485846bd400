"""Several values packed in one string column -> one row per value with its position.

Everything is built-in column expressions, so the operator is one narrow stage: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that separate values wherever they stand unprotected; a slash only between spaces.
SEPARATORS = ";,|、，；｜\t\n\r"

_OPEN, _CLOSE = "\ue000", "\ue001"
_SPACE = "\\s\\x{a0}\\x{3000}"
_SEP = f"[{SEPARATORS}]"
_GAP = f"[{_SPACE}]{{0,16}}"
_BEFORE = f"(?<=^{_GAP}|{_SEP}{_GAP}|[{_SPACE}]/[{_SPACE}]{{1,16}})"
_AFTER = f"(?=[{_SPACE}]*(?:{_SEP}|[{_SPACE}]/[{_SPACE}]|$))"
_STRAIGHT = '"(?:[^"\\\\]|""|\\\\.)*"'
_CURLY = "“[^”]*”"
#: A quoted span that makes up a whole item, or one escaped character.
_SPAN = f"(?s){_BEFORE}(?:{_STRAIGHT}|{_CURLY}){_AFTER}|\\\\[{SEPARATORS}/\"\\\\]"
_SPLIT = f"{_SEP}|(?<=[{_SPACE}])/(?=[{_SPACE}])"
_TOKEN = f"{_OPEN}([0-9]+|x){_CLOSE}"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{_SPACE}]+|[{_SPACE}]+$", "")


def _unwrap(span: Column) -> Column:
    """The text a protected span stands for: quotes removed, doubled quotes and escapes undone."""
    body = F.substring(span, F.lit(2), F.length(span) - 2)
    straight = F.regexp_replace(F.replace(body, F.lit('""'), F.lit('"')), "\\\\(.)", "$1")
    return (
        F.when(span.startswith('"') & (F.length(span) >= 2), straight)
        .when(span.startswith("“"), body)
        .otherwise(F.substring(span, F.lit(2), F.lit(1)))
    )


def _restore(item: Column, spans: Column) -> Column:
    """Put the spans back where their numbered placeholders stand."""
    texts = F.split(item, _TOKEN, -1)
    keys = F.concat(F.regexp_extract_all(item, F.lit(_TOKEN), F.lit(1)), F.array(F.lit("")))
    parts = F.zip_with(
        texts,
        keys,
        lambda text, key: F.concat(
            text,
            F.when(key == "", "").when(key == "x", _OPEN).otherwise(F.get(spans, key.try_cast("int"))),
        ),
    )
    return F.array_join(parts, "")


def explode_packed(df: DataFrame, packed: str, value: str = "value", pos: str = "pos") -> DataFrame:
    """One row per value of column ``packed``, with all other columns kept and ``pos`` from 1.

    Quoted spans and escaped separators become placeholders that cannot occur in the text, the rest
    is split at the separators, and array lookup restores the spans.  A JSON list is read as one.
    Items that are empty after stripping are no values, an opening quote without its partner is an
    ordinary character.  Rows whose field is null or holds no value give no row.  Columns of ``df``
    that are called ``value`` or ``pos`` are replaced by the new ones.
    """
    keep = [c for c in df.columns if c not in (packed, value, pos)]
    kept = [F.col(f"`{c}`") for c in keep]
    stripped = df.select(*kept, _strip(F.col(f"`{packed}`")).alias("__s")).where("__s <> ''")
    bracketed = F.col("__s").rlike("(?s)^\\[.*\\]$")
    inner = F.when(bracketed, F.substring("__s", F.lit(2), F.length("__s") - 2)).otherwise(F.col("__s"))
    # Each step is a column of its own, so that nothing is computed again for every item.
    rows = stripped.select(*kept, F.when(bracketed, F.from_json("__s", "array<string>")).alias("__listed"), F.replace(inner, F.lit(_OPEN), F.lit(f"{_OPEN}x{_CLOSE}")).alias("__safe"))
    rows = rows.select(*kept, "__listed", F.regexp_extract_all("__safe", F.lit(_SPAN), F.lit(0)).alias("__raw"), F.split("__safe", _SPAN, -1).alias("__gaps"))
    last = F.size("__gaps") - 1
    marked = F.transform("__gaps", lambda gap, i: F.when(i < last, F.concat(gap, F.lit(_OPEN), i.cast("string"), F.lit(_CLOSE))).otherwise(gap))
    rows = rows.select(*kept, "__listed", F.transform("__raw", _unwrap).alias("__spans"), F.split(F.array_join(marked, ""), _SPLIT, -1).alias("__items"))
    items = F.transform("__items", lambda item: _strip(_restore(_strip(item), F.col("__spans"))))
    values = F.coalesce(F.transform("__listed", lambda v: _strip(v)), items)
    exploded = rows.select(*kept, F.posexplode(F.filter(values, lambda v: v.isNotNull() & (v != ""))).alias("__p", "__v"))
    return exploded.select(*kept, (F.col("__p") + 1).alias(pos), F.col("__v").alias(value))
