"""Language names and codes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two-letter code -> other usual codes and names, lower case.
NAMES = {
    "en": ("eng", "english"),
    "de": ("deu", "ger", "german", "deutsch"),
    "fr": ("fra", "fre", "french", "français", "francais"),
    "es": ("spa", "spanish", "español", "espanol", "castellano"),
    "pt": ("por", "portuguese", "português", "portugues"),
    "ru": ("rus", "russian", "русский"),
    "ar": ("ara", "arabic", "العربية"),
    "ja": ("jpn", "japanese", "日本語"),
    "zh": ("zho", "chi", "chinese", "中文", "cmn"),
    "ko": ("kor", "korean", "한국어"),
}
_CODES = {alias: code for code, names in NAMES.items() for alias in (code, *names)}


def language_code(c: Column) -> Column:
    """Two-letter code of a language written in any usual way, null where it names none of ``NAMES``.

    Region and script subtags after a hyphen or underscore do not matter.
    """
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(_CODES.items())])
    return F.get(F.array(table[F.regexp_extract(F.lower(F.trim(c)), "^[^-_]*", 0)]), F.lit(0))
