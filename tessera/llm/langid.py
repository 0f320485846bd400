"""Language of texts and of their segments by cross-parsing.

For each language a suffix automaton holds a bounded sample of labelled text.  A sentence is cut
greedily into the longest phrases that occur in a language's sample; the language that needs the
fewest phrases wins.  The automata are dense transition tables, so a whole Arrow batch of sentences
takes one table lookup per character and language.  Segments are the cheapest labelling of the
sentences when every change of language costs extra phrases.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.languages import language_code

#: Characters of labelled text per language that the automata hold; the bound of the fitted sample.
SAMPLE_CHARS = 16_000
#: Labelled texts per language that are drawn to get there.
SAMPLE_TEXTS = 60
#: What a change of language inside a text costs, in phrases.
SWITCH_PHRASES = 4.0

SEGMENTS = "array<struct<segment_no:int,lang:string,confidence:double,start:int,end:int>>"

_END = re.compile(r"[.!?؟](?![\w.!?؟])|[。！？\n]")
_MARKUP = re.compile(r"<[^<>]{0,80}>|&[a-z]{2,8};|&#[0-9]+;")

# Words that open a summary and wordings of rights and keyword notices.
_HEADING = re.compile(
    r"^\W*(?:abstract|summary|zusammenfassung|kurzfassung|r[ée]sum[ée]|resumen|resumo|sum[áa]rio|аннотация|резюме|摘要|要旨|概要|抄録|초록|요약|ملخص|الملخص|introduction|background|einleitung)\s*(?:[.:：—–\-|\n]|$)\W*",
    re.IGNORECASE,
)
_NOTICE = re.compile(
    r"©|\(c\) ?[0-9]{4}|copyright|all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos|todos os direitos|все права|無断転載|版权所有|著作権|저작권|جميع الحقوق|"
    r"^\W*(?:key ?words?|schl(?:agw|üsselw)[öo]rter|mots[- ]cl[ée]s|palabras clave|palavras[- ]chave|ключевые слова|キーワード|关键词|關鍵詞|주제어|핵심어|키워드|الكلمات المفتاحية|jel|doi|issn|isbn)\b ?[:：—-]|\bcc[ -]by\b|^\W*(?:the )?authors?\W*$|creative commons|^\W*(?:published|licensed) (?:by|under)\b",
    re.IGNORECASE,
)


# One of these occurs in every text in which a heading or notice is looked for (lower case).
_HINTS = (
    "abstract", "summary", "fassung", "resum", "résum", "sumário", "sumario", "аннотация", "резюме", "摘要", "要旨", "概要", "抄録", "초록", "요약", "ملخص",
    "introduction", "background", "einleitung", "©", "(c)", "copyright", "rights", "rechte", "droits", "derechos", "direitos", "права", "転載", "版权", "著作権",
    "저작권", "حقوق", "key", "wörter", "worter", "mots", "palabras", "palavras", "слова", "キーワード", "关键", "關鍵", "주제어", "핵심어", "키워드", "الكلمات",
    "jel", "doi", "issn", "isbn", "cc", "author", "creative", "published", "licensed",
)


def _letter_table() -> np.ndarray:
    """Code point -> code point of the lower-case letter, or of a blank."""
    table = np.full(1 << 16, 32, dtype=np.uint16)
    for cp in range(1 << 16):
        c = chr(cp)
        if c.isalpha() or unicodedata.category(c) in ("Mn", "Mc"):
            low = c.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    return table


_LOWER = _letter_table()


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(letters of all texts with single blanks between words, length of each text)."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), dtype=np.uint32)
    flat = _LOWER[np.where(flat < (1 << 16), flat, 0)]
    starts = np.concatenate(([0], np.cumsum(sizes)))
    blank = flat == 32
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    first = starts[:-1][sizes > 0]
    keep[first] = ~blank[first]
    total = np.concatenate(([0], np.cumsum(keep)))
    return flat[keep], total[starts[1:]] - total[starts[:-1]]


class Automaton:
    """Suffix automaton of one text as a dense table: row 0 is the root, entry 0 means no way on."""

    def __init__(self, text: str):
        alphabet = sorted(set(text))
        code = {c: i + 1 for i, c in enumerate(alphabet)}
        ways: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for symbol in map(code.__getitem__, text):
            new = len(ways)
            ways.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and symbol not in ways[p]:
                ways[p][symbol] = new
                p = link[p]
            if p >= 0:
                q = ways[p][symbol]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    clone = len(ways)
                    ways.append(dict(ways[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = link[new] = clone
                    while p >= 0 and ways[p].get(symbol) == q:
                        ways[p][symbol] = clone
                        p = link[p]
            last = new
        self.symbols = np.array([ord(c) for c in alphabet], dtype=np.uint32)
        self.states = len(ways)
        self.triples = np.array([(s, c, t) for s, w in enumerate(ways) for c, t in w.items()], dtype=np.int32).reshape(-1, 3)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """(symbol of each code point, transitions)."""
        remap = np.zeros(1 << 16, dtype=np.int64)
        low = self.symbols < (1 << 16)
        remap[self.symbols[low]] = np.flatnonzero(low) + 1
        table = np.zeros((self.states, len(self.symbols) + 1), dtype=np.int32)
        table[self.triples[:, 0], self.triples[:, 1]] = self.triples[:, 2]
        return remap, table


@dataclass
class Parser:
    """Phrase counts of sentences under each language."""

    automata: dict[str, Automaton]

    def __post_init__(self):
        self.languages = sorted(self.automata)
        self._tables = None

    def __getstate__(self):
        return {"automata": self.automata, "languages": self.languages, "_tables": None, "_members": None}

    def phrases(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases: parts x languages, letters of each part); infinite where a language lacks the
        letters of the part."""
        if self._tables is None:
            self._tables = [self.automata[x].tables() for x in self.languages]
            self._members = sum(((remap > 0).astype(np.uint16) << k for k, (remap, _) in enumerate(self._tables)), np.zeros(1 << 16, np.uint16))
            self._members[32] = 0
        result = np.full((len(parts), len(self.languages)), np.inf)
        flat, lengths = _codes(parts)
        starts = np.concatenate(([0], np.cumsum(lengths)))
        members = self._members[flat]
        letters = np.concatenate(([0], np.cumsum(flat != 32)))
        letters = letters[starts[1:]] - letters[starts[:-1]]
        known = np.empty(result.shape)
        for k in range(len(self.languages)):
            hits = np.concatenate(([0], np.cumsum((members >> k) & 1, dtype=np.int64)))
            known[:, k] = (hits[starts[1:]] - hits[starts[:-1]]) / np.maximum(letters, 1)
        wanted = (known > 0) & (known >= known.max(axis=1, keepdims=True) - 0.3)
        for k, (remap, table) in enumerate(self._tables):
            rows = np.flatnonzero(wanted[:, k])
            rows = rows[np.argsort(-lengths[rows], kind="stable")]
            codes = remap[flat]
            for at in range(0, len(rows), 8192):
                part = rows[at : at + 8192]
                n, begin = lengths[part], starts[part]
                active = np.searchsorted(-n, -np.arange(int(n[0])), side="left")
                state = np.zeros(len(part), dtype=np.int32)
                count = np.ones(len(part))
                for t, m in enumerate(active):
                    c = codes[begin[:m] + t]
                    following = table[state[:m], c]
                    missed = np.flatnonzero(following == 0)
                    if len(missed):
                        count[missed] += 1
                        following[missed] = table[0, c[missed]]
                    state[:m] = following
                result[part, k] = count
        return result, letters


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, text) of the sentences that count: markup, summary headings, rights and keyword
    notices do not."""
    if "<" in text or "&" in text:
        text = _MARKUP.sub(lambda m: " " * len(m.group()), text)
    low = text.lower()
    noisy = any(hint in low for hint in _HINTS)
    found = []
    start = 0
    for end in [*(m.end() for m in _END.finditer(text)), len(text)]:
        if end <= start:
            continue
        at, part, start = start, text[start:end], end
        if noisy:
            while (heading := _HEADING.match(part)) and heading.end():
                at, part = at + heading.end(), part[heading.end() :]
            if _NOTICE.search(part):
                continue
        if part:
            found.append((at, end, part))
    return found


def _label(cost: np.ndarray, switch: float) -> np.ndarray:
    """Cheapest sequence of languages of one text."""
    finite = np.where(np.isfinite(cost), cost, 1e6)
    if len(finite) == 1:
        return finite.argmin(axis=1)
    total = finite[0].copy()
    back = np.zeros(finite.shape, dtype=int)
    stay = np.arange(finite.shape[1])
    for i in range(1, len(finite)):
        low = int(total.argmin())
        change = total[low] + switch < total
        back[i] = np.where(change, low, stay)
        total = np.where(change, total[low] + switch, total) + finite[i]
    path = np.empty(len(finite), dtype=int)
    path[-1] = int(total.argmin())
    for i in range(len(finite) - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def segment_texts(texts: list[str | None], parser: Parser, switch: float = SWITCH_PHRASES) -> list[list[dict]]:
    """Segments of each text; none for null texts and texts without letters."""
    split = [sentences(t) if t else [] for t in texts]
    flat = [s for found in split for s in found]
    costs, letters = parser.phrases([s[2] for s in flat])
    best = costs.argmin(axis=1) if len(flat) else np.empty(0, dtype=int)
    best[letters < 2] = -1
    spoken = best.tolist()
    spans: list[tuple[int, int, int, int]] = []
    at = 0
    for row, found in enumerate(split):
        use = [i for i in range(at, at + len(found)) if spoken[i] >= 0]
        at += len(found)
        if not use:
            continue
        langs = [spoken[i] for i in use]
        if any(x != langs[0] for x in langs):
            langs = _label(costs[use], switch).tolist()
        a = 0
        for i in range(1, len(use) + 1):
            if i == len(use) or langs[i] != langs[a]:
                spans.append((row, langs[a], use[a], use[i - 1]))
                a = i
    result: list[list[dict]] = [[] for _ in texts]
    if not spans:
        return result
    which, first, last = (np.array([s[k] for s in spans]) for k in (1, 2, 3))
    counted = np.where(letters[:, None] >= 2, np.where(np.isfinite(costs), costs, 1e6), 0)
    summed = np.vstack((np.zeros(counted.shape[1]), counted.cumsum(axis=0)))
    chars = np.concatenate(([0], np.cumsum(letters)))
    total = summed[last + 1] - summed[first]
    scale = np.minimum(1.0, 40 / np.maximum(chars[last + 1] - chars[first], 1))
    odds = np.exp(np.clip((total[np.arange(len(spans)), which][:, None] - total) * scale[:, None], -700, 0)).sum(axis=1)
    for (row, lang, a, b), confidence in zip(spans, (1 / odds).round(4).tolist(), strict=True):
        result[row].append({"segment_no": len(result[row]) + 1, "lang": parser.languages[lang], "confidence": confidence, "start": flat[a][0], "end": flat[b][1]})
    return result


def fit(labelled: DataFrame, text: str, lang: str, sample_texts: int = SAMPLE_TEXTS, sample_chars: int = SAMPLE_CHARS, key: str | None = None) -> Parser:
    """Automata of the languages in ``labelled``, from about ``sample_texts`` texts per language drawn
    by a hash and cut to ``sample_chars`` characters in all: the only bounded sample here."""
    rows = labelled.select(F.col(f"`{text}`").alias("text"), language_code(F.col(f"`{lang}`")).alias("lang")).where("lang is not null and length(text) >= 40")
    rows = rows.withColumn("u", F.xxhash64("text") / F.lit(float(1 << 63)) / 2 + 0.5)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        raise ValueError("no labelled text")
    rate = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, sample_texts * 1.5 / n)))])
    drawn = rows.where(F.col("u") < rate[F.col("lang")]).select("lang", F.substring("text", 1, 2 * sample_chars // sample_texts).alias("text"), "u").collect()
    samples: dict[str, str] = {}
    for row in sorted(drawn, key=lambda r: (r["lang"], r["u"])):
        so_far = samples.get(row["lang"], "")
        if len(so_far) < sample_chars:
            letters = _codes([" ".join(s[2] for s in sentences(row["text"]))])[0]
            samples[row["lang"]] = f"{so_far} {''.join(map(chr, letters))}"[:sample_chars]
    return Parser({k: Automaton(v) for k, v in samples.items() if v.strip()})


def segments(text: Column, parser, switch: float = SWITCH_PHRASES) -> Column:
    """Array of segments of ``text`` (``SEGMENTS``) by a broadcast ``Parser``."""

    @F.pandas_udf(SEGMENTS)
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(segment_texts([t if isinstance(t, str) else None for t in texts], parser.value, switch))

    return cut(text)


def label_languages(docs: DataFrame, labelled: DataFrame, text: str, lang: str, labelled_text: str, labelled_lang: str) -> DataFrame:
    """``docs`` with the columns ``declared`` (two-letter code or null) and ``segments``.

    A text that is null or holds no sentence has no segments.  Languages other than those in
    ``labelled`` cannot be found.  Equal texts get equal segments.
    """
    parser = docs.sparkSession.sparkContext.broadcast(fit(labelled, labelled_text, labelled_lang))
    return docs.withColumn("declared", language_code(F.col(f"`{lang}`"))).withColumn("segments", segments(F.col(f"`{text}`"), parser))


def mislabelled(labelled: DataFrame, lang: str) -> DataFrame:
    """Rows of ``label_languages`` whose label is missing or wrong, or whose text mixes languages."""
    named = F.nullif(F.lower(F.trim(F.col(f"`{lang}`"))), F.lit(""))
    known = F.coalesce(F.col("declared"), named)
    first = F.col("segments")[0]["lang"]
    return labelled.where((F.size("segments") > 1) | ((F.size("segments") == 1) & (known.isNull() | (known != first))))


