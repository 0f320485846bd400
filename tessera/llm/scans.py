"""Repair of text taken from scanned pages.

Three learned decisions, each a boosted model trained here on pages that are laid out and damaged from
a bounded sample of clean texts of the same table: is a line furniture (running head, foot, page
number), does a line end inside a word, and which vocabulary word should a rare word read.  Candidates
for rare words come from a join over character q-grams; names are compared inside their own text.
"""

from __future__ import annotations

import random
import re
import textwrap
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.boost import Boosted
from tessera.storage import materialize

#: A word is trusted when at least this share of the clean texts holds it, so there can be no more
#: trusted words than (distinct words of a text) / share: the bound of what is broadcast.
TRUST_SHARE, TRUST_LEAST = 0.0005, 3
#: Clean texts laid out as pages for training, and a quarter as many without words set apart: the
#: bound of the fitted sample.
SAMPLE_TEXTS = 240
#: Letters of each sampled text and trusted words from which training rows are made.
SAMPLE_CHARS, SAMPLE_WORDS = 6000, 4000
#: Wider lines are paragraphs, unless the lines of the text that end inside a sentence are all as wide.
PARAGRAPH = 160
#: Least probability of a line to be furniture.
FURNITURE = 0.4

# Letters and letter groups that scanners take for each other.
LOOKALIKES = {
    frozenset(p.split("~"))
    for p in (
        "rn~m cl~d vv~w ii~u li~h nn~m in~m ri~n iii~m fi~fl ci~d tl~d h~b h~li o~0 l~1 i~1 i~l l~! i~! i~j e~c c~o e~o a~o a~u n~u n~r u~v v~y t~f f~s t~l s~5 "
        "g~q g~9 q~9 b~6 b~8 o~6 z~2 g~y p~q k~h d~cl d~ol n~ri n~ii u~ll w~iv ä~a ö~o ü~u é~e è~e ß~b ç~c ñ~n ã~a õ~o ſ~s ſ~f ﬁ~fi ﬂ~fl í~i ó~o á~a ê~e â~a"
    ).split()
}
#: Pairs of look-alikes in both orders.
_LOOKS = {pair for x in LOOKALIKES for y in [tuple(x)] if len(y) == 2 for pair in (y, y[::-1])}
_DIGITS = str.maketrans("015698", "olsbgb")
_HYPHENS = "-­¬‐‑"
_EDGE = re.compile(r"^[^\w]+|[^\w]+$")
_DASHES = re.compile(r"[\s—–]+")
_NUMBER = r"(?:[0-9lIOoSB]{1,5}|[ivxlcIVXLC1]{1,8})"
_PAGE = re.compile(rf"^\W*(?:(?:page|seite|p|s|pag|página|стр|pg)\b\.?\s*)?({_NUMBER})(?:\s*(?:of|/|von|de|sur)\s*{_NUMBER})?\W*$", re.IGNORECASE)
_SIDE = re.compile(rf"^\s*(?:({_NUMBER})[\s|]{{2,}}(\S.*)|(.*\S)[\s|]{{2,}}({_NUMBER}))\s*$")
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


# Signs that stand around words.
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~“”„‟«»‘’‚‹›…·•‐‑¬\u00ad、。，！？；：（）「」『』《》【】¿¡§†‡°؟،؛"


def words(text: str) -> list[str]:
    """Words in lower case without signs around them; signs inside stay."""
    parts = text.lower().replace("—", " ").replace("–", " ").split()
    return [w for w in (t.strip(_SIGNS) for t in parts) if w]


def distinct_words(text: str) -> set[str]:
    """The set of ``words``; each distinct token is stripped once."""
    return {t.strip(_SIGNS) for t in set(text.lower().replace("—", " ").replace("–", " ").split())} - {""}


def _value(number: str) -> int | None:
    low = number.lower()
    if re.fullmatch(r"[ivxlc]+", low) and not re.fullmatch(r"[l]+", low):
        total, last = 0, 0
        for c in reversed(low):
            v = _ROMAN[c]
            total, last = (total - v, last) if v < last else (total + v, v)
        return total
    digits = low.translate(str.maketrans("lioosb", "110058"))
    return int(digits) if digits.isdigit() else None


_OTHER, _CONFUSED = re.compile(r"[\W\d_]+"), re.compile("[015698]")


#: What ``_core`` makes of every ASCII sign.
_ASCII_CORE = {i: _OTHER.sub("", chr(i).translate(_DIGITS)) or None for i in range(128)}


def _core(text: str) -> str:
    low = text.lower()
    if low.isascii():
        return low.translate(_ASCII_CORE)
    return _OTHER.sub("", low.translate(_DIGITS) if _CONFUSED.search(low) else low)


def _pairs(s: str) -> set[str]:
    return set(map(add, s, s[1:]))


def _alike(a: str, b: str, known: dict[str, set[str]]) -> bool:
    """Whether two heads are one but for a few misread characters or a cut end; ``known`` keeps the
    letter pairs of texts seen."""
    if not a or not b or abs(len(a) - len(b)) > 2 + max(len(a), len(b)) // 12:
        return False
    if a == b:
        return True
    x = known.get(a) or known.setdefault(a, _pairs(a))
    y = known.get(b) or known.setdefault(b, _pairs(b))
    return len(x & y) >= 0.7 * max(len(x), len(y), 1)


#: More like lines than this tell no more.
TWINS = 5
#: Up to so many different lines are compared by one product of matrices, which costs less than an index.
FEW_LINES = 1000


def _twins(cores: list[str]) -> dict[str, int]:
    """How many other lines each core is like (see ``_alike``), ``TWINS`` at most.

    Like cores share 0.7 of the letter pairs of the longer
    one, so two of the rarest 0.3 n + 2 of each are common to both: of many lines only those that meet
    in two such pairs are compared."""
    count = Counter(cores)
    if len(count) <= FEW_LINES:
        codes = np.frombuffer("".join(count).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        row = np.repeat(np.arange(len(count)), [len(c) for c in count])
        inside = np.flatnonzero(row[1:] == row[:-1])
        _, column = np.unique((codes[inside] << np.uint64(32)) | codes[inside + 1], return_inverse=True)
        has = np.zeros((len(count), int(column.max(initial=-1)) + 1), dtype=np.float32)
        has[row[inside], column] = 1
        size, length = has.sum(1), np.array([len(c) for c in count])
        like = has @ has.T >= 0.7 * np.maximum(np.maximum(size[:, None], size), 1)
        longer = np.maximum(length[:, None], length)
        like &= np.abs(length[:, None] - length) <= 2 + longer // 12
        np.fill_diagonal(like, False)
        often = np.array(list(count.values()))
        total = like @ often + often - 1
        return dict(zip(count, np.minimum(total, TWINS).tolist(), strict=True))
    pairs = {c: _pairs(c) for c in count}
    place = {p: i for i, p in enumerate({p for ps in pairs.values() for p in ps})}
    bits = {c: sum(1 << place[p] for p in ps) for c, ps in pairs.items()}
    found = {c: n - 1 for c, n in count.items()}

    def compare(a: str, b: str) -> None:
        if (found[a] < TWINS or found[b] < TWINS) and abs(len(a) - len(b)) <= 2 + max(len(a), len(b)) // 12:
            if (bits[a] & bits[b]).bit_count() >= 0.7 * max(len(pairs[a]), len(pairs[b]), 1):
                found[a] += count[b]
                found[b] += count[a]

    rarity = Counter(p for ps in pairs.values() for p in ps)
    index: dict[tuple[str, ...], list[str]] = {}
    for c, ps in pairs.items():
        rare = sorted(ps, key=lambda p: (rarity[p], p))[: int(0.3 * len(ps)) + 2]
        seen: set[str] = set()
        for k in combinations(rare, 2) if len(rare) > 1 else (tuple(rare),):
            held = index.setdefault(k, [])
            for other in held:
                if other not in seen:
                    seen.add(other)
                    compare(c, other)
            held.append(c)
    return {c: min(n, TWINS) for c, n in found.items()}


LINE_FEATURES = 17
_CLOSED, _ENDED = frozenset(".!?:;,»”\"')。！？；，」』"), frozenset(".!?:»”\"')。！？」』")
#: What a line that ``_SIDE`` matches has at an end, and inside.
_NUMERALS, _GAP = frozenset("0123456789lIOoSBivxcVXLC"), re.compile(r"[\s|]{2}")


def line_features(lines: list[str], title: str, authors: list[str]) -> tuple[list[int], np.ndarray]:
    """(numbers of the lines with text, features of each with its neighbours)."""
    at = [i for i, line in enumerate(lines) if line.strip()]
    if not at:
        return [], np.empty((0, LINE_FEATURES))
    texts = [lines[i].strip() for i in at]
    filled = [False] * len(lines)
    for i in at:
        filled[i] = True
    widths = sorted(len(lines[i].rstrip()) for i in at)
    width = max(widths[int(len(widths) * 0.9)] if len(widths) > 1 else widths[0], 1)
    title_core = _core(title or "")
    author_cores = [c for c in (_core(a) for a in authors) if len(c) > 3]
    cores, numbers, sides = [], [], []
    for i, rest in zip(at, texts, strict=True):
        line = lines[i]
        number = side = None
        if len(line) <= 1.6 * width + 20:
            if m := _PAGE.match(line):
                number, rest = _value(m.group(1)), ""
            elif (rest[0] in _NUMERALS or rest[-1] in _NUMERALS) and _GAP.search(rest) and (m := _SIDE.match(line)):
                side = _value(m.group(1) or m.group(4))
                rest = (m.group(2) or m.group(3)) if side is not None else rest
        cores.append(_core(rest))
        numbers.append(number)
        sides.append(side)
    short = [j for j in range(len(at)) if 0 < len(cores[j]) and len(texts[j]) <= 1.25 * width]
    pairs: dict[str, set[str]] = {}
    like = _twins([cores[j] for j in short])
    twins = [0] * len(at)
    for j in short:
        twins[j] = like[cores[j]]
    title_pairs = _pairs(title_core)
    paged = [n if n is not None else s for n, s in zip(numbers, sides, strict=True)]
    known = {n for n in paged if n is not None}
    rows = []
    for j, i in enumerate(at):
        line = lines[i]
        text = texts[j]
        before = texts[j - 1] if j else ""
        after = texts[j + 1] if j + 1 < len(at) else ""
        initials = [w[0] for w in text.split()]
        n = paged[j]
        core = cores[j]
        as_title = bool(core) and len(core) >= 8 and (title_core.startswith(core[: max(8, len(core) - 2)]) or (len(core) - len(title_core) <= 2 + len(core) // 12 and len((pairs.get(core) or pairs.setdefault(core, _pairs(core))) & title_pairs) >= 0.7 * len(pairs[core]) and _alike(core, title_core[: len(core)], pairs)))
        as_author = any(a in core for a in author_cores)
        near_number = next((d for d in (1, 2) if (j >= d and paged[j - d] is not None) or (j + d < len(at) and paged[j + d] is not None)), 9)
        rows.append(
            (
                numbers[j] is not None,
                sides[j] is not None,
                n is not None and ((n + 1) in known or (n - 1) in known),
                twins[j],
                len(text) / width,
                as_title,
                as_author,
                text[-1] in _CLOSED,
                bool(before) and before[-1] not in _ENDED,
                bool(after) and after[0].islower(),
                i == 0 or not filled[i - 1],
                i + 1 >= len(lines) or not filled[i + 1],
                1.0 if text.isupper() else sum(map(str.isupper, initials)) / len(initials) / 2,
                j == 0 or j + 1 == len(at),
                text[0].islower() and numbers[j] is None,
                near_number,
                (len(line) - len(line.lstrip())) / width,
            )
        )
    return at, np.array(rows, dtype=float)


def join_features(first: str, second: str, mark: str, trusted: dict[str, int]) -> tuple:
    """Features of a line that ends in ``first`` and a hyphen, and of the word it goes on with."""
    joined, hyphened = first + second, f"{first}-{second}"
    log = lambda w: float(np.log1p(trusted.get(w, 0)))
    return (log(joined), log(hyphened), log(first), log(second), len(first), len(second), mark == "­" or mark == "¬", second[:1].islower(), "-" in first)


def difference(word: str, other: str) -> tuple[str, str, int]:
    """What is left of both without their common start and end, and the length of the start."""
    a = 0
    while a < min(len(word), len(other)) and word[a] == other[a]:
        a += 1
    b = 0
    while b < min(len(word), len(other)) - a and word[-1 - b] == other[-1 - b]:
        b += 1
    return word[a : len(word) - b], other[a : len(other) - b], a


#: No reading may cost more.
DEAREST = 1.1


def sight_cost(x: str, y: str) -> float:
    """Edit cost in which a confusion of look-alike letters counts a third; 9 beyond ``DEAREST``."""
    if (x, y) in _LOOKS:
        return 0.35
    rows: list[list[float]] = []
    for i in range(len(x) + 1):
        row = [0.0] * (len(y) + 1)
        for j in range(len(y) + 1):
            if not i and not j:
                continue
            best = 9.0
            if i:
                best = rows[i - 1][j] + 1
            if j and row[j - 1] + 1 < best:
                best = row[j - 1] + 1
            if i and j:
                best = min(best, rows[i - 1][j - 1] + (x[i - 1] != y[j - 1]))
            for p in (1, 2, 3)[: min(i, 3)]:
                above = rows[i - p]
                for q in (1, 2, 3)[: min(j, 3)]:
                    if above[j - q] + 0.35 < best and (x[i - p : i], y[j - q : j]) in _LOOKS:
                        best = above[j - q] + 0.35
            row[j] = best
        rows.append(row)
        if i >= 2 and min(map(min, rows[-3:])) > DEAREST:
            return 9.0
    return rows[-1][-1] if rows[-1][-1] <= DEAREST else 9.0


def word_features(word: str, other: str, weight: float) -> tuple:
    """Features of reading ``word`` as ``other``, which has the given log frequency."""
    x, y, at = difference(word, other)
    cost = sight_cost(x, y) if max(len(x), len(y)) <= 14 else 9.0
    digits = sum(c.isdigit() for c in word)
    return (cost, cost / max(len(other), 1), len(other), len(x), len(y), at == 0, weight, digits, len(word) - len(other), any(c.isdigit() for c in x), word.isalpha())


# ---- training pages ------------------------------------------------------------------------------


def _misread(word: str, rng: random.Random) -> str:
    options = [(i, a, b) for pair in _PAIRS for a, b in (pair, pair[::-1]) for i in range(len(word)) if word.startswith(a, i)]
    if not options:
        return word
    i, a, b = rng.choice(options)
    return word[:i] + b + word[i + len(a) :]


_PAIRS = sorted(tuple(sorted(p)) for p in LOOKALIKES if len(p) == 2)


def layout(text: str, title: str, author: str, rng: random.Random) -> tuple[list[str], list[bool], list[tuple[str, str, str, int]]]:
    """A damaged page image of a clean text: (lines, furniture flags, splits (first, second, mark, kind))
    where kind 1 is a word cut in two and 0 a hyphen that the word itself has."""
    width, page = rng.randint(40, 75), rng.choice([rng.randint(6, 14), rng.randint(10, 32)])
    mark = rng.choice(["-", "- ", "­", "¬", "‐"])
    body: list[str] = []
    splits: list[tuple[str, str, str, int]] = []
    for number, paragraph in enumerate(p for p in re.split(r"\n\s*\n", text) if p.strip()):
        if number and rng.random() < 0.25:
            head = " ".join(w for w in rng.sample(words(text) or ["part"], min(2, len(words(text)) or 1)))
            body += ["", rng.choice([f"§ {number}. {head.capitalize()}", f"{number}. {head.capitalize()}", head.title()])]
        indent = rng.random() < 0.5
        if body and (not indent or rng.random() < 0.3):
            body.append("")
        line = "    " if indent else ""
        for word in paragraph.split():
            if rng.random() < 0.01:
                word = _misread(word, rng)
            if rng.random() < 0.004:
                word = f"({rng.randint(1400, 1990)}) {word}"
            if len(line) + len(word) + 1 <= width:
                line = f"{line} {word}" if line.strip() else line + word
                continue
            room = width - len(line) - 2
            inner = [i for i, c in enumerate(word) if c == "-" and 1 < i < len(word) - 2]
            if inner and inner[0] < room + 3 and line.strip() and rng.random() < 0.7:
                cut = inner[0]
                body.append(f"{line} {word[: cut + 1]}")
                splits.append((_EDGE.sub("", word[:cut].lower()), _EDGE.sub("", word[cut + 1 :].lower()), "-", 0))
                line = word[cut + 1 :]
            elif len(word) >= 5 and room >= 2 and line.strip() and word.isalpha() and rng.random() < 0.6:
                cut = rng.randint(2, min(room, len(word) - 2)) if min(room, len(word) - 2) >= 2 else 2
                body.append(f"{line} {word[:cut]}{mark}")
                splits.append((word[:cut].lower(), word[cut:].lower(), mark.strip(), 1))
                line = word[cut:]
            else:
                body.append(line)
                line = word
        if line.strip():
            body.append(line)
    style, start = rng.randint(0, 5), rng.choice([rng.randint(1, 40), rng.randint(80, 400)])
    roman = rng.random() < 0.2
    journal = rng.choice([f"Journal of {title.split()[0] if title.split() else 'New'} Studies", author, f"{author}, {title[:24]}"])
    heads = [title[: rng.choice([rng.randint(18, 44), width - 8, width])].rstrip(), journal]
    if rng.random() < 0.3:
        heads = [rng.choice(heads)] * 2
    if rng.random() < 0.4:
        heads = [h.upper() for h in heads]
    numeral = lambda n: "".join(t * (n // v % d) for t, v, d in (("x", 10, 9), ("v", 5, 2), ("i", 1, 5))) if roman else str(n)
    total = start + rng.randint(5, 60)
    shape = rng.choice(["{}", "[{}]", "- {} -", "— {} —", "p. {}", "Page {} of " + str(total), "{} |", "Seite {}"])
    with_heads, with_numbers = rng.random() < 0.85, rng.random() < 0.65
    top = rng.random() < 0.5
    pad = rng.choice(["", " " * (width // 2), " " * (width // 3)])
    lines: list[str] = []
    flags: list[bool] = []

    def furniture(text: str) -> None:
        if rng.random() < 0.3:
            lines.append("")
            flags.append(False)
        if rng.random() < 0.15:
            text = _misread(text, rng)
        lines.append(text)
        flags.append(True)
        if rng.random() < 0.5:
            lines.append("")
            flags.append(False)

    for number, a in enumerate(range(0, len(body), page)):
        n = numeral(start + number)
        head = heads[number % 2]
        if with_heads and style < 3 and with_numbers:
            (side := f"{n}   {head}" if number % 2 else f"{head}   {n}")
            if top:
                furniture(side)
        elif with_heads and (number or rng.random() < 0.7):
            furniture(head)
        lines += body[a : a + page]
        flags += [False] * len(body[a : a + page])
        if with_heads and style < 3 and with_numbers:
            if not top:
                furniture(side)
        elif with_numbers:
            furniture(pad + shape.format(n))
    return lines, flags, splits


@dataclass
class Models:
    """Trusted words with their frequency, and the three boosted models."""

    trusted: dict[str, int]
    line: Boosted
    join: Boosted
    word: Boosted


def train(samples: list[tuple[str, str, str]], trusted: dict[str, int], seed: int = 11) -> Models:
    """Models from clean (text, title, author) rows."""
    rng = random.Random(seed)
    line_x, line_y, join_x, join_y = [], [], [], []
    for text, title, author in samples:
        # The clean text as it stands, and wrapped without pages: nothing in it is furniture.
        # Stretches of a text that are set in lines may be scanned themselves and teach nothing.
        whole = text.split("\n")
        clean = _paragraphs(text)
        text = "\n\n".join(clean)
        for lines, runs in ((whole, [(a, b) for a, b in stretches(whole) if not set_in_lines(whole[a:b])]), (wrapped := [x for p in clean for x in textwrap.wrap(p, rng.randint(40, 90)) or [""]], stretches(wrapped))):
            for a, b in runs:
                at, features = line_features(lines[a:b], title or "", [author] if author else [])
                line_x.append(features)
                line_y += [False] * len(at)
        # Pages are laid out of words set apart.
        for _ in range(0 if _WIDE.search(text) else 4):
            lines, flags, splits = layout(text, title or "Untitled", author or "Anonymous", rng)
            at, features = line_features(lines, title if rng.random() < 0.8 else "", [author] if author else [])
            line_x.append(features)
            line_y += [flags[i] for i in at]
            for first, second, mark, kind in splits:
                join_x.append(join_features(first, second, mark, trusted))
                join_y.append(kind)
    vocabulary = sorted((w for w in trusted if w.isalpha() and len(w) > 2), key=lambda w: (-trusted[w], w))[:SAMPLE_WORDS]
    word_x, word_y = [], []
    by_length: dict[int, list[str]] = {}
    for w in vocabulary:
        by_length.setdefault(len(w), []).append(w)
    for w in vocabulary:
        for _ in range(2):
            bad = _misread(w, rng)
            if bad not in trusted:
                word_x.append(word_features(bad, w, float(np.log1p(trusted[w]))))
                word_y.append(1)
        # A rare word of its own: the other words are no readings of it.
        for shift in (-1, 0, 1):
            if others := by_length.get(len(w) + shift):
                other = rng.choice(others)
                stem = w[: rng.randint(1, len(w) - 1)] + rng.choice(vocabulary)[-rng.randint(1, 4) :]
                for x in (w, stem):
                    if x != other:
                        word_x.append(word_features(x, other, float(np.log1p(trusted[other]))))
                        word_y.append(0)
        i = rng.randrange(len(w))
        changed = w[:i] + rng.choice("abcdefghijklmnoprstuvwxyz") + w[i + 1 :]
        x, y, _ = difference(changed, w)
        if changed not in trusted and changed != w and frozenset((x, y)) not in LOOKALIKES:
            word_x.append(word_features(changed, w, float(np.log1p(trusted[w]))))
            word_y.append(0)
    blank = lambda n: (np.vstack([np.zeros((1, n)), np.ones((1, n))]), np.array([0, 1]))
    lx, ly = (np.vstack(line_x), np.array(line_y)) if line_y else blank(LINE_FEATURES)
    jx, jy = (np.array(join_x), np.array(join_y)) if join_y else blank(9)
    wx, wy = (np.array(word_x), np.array(word_y)) if word_y else blank(11)
    return Models(trusted, Boosted(rounds=60, depth=4).fit(lx, ly), Boosted(rounds=20).fit(jx, jy), Boosted().fit(wx, wy))


# ---- reading pages -------------------------------------------------------------------------------


_WIDE = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uff00-\uffef]")


def _width(line: str) -> int:
    """Columns that a line takes: letters of Chinese, Japanese and Korean take two."""
    return len(line) if line.isascii() else len(line) + len(_WIDE.findall(line))


_STOPPED = re.compile(r"[.!?。！？؟][\"”»’')\]」』]*\s*$")


def _is_stopped(line: str) -> bool:
    """Whether a line that is not blank ends a sentence, be it inside quotes or brackets."""
    last = line.rstrip()[-1]
    return last in ".!?。！？؟" or (last in "\"”»’')]」』" and _STOPPED.search(line) is not None)


def stretches(lines: list[str]) -> list[tuple[int, int]]:
    """Runs of lines that may be set as on a page: the text between paragraphs of one line each."""
    sizes = [_width(x.rstrip()) for x in lines]
    inside = sorted(n for n, x in zip(sizes, lines, strict=True) if n and not _is_stopped(x))
    # Lines of one width are set, however wide.
    even = len(inside) > 3 and inside[int(len(inside) * 0.9)] <= 1.25 * inside[len(inside) // 2]
    limit = max(PARAGRAPH, 1.6 * inside[len(inside) // 2] if even else 0)
    found, start = [], None
    for i, n in enumerate([*sizes, limit + 1]):
        if n > limit:
            if start is not None:
                found.append((start, i))
            start = None
        elif n and start is None:
            start = i
    return found


def set_in_lines(lines: list[str]) -> bool:
    """Whether most lines end inside a sentence."""
    text = [s for s in (x.rstrip() for x in lines) if s]
    return len(text) > 1 and sum(s[-1] in ".!?。！？؟" for s in text) < 0.6 * len(text)


def read_pages(pages: list[tuple[str, str, list[str]]], models: Models) -> list[list[tuple[int, str, str, str]]]:
    """Cases of each (text, title, authors): (line_no, kind, word, reading) of furniture; split with the
    whole word; rare with a word outside the trusted ones and its reading where the text itself tells
    it, else ''.  Every stretch of lines is looked at as a page of its own."""
    set_out = [text.split("\n") for text, _, _ in pages]
    runs = [(k, a, b) for k, lines in enumerate(set_out) for a, b in stretches(lines)]
    features = [line_features(set_out[k][a:b], *pages[k][1:]) for k, a, b in runs]
    stacked = [f for _, f in features if len(f)]
    likely = iter(models.line.predict(np.vstack(stacked)) >= FURNITURE if stacked else [])
    furniture: list[set[int]] = [set() for _ in pages]
    paged: list[set[int]] = [set() for _ in pages]
    for (k, a, b), (at, f) in zip(runs, features, strict=True):
        flagged = {a + i for i in at if next(likely)}
        paged[k].update(range(a, b))
        # A few lines of which none repeats or bears a number are no page.
        if len(at) > 4 or f[:, :4].any():
            furniture[k] |= flagged
    drafts = [_draft(lines, skip, inside, models.trusted) for lines, skip, inside in zip(set_out, furniture, paged, strict=True)]
    facts = [f for _, pending in drafts for *_, f in pending]
    joins = iter(models.join.predict(np.array(facts)) if facts else [])
    return [_cases(skip, draft, joins, models.trusted) for skip, draft in zip(furniture, drafts, strict=True)]


def _draft(lines, furniture, paged, trusted):
    """(rare words, split words with their features) of one text."""
    text_lines = [i for i, x in enumerate(lines) if i not in furniture and x.strip()]
    rare: list[tuple[int, str]] = []
    carried = False
    pending = []
    for k, i in enumerate(text_lines):
        line = lines[i].rstrip()
        tokens = line.lower().replace("—", " ").replace("–", " ").split()
        if carried and tokens:
            tokens = tokens[1:]
        carried = False
        if i in paged and tokens and line[-1] in _HYPHENS and len(line) > 1 and line[-2].isalnum() and k + 1 < len(text_lines):
            following = lines[text_lines[k + 1]].lower().split()
            first = tokens[-1].strip(_SIGNS)
            second = re.split("[—–]", following[0])[0].strip(_SIGNS) if following else ""
            if first and second:
                pending.append((i + 1, first, second, join_features(first, second, line[-1], trusted)))
                tokens = tokens[:-1]
                carried = True
        for t in tokens:
            if t in trusted:
                continue
            w = t.strip(_SIGNS)
            if w and w not in trusted and len(w) > 1 and not w.isdigit() and any(c.isalpha() for c in w):
                rare.append((i + 1, w))
    return rare, pending


def _thirds(size: int) -> list[tuple[int, int]]:
    a, b = size // 3, 2 * size // 3
    return [(0, a), (a, b), (b, size)]


def own_readings(counts: Counter) -> dict[str, str]:
    """What rare words of a text should read by more frequent ones of the same text: the most frequent
    that at most two confusions of look-alike letters turn into them.

    Two confusions leave one of three parts of the other word as it is, moved by two letters at most,
    so only words that share such a part are compared."""
    order = {w: i for i, w in enumerate(counts)}
    index: dict[tuple[int, int, str], list[str]] = {}
    for w, n in counts.items():
        if n > 1:
            for part, (a, b) in enumerate(_thirds(len(w))):
                index.setdefault((len(w), part, w[a:b]), []).append(w)
    sizes = {k[0] for k in index}
    found = {}
    for w, n in counts.items() if index else ():
        if len(w) < 5:
            continue
        near: set[str] = set()
        for size in range(len(w) - 2, len(w) + 3):
            if size in sizes:
                for part, (a, b) in enumerate(_thirds(size)):
                    for start in range(max(0, a - 2), min(a + 2, len(w) - (b - a)) + 1):
                        near.update(index.get((size, part, w[start : start + b - a]), ()))
        for other in sorted(near, key=lambda o: (-counts[o], order[o])):
            if counts[other] <= n:
                break
            x, y, _ = difference(w, other)
            if max(len(x), len(y)) <= 6 and sight_cost(x, y) <= 0.75:
                found[w] = other
                break
    return found


def _cases(furniture, draft, joins, trusted):
    rare, pending = draft
    cases = [(i + 1, "furniture", "", "") for i in sorted(furniture)]
    for number, first, second, _ in pending:
        p = next(joins)
        joined, hyphened = first + second, f"{first}-{second}"
        if joined in trusted and trusted[joined] >= trusted.get(hyphened, 0):
            word = joined
        elif hyphened in trusted:
            word = hyphened
        else:
            word = joined if p >= 0.5 or not (first in trusted and second in trusted) else hyphened
        cases.append((number, "split", word, ""))
        if word not in trusted:
            rare.append((0, word))
    readings = own_readings(Counter(w for _, w in rare))
    return cases + [(number, "rare", w, readings.get(w, "")) for number, w in rare if number]


def _paragraphs(text: str) -> list[str]:
    """The lines of a text that are paragraphs: no scanned page is set so wide."""
    lines = text.split("\n")
    paged = {i for a, b in stretches(lines) for i in range(a, b)}
    return [x for i, x in enumerate(lines) if i not in paged and x.strip()]


_CASES = "rec_no bigint, line_no int, kind string, word string, reading string"


def _grams(w: str) -> list[str]:
    forms = {w, w.translate(_DIGITS), w.replace("1", "i")}
    return sorted({g for f in forms for g in (lambda s: [s[i : i + 3] for i in range(len(s) - 2)])(f"##{f}##")})


#: Misreadings of one word that are told at most: three at a cost of 0.35 each.
MISREAD = 3


def candidates(rare: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, other, df): trusted words that share enough q-grams with a rare word and differ in
    length by at most two.

    A word of ``n`` letters has ``n + 2`` grams; half of them must be left, which two misreadings leave
    in words of up to nine letters and three in longer ones.  The lengths are part of the join key, so
    that a frequent gram is many keys."""

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.assign(gram=[_grams(w) for w in pdf["word"]])
            yield pdf.explode("gram")[["word", "n", "gram"]]

    sized = lambda df: df.mapInPandas(grams, "word string, n bigint, gram string")
    size = F.length("other")
    known = sized(vocabulary.select("word", F.col("n").cast("bigint").alias("n"))).select(F.col("word").alias("other"), F.col("n").alias("df"), "gram")
    known = known.select("other", "df", "gram", F.explode(F.sequence(size - 2, size + 2)).alias("size"))
    asked = sized(rare.select("word", F.lit(0).cast("bigint").alias("n"))).select("word", "gram", F.length("word").alias("size"))
    met = asked.join(known, ["gram", "size"]).groupBy("word", "other").agg(F.count(F.lit(1)).alias("shared"), F.max("df").alias("df"))
    left = F.greatest(F.lit(1), F.floor((size - 2) / 2))
    # Three misreadings of two letters each are six edits.
    near = F.call_function("levenshtein", F.col("word"), F.col("other"), F.lit(2 * MISREAD)) >= 0
    return met.where((F.col("shared") >= left) & near).select("word", "other", "df")


def read_scans(docs: DataFrame, text: str = "fulltext") -> DataFrame:
    """(rec_no, line_no, kind, word, wrong): cases of noise in the texts of ``docs`` (rec_no, title,
    authors, abstract and the text column).

    Lines are split at line feeds and counted from 1.  kind furniture has an empty word; split the
    whole word; misread what the word should read, with what stands there in ``wrong``.  Null and
    empty texts give nothing; a text that is one long line can only hold misread words.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("rec_no").cast("bigint").alias("rec_no"), "title", "authors", "abstract", F.col(f"`{text}`").alias("text")).where("rec_no is not null")
    texts = rows.where("length(text) > 0")
    clean = rows.select("abstract", "text").where("length(abstract) > 0 or length(text) > 0")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: Counter = Counter()
            texts = [t for t in pdf["abstract"] if t] + [" ".join(p) for p in (_paragraphs(t) for t in pdf["text"] if t) if p]
            for t in texts:
                seen.update(distinct_words(t))
            yield pd.DataFrame({"word": list(seen), "n": list(seen.values()), "texts": 0})
            yield pd.DataFrame({"word": [""], "n": [0], "texts": [len(texts)]})

    counted = materialize(clean.mapInPandas(count, "word string, n bigint, texts bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts")), "words")
    total = counted.where("word = ''").agg(F.coalesce(F.sum("texts"), F.lit(0))).first()[0]
    least = max(TRUST_LEAST, int(total * TRUST_SHARE))
    vocabulary = counted.where((F.col("n") >= least) & (F.length("word") > 1) & F.col("word").rlike(r"\p{L}")).select("word", "n")
    trusted = {r["word"]: r["n"] for r in vocabulary.collect()}
    some = F.pmod(F.xxhash64("rec_no"), F.lit(1_000_003)) < int(1_000_003 * min(1.0, SAMPLE_TEXTS * 40 / max(total, 1)))
    wide, broad = F.col("text").rlike(r"\p{IsHan}|\p{IsHangul}"), F.col("text").rlike(r"[^\n]{80}")
    apart = F.col("text").rlike(r"[^\n]{160}") & (F.length("text") > 400) & F.col("text").rlike("[A-Za-z]{3}") & ~wide
    sampled = texts.where(some).select(F.substring("text", 1, SAMPLE_CHARS).alias("text"), "title", F.get("authors", F.lit(0)).alias("author"), F.xxhash64("rec_no").alias("u"))
    drawn = [r for kind, most in ((apart, SAMPLE_TEXTS), (wide & broad, SAMPLE_TEXTS // 4)) for r in sampled.where(kind).orderBy("u").limit(most).collect()]
    models = spark.sparkContext.broadcast(train([(r["text"], r["title"] or "", r["author"] or "") for r in drawn], trusted))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pages = [(t, title or "", [a for a in authors if a] if authors is not None else []) for t, title, authors in zip(pdf["text"], pdf["title"], pdf["authors"], strict=True)]
            found = [(rec, *c) for rec, cases in zip(pdf["rec_no"], read_pages(pages, models.value), strict=True) for c in cases]
            yield pd.DataFrame(found, columns=["rec_no", "line_no", "kind", "word", "reading"])

    cases = materialize(texts.select("rec_no", "title", "authors", "text").mapInPandas(read, _CASES), "cases")
    open_words = cases.where("kind in ('rare', 'split') and reading = ''").select("word").distinct().join(vocabulary, "word", "left_anti")

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = [word_features(w, o, float(np.log1p(n))) for w, o, n in zip(pdf["word"], pdf["other"], pdf["df"], strict=True)]
                yield pdf[["word", "other", "df"]].assign(score=models.value.word.predict(np.array(x, dtype=float)), cost=[f[0] for f in x])

    scored = candidates(open_words, vocabulary).mapInPandas(rank, "word string, other string, df bigint, score double, cost double").where(f"score >= 0.5 and cost <= {DEAREST}")
    best = scored.groupBy("word").agg(F.max_by("other", F.struct(-F.round("cost", 2), F.round("score", 3), "df", "other")).alias("right"))
    read_words = cases.where("kind <> 'furniture'").join(best, "word", "left")
    reading = F.coalesce(F.nullif("reading", F.lit("")), F.col("right"))
    misread = read_words.where("kind = 'rare'").where(reading.isNotNull()).select("rec_no", "line_no", F.lit("misread").alias("kind"), reading.alias("word"), F.col("word").alias("wrong"))
    split = read_words.where("kind = 'split'").select("rec_no", "line_no", "kind", F.coalesce(reading, F.col("word")).alias("word"), F.col("word").alias("wrong"))
    furniture = cases.where("kind = 'furniture'").select("rec_no", "line_no", "kind", "word", F.lit("").alias("wrong"))
    return furniture.unionByName(split).unionByName(misread).distinct()


def _like(model: str, word: str) -> str:
    """``word`` with the capitals of ``model``."""
    if model.isupper() and len(model) > 1:
        return word.upper()
    return word[:1].upper() + word[1:] if model[:1].isupper() else word


def repair_text(text: str, cases: list[tuple[int, str, str, str]]) -> str:
    """The text in paragraphs, one to a line with a blank line between, without furniture, with split
    words whole and misread words replaced.  Cases: (line_no, kind, word, wrong)."""
    furniture = {n for n, kind, _, _ in cases if kind == "furniture"}
    splits = {n: word for n, kind, word, _ in cases if kind == "split"}
    readings: dict[int, dict[str, str]] = {}
    for n, kind, word, wrong in cases:
        if kind == "misread":
            readings.setdefault(n, {})[wrong] = word
    paragraphs: list[list[str]] = [[]]
    whole, blank = None, False
    lines = text.split("\n")
    paged = {i + 1 for a, b in stretches(lines) if set_in_lines(lines[a:b]) for i in range(a, b)}
    for n, line in enumerate(lines, 1):
        if n in furniture:
            continue
        tokens = line.split()
        if not tokens:
            blank = True
            continue
        last = paragraphs[-1][-1] if paragraphs[-1] else ""
        page = n in paged
        open_end = whole is not None or (page and last and last[-1] not in ".!?:。！？" and tokens[0][0].islower())
        if paragraphs[-1] and not open_end and (not page or blank or line[:2] == "  "):
            paragraphs.append([])
        blank = False
        known = readings.get(n, {})
        for i, t in enumerate(tokens):
            bare = t.strip(_SIGNS)
            if bare.lower() in known:
                tokens[i] = t.replace(bare, _like(bare, known[bare.lower()]), 1)
        if whole is not None:
            head, tail = whole
            bare = tokens[0].strip(_SIGNS)
            after = tokens[0][tokens[0].find(bare) + len(bare) :] if bare else ""
            tokens[0] = head + tail + after
            whole = None
        if n in splits:
            broken = tokens.pop()
            bare = broken.strip(_SIGNS)
            whole = (broken[: broken.find(bare)] if bare else "", _like(bare, splits[n]))
        paragraphs[-1] += tokens
    if whole is not None:
        paragraphs[-1].append("".join(whole))
    return "\n\n".join(" ".join(p) for p in paragraphs if p)


def repair(docs: DataFrame, found: DataFrame, text: str = "fulltext") -> DataFrame:
    """(rec_no, text): repaired texts by the cases of ``read_scans``; texts without cases are set in
    paragraphs as they are, null texts give no row."""
    cases = found.groupBy("rec_no").agg(F.collect_list(F.struct("line_no", "kind", "word", "wrong")).alias("cases"))
    rows = docs.select(F.col("rec_no").cast("bigint").alias("rec_no"), F.col(f"`{text}`").alias("text")).where("rec_no is not null and text is not null")

    def mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            mended = [repair_text(t, [(c["line_no"], c["kind"], c["word"], c["wrong"]) for c in (cs if cs is not None else [])]) for t, cs in zip(pdf["text"], pdf["cases"], strict=True)]
            yield pd.DataFrame({"rec_no": pdf["rec_no"], "text": mended})

    return rows.join(cases, "rec_no", "left").mapInPandas(mend, "rec_no bigint, text string")
