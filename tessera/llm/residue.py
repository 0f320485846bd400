"""Template residue, filler and error pages in texts.

Records of one template are aligned and their slots induced: a unit of text (a line or a sentence of
it) becomes a frame in which numbers, names in code and words that few texts use are open, and units
of one frame are records of one template.  A slot that others fill and one leaves with a variable
name, a default or blank is residue, and so is a frame in which hardly anything but variable names
stands.  Beside it pages of servers and generators are templates as wholes: a line that ends several
different texts, stands in some of them with nothing but a heading, and is made of words that running
text does not use.  What occurs once cannot be aligned; slots in template syntax, dummy text and a
list of known wordings tell it.  Every unit of every text is looked at, however long.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.storage import materialize

_NAME = r"[A-Za-z_][A-Za-z0-9_.]*"

# Slot syntaxes of common template languages and the usual forms of defaults.
PLAIN_SLOTS = [
    rf"\{{\{{\s*({_NAME})\s*\}}\}}",
    r"\{%[^%\n]{1,80}%\}",
    r"<%=?[^%\n]{1,80}%>",
    rf"\$\{{({_NAME})\}}",
    rf"#\{{({_NAME})\}}",
    rf"%%({_NAME})%%",
    rf"@@({_NAME})@@",
    rf"\[\[({_NAME})\]\]",
    rf"\{{{_NAME}![rs]\}}",
    r"\[(?i:your) [A-Za-z_][A-Za-z0-9_. ]{0,40}\]",
    r"\[(?i:insert) [^\]\n]{1,60}(?i:here)\]",
    rf"\[{_NAME} (?i:tbd)\]",
    rf"<{_NAME}(?: [A-Za-z]+)? (?i:goes here)>",
    r"\bTODO: (?i:add) [A-Za-z_]",
]
NAMED_SLOTS = [rf"\{{\{{\s*({_NAME})\s*\}}\}}", rf"\$\{{({_NAME})\}}", rf"#\{{({_NAME})\}}", rf"%%({_NAME})%%", rf"@@({_NAME})@@", rf"\[\[({_NAME})\]\]"]
AMBIGUOUS_SLOTS = [rf"\$({_NAME})\$", rf"\{{({_NAME})\}}", rf"__([A-Za-z][A-Za-z0-9_.]*?)__", rf"«({_NAME})»", rf"&lt;({_NAME})&gt;"]

# Wordings of error, access, viewer, script and stub messages (lower case, one line).
MESSAGES = [
    r"^(?:https? |http/[0-9.]+ )?(?:error|status code|fehler|erreur|erro|error de servidor|ошибка|エラー|错误|错误代码|오류|خطأ)\W{0,3}[0-9]{3}\b",
    r"^[0-9]{3}\W{1,3}(?:not found|forbidden|internal server error|bad gateway|service unavailable|gone|too many requests|unauthori[sz]ed|gateway time-?out|bad request|moved)",
    r"^\{\s*\"error\"",
    r"^the requested (?:url|page|document|resource)\b.*\bnot found",
    r"^(?:\W*(?:sorry|oops|we.re sorry|we are sorry|whoops)\W+)?(?:we )?(?:could not|couldn.t|can.t|cannot) find (?:that|this|the) (?:page|document|article|file|resource)",
    r"^(?:\W*(?:sorry|oops|we.re sorry|we are sorry|whoops)\W+)?the (?:page|document|article|file|resource) you (?:are looking|were looking|requested|have requested)",
    r"^(?:\W*(?:sorry|oops|we.re sorry|whoops)\W+)something went wrong (?:while|when|on|with)",
    r"^(?:page|document|article|file) not found",
    r"^(?:page introuvable|seite nicht gefunden|página no encontrada|página não encontrada|страница не найдена|ページが見つかりません|页面不存在|页面未找到|找不到页面|페이지를 찾을 수 없|الصفحة غير موجودة|لم يتم العثور على الصفحة)",
    r"^(?:please|you (?:need|must|have)|this (?:site|page|app|document|viewer)|for (?:full|best)|to (?:view|use|see|read)|your browser|loading|if |enable|turn on|allow|sorry|oops|we.re sorry).{0,80}\b(?:enable|turn on|activate|allow|requires?|needs?|supports?)\b.{0,40}\b(?:javascript|scripts?|scripting|cookies)\b",
    r"^(?:please )?(?:enable|turn on|activate|allow)\b.{0,40}\b(?:javascript|scripts?|cookies)\b",
    r"^(?:this (?:site|page|app)|your browser)\b.{0,40}\b(?:requires?|needs?|does not support|doesn.t support)\b.{0,40}\b(?:javascript|scripts?|cookies)\b",
    r"^(?:scripting|javascript) (?:is |seems to be )?(?:switched off|turned off|disabled|required|deactivated)",
    r"^.{0,60}(?:activer|activez|habilite|habilitar|active|ative|ativar|aktivieren|включите|включить|启用|啟用|تفعيل|تمكين|فعّل).{0,30}javascript",
    r"^.{0,40}javascript.{0,20}(?:有効|켜|启用|啟用|включ|aktivieren|تفعيل)",
    r"^(?:access|permission) denied\b(?! to)|^.{0,30}you do not have permission|^(?:zugriff verweigert|accès refusé|acceso denegado|acesso negado|доступ запрещ|アクセスが拒否|访问被拒绝|접근이 거부|تم رفض الوصول)",
    r"security check to prove|not a robot|^.{0,40}\bcaptcha\b|^checking your browser|^your session has (?:expired|timed out)|^(?:please )?(?:log|sign) ?in (?:again )?to (?:continue|view|read)|download limit reached|(?:subscribe|sign in|log in)\b.{0,30}\bto read the full text|^subscription required",
    r"^database (?:connection )?(?:failed|error)|^error establishing a database|contact the administrator\W*$|^this (?:document|page|file|article) could not be (?:displayed|loaded|found|opened)|viewer failed to load",
    r"^traceback \(most recent call last\)|^(?:key|value|type|attribute|name|index|import|runtime)error: |^(?:php )?(?:fatal error|warning|notice|parse error|deprecated): .{0,200}\bon line [0-9]+|failed to open stream|^file \".{1,200}\", line [0-9]+, in ",
    r"^(?:this is )?(?:some )?(?:a )?(?:sample|placeholder|dummy|demo|filler|example) (?:text|content|paragraph|copy)\b(?:\.|:| goes here| for the | to be |\W*$)",
    r"\breplace (?:it|this) with your\b|^type the .{1,60} in this box|\bstub awaiting content|^content (?:pending|to follow|goes here)|^coming soon\W|^coming soon$|^no (?:abstract|content|summary|description) available yet|\(auto-generated page\)|^this (?:page|entry|article|section) (?:is under construction|has been left blank|intentionally left blank)",
    r"^\[?(?:text|content|title|body|abstract|summary) here\]?\W*$|^[#/*\- ]*todo\b",
    r"^dies ist ein (?:blindtext|platzhalter|beispieltext)|^platzhalter\b.{0,6}text|^texte (?:provisoire|d.exemple|factice)\b ?[,;.:]|^texto (?:de ejemplo|de exemplo|provisional|provisório|provisorio) ?[;,.:]|^это пример текста|^здесь будет текст|^ダミーテキスト|^ここに(?:本文|テキスト)|^此处为(?:示例|占位)|^这里是(?:示例|占位)|^여기에 .{0,10}(?:입력|내용)|^(?:예시|샘플|임시) 텍스트|^هذا (?:نص|مثال)|^نص تجريبي",
    r"^\[object object\]\W*$|^(?:null|undefined|nan)(?:[ ,;]+(?:null|undefined|nan|none))*\W*$|^x{4,}(?: +x{4,})*\W*$",
]

# Words of the usual dummy Latin and of keyboard filler.
LATIN = (
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim "
    "ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure reprehenderit voluptate velit "
    "esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
).split()
FILLER = "asdf asdfgh qwerty blah foo bar baz test text more xxx xxxx yyy zzz hello world sample".split()

# What a known wording holds at least, in lower case; other units are not tried.
CUES = (
    "error|fehler|erreur|erro|ошибка|エラー|错误|오류|خطأ|status code|http|found|find|looking|requested|wrong|introuvable|gefunden|encontrad|не найдена|見つかりません|不存在|未找到|找不到|찾을 수 없|موجودة|العثور|"
    "javascript|script|cookies|denied|permission|verweigert|refusé|denegado|negado|запрещ|拒否|拒绝|거부|رفض|robot|captcha|security check|checking your|session|log in|sign in|login|limit reached|subscri|database|administrator|"
    "could not be|failed to load|traceback|exception|warning|notice|deprecated|stream|file|sample|placeholder|dummy|demo|filler|example|replace|in this box|stub|content|coming soon|available yet|auto-generated|under construction|"
    "left blank|text here|title here|body here|abstract here|summary here|todo|blindtext|platzhalter|beispieltext|provisoire|exemple|factice|ejemplo|exemplo|provisional|provisório|provisorio|пример|здесь|ダミー|ここに|此处|这里|여기|예시|샘플|임시|"
    "نص|مثال|object|null|undefined|nan|xxxx|forbidden|gateway|unavailable|gone|too many|unauthori|bad request|moved|whoops|oops|sorry|{"
).split("|")

# What generators put where a value is missing.
DEFAULTS = {"tbd", "tba", "todo", "null", "undefined", "nan", "xxx", "untitled", "changeme", "fixme", "n/a"}

#: A frame or line in at least this many different texts is a template.
MIN_TEXTS = 3
#: A word is common when at least this share of the texts holds it, so there can be no more common
#: words than (distinct words of a text) / share: the bound of what is broadcast.
COMMON_SHARE, COMMON_LEAST = 0.0005, 3
#: Share of its uses that a word of running text has in lines of several sentences.
RUNNING = 0.5

_SLOT = "\u25a2"
_WORD = re.compile(r"[^\W_]+")
_WIDE = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
_SENTENCE = re.compile(r"(?<=[.!?؟])\s+|(?<=[。！？])\s*")
_CODED = re.compile(r"[{}\[\]<>«»$%@#_=0-9/]|[a-z][A-Z]|&[lg]t;")
_WRAPPED = re.compile(rf"(?:\{{\{{?|\$\{{?|#\{{|%%?|@@|\[\[?|<%?=?|«|__|&lt;)\W*({_NAME}?)\W*(?:\}}|\$|%|@|\]|>|»|__|&gt;)\W*")
_IDENTIFIER = re.compile(r"[A-Za-z]+(?:_[A-Za-z0-9]+)+|[a-z]+[A-Z][A-Za-z0-9]*")
_LABEL = re.compile(r"[^\W\d_][^:\n]{0,60}:")
_EDGES = ".,;:!?\"'()…“”’‘、。，；：！？"
_PLAIN = re.compile("|".join(f"(?:{p})" for p in PLAIN_SLOTS))
_MESSAGE = re.compile("|".join(f"(?:{p})" for p in MESSAGES))
_LATIN, _KEYS = set(LATIN), set(FILLER)
_DUMMY = _LATIN | _KEYS


def _bare(name: str) -> str:
    return name.strip("._").lower()


def words_of(unit: str) -> list[str]:
    """Words in lower case; pairs of letters where words are not set apart."""
    found = _WORD.findall(unit.lower())
    if not _WIDE.search(unit):
        return found
    return [x for w in found for x in ([w[i : i + 2] for i in range(max(1, len(w) - 1))] if _WIDE.search(w) else [w])]


def _units(text: str) -> list[tuple[str, list[str]]]:
    """The lines that are not blank, each with its sentences."""
    lines = [x.strip() for x in re.split(r"[\r\n]+", text)]
    return [(x, [y for y in _SENTENCE.split(x) if y]) for x in lines if x]


class Lexicon:
    """Common words, those of running text among them, and variable names in use."""

    def __init__(self, common: set[str], running: set[str], names: set[str]):
        self.common, self.running, self.names = common, running, names
        self.known = common - names - DEFAULTS
        self.known_running = self.known & running

    def is_running(self, words: list[str]) -> bool:
        known = len(self.known.intersection(words))
        return known > 0 and len(self.known_running.intersection(words)) > known / 2

    def frame(self, unit: str, words: list[str]) -> tuple[str, list[tuple[str, str]]]:
        """(frame, values): each value with its kind: name (by its form), word (a variable name in use
        that is also a word), default or value."""
        plain = self.is_running(words)
        common, names = self.common, self.names
        if not _CODED.search(unit):
            plainly = common if plain else self.known
            if plainly.issuperset(words):
                return " ".join(words), []
            tokens = [(w, "" if w in plainly and w not in DEFAULTS else "default" if w in DEFAULTS else "word" if w in names and not plain else "value") for w in words]
        else:
            tokens = []
            for chunk in unit.split():
                core = chunk.strip(_EDGES)
                if (m := _WRAPPED.fullmatch(chunk)) and m.group(1):
                    tokens.append((_bare(m.group(1)), "name"))
                elif core.lower() in DEFAULTS:
                    tokens.append((core.lower(), "default"))
                elif _IDENTIFIER.fullmatch(core) and (core.lower() not in common or "_" in core):
                    tokens.append((core.lower(), "name"))
                else:
                    for w in words_of(core):
                        fixed = w in common and (plain or w not in names) and not w.isdigit()
                        tokens.append((w, "" if fixed else "word" if w in names and not plain else "value"))
        fixed, values = [], []
        for w, kind in tokens:
            if not kind:
                fixed.append(w)
            elif fixed and fixed[-1] == _SLOT:
                old, old_kind = values[-1]
                values[-1] = (f"{old} {w}", old_kind if old_kind == kind else "value")
            else:
                fixed.append(_SLOT)
                values.append((w, kind))
        return " ".join(fixed), values


def _is_filler(words: list[str]) -> bool:
    if len(_DUMMY.intersection(words)) < 2:
        return False
    latin, keys = sum(w in _LATIN for w in words), sum(w in _KEYS for w in words)
    return (latin >= 5 and latin * 2 >= len(words)) or (keys >= 3 and keys * 10 >= len(words) * 9 and ("asdf" in words or "blah" in words or "xxx" in words))


def _cue_automaton():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for cue in CUES:
        automaton.add_word(cue, cue)
    automaton.make_automaton()
    return automaton


def _tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(kind, word, n, running): texts that hold a word, and of these the ones with it in a line of
    several sentences; texts that hold a variable name in template syntax."""
    for pdf in batches:
        seen, running, names = Counter(), Counter(), Counter()
        for text in pdf["text"]:
            own: set[str] = set()
            inside: set[str] = set()
            for line, sentences in _units(text):
                words = words_of(line)
                own.update(words)
                if len(sentences) > 2:
                    inside.update(words)
            seen.update(own)
            running.update(inside)
            if "{" in text or "%" in text or "@@" in text or "[[" in text:
                names.update({_bare(m) for p in NAMED_SLOTS for m in re.findall(p, text)})
        rows = [("word", w, n, running[w]) for w, n in seen.items()] + [("name", w, n, 0) for w, n in names.items()]
        yield pd.DataFrame([*rows, ("texts", "", len(pdf), 0)], columns=["kind", "word", "n", "running"])


def learn(rows: DataFrame) -> Lexicon:
    """The lexicon of all texts of ``rows``."""
    counted = materialize(rows.select("text").mapInPandas(_tally, "kind string, word string, n bigint, running bigint").groupBy("kind", "word").agg(F.sum("n").alias("n"), F.sum("running").alias("running")), "tally")
    total = counted.where("kind = 'texts'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(COMMON_LEAST, int(total * COMMON_SHARE))
    common = counted.where((F.col("kind") == "word") & (F.col("n") >= least)).select("word", (F.col("running") >= F.col("n") * RUNNING).alias("running")).collect()
    names = counted.where((F.col("kind") == "name") & (F.col("n") >= max(2, total * COMMON_SHARE / 5)) & (F.length("word") >= 3)).select("word").collect()
    return Lexicon({r["word"] for r in common}, {r["word"] for r in common if r["running"]}, {r["word"] for r in names})


EVIDENCE = "kind string, frame bigint, value bigint, doc_id bigint, n bigint, alone bigint, last bigint"


def _look(lexicon) -> callable:
    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        def code(x: str) -> int:
            return xxhash.xxh3_64_intdigest(x) - (1 << 63)

        words, cues = lexicon.value, _cue_automaton()
        loose = re.compile("|".join(f"(?:{p})" for p in AMBIGUOUS_SLOTS))
        for pdf in batches:
            rows: list[tuple] = []
            filled: Counter = Counter()
            for doc, text in zip(pdf["doc_id"].tolist(), pdf["text"], strict=True):
                version = code(text)
                coded = bool(_CODED.search(text))
                if coded and (_PLAIN.search(text) or any(_bare(next(g for g in m.groups() if g)) in words.names for m in loose.finditer(text))):
                    rows.append(("slot", 0, 0, doc, 1, 0, 0))
                units = _units(text)
                cued = next(cues.iter(text.lower()), None) is not None
                bodies = sum(len(s) > 2 for _, s in units)
                filler = message = False
                for k, (line, sentences) in enumerate(units):
                    own = words_of(line)
                    if len(sentences) < 3 and not words.is_running(own) and own:
                        mask = re.sub(r"[0-9]+", "0", " ".join(line.lower().split()))
                        rows.append(("line", code(mask), version, doc, 1, int(not bodies), int(k + 1 == len(units))))
                    # A line of several sentences is looked at by its sentences.
                    for unit in dict.fromkeys((line, *sentences)) if len(sentences) < 3 else dict.fromkeys(sentences):
                        inner = own if unit == line else words_of(unit)
                        filler = filler or _is_filler(inner)
                        if cued and not message:
                            low = " ".join(unit.lower().split())
                            message = next(cues.iter(low), None) is not None and _MESSAGE.search(low) is not None
                        frame, values = words.frame(unit, inner)
                        if not values or frame == _SLOT:
                            if frame and len(sentences) < 2 and _LABEL.fullmatch(line):
                                rows.append(("blank", code(f"{frame} {_SLOT}"), 0, doc, 1, 0, 0))
                            continue
                        spot = code(frame)
                        for i, (value, kind) in enumerate(values):
                            if kind == "value":
                                filled[spot + i, code(value)] += 1
                            else:
                                rows.append((kind, spot + i, code(value), doc, 1, 0, 0))
                if filler:
                    rows.append(("filler", 0, 0, doc, 1, 0, 0))
                if message:
                    rows.append(("message", 0, 0, doc, 1, 0, 0))
            rows += [("value", f, v, None, n, 0, 0) for (f, v), n in filled.items()]
            out = pd.DataFrame(rows, columns=["kind", "frame", "value", "doc_id", "n", "alone", "last"])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    return look


def residue(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_texts: int = MIN_TEXTS) -> DataFrame:
    """(doc_id, reason): documents that hold residue, one row per kind of evidence: template (a slot of
    an aligned template left with a variable name, default or blank), page (a template of a whole page
    that recurs), slot (template syntax), filler, message (known wordings).

    Null, empty and blank texts and rows without an id give nothing; identical texts count as one
    when repetition is counted.  Texts are read whole.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("doc_id is not null and length(trim(text)) > 0")
    lexicon = rows.sparkSession.sparkContext.broadcast(learn(rows))
    seen = materialize(rows.mapInPandas(_look(lexicon), EVIDENCE), "evidence")
    told = seen.where(F.col("kind").isin("slot", "filler", "message")).select("doc_id", F.col("kind").alias("reason"))

    lines = seen.where("kind = 'line'").groupBy("frame", F.col("value").alias("version")).agg(F.max("alone").alias("alone"), F.max("last").alias("last"))
    pages = lines.groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.sum("alone").alias("alone"), F.sum("last").alias("last"))
    pages = pages.where((F.col("n") >= min_texts) & (F.col("last") * 2 >= F.col("n")) & (F.col("alone") * 4 >= F.col("n"))).select("frame")
    page = seen.where("kind = 'line'").join(pages, "frame", "left_semi").select("doc_id", F.lit("page").alias("reason"))

    left = seen.where(F.col("kind").isin("name", "word", "default", "blank"))
    slots = seen.where(~F.col("kind").isin("slot", "filler", "message", "line")).groupBy("frame", "value", (F.col("kind") == "value").alias("filled")).agg(F.sum("n").alias("n"))
    frames = slots.groupBy("frame").agg(
        F.count(F.when(F.col("filled"), 1)).alias("fills"), F.sum(F.when(F.col("filled"), F.col("n")).otherwise(0)).alias("filled"),
        F.count(F.when(~F.col("filled"), 1)).alias("names"), F.sum("n").alias("n"),
    )
    frames = frames.where((F.col("n") >= min_texts) & (F.col("names") > 0))
    # Others fill it: any variable name is left over, a default, a blank or a mere word only where nearly all do.
    open_ = frames.select("frame", (F.col("fills") >= min_texts).alias("some"), ((F.col("fills") >= min_texts) & (F.col("filled") >= F.col("n") * 0.8)).alias("most"), ((F.col("names") >= 2) & (F.col("filled") * 5 <= F.col("n"))).alias("bare"))
    judged = left.join(open_, "frame").where(F.when(F.col("kind") == "name", F.col("some") | F.col("bare")).when(F.col("kind") == "word", F.col("most") | F.col("bare")).otherwise(F.col("most")))
    return told.unionByName(page).unionByName(judged.select("doc_id", F.lit("template").alias("reason"))).distinct()


def exclude(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the documents of ``found``; documents without an id stay."""
    bad = found.select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, F.col(f"`{doc_id}`") == F.col("__bad"), "left_anti")
