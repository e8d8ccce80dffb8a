"""Problem 5: sentence boundaries by cascading tables of break and no-break rules.

A rule is a pair of regular expressions, one for the text before a position and one for the text after it. Every
language has an ordered table; those of the languages that a text's own words speak for (all of its script, where they
tell none) are cascaded before the common one, and the first rule whose two sides match decides the position. Positions
come from the stops (and, in Thai, the blanks) of one line; a line break always ends a unit. What stands in an open
quotation or bracket is decided by the line's pairs, found once, so the work grows with the length of a line. Rules see
a cleaned line (disguised characters undone) whose characters keep their places in the stored text.

Defined results: null, empty and blank texts have no sentence; a label is one unit; texts of any length are cut
whole; repeated rows give repeated rows (``found`` counts a key once); extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import _MIXED, _MIXED_WORD, INVISIBLE, _unmix
from pagewright.sources.tables import table

UP = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĘĚĞĢĪĶĹĻŁŃŅŇŐŒŔŘŚŞŠŤŪŮŰŹŻŽА-ЯЁ"
LOW = "a-zß-öø-ÿāăąćčďđēęěğģīķĺļłńņňőœŕřśşšťūůűźżžа-яё"
CJK = "぀-ヿㇰ-ㇿ㐀-䶿一-鿿\uf900-\ufaff"
OPEN = r"\"'“„«‹(\[¿¡「『（【"
CLOSE = r"”“\"'’»›)\]」』）】"


#: Characters before a position that a rule sees, unless it says from where.
WINDOW = 60


class Rule(NamedTuple):
    breaks: bool
    before: re.Pattern
    after: re.Pattern
    start: Callable[[Line, int], int] | None = None  # where what stands before may begin


class Pair(NamedTuple):
    """A no-break rule: a sign of ``opening`` is the last of ``signs`` before the position, one of ``closing`` the next after it."""

    opening: str
    closing: str
    signs: str

    def holds(self, line: Line, at: int) -> bool:
        places = line.places(self.signs)
        i = bisect_left(places, at)
        return 0 < i < len(places) and line.text[places[i - 1]] in self.opening and line.text[places[i]] in self.closing


class Bracket(NamedTuple):
    """A no-break rule: the position follows a bracket that began within a sentence, and so leaves it open."""

    def holds(self, line: Line, at: int) -> bool:
        places = line.places("()（）")
        i = bisect_left(places, at)
        if i < 2 or places[i - 1] != at - 1 or line.text[at - 1] not in ")）" or line.text[places[i - 2]] not in "(（":
            return False
        before = line.text[line.lead(places[i - 2]) : places[i - 2]].rstrip()
        return bool(before) and before[-1] not in ".!?…。！？"


class Line:
    """A cleaned line with the places of its quotation marks and brackets."""

    def __init__(self, text: str):
        self.text = text
        self.pairs = _HAS_PAIR.search(text) is not None
        self._places: dict[str, list[int]] = {}

    def places(self, signs: str) -> list[int]:
        known = self._places.get(signs)
        if known is None:
            known = self._places[signs] = [i for i, c in enumerate(self.text) if c in signs] if any(c in self.text for c in signs) else []
        return known

    def lead(self, at: int) -> int:
        """The place of the last character before ``at`` that is no blank (0 without one)."""
        while at > 0 and self.text[at - 1].isspace():
            at -= 1
        return max(0, at - 1)


def _no(before: str, after: str = "", start: Callable[[Line, int], int] | None = None) -> Rule:
    return Rule(False, re.compile(f"(?:{before})\\Z"), re.compile(after), start)


def _yes(before: str, after: str = "") -> Rule:
    return Rule(True, re.compile(f"(?:{before})\\Z"), re.compile(after))


def _host_start(line: Line, at: int) -> int:
    """A host's name has 253 characters at most."""
    return max(0, at - 254)


def _quote_start(line: Line, at: int) -> int:
    """The quotation that ends at a position, with the stop and the closing signs before it."""
    places = line.places("“”「」")
    i = bisect_left(places, at)
    if i < 2 or places[i - 1] != at - 1:
        return at
    lead = line.lead(places[i - 2])
    while lead > 0 and line.text[lead] in "”」』）)":
        lead -= 1
    return lead


def _short(words: str) -> str:
    """A pattern of abbreviations, which stand at the start of a word and end with a stop."""
    return rf"(?<!\w)(?:{'|'.join(re.escape(w) for w in words.split())})\."


# an open quotation or bracket that closes later in the line
INSIDE = [
    Pair("“", "”", "“”"),
    Pair("„", "“”", "„“”"),
    Pair("«", "»", "«»"),
    Pair("「", "」", "「」"),
    Pair("『", "』", "『』"),
    Pair("(", ")", "()"),
    Pair("（", "）", "（）"),
    Pair("[", "]", "[]"),
]
BRACKET = [Bracket()]

ENGLISH = [
    _no(_short("Mr Mrs Ms Dr Prof Rev Gen Col Capt Lt Sgt Gov Sen Rep St Mt Ft Messrs vs approx Approx eds cf Cf"), r"\s?\S"),
    _no(_short("fig Fig figs Figs p pp No no nos Nos Art art Eq eq Ver v Vol vol Ch ch chap cap Cap Sec sec hab tel Tel"), r"\s?(?:[\d(]|[IVXLC]+\b)"),
    _no(r"(?<!\w)(?:e\.\s?g|i\.\s?e)\.", ""),
    _no(r"(?<!\w)[eiap]\.", r"\s?[gem]\."),
]
GERMAN = [
    _no(_short("Dr Prof Hr Fr Nr Str Abb Bd S Kap Tel geb gest vgl Vgl ca Ca bzw evtl ggf inkl zzgl sog Mio Mrd St"), r"\s?\S"),
    _no(r"(?<!\w)(?:z\.\s?B|d\.\s?h|u\.\s?a|o\.\s?ä|i\.\s?d\.\s?R|s\.\s?o|s\.\s?u)\.", ""),
    _no(r"(?<!\w)(?:z|d|u|o|i|s)\.", r"\s?(?:B|h|a|ä|d|R|o|u)\."),
    _no(r"(?<![\w.,])\d{1,2}\.", r"\s?(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jahrhundert|Jh|Jahrestag|Geburtstag|Klasse|Stock|Auflage|Kapitel|Woche|Tag|Platz|Mal)\b"),
]
FRENCH = [
    _no(_short("M MM Mme Mlle Dr Pr Me St Ste av Av bd Bd boul env Env cf Cf éd fig Fig"), r"\s?\S"),
    _no(_short("p pp n no tél"), r"\s?[\d(]"),
    _no(r"(?<!\w)p\.", r"\s?ex\."),
    _no(r"(?<!\w)c\.?-à-d\.|(?<!\w)c\.", r"\s?\S"),
]
SPANISH = [
    _no(_short("Sr Sra Srta Sres Dr Dra D Dña Ud Uds Avda Av Avd Gral Lic Ing Prof núm Núm pág págs Pág fig Fig aprox Aprox cf"), r"\s?\S"),
    _no(r"(?<!\w)p\.", r"\s?(?:ej|m)\."),
    _no(r"\bEE\.", r"\s?UU\."),
]
PORTUGUESE = [
    _no(_short("Sr Sra Srs Dr Dra Drs D Prof Profa Av R Eng Exmo núm pág págs Pág fig Fig aprox Aprox cf séc"), r"\s?\S"),
    _no(r"(?<!\w)p\.", r"\s?ex\."),
]
ITALIAN = [
    _no(_short("sig Sig dott Dott prof Prof ing avv Avv p.zza v.le c.so pag pagg Pag fig Fig ca Ca cfr Cfr n nn N"), r"\s?\S"),
    _no(r"(?<!\w)(?:[Ss]ig|[Dd]ott|[Pp]rof)\.", r"(?:ra|na|ssa)\b"),
    _no(r"(?<!\w)p\.", r"(?:zza|le|es)\b|\s?es\."),
]
RUSSIAN = [
    _no(_short("г гг ул д кв стр рис Рис табл гл пр просп пер пл им проф Проф акад доц тов см См ср Ср т руб коп тыс млн млрд св Св о ок др"), r"\s?[\w«„(№]") ,
]
# "и т. д. Когда": the closing parts may end a sentence, so they come before the abbreviations
RUSSIAN_FIRST = [
    _yes(r"(?<!\w)т\.\s?[дп]\.", rf"\s*[{UP}\d{OPEN}]"),
    _no(r"(?<!\w)т\.", r"\s?[депкно]\."),
    _no(r"(?<!\w)т\.\s?[екно]\.", ""),
    _yes(r"\d\s?(?:г|гг|руб|коп)\.", rf"\s+[{UP}]"),
]
LATIN_COMMON = [
    # initials, not after a lower-case letter: J. K., J.-P.
    _no(rf"(?<![\w’'°])[A-ZÀ-ÖØ-ÞА-ЯЁ]\.(?:-[A-ZÀ-Þ]\.)*", rf"[\s\-]*[{UP}]"),
    # names of hosts
    _no(r"(?<![\w@])[\w\-]+(?:\.[\w\-]+)*\.", r"(?:[\w\-]{1,63}\.){0,126}(?:example|test|invalid|localhost|com|org|net|edu|gov|io|info|de|fr|es|it|pt|ru|uk|eu|co)\b", _host_start),
    _no(r"n\.", r"[ºª°]"),
    _no(r"\d\.", r"[ºª°]"),
]
COMMON = [
    _no(r"\d[.,]", r"\d"),
    _no("", r"\s*[,;:，、；：]"),
    _no(rf"[{CLOSE}]", r"\s*[—–-]\s"),
    _no("", rf"\s*(?:[—–-]\s*)?[{OPEN}]?\s?[{LOW}]"),
    _yes(r"", r"\s"),
    _yes(rf"[.!?…][{CLOSE}]*", rf"[{OPEN}]?[{UP}]"),
    _yes(rf"[!?。！？][{CLOSE}]*", r"[^\W\d_]"),
    _yes(rf"[^\W_].?\.[{CLOSE}]*", rf"[{CJK}가-힣฀-๿]"),
    _no(""),
]
IDEOGRAPHIC = [
    _no(r"(?:…|\.\.+)", r"\S"),
    # a full stop of the Latin script ends a sentence only after an ideograph or kana
    _no(rf"[^{CJK}{CLOSE}]\.", ""),
    _no(rf"[{CLOSE}]", r"\s?[、，。；：]"),
]
JAPANESE = [
    _no(r"[。！？!?．][」』”]+", r"(?:と|って|という|など|の|を|が|は|も|に|で|、)"),
    _yes(r"[。！？!?｡][」』”）)】]*", r""),
]
CHINESE = [
    _no(r"(?:^|[。！？!?…][”」』）]*\s*)[“「][^“”「」]*[”」]", r"[^。！？!?，：“「\n]{0,16}?(?:问|说|道|喊|答|写|讲|叫|想|問|說|喊)", _quote_start),
    _yes(r"[。！？!?｡][”’」』）)】]*", r""),
]
KOREAN = [
    _no(r"(?:…|\.\.+)", r"\s?\S"),
    _no(r"[.!?][”’\"'」』)]+", r"(?:라고|하고|라는|이라고|라며|고|는|를|을|이|가|은|의|에|와|과|도)"),
]
THAI = [
    _no(r"", r"\s*[พค]\.ศ\."),
    _no(r"\d\s*", r"\s*\S"),
    _no(r"", r"\s*\d"),
    _no(r"\.", r"[฀-๿]"),
    _yes(r"", r"\s"),
    _yes(r"\s", r""),
    _yes(r"[!?]+", r"[^\s,.;:!?]"),
    _no(""),
]
#: The table of each language, and of all of a script where a text's words tell no language.
TABLES = {
    "en": ENGLISH,
    "de": GERMAN,
    "fr": FRENCH,
    "es": SPANISH,
    "pt": PORTUGUESE,
    "it": ITALIAN,
    "ru": RUSSIAN_FIRST + RUSSIAN,
    "ja": IDEOGRAPHIC + JAPANESE,
    "zh": IDEOGRAPHIC + CHINESE,
    "ko": KOREAN + ENGLISH + LATIN_COMMON,
}
ALPHABETIC = ("en", "de", "fr", "es", "pt", "it", "ru")
#: Words that speak for a language among those written alike.
FUNCTION_WORDS = {
    "en": "the of and to is was are that with for not it by from this",
    "de": "der die das und ist nicht ein eine den dem mit von zu im auf",
    "fr": "le les et est une dans du des pas qui au sur pour ce",
    "es": "el los las y una es por con del para muy como",
    "pt": "o os uma e é do da em não com dos no um",
    "it": "il lo gli è di che per non della un i nel",
}
_SPEAKS_FOR = {w: tuple(x for x, words in FUNCTION_WORDS.items() if w in words.split()) for words in FUNCTION_WORDS.values() for w in words.split()}
#: Words of a text that must speak for one language, and their least part of them for another to count as well.
LEAST_WORDS, LEAST_PART = 4, 0.25


@cache
def cascade_of(script: str, langs: tuple[str, ...] = ()) -> list[list]:
    """The tables of a script, those of its languages in their order, the common one last."""
    if script == "th":
        return [INSIDE, THAI]
    if script != "latin":
        return [INSIDE, BRACKET, TABLES[script], COMMON]
    return [INSIDE, BRACKET, *(TABLES[x] for x in langs or ALPHABETIC), LATIN_COMMON, COMMON]


def languages_of(text: str, declared: str | None = None) -> tuple[str, ...]:
    """The languages of a text in an alphabet: those that its function words speak for, most words first, and the declared one if one
    word does; none if too few words tell."""
    words = Counter(x for w in _FUNCTION.findall(text.lower()) for x in _SPEAKS_FOR.get(w, ()))
    cyrillic = len(_CYRILLIC.findall(text))
    if cyrillic:
        words["ru"] = cyrillic
    if not words:
        return ()
    most = max(words.values())
    if most < LEAST_WORDS:
        return ()
    own = (declared or "")[:2].lower()
    told = [x for x, n in words.items() if n >= most * LEAST_PART or x == own]
    return tuple(sorted(told, key=lambda x: (-words[x], x)))


_FUNCTION = re.compile(r"[^\W\d_]+")
_CYRILLIC = re.compile("[А-яЁё]{2,}")
_STOP = re.compile(r"[.!?…。！？｡।؟．]+(?:\s?[»›](?!\w)|[”’」』）)\]】]|“(?![\w¿¡])|[\"'](?!\w))*")
_BLANK_OR_STOP = re.compile(r"\s+|[!?…。]+[”’»)]*")
_HAS_PAIR = re.compile(r"[“„«「『（(\[]")
_CONCERN = re.compile(f"[{INVISIBLE}  -   　０-９Ａ-Ｚａ-ｚｦ-ﾟ̀-゙゚ͯᄀ-ᇿﬀ-ﬆ⼀-⿕]")


def clean(line: str) -> tuple[str, list[int] | None]:
    """The line with disguised characters undone, and the stored place of each of its characters (None: the same)."""
    if line.isascii():
        return line, None
    places = None
    if _CONCERN.search(line):
        out, places = [], []
        i, n = 0, len(line)
        while i < n:
            c, j = line[i], i + 1
            while j < n and (unicodedata.combining(line[j]) or "ᅠ" <= line[j] <= "ᇿ" and "ᄀ" <= c <= "ᇿ"):
                j += 1
            if c not in INVISIBLE:
                form = " " if c.isspace() else unicodedata.normalize("NFC" if j - i > 1 else "NFKC", line[i:j]) if j - i > 1 or not "！" <= c <= "／" and _CONCERN.match(c) else c
                out.append(form)
                places.extend([i] * len(form))
            i = j
        line = "".join(out)
        places.append(n)
    if _MIXED.search(line):
        line = _MIXED_WORD.sub(_unmix, line)
    return line, places


_KANA, _HAN, _HANGUL, _THAI = re.compile("[぀-ヿｦ-ﾟ]"), re.compile("[㐀-鿿]"), re.compile("[가-힣ᄀ-ᇿ]"), re.compile("[฀-๿]")


def script_of(text: str) -> str:
    """The cascade for a text, by the letters that most of it consists of."""
    if text.isascii() or max(text) < "฀":
        return "latin"
    kana, han, hangul, thai = (len(p.findall(text)) for p in (_KANA, _HAN, _HANGUL, _THAI))
    letters = sum(map(str.isalpha, text)) + thai * 0.3
    best = max((kana + han, "ja" if kana * 20 >= han else "zh"), (hangul, "ko"), (thai, "th"))
    return best[1] if best[0] * 4 >= letters else "latin"


def _decide(line: Line, at: int, cascade: list[list]) -> bool:
    text = line.text
    for rules in cascade:
        if rules is INSIDE or rules is BRACKET:
            if line.pairs and any(r.holds(line, at) for r in rules):
                return False
            continue
        for breaks, left, right, start in rules:
            if right.match(text, at) and left.search(text, max(0, at - WINDOW) if start is None else start(line, at), at):
                return breaks
    return False


def spans(text: str, label: bool = False, declared: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of every sentence of ``text``, in its own code points."""
    out: list[tuple[int, int]] = []
    if label:
        _trimmed(text, 0, len(text), out)
        return out
    script = script_of(text)
    cascade = None
    candidates = _BLANK_OR_STOP if script == "th" else _STOP
    base = 0
    for raw in text.split("\n"):
        shown, places = clean(raw)
        line = None
        start = 0
        for m in candidates.finditer(shown):
            at = m.end()
            if script == "th" and m.group().isspace():
                at = m.start()
                if not at:
                    continue
            if at == len(shown):
                continue
            if line is None:
                line = Line(shown)
                cascade = cascade or cascade_of(script, languages_of(text, declared) if script == "latin" else ())
            if _decide(line, at, cascade):
                end = places[at] if places else at
                _trimmed(text, base + start, base + end, out)
                start = end
        _trimmed(text, base + start, base + len(raw), out)
        base += len(raw) + 1
    return out


_EDGE = re.compile(f"[\\s{INVISIBLE}]")


def _trimmed(text: str, a: int, b: int, out: list[tuple[int, int]]) -> None:
    while a < b and _EDGE.match(text[a]):
        a += 1
    while b > a and _EDGE.match(text[b - 1]):
        b -= 1
    if a < b:
        out.append((a, b))


SCHEMA = "record string, record_id bigint, pos bigint, start_char bigint, end_char bigint, sentence string"


def sentences(texts: DataFrame) -> DataFrame:
    """The sentences of rows (record, record_id, pos, text, label, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for record, id_, pos, text, label, lang in zip(*(c.to_pylist() for c in b.columns)):
                if text:
                    rows.extend((record, id_, pos, a, e, text[a:e]) for a, e in spans(text, bool(label), lang))
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:5]), pa.array(cols[5], pa.string())],
                    ["record", "record_id", "pos", "start_char", "end_char", "sentence"],
                )

    return texts.select("record", "record_id", "pos", "text", "label", "lang").mapInArrow(run, SCHEMA)


def quote_texts(pages: DataFrame) -> DataFrame:
    """The text of each quote block: its spans joined with nothing between."""
    block = pages.select("page_id", F.posexplode("blocks").alias("pos", "block")).where("block.kind = 'quote'")
    text = F.array_join(F.col("block.spans.text"), "")
    return block.select(F.lit("page").alias("record"), F.col("page_id").alias("record_id"), F.col("pos").cast("bigint").alias("pos"), text.alias("text"), F.lit(False).alias("label"), F.lit(None).cast("string").alias("lang"))


def chunk_texts(chunks: DataFrame) -> DataFrame:
    """The text of each chunk, with its declared language if the table has one."""
    lang = F.col("lang") if "lang" in chunks.columns else F.lit(None).cast("string")
    return chunks.select(F.lit("chunk").alias("record"), F.col("chunk_id").alias("record_id"), F.lit(-1).cast("bigint").alias("pos"), "text", "label", lang.alias("lang"))


def found(spark: SparkSession, data_dir: str) -> DataFrame:
    """p5_found: one row per sentence; a redelivered row counts once."""
    pages = table(spark, data_dir, "page_docs", "page_id bigint, blocks array<struct<kind:string,spans:array<struct<text:string>>>>")
    chunks = table(spark, data_dir, "chunks", "chunk_id bigint, lang string, text string, label boolean")
    both = quote_texts(pages).unionByName(chunk_texts(chunks))
    return sentences(both).select("record", "record_id", "pos", "start_char", "end_char").dropDuplicates()
