"""Text predicates and rewrites as column expressions, and the sequential ones as Arrow functions."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: ranges and signs that decide how text is joined, cut and classed
CJK = r"　-ヿ㐀-鿿豈-﫿＀-￯"
KANA = r"぀-ヿｦ-ﾟ"
KANJI = r"㐀-鿿"
JA_MIN_RATIO, KANA_MIN_RATIO = 0.2, 0.05
SENTENCE = r"[^。！？!?\n]{8,}[。！？!?]"
HARD_STOPS, SOFT_STOPS = "。！？!?।؟", ".;:"
MAX_CHARS = 150
INLINE_CHARS, INLINE_WORDS = 24, 4
TAIL_SECTION = r"(?i)^\s*(脚注|注釈|出典|参考文献|参考資料|関連項目|関連記事|関連リンク|外部リンク|references?|notes?|footnotes|see also|external links|further reading)\s*$"
BREADCRUMB_END = r"[>›»/|]\s*$"
URL_ONLY = r"^\s*(https?://|www\.)\S*\s*$"
READABLE = ["ja", "en", "ko", "ar", "bg", "cs", "da", "de", "el", "es", "et", "fi", "fr", "hi", "hr", "hu", "id", "it", "lt", "lv", "nl", "pl", "pt", "ro", "ru", "sk", "sl", "sv", "tr", "uk", "vi"]
NEXT_LINK = r"(?i)^\s*(次へ|次のページ|次の記事|次|다음|next|more|›|»|>>?|→)"
PREVIOUS_LINK = r"(?i)^\s*(前へ|前のページ|前の記事|前|이전|prev(ious)?|‹|«|<<?|←)"
TITLE_SEPARATOR = r"\s+[|｜\-–—:：]\s+|[|｜]"

#: Blanks of Unicode, and the separators of information.
SPACE = r"[\s\x1C-\x1F\x85   -     　]"


def strip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"^{SPACE}+", ""), f"{SPACE}+$", "")


def solid_length(c: Column) -> Column:
    """Characters that are not blank."""
    return F.length(F.regexp_replace(c, SPACE, ""))


def norm(c: Column) -> Column:
    """Letters and digits only, in lower case character by character."""
    return F.translate(F.lower(F.regexp_replace(c, r"[^\p{IsAlphabetic}\p{N}]", "")), "ς", "σ")


def collapse(c: Column) -> Column:
    """Runs of blanks as one; those with a line break as a line break."""
    return F.regexp_replace(F.regexp_replace(c, r"[ \t\r\f 　]*\n[ \t\r\f\n 　]*", "\n"), r"[ \t\r\f ]+", " ")


def without_cjk_gaps(c: Column) -> Column:
    return F.regexp_replace(c, f"(?<=[{CJK}])[ \\n]+(?=[{CJK}])", "")


def has_letter(c: Column) -> Column:
    return c.rlike(r"\p{L}")


def speakable(spans: Column) -> Column:
    """The text of spans without pictures and addresses, stripped."""
    text = F.array_join(F.transform(F.filter(spans, lambda s: ~F.coalesce(s["image"], F.lit(False))), lambda s: F.coalesce(s["text"], F.lit(""))), "")
    return strip(F.regexp_replace(text, r"https?://\S+", ""))


def prose_sentences(c: Column) -> Column:
    """Runs of eight characters or more up to a hard stop. A run begins where the one before ended, so the pattern is
    tried there only: without that, text without hard stops would be scanned again from each of its characters."""
    return F.regexp_extract_all(c, F.lit(r"(?<![^。！？!?\n])([^。！？!?\n]{8,}+[。！？!?])"), 1)


def shingles(c: Column, n: int = 4) -> Column:
    """All runs of ``n`` characters of a normalised text, with repeats; none of a shorter one."""
    size = F.length(c)
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(c, i, n))).otherwise(F.array().cast("array<string>"))


def script_counts(c: Column) -> dict[str, Column]:
    """Characters by script: kana, kanji, hangul, thai, cyrillic, latin."""
    of = lambda r: F.length(F.regexp_replace(c, f"[^{r}]", ""))
    return {"kana": of(KANA), "kanji": of(KANJI), "hangul": of(r"가-힣"), "thai": of(r"฀-๿"), "cyrillic": of(r"Ѐ-ӿ"), "latin": of(r"A-Za-zÀ-ɏ")}


def readable_code(code: Column) -> Column:
    """The language of a locale code if it is one that can be read aloud."""
    primary = F.lower(F.regexp_extract(strip(code), r"^([^\-_]*)", 1))
    return F.when(primary.isin(READABLE), primary)


def language_by_rules(c: Column, declared: Column) -> Column:
    """ja by its script; else the declared language; else en for mostly Latin text; else none."""
    n = script_counts(c)
    ja, letters = n["kana"] + n["kanji"], F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    total = ja + n["latin"]
    is_ja = (total > 0) & (ja >= JA_MIN_RATIO * total) & (n["kana"] >= KANA_MIN_RATIO * ja) & (ja > 0)
    code = readable_code(declared)
    missing = F.coalesce(strip(declared), F.lit("")).isin("", "und")
    return F.when(is_ja, "ja").when(code.isNotNull() & (code != "ja"), code).when(missing & (letters > 0) & (n["latin"] * 2 >= letters), "en")


def script_runs(c: Column) -> Column:
    """The runs of one script: hiragana, katakana, kanji, letters and digits, or signs."""
    return F.regexp_extract_all(c, F.lit(r"([ぁ-ゟ]+|[゠-ヿｦ-ﾟ]+|[㐀-鿿豈-﫿々〆ヶ]+|[\p{IsAlphabetic}\p{N}&&[^ぁ-ヿ㐀-鿿豈-﫿ｦ-ﾟ]]+|[^\s\p{IsAlphabetic}\p{N}]+)"), 1)


def is_short(c: Column) -> Column:
    """Short enough for its translation to stand on the same line."""
    return (F.length(c) <= INLINE_CHARS) & (F.size(F.split(strip(c), r"\s+")) <= INLINE_WORDS) & (F.instr(c, "\n") == 0)


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescape(c: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


#: A blank before a closing sign; a stop closes only before a blank or the end.
SPACE_BEFORE_CLOSE = r"\s+([,.;:!?](?:\s|$)|[)\]）」』、。])"


def tidy_spaces(c: Column) -> Column:
    """No blanks before a closing sign."""
    return F.regexp_replace(c, SPACE_BEFORE_CLOSE, "$1")


def extracted_text(c: Column) -> Column:
    """Text of printed pages: no control characters, no gaps between Japanese and its neighbours."""
    ja = r"、-ヿ㐀-鿿豈-﫿！-￯"
    clean = F.regexp_replace(c, r"[\x00-\x08\x0B-\x1F\x7F]", "")
    clean = F.regexp_replace(clean, f"(?<=[{ja}])[ \\t\\u00A0]+(?=[{ja}A-Za-z0-9])", "")
    return F.regexp_replace(clean, f"(?<=[A-Za-z0-9])[ \\t\\u00A0]+(?=[{ja}])", "")


def base64_plain(c: Column) -> Column:
    return F.regexp_replace(F.base64(F.encode(c, "UTF-8")), r"\s", "")


#: Half-width kana and their marks, and the pairs of a kana and its voice mark that have a form of one character.
HALF_WIDTH = [chr(i) for i in range(0xFF61, 0xFF9E)]
VOICE_MARKS = "ﾞﾟ"
VOICED = {k + m: v for m in VOICE_MARKS for k in HALF_WIDTH if len(v := unicodedata.normalize("NFKC", k + m)) == 1 and v not in "ヷヺ"}


def full_width(c: Column) -> Column:
    """ASCII and half-width kana as full-width forms, kana with their voice marks; other control characters go."""
    signs = "".join(chr(i) for i in range(0x20, 0x7F)) + "".join(HALF_WIDTH) + VOICE_MARKS
    wide = "　" + "".join(chr(i + 0xFEE0) for i in range(0x21, 0x7F)) + "".join(unicodedata.normalize("NFKC", k) for k in HALF_WIDTH)
    paired = c
    for pair, form in VOICED.items():
        paired = F.replace(paired, F.lit(pair), F.lit(form))
    voiced = F.when(c.rlike(f"[{VOICE_MARKS}]"), paired).otherwise(c)
    return F.translate(F.regexp_replace(voiced, r"[\x00-\x1F\x7F]", ""), signs, wide)


def mora_count(c: Column) -> Column:
    """Moras of kana: every kana but the small ones that join the one before."""
    return F.length(F.regexp_replace(c, r"[^ぁ-ゖァ-ヺー]|[ゃゅょぁぃぅぇぉャュョァィゥェォ]", ""))


# fixed values: a fitted model of how long a voice needs, in seconds
BASE_SECONDS, MORA_SECONDS, PAUSE_SECONDS, FLOOR = 0.27, 0.154, 0.3, 0.95
PAUSES = "、。，．！？!?,.;:；：・…"


def pause_count(c: Column) -> Column:
    """Pauses within a text: runs of their signs with something on both sides."""
    inner = F.regexp_replace(F.regexp_replace(c, f"^[{PAUSES}\\s]+", ""), f"[{PAUSES}\\s]+$", "")
    return F.size(F.regexp_extract_all(inner, F.lit(f"([{PAUSES}]+)"), 1))


def least_seconds(moras: Column, pauses: Column) -> Column:
    """The least time that a Japanese sentence of so many moras and pauses is given."""
    return FLOOR * (BASE_SECONDS + MORA_SECONDS * moras) + PAUSE_SECONDS * pauses


def csv_field(line: Column, n: int) -> Column:
    """A field of a line of comma-separated values, which quotes may hold together; null beyond the last."""
    names = [f"f{i}" for i in range(n + 1)]
    return F.from_csv(line, F.lit(", ".join(f"{x} string" for x in names)), {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1", "emptyValue": "", "nullValue": "\0"})[names[n]]


def pronunciation(features: Column) -> Column:
    """The ninth field of a word's features; null if it is empty or a star."""
    p = csv_field(features, 8)
    return F.when((p != "") & (p != "*"), p)


def alpha(n: Column) -> Column:
    """1, 2, ... as a, b, ..., z, aa, ..."""
    return F.when(n <= 26, F.chr(n + 96)).otherwise(F.concat(F.chr(((n - 1) / 26).cast("int") + 96), F.chr((n - 1) % 26 + 97)))


def roman(n: Column) -> Column:
    """1 to 99 in small Roman numerals."""
    tens = F.element_at(F.array(*map(F.lit, ["", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"])), (n / 10).cast("int") + 1)
    ones = F.element_at(F.array(*map(F.lit, ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"])), n % 10 + 1)
    return F.concat(tens, ones)


# ---- sequential functions -------------------------------------------------------------------------------------


def cut_long(text: str, most: int = MAX_CHARS) -> list[str]:
    """Pieces of at most ``most`` characters, cut after the last pause, else after the last blank, else hard; a sign at
    the very beginning is no place to cut. No character is lost."""
    out = []
    while len(text) > most:
        at = max(text.rfind("、", 0, most), text.rfind(", ", 0, most))
        if at <= 0:
            at = text.rfind(" ", 0, most)
        at = at + 1 if at > 0 else most
        out.append(text[:at])
        text = text[at:]
    return [*out, text] if text else out


_OPENING, _CLOSING = "(（", ")）"


def split_sentences(text: str, most: int = MAX_CHARS) -> list[str]:
    """Pieces for reading aloud: after a hard stop, after a soft stop and a blank outside brackets, and at line ends."""
    out: list[str] = []
    for line in text.split("\n"):
        depth, start = 0, 0
        for i, c in enumerate(line):
            if c in _OPENING:
                depth += 1
            elif c in _CLOSING:
                depth = max(0, depth - 1)
            soft = c in SOFT_STOPS and not depth and i + 1 < len(line) and line[i + 1].isspace()
            if c in HARD_STOPS or soft:
                out.append(line[start : i + 1])
                start = i + 1
        out.append(line[start:])
    return [p for s in out if s.strip() for p in cut_long(s.strip(), most)]


@F.arrow_udf(T.ArrayType(T.StringType()))
def reading_pieces(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else split_sentences(t) for t in text.to_pylist()], pa.list_(pa.string()))


_EMOJI = re.compile("[\U0001f000-\U0001faff☀-➿‍️⬀-⯿]")
# fixed values: signs that speech does without
_SPOKEN = str.maketrans({"–": "-", "—": "-", "‑": "-", "_": " ", "“": '"', "”": '"', "‘": "'", "’": "'", "´": "'", "`": "'", "[": " ", "]": " ", "|": " ", "/": " ", "#": " ", "→": " ", "←": " ", "♥": "", "☆": "", "♡": "", "©": "", "\\": ""})


def speech_text(text: str, lang: str) -> str:
    """The text a voice model reads: composed signs taken apart, emoji dropped, signs and spaces tidied, a final stop."""
    text = _EMOJI.sub("", unicodedata.normalize("NFKD", text)).translate(_SPOKEN)
    text = text.replace("e.g.,", "for example, ").replace("i.e.,", "that is, ")
    text = re.sub(r"\s+([,.!?;:'])", r"\1", text)
    text = re.sub(r"\s+", " ", text).strip()
    if not re.search(r"[.!?;:,'\")\]}…。」』】〉》›»]$", text):
        text += "."
    return f"<{lang}>{text}</{lang}>"


@F.arrow_udf(T.StringType())
def speech_input(text: pa.Array, lang: pa.Array) -> pa.Array:
    return pa.array([None if t is None or la is None else speech_text(t, la) for t, la in zip(text.to_pylist(), lang.to_pylist())], pa.string())


_SHIFT_JIS = ("cp932", "ms_kanji", "mskanji", "shift_jis", "shift-jis", "sjis", "x-sjis", "windows-31j")
_USUAL = re.compile(r"[\x20-\x7E\t\r\n぀-ゟァ-ヺー、。「」・一-鿿　！？]")
_UNUSUAL = re.compile("[\x80-\x9F｡-ﾟ\uE000-\uF8FF\uFFFD]")


def _decodes(content: bytes, name: str) -> str | None:
    name = "cp932" if name.lower() in _SHIFT_JIS else name
    try:
        return content.decode(name)
    except (LookupError, UnicodeDecodeError):
        return None


def decode_bytes(content: bytes, declared: str | None) -> str:
    """Text of bytes: by a mark at its beginning or the escapes of a Japanese charset, the declared charset, the one named in the first 4,096 bytes, UTF-8;
    else by that of the Japanese charsets that can read it in which it looks most like text; else Latin-1."""
    if content.startswith(b"\xef\xbb\xbf"):
        return content[3:].decode("utf-8", "replace")
    if re.search(rb"\x1b[$(]", content) and (text := _decodes(content, "iso2022_jp")) is not None:
        return text
    m = re.search(rb"(?:charset|encoding)\s*=\s*[\"']?\s*([\w\-]+)", content[:4096], re.I)
    for name in (declared, m.group(1).decode("ascii") if m else None, "utf-8"):
        text = _decodes(content, name) if name else None
        if text is not None:
            return text
    read = [t for n in ("euc_jp", "cp932") if (t := _decodes(content, n)) is not None]
    likely = max(read, key=lambda t: len(_USUAL.findall(t)) - 3 * len(_UNUSUAL.findall(t)), default=None)
    if likely is not None and len(_UNUSUAL.findall(likely)) * 2 <= len(likely):
        return likely
    return content.decode("latin-1")


@F.arrow_udf(T.StringType())
def decoded(content: pa.Array, declared: pa.Array) -> pa.Array:
    return pa.array([None if c is None else decode_bytes(c, d) for c, d in zip(content.to_pylist(), declared.to_pylist())], pa.string())
