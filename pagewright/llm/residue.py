"""Problem 10: template residue, filler, error pages and demands to enable scripts.

Every document is read for places of a template outside code, for filler (stock Latin, one sentence over and over) and
for messages. A message counts if the document is little else: menu words, rules and legal lines are set aside, and
what remains must be short. Its terms are compared with those of the address and the title (the heading, else the first
of several lines): what all three name beside the message is an article about it; a low-information response that
neither names, that other addresses and hosts serve as well, and that speaks as messages do, is one even in words
that no detector knows. A title that itself speaks as messages do is part of the response; one
that is nothing but a message, unnamed by the address, makes the response one.

Defined results: null, empty and blank texts are never found; marks of tokenizers are ordinary text; a syntax shown in
code is no residue; texts of any length are read whole; a document counts once; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from re import _parser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import fold, host_of, line_key
from pagewright.llm.repeats import hash64
from pagewright.plans.stages import join_small, materialize
from pagewright.sources.tables import table

#: A document with more characters than this beside menu words is more than a message.
MESSAGE_CHARS = 320
#: A low-information response is duplicated from so many addresses on, of so many hosts.
ADDRESSES, HOSTS = 3, 2
#: A document is filler if this part of its words or sentences is.
FILLER = 0.6
#: A phrase that filler repeats has no more words than this.
DISTINCT = 12

# ---- places of a template ---------------------------------------------------------------------------------------

_CODE = re.compile(r"```.*?(?:```|\Z)|``[^\n]*?``|`[^`\n]*`", re.S)
_PLACE = re.compile(
    r"""\{\{[^{}\n]{1,80}\}\}|\{%[^%\n]{1,80}%\}|\$\{[^{}\n]{1,60}\}|<%[^%\n]{1,80}%>|%\(\w{1,40}\)[sdf]|%%\w{2,40}%%|(?<!\w)__[A-Z][A-Z_]{2,40}__(?!\w)"""
    r"""|\[\[[\w.\- ]{1,40}\]\]|@@\w{2,40}@@|(?<!\w)\$[A-Z][A-Z_]{2,40}\$(?!\w)|\#\{[\w.]{1,40}\}|(?<![\w}\\^_])\{\d{1,2}\}(?!\w)|(?<![\w%])%[sd](?![\w%])"""
    r"""|\[object\ Object\]|<[A-Z]{2,}(?:\ [A-Z]{2,}){1,6}>|[○〇]{2}(?:様|さん|氏|殿)?"""
    r"""|【[^】\n]{0,30}(?:ここに|入れる|入力|記入|填写|填入|输入|此处|在此)[^】\n]{0,30}】"""
    r"""|\[(?:your|insert|enter|add|type)\ [^\]\n]{1,40}\](?!\()|\[[^\]\n]{1,40}\ (?:einfügen|eingeben|hier|ici|aquí|aqui|qui|here|입력|삽입)\](?!\()"""
    r"""|\[(?:inserir|insertar|inserire|insérer|saisir|escriba|ingrese|digite|вставьте|введите|укажите)\ [^\]\n]{1,40}\](?!\()|\[(?:ใส่|กรอก|พิมพ์)[^\]\n]{1,40}\](?!\()""",
    re.I | re.X,
)
_CASED = re.compile(r"^(?:__|<[A-Za-z]|\$[A-Za-z])")
#: How each of them begins.
_BEGIN = re.compile(r"\{[{%\d]|\$[{A-Z]|<[%A-Z]|%[(%sd]|__[A-Z]|\[|@@|\#\{|【|[○〇]{2}")


def places(text: str) -> list[str]:
    """The places of a template left unfilled, outside code."""
    if not _BEGIN.search(text):
        return []
    bare = _CODE.sub(" ", text) if "`" in text else text
    found_ = (_PLACE.match(bare, b.start()) for b in _BEGIN.finditer(bare))
    return [m.group() for m in found_ if m and (not _CASED.match(m.group()) or m.group().upper() == m.group())]


# ---- filler -----------------------------------------------------------------------------------------------------

# fixed values: the words of the stock Latin paragraph, from "lorem" to "laborum"
_LATIN = frozenset(
    w[:4]
    for w in """lorem ipsum dolor amet consectetur adipiscing elit eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam
    quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum
    fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum""".split()
)
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?。！？\n]+[.!?。！？]*")
_STOCK = re.compile(
    r"""(?i)placeholder\ text|sample\ (?:paragraph|text|sentence)|your\ text\ goes\ here|text\ goes\ here|content\ coming\ soon|heading\ here|type\ something\ about|dummy\ text
    |blindtext|platzhalter(?:text)?|beispiel(?:text|satz)|mustertext|texte?\ (?:de\ remplissage|d['’]exemple|factice)|texto\ de\ (?:relleno|ejemplo|exemplo|preenchimento|marcador)
    |testo\ (?:segnaposto|di\ esempio|di\ riempimento)|текст[- ]заполнитель|пример\ текста|текст\ для\ примера|здесь\ будет\ текст|ダミーテキスト|サンプル(?:テキスト|文)|ここに(?:本文|文章|テキスト|内容)
    |示例(?:文字|文本|句子)|占位(?:文字|文本)|(?:예시|샘플)\ ?(?:문장|텍스트)|여기에\ (?:내용|글|텍스트)|ข้อความตัวอย่าง|ตัวอย่างข้อความ|ใส่ข้อความ|votre\ texte\ ici|aquí\ va\ su\ texto|(?:o\ )?seu\ texto\ aqui|il\ tuo\ testo(?:\ va)?\ qui|ваш\ текст\ (?:здесь|тут)|在此(?:输入|填写|处)|(?:hier\ )?ihr\ text|texte\ provisoire|texto\ provisional|texto\ provisório|testo\ provvisorio""",
    re.X,
)


def _needs(parsed) -> frozenset[str]:
    """Texts of which every match of a parsed pattern holds one, in lower case; none if there is no such set."""
    sets, run = [], ""
    for op, arg in [*parsed, (None, None)]:
        if op is _parser.LITERAL:
            run += chr(arg).lower()
            continue
        if run:
            sets.append(frozenset([run]))
        run = ""
        if op is _parser.BRANCH:
            each = [_needs(x) for x in arg[1]]
            sets.append(frozenset().union(*each) if all(each) else frozenset())
        elif op is _parser.SUBPATTERN:
            sets.append(_needs(arg[3]))
        elif op is _parser.MAX_REPEAT and arg[0]:
            sets.append(_needs(arg[2]))
    return max(filter(None, sets), key=lambda x: min(map(len, x)), default=frozenset())


_STOCK_NEEDS = sorted(_needs(_parser.parse(_STOCK.pattern, re.X)))
#: Characters whose lower case is not the one that a pattern without case takes them for.
_ODD_CASE = re.compile("[\u017f\u212a\u0130\u0131\u1c80-\u1c88]")


def _may_match(text: str, low: str, needs: list[str]) -> bool:
    """Whether a pattern of which every match holds one of ``needs`` may match a text whose lower case is ``low``."""
    return any(x in low for x in needs) or not text.isascii() and _ODD_CASE.search(text) is not None


def _has_stock(text: str, low: str) -> bool:
    """Whether a stock phrase stands in a text."""
    return _may_match(text, low, _STOCK_NEEDS) and _STOCK.search(text) is not None


def _periodic(tokens: list[str]) -> bool:
    """Whether a text is one phrase of words over and over: three times, or twice if it is stock."""
    n = len(tokens)
    for period in range(1, min(n // 2, DISTINCT) + 1):
        if n % period and n < 3 * period or tokens[period:] != tokens[: n - period]:
            continue
        phrase = " ".join(tokens[:period])
        if sum(map(str.isalpha, phrase)) < 4 or "<" in phrase:
            return False
        return n >= 3 * period or bool(_STOCK.search(phrase))
    return False


def filler(text: str) -> bool:
    """Whether the text below its headings is stock Latin or one sentence over and over."""
    body = [x for x in text.split("\n") if x and not x.isspace() and not x.lstrip().startswith("#")]
    if not body:
        return False
    joined = " ".join(body)
    low = joined.lower()
    tokens = low.split()
    distinct = set(tokens)
    if len(distinct) <= DISTINCT and _periodic(tokens):
        return True
    if len({w[:4] for t in distinct for w in ((t,) if t.isalpha() else _WORD.findall(t))} & _LATIN) >= 4:
        words = _WORD.findall(low)
        stock = [w for w in words if w[:4] in _LATIN]
        if len(words) >= 5 and len(stock) >= FILLER * len(words) and len(set(stock)) >= 4:
            return True
    said = (t for x in body for m in _SENTENCE.finditer(x) if len(t := m.group().strip()) > 3)
    if not _has_stock(joined, low):  # then more than three different sentences are no filler
        first: list[str] = []
        for t in said:
            first.append(t)
            if len(first) > 3 and len(set(first)) > 3:
                return False
        said = first
    said = list(said)
    times = Counter(said)
    if not said:
        return False
    stock_chars = sum(len(s) * n for s, n in times.items() if _STOCK.search(s))
    total = sum(len(s) * n for s, n in times.items())
    if stock_chars >= FILLER * total:
        return True
    if len(times) == 1 and len(said) > 1 and any(map(str.isalpha, said[0])) and "<" not in said[0]:
        return True
    # sentences that recur, a few of them in turn
    again = sum(n for s, n in times.items() if n >= 3)
    return len(said) >= 3 and len(times) <= 3 and again >= 0.8 * len(said)


# ---- messages ---------------------------------------------------------------------------------------------------

_ERROR = r"""
    ^\W*(?:http\W*)?[45]\d\d\W+(?:bad\ request|unauthori[sz]ed|payment\ required|forbidden|not\ found|method\ not\ allowed|request\ time-?out|gone|too\ many\ requests|internal\ server\ error|not\ implemented|bad\ gateway|service\ (?:temporarily\ )?unavailable|gateway\ time-?out)
    |^\W*(?:error|erreur|fehler|errore|erro|ошибка|エラー|错误|오류|ข้อผิดพลาด)\W*[45]\d\d\W*[:：.–-]
    |(?:page|article|seite|artikel|página|pagina|article|artigo|articolo|artículo)\b[^.\n]{0,40}\b(?:not\ found|could\ not\ be\ found|cannot\ be\ found|does\ not\ exist|no\ longer\ available|has\ been\ removed|wurde\ nicht\ gefunden|nicht\ gefunden|existiert\ nicht|est\ introuvable|introuvable|n['’]existe\ pas|no\ existe|não\ (?:foi\ )?encontrada|non\ trovata|non\ esiste|não\ existe)
    |can['’]?t\ find\ (?:that|the|this)\ page|page\ you\ (?:are\ looking|were\ looking|requested|have\ requested)|(?:it|page)\ may\ have\ (?:been\ )?moved|no\ (?:encontramos|se\ (?:ha\ )?encontr\w+)\ la\ página|страница\ не\ найдена|такой\ страницы\ (?:нет|не)|ページ(?:は|が)見つかり|页面不存在|您访问的页面|找不到(?:该|此|您)?\w{0,6}页面|페이지를\ 찾을\ 수\ 없|ไม่พบหน้า
    |internal\ server\ error|error\ establishing|traceback\ \(most\ recent|^\W*file\ "[^"]+",\ line\ \d+|^\w*(?:error|exception):\ |fatal\ error|uncaught\ exception|stack\ trace|something\ went\ wrong|an\ error\ (?:has\ )?occurred|we\ are\ down\ for|down\ for\ maintenance|temporarily\ unavailable|service\ unavailable|bad\ gateway|gateway\ time-?out
    |too\ many\ requests|retry\ after\ \d|slow\ down\ and\ retry|try\ again\ (?:later|in\ \d)
    |service\ momentanément|momentanément\ indisponible|dienst\ ist\ zurzeit|zurzeit\ nicht\ (?:verfügbar|erreichbar)|später\ erneut\ versuchen|servicio\ no\ (?:está\ )?disponible|servi[cç]o\ (?:temporariamente\ )?indispon[íi]vel|servizio\ (?:momentaneamente\ |temporaneamente\ )?non\ disponibile|сервис\ (?:временно\ )?недоступен|временно\ недоступ|ведутся\ технические\ работы|попробуйте\ (?:ещё\ раз\ )?позже
    |ただいま\w{0,12}(?:混み合って|メンテナンス|アクセスが集中)|サーバー?(?:が|は)\w{0,12}(?:混雑|応答|エラー)|しばらくしてから|メンテナンス中|服务器(?:繁忙|错误|内部错误)|请稍后再试|系统(?:维护|繁忙)|서비스를\ 이용할\ 수\ 없|잠시\ 후\ 다시|점검\ 중|ระบบ(?:ขัดข้อง|ไม่พร้อม)|ลองใหม่(?:อีกครั้ง|ภายหลัง)|ปิดปรับปรุง"""
_ACCESS = r"""
    ^\W*(?:access\ denied|permission\ denied|forbidden)|do(?:n['’]t|\ not)\ have\ permission|are\ not\ (?:authori[sz]ed|allowed)\ to\ (?:access|view)|verify\ (?:that\ )?you\ are\ (?:a\ )?human|are\ you\ a\ robot|not\ a\ robot|complete\ the\ captcha|unusual\ traffic|session\ has\ expired|please\ (?:sign|log)\ in|(?:sign|log)\ in\ (?:again|to\ continue)|subscribers\ only
    |acceso\ (?:denegado|restringido)|acesso\ negado|accesso\ negato|accès\ (?:refusé|interdit)|zugriff\ (?:verweigert|abgelehnt)|доступ\ (?:запрещ[её]н|закрыт|ограничен)|アクセス(?:が|は)?(?:拒否|禁止|できません)|访问(?:被拒绝|受限)|禁止访问|拒绝访问|접근(?:이|\ 권한)|액세스\ 거부|ปฏิเสธการเข้าถึง|ไม่มีสิทธิ์
    |sitzung\ ist\ abgelaufen|session\ a\ expiré|sesión\ ha\ (?:caducado|expirado)|sessão\ expirou|sessione\ (?:è\ )?scaduta|сеанс\ (?:истёк|завершён)|セッションの有効期限|会话已过期|세션이\ 만료|เซสชันหมดอายุ"""
_SCRIPT = r"""
    (?:please\ )?(?:enable|activate|turn\ on|allow)\ (?:java\ ?script|scripts|cookies)|(?:requires?|needs?)\ java\ ?script|java\ ?script\ is\ (?:disabled|required|off|turned\ off)|does\ not\ support\ (?:java\ ?)?scripts?|enable\ scripts\ to\ run|nothing\ happens,\ allow|without\ java\ ?script\ enabled
    |(?:aktivieren\ sie|schalten\ sie)\b[^.\n]{0,30}java\ ?script|java\ ?script\ (?:ist\ deaktiviert|aktivieren|einschalten)|(?:activer|activez|autoriser)\b[^.\n]{0,20}java\ ?script|java\ ?script\ (?:est\ désactivé|doit\ être)|(?:activ[ea]|habilit[ea]|actívalo|active)\b[^.\n]{0,15}java\ ?script|(?:ative|habilite|ligue)\b[^.\n]{0,10}java\ ?script|(?:attiva|abilita|attivare|abilitare)\b[^.\n]{0,10}java\ ?script|включите\ java\ ?script|необходим[оа]?\ (?:включить\ )?java\ ?script
    |java\ ?script\ ?を(?:有効|オン)|(?:启用|开启|打开)\ ?java\ ?script|자바\ ?스크립트를\ (?:켜|활성화|사용)|java\ ?script를\ (?:켜|활성화)|(?:เปิดใช้(?:งาน)?|เปิด)\ ?java\ ?script"""
_MESSAGE = re.compile(f"(?:{_ERROR}|{_ACCESS}|{_SCRIPT})", re.I | re.X | re.M)
_MESSAGE_NEEDS = sorted(_needs(_parser.parse(_MESSAGE.pattern, re.X)))
#: Words of messages in a manner of address, for responses that no detector knows.
_ADDRESS = re.compile(
    r"""(?i)\b(?:please|oops|sorry|your\ (?:browser|request|session|connection)|bitte|veuillez|désolé|s['’]il\ vous\ pla[iî]t|por\ favor|lo\ sentimos|desculpe|spiacenti|per\ favore|пожалуйста|извините)\b
    |ください|申し訳|请|抱歉|주세요|죄송|โปรด|กรุณา|ขออภัย|\b[45]\d\d\b""",
    re.X,
)
_RULE = re.compile(r"^[\W_]*$")
_BAR = re.compile(r"\s*[|·•›»]\s*")
_LEGAL = re.compile(r"^\W*(?:©|\(c\)\s|copyright\b)", re.I)
_END = re.compile(r"[.!?。！？…]\W*$")
#: Phrases that real sentences use as well: they make a message only with little else to say, see ``ABOUT``.
_COMMON = re.compile(
    r"""(?:something\ went\ wrong|an\ error\ (?:has\ )?occurred|please\ (?:sign|log)\ in|(?:sign|log)\ in\ (?:again|to\ continue)|try\ again\ (?:later|in\ \d)|temporarily\ unavailable
    |no\ longer\ available|has\ been\ removed|does\ not\ exist|subscribers\ only|down\ for\ maintenance|do(?:n['’]t|\ not)\ have\ permission)""",
    re.I | re.X,
)
#: A sentence with more terms than this beside such a phrase is about something.
ABOUT = 4
_CLAIM = re.compile(r"\w/\d+(?:\.\d+)*$")


def _remaining(text: str) -> tuple[str, list[str]]:
    """The title, a heading or else the first of several lines ('' without one), and the other lines, beside menu
    words, rules and legal lines; no line if they are too long for a message."""
    out, headed, size = [], None, 0
    for line in text.split("\n"):
        line = line.strip()
        if not line or _RULE.match(line) or _LEGAL.match(line):
            continue
        parts = [x for x in _BAR.split(line) if x.strip()] if _BAR.search(line) else []
        if len(parts) >= 3 and all(len(x.split()) <= 4 and len(x) < 30 for x in parts):
            continue
        if line.startswith("#"):
            line = line.lstrip("#").strip()
            headed = len(out) if headed is None else headed
        out.append(line)
        if len(line) > 30 or len(line.split()) > 3 or _END.search(line):  # else a menu word
            size += len(line)
        if size > MESSAGE_CHARS:
            return "", []
    if headed is None:
        headed = 0 if len(out) > 1 else None
    return ("", out) if headed is None else (out[headed], out[:headed] + out[headed + 1 :])


def _told(line: str) -> bool:
    """Whether a detector of messages matches a line, and not only by a phrase of a sentence about something."""
    if not _may_match(line, line.lower(), _MESSAGE_NEEDS) or _MESSAGE.search(line) is None:
        return False
    if not _COMMON.search(line):
        return True
    if _MESSAGE.search(_COMMON.sub(" ", line)):
        return True
    said = [x for m in _SENTENCE.finditer(line) if _COMMON.search(x := m.group())]
    return any(len(terms(_COMMON.sub(" ", x))) <= ABOUT for x in said)


def message(lines: list[str]) -> bool:
    """Whether the remaining lines are a message, with no more than a few menu words besides."""
    told = [x for x in lines if _told(x)]
    if not told:
        return False
    rest = [x for x in lines if x not in told and not _CLAIM.search(x)]
    # a menu word is short and no sentence
    real = sum(len(x) for x in rest if len(x) > 30 or len(x.split()) > 3 or _END.search(x))
    told_chars = sum(map(len, told))
    return real <= told_chars


_TERM = re.compile(r"[^\W\d_]{3,}")


def terms(text: str) -> set[str]:
    return set(_TERM.findall(text.lower()))


def _slug(url: str | None) -> tuple[set[str], int]:
    """The terms of an address's last part, and the hash of the address without case, query and fragment."""
    if not url:
        return set(), 0
    path = re.split(r"[?#]", url.split("://", 1)[-1], maxsplit=1)[0].rstrip("/")
    return terms(path.rsplit("/", 1)[-1].rsplit(".htm", 1)[0]), hash64(path.lower())


def _apart(lines: list[str]) -> set[str]:
    """The terms of lines beside what makes them a message."""
    return {t for x in lines for t in terms(_MESSAGE.sub(" ", x) if _told(x) else x)}


def compared(slug: set[str], title: str, body: list[str]) -> tuple[bool, bool]:
    """Whether address, title and body name the same thing beside a message; whether neither address nor title names the body."""
    named = bool(title and slug and slug & _apart([title]) & _apart(body))
    own = terms(" ".join(body))
    if title and not _speaks(title):
        return named, not slug & own and not {t for t in terms(title) & own if len(t) > 3}
    return named, not slug & (own | terms(title))


def titled(slug: set[str], title: str) -> bool:
    """Whether a title is nothing but a message, and the address doesn't name it: what follows is then part of it."""
    return bool(title) and _told(title) and not _apart([title]) and not slug & terms(title)


def _speaks(text: str) -> bool:
    """Whether a text is in the manner of a message."""
    return bool(_ADDRESS.search(text)) or _told(text)


FIELDS = "doc_id bigint, place boolean, filler boolean, message boolean, low boolean, mismatch boolean, speaks boolean, body bigint, host bigint, address bigint"


def signs(documents: DataFrame) -> DataFrame:
    """FIELDS of every document with a text: what its detectors say, and the hashes that evidence is gathered by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, raw, url in zip(*(c.to_pylist() for c in b.columns)):
                if not raw or raw.isspace():
                    continue
                text = fold(raw)
                place = bool(places(text))
                title, body_lines = _remaining(text)
                low = bool(body_lines or title)
                said = speaks = mismatch = False
                body = host = address = 0
                if low:
                    slug, address = _slug(url)
                    named, mismatch = compared(slug, title, body_lines)
                    said = not named and (titled(slug, title) or message([title, *body_lines] if title else body_lines))
                    # a title of the page's own is no part of what is said at many addresses
                    joined = " ".join(body_lines if body_lines and title and not _speaks(title) else [title, *body_lines])
                    speaks = bool(_ADDRESS.search(joined))
                    key = line_key(joined)
                    body = hash64(key) if key else 0
                    name = host_of(url)
                    host = hash64(name) if name else 0
                rows.append((doc_id, place, filler(text), said, low, mismatch, speaks, body, host, address))
            if rows:
                c = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), *(pa.array(x, pa.bool_()) for x in c[1:7]), *(pa.array(x, pa.int64()) for x in c[7:])], [f.split()[0] for f in FIELDS.split(", ")])

    return documents.select(F.col("doc_id").cast("bigint"), "text", "url").mapInArrow(run, FIELDS)


def judge(documents: DataFrame) -> DataFrame:
    """(doc_id, place, filler, message, echoed): the documents that are not, or not wholly, real content, and why."""
    all_signs = materialize(signs(documents), "signs")
    low = all_signs.where("low AND body <> 0")
    # distinct addresses first, so that no group of one body is gathered in a task
    places_ = low.select("body", "host", "address").distinct()
    evidence = places_.groupBy("body", "host").agg(F.count("*").alias("n")).groupBy("body").agg(F.sum("n").alias("addresses"), F.count("*").alias("hosts"))
    evidence = evidence.where((F.col("addresses") >= ADDRESSES) & (F.col("hosts") >= HOSTS)).select("body", F.lit(True).alias("echo"))
    out = join_small(all_signs, evidence, "body", "left")
    echoed = F.coalesce(F.col("low") & F.col("mismatch") & F.col("speaks") & F.col("echo"), F.lit(False))
    out = out.select("doc_id", "place", "filler", "message", echoed.alias("echoed"))
    return out.where("place OR filler OR message OR echoed").dropDuplicates(["doc_id"])


def reasons(spark: SparkSession, data_dir: str) -> DataFrame:
    """p10_reasons: the documents to leave out, with what they are."""
    return judge(table(spark, data_dir, "documents", "doc_id bigint, text string, url string"))


def found(spark: SparkSession, data_dir: str) -> DataFrame:
    """p10_found."""
    return reasons(spark, data_dir).select("doc_id")
