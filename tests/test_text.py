import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.functions import text as X
from pagewright.operators import blocks as B
from pagewright.operators import markdown as M
from pagewright.operators import printed as R
from pagewright.sources import store as J


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_reading_pieces():
    assert X.split_sentences("雨が降った。傘はない！帰る") == ["雨が降った。", "傘はない！", "帰る"]
    assert X.split_sentences("It rained. Why? I left\n\nNo stop") == ["It rained.", "Why?", "I left", "No stop"]
    assert X.split_sentences("2.5 litres") == ["2.5 litres"]
    assert X.split_sentences("look (p. 7) there. Done") == ["look (p. 7) there.", "Done"]


@given(st.text(alphabet="ab ,、.", max_size=400), st.integers(5, 60))
@settings(max_examples=200, deadline=None)
def test_long_pieces_lose_nothing(text, most):
    pieces = X.cut_long(text, most)
    assert "".join(pieces) == text
    assert all(0 < len(p) <= most for p in pieces)
    for p in pieces[:-1]:
        assert len(p) == most or p.endswith(("、", ",", " "))


def test_a_pause_at_the_beginning_is_no_place_to_cut():
    assert X.cut_long("、" + "x" * 9 + " yy", 10) == ["、" + "x" * 9, " yy"]


def test_speech_text():
    assert X.speech_text("あめ", "ja") == "<ja>あめ.</ja>"
    assert X.speech_text("Rain , again ?", "en") == "<en>Rain, again?</en>"
    assert X.speech_text("rain – sun", "en") == "<en>rain - sun.</en>"


JAPANESE = ["カタカナ", "ひらがなと漢字です。", "夕方の市場（入口）「三番」", "東京タワー 2024年"]


@pytest.mark.parametrize("charset", ["euc_jp", "cp932", "utf-8", "iso2022_jp"])
@pytest.mark.parametrize("text", JAPANESE)
def test_decoding_japanese_without_a_label(text, charset):
    assert X.decode_bytes(text.encode(charset), None) == text


def test_decoding_by_labels():
    for charset in ("koi8-r", "gb18030", "windows-1252", "big5"):
        text = {"koi8-r": "Привет", "gb18030": "你好", "windows-1252": "naïve “x”", "big5": "中文"}[charset]
        assert X.decode_bytes(text.encode(charset), charset) == text
        head = f'<?xml version="1.0" encoding="{charset}"?>'
        assert X.decode_bytes((head + text).encode(charset), None) == head + text
    assert X.decode_bytes("ö".encode(), "unknown-name") == "ö"
    assert X.decode_bytes("ö and é".encode("latin-1"), None) == "ö and é"
    assert X.decode_bytes("\ufeffö".encode(), None) == "ö"


def test_full_width(spark):
    assert value(spark, X.full_width(F.lit("No. 3 ﾊﾟﾋﾞﾖﾝ\n｢x｣ﾞ"))) == "Ｎｏ．　３　パビヨン「ｘ」"
    assert len(X.VOICED) == 26 and all(unicodedata.normalize("NFC", unicodedata.normalize("NFKC", k)) == v for k, v in X.VOICED.items())


def test_language_rules(spark):
    rows = [("雨が降っています", None), ("Il pleut encore", "fr_CA"), ("雨がやみました", "de"), ("下雨的时候", None), ("12 34", None), ("Rain again", "und"), ("Rain again", "tlh")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, t string, l string").select("n", X.language_by_rules(F.col("t"), F.col("l")).alias("v"))
    assert [r["v"] for r in df.orderBy("n").collect()] == ["ja", "fr", "ja", None, None, "en", None]


def test_printed_text(spark):
    assert value(spark, X.extracted_text(F.lit("図 3 は Mill の 絵\x01"))) == "図3はMillの絵"
    assert value(spark, X.extracted_text(F.lit("Mills of 3 kinds."))) == "Mills of 3 kinds."


def test_replies_keep_styles_and_tidy_blanks():
    assert J.reply_parts("see <b>it</b> , now &amp; then", 1) == [(0, "see it, now & then")]
    assert J.reply_parts("A <a i=1>x </a> , <a i=0>y</a><a i=7>z</a> )", 2) == [(-1, "A "), (1, "x"), (-1, ", "), (0, "y"), (-1, "z"), (-1, ")")]
    assert J.reply_parts("<a i=0>one</a> .NET", 2) == [(0, "one"), (-1, " .NET")]
    assert J.reply_parts("", 2) == []


def test_requests_mark_groups_of_one_style(spark):
    span = "struct<text:string,link:int,bold:boolean,code:boolean,image:boolean,italic:boolean,strike:boolean,minor:boolean,translated:boolean,src:string>"

    def s(text, link=None, bold=False):
        return (text, link, bold, False, False, False, False, False, False, None)

    rows = [([s("a & "), s("b ")],), ([s("a"), s("<b>", 0), s("c", 0), s("d")],), ([],), ([s(None)],), (None,)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"n int, spans array<{span}>")
    got = [r["v"] for r in df.select("n", B.request(B.grouped(F.col("spans"))).alias("v")).orderBy("n").collect()]
    assert got == ["a &amp; b", "<a i=0>a</a><a i=1>&lt;b&gt;c</a><a i=2>d</a>", None, "", None]


def test_markers(spark):
    shown = [value(spark, M.list_marker(F.lit(m), F.lit(lv))) for m, lv in (("3.", 0), ("3.", 1), ("4.", 2), ("・", 2), ("", 0))]
    assert shown == ["3.", "c.", "iv.", "-", ""]


def blocks(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, pos int, kind string, level int, text string, title string")


def test_title_repeats_leave_one_heading(spark):
    df = blocks(spark, [(1, 0, "p", 0, "News of A", "News of A | Site"), (1, 1, "h", 1, "News of A", "News of A | Site"), (1, 2, "p", 0, "Same", "News of A | Site"), (1, 3, "p", 0, "same!", "News of A | Site"), (1, 4, "p", 0, "", "News of A | Site")])
    assert sorted(r["pos"] for r in B.dedupe(df).collect()) == [1, 2, 4]


def test_sections(spark):
    df = blocks(spark, [(1, 0, "h", 2, "Body", ""), (1, 1, "p", 0, "a", ""), (1, 2, "h", 2, "References", ""), (1, 3, "h", 3, "Sub", ""), (1, 4, "p", 0, "b", ""), (1, 5, "h", 2, "More", ""), (1, 6, "p", 0, "c", "")])
    assert sorted(r["pos"] for r in B.sections(df).where("in_tail").collect()) == [2, 3, 4]


def brute_run(weights):
    best, at, start, total = 0, None, 0, 0
    for i, w in enumerate(weights):
        if total <= 0:
            start, total = i, 0
        total += w
        if total > best:
            best, at = total, (start, i)
    return None if at is None else (*at, best)


def test_max_run_equals_the_fold(spark):
    rng = random.Random(7)
    pages = [[rng.randint(-3, 3) for _ in range(rng.randint(1, 9))] for _ in range(300)]
    rows = [(p, i, w) for p, ws in enumerate(pages) for i, w in enumerate(ws)]
    got = {r["page_id"]: (r["first"], r["last"], r["best"]) for r in B.max_run(spark.createDataFrame(rows, "page_id bigint, pos int, weight int")).collect()}
    for p, ws in enumerate(pages):
        assert got.get(p) == brute_run(ws), ws


@given(st.lists(st.text(alphabet="abc水\U00020000", max_size=12), max_size=6), st.text(alphabet="abc水\U00020000", max_size=30))
@settings(max_examples=300, deadline=None)
def test_runs_of_characters_equal_sets(texts, ref):
    known = {ref[i : i + 4] for i in range(len(ref) - 3)}
    want = [(max(len(t) - 3, 0), sum(t[i : i + 4] in known for i in range(len(t) - 3))) for t in texts]
    assert B._hits(texts, ref) == want


def test_page_run_equals_the_fold():
    rng = random.Random(8)
    for _ in range(3000):
        ws = [rng.randint(-3, 3) for _ in range(rng.randint(0, 9))]
        assert B.heaviest_run(ws) == brute_run(ws), ws


def test_batches_reset_at_both_limits(spark):
    rows = [(1, i, "x" * 10) for i in range(120)] + [(2, 0, "x" * 3000), (2, 1, "x" * 2000), (2, 2, "x" * 9000), (2, 3, "x")]
    got = B.batches(spark.createDataFrame(rows, "page_id bigint, pos int, request string")).collect()
    sizes = [sum(r["page_id"] == 1 and r["batch"] == b for r in got) for b in range(3)]
    assert sizes == [50, 50, 20]
    assert [r["batch"] for r in sorted(got, key=lambda r: r["pos"]) if r["page_id"] == 2] == [0, 1, 2, 3]


def test_indents(spark):
    kinds = [("p", 0), ("h", 2), ("p", 0), ("h", 4), ("li", 0), ("h", 2)]
    df = blocks(spark, [(1, i, k, lv, "x", "") for i, (k, lv) in enumerate(kinds)])
    assert [r["indent"] for r in M.indents(df).orderBy("pos").collect()] == [0, 0, 2, 2, 4, 0]


def test_printed_lines_are_joined():
    full = "この村の水車は川のそばにあり、長いあいだ"
    assert R.joined(f"{full}\n\n使われていません。\n\n次の段落です。") == f"{full}\n使われていません。\n\n次の段落です。"
    assert R.joined(f"見出し\n\n{full}\n{full}") == f"見出し\n\n{full}\n{full}"  # a short line before
    assert R.joined("One line here\n\nanother one here") == "One line here\n\nanother one here"
    assert R.joined("The river-\nbank is a riverbank") == "The riverbank is a riverbank"
    assert R.joined("A well-\nknown mill") == "A well-known mill"
    assert R.joined("Pages 3-\nfour and A-\nB") == "Pages 3-\nfour and A-\nB"
    assert R.joined("") == "" and R.joined("\n\n") == "\n\n"


def test_durations_and_readings(spark):
    rows = [("かわ、みず。", 4, 1), ("。かわ", 2, 0), ("abc, def: ghi", 0, 2), ("", 0, 0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, t string, m int, p int")
    got = df.select("n", X.mora_count(F.col("t")).alias("m"), X.pause_count(F.col("t")).alias("p"), X.least_seconds(F.col("m"), F.col("p")).alias("s")).orderBy("n").collect()
    assert [(r["m"], r["p"]) for r in got] == [(m, p) for _, m, p in rows]
    assert all(abs(r["s"] - (0.95 * (0.27 + 0.154 * r["m"]) + 0.3 * r["p"])) < 1e-9 for r in got)
    lines = ['1,2,3,4,5,6,7,8,"a,""b""",10', "1,2,3,4,5,6,7,8,*,10", "1,2,3,4,5,6,7,8,,10", "1,2", None]
    df = spark.createDataFrame(list(enumerate(lines)), "n int, l string")
    assert [r["v"] for r in df.select("n", X.pronunciation(F.col("l")).alias("v")).orderBy("n").collect()] == ['a,"b"', None, None, None, None]


def test_replies_of_use(spark):
    rows = [('["x", " "]', [("x", None, True), (" ", None, False)]), ('[["x", "de"], ["y", "en"], ["", "de"]]', [("x", "de", True), ("y", "en", False), ("", "de", False)])]
    for reply, want in rows:
        pairs = spark.range(1).select(F.explode(J.reply_pairs(F.lit(reply))).alias("p"))
        got = pairs.select("p.text", "p.lang", J.is_of_use(F.col("p.text"), F.col("p.lang"), "en").alias("use")).collect()
        assert [tuple(r) for r in got] == want
