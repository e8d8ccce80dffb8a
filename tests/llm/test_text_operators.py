"""Unifying, segmenting, tokenizing, packing: brute force, round trips, odd input."""

import random
import re
import time
import unicodedata
from itertools import combinations_with_replacement

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import pack, segment, tokenize, unify
from tests.llm import helpers as H

CHUNKS = "chunk_id bigint, text string, label boolean, record string, pos int, unified string"


def chunks(spark, texts):
    return spark.createDataFrame([(i, t, False, "x", 3, "y") for i, t in enumerate(texts)], CHUNKS)


# ---- unify

@pytest.mark.parametrize(
    "text, unified",
    [
        ("plain text", None),
        ("café", "café"),
        ("ｆｕｌｌ １２", "full 12"),
        ("re​ad", "read"),
        ("a b", "a b"),
        ("reserνed", "reserved"),
        ("Сulture", "Culture"),
        ("вpемя", "время"),
        ("ﾒｰﾀｰ ﾊﾞｽ", "メーター バス"),
        ("가", "가"),
        ("⼀个", "一个"),
        ("ﬁne", "fine"),
        ("นํา", "นำ"),
        ("The sign reads νερό and хлеб", None),
        ("½ ² ① № ™ Ω 👩‍🌾", None),
        ("「本」（図１２）、。", "「本」（図12）、。"),
        ("全角　空白", None),
        ("", None),
    ],
)
def test_one_form(spark, text, unified):
    row = unify.unify_chunks(chunks(spark, [text])).first()
    assert row["altered"] == (unified is not None)
    assert row["unified"] == (text if unified is None else unified)


def test_unify_odd_input(spark):
    long = "x​y " * 200_000
    out = {r["record_id"]: r for r in unify.unify_chunks(chunks(spark, [None, "", long, long])).collect()}
    assert out[0]["unified"] is None and not out[0]["altered"]
    assert out[2]["unified"] == "xy " * 200_000 == out[3]["unified"]
    assert unify.unify_chunks(chunks(spark, [])).count() == 0
    rows = unify.unify_pages(H.pages(spark, [H.page(1, [H.block("p", "ok"), H.block("p", "re​ad")]), H.page(2, None), H.page(3, H.ODD_BLOCKS)]), True).collect()
    assert [(r["record_id"], r["pos"], r["span_pos"]) for r in rows] == [(1, 1, 0)]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="abcéｆ０а́​ ", max_size=12), min_size=1, max_size=8))
def test_unified_text_is_composed_and_stays(texts):
    import duckdb
    import pyarrow as pa

    def run(values):
        n = len(values)
        batch = pa.table({"record": ["c"] * n, "record_id": list(range(n)), "pos": [-1] * n, "span_pos": [-1] * n, "text": pa.array(values, pa.string())})
        con = duckdb.connect()
        con.register("batch", batch)
        return [r["unified"] for r in sorted(con.sql(unify.build_sql()).to_arrow_table().to_pylist(), key=lambda r: r["record_id"])]

    once = run(texts)
    assert all(unicodedata.normalize("NFC", t) == t for t in once)
    assert run(once) == once


# ---- segment

@pytest.mark.parametrize(
    "text, sentences",
    [
        ("One. Two? Three!", ["One.", "Two?", "Three!"]),
        ("Dr. A. B. Smith paid 3.50 at 7 p.m. He left.", ["Dr. A. B. Smith paid 3.50 at 7 p.m.", "He left."]),
        ("Really, Ann?! Yes.", ["Really, Ann?!", "Yes."]),
        ("“Nobody came. We waited,” said Ann. Then it rained.", ["“Nobody came. We waited,” said Ann.", "Then it rained."]),
        ("She paused ... and went on. End", ["She paused ... and went on.", "End"]),
        ("It ended.The next began.", ["It ended.", "The next began."]),
        ("Visit docs.Some.example for more. Go.", ["Visit docs.Some.example for more.", "Go."]),
        ("No stop\nNext line; still: one.", ["No stop", "Next line; still: one."]),
        ("Im 19. Jahrhundert kam er. „Gut?“, fragte sie. Ende.", ["Im 19. Jahrhundert kam er.", "„Gut?“, fragte sie.", "Ende."]),
        ("Доски и т. д. Когда он пришёл на ул. Липовой, д. 3, было темно.", ["Доски и т. д.", "Когда он пришёл на ул. Липовой, д. 3, было темно."]),
        ("「必要ですか？」と聞いた。彼は（図3を参照。）行った。", ["「必要ですか？」と聞いた。", "彼は（図3を参照。）行った。"]),
        ("他写道：“开门。”后来走了。“好吗？”他问道。", ["他写道：“开门。”", "后来走了。", "“好吗？”他问道。"]),
        ("“정말?”라고 물었다. 그는... 그리고 갔다.", ["“정말?”라고 물었다.", "그는... 그리고 갔다."]),
        ("ฝนตก แมวนอน มีคน 5 คน", ["ฝนตก", "แมวนอน", "มีคน 5 คน"]),
        ("", []),
        ("  \n ", []),
    ],
)
def test_sentences(text, sentences):
    assert [text[a:b] for a, b in segment.spans(text)] == sentences


def test_offsets_are_those_of_the_stored_text():
    text = "  Café clo​sed. Ｎext onе. "
    assert [text[a:b] for a, b in segment.spans(text)] == ["Café clo​sed.", "Ｎext onе."]


def test_segment_odd_input(spark):
    long = "A word. " * 50_000
    df = segment.sentences(segment.chunk_texts(chunks(spark, [None, "", long, "Label. Two"])))
    assert df.where("record_id = 2").count() == 50_000
    assert df.where("record_id < 2").count() == 0
    assert segment.spans("Label. Two", label=True) == [(0, 10)]
    assert segment.sentences(segment.quote_texts(H.pages(spark, [H.page(1, H.ODD_BLOCKS), H.page(2, None)]))).count() == 0


# ---- tokenize

def reference(text):
    import tiktoken
    import base64
    import os

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(os.path.join(tokenize.TOKENIZERS, "byte_bpe_50k.tiktoken"), "rb"))}
    enc = reference.enc = getattr(reference, "enc", None) or tiktoken.Encoding("own", pat_str=tokenize.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return enc.encode_ordinary(text)


CONTENT = tokenize.read_vocabulary()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aAn \n\t=0é中́", max_size=80))
def test_ids_equal_the_library_and_decode_back(text):
    if any("\ud800" <= c <= "\udfff" for c in text):
        return
    ids = tokenize.encode_texts([text], CONTENT)[0]
    assert ids == reference(text)
    assert tokenize.load(CONTENT)[0].decode(ids) == text


def test_encode_and_decode(spark):
    texts = [None, "", " ", "<|endoftext|> <s>", "word " * 100_000, "a" * 3000, "\n\n\n"]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id bigint, text string, ids array<int>")
    out = tokenize.encode(df)
    assert out.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    got = {r["doc_id"]: r["ids"] for r in out.collect()}
    assert got[0] == [] and got[1] == []
    assert all(got[i] == reference(t) for i, t in enumerate(texts) if t)
    back = {r["doc_id"]: r["text"] for r in tokenize.decode(out).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    assert tokenize.encode(df.limit(0)).count() == 0


# ---- pack

def check_plan(histogram, capacity):
    intervals, bins = pack.plan(dict(histogram), capacity)
    used, seen = {}, {}
    for size, r0, r1, first, per in intervals:
        for r in range(r0, r1):
            assert (size, r) not in seen
            seen[size, r] = True
            b = first + (r - r0) // per
            assert b < bins
            used[b] = used.get(b, 0) + size
    assert all(u <= capacity for u in used.values())
    assert len(seen) == sum(histogram.values())
    assert len(used) == bins
    return bins


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_plan_places_all_within_capacity(histogram):
    bins = check_plan(histogram, 64)
    total = sum(s * n for s, n in histogram.items())
    assert bins >= -(-total // 64)


def best(items, capacity, bins=()):
    if not items:
        return len(bins)
    s, rest = items[0], items[1:]
    options = [best(rest, capacity, (*bins, capacity - s))]
    for f in set(b for b in bins if b >= s):
        i = bins.index(f)
        options.append(best(rest, capacity, (*bins[:i], f - s, *bins[i + 1 :])))
    return min(options)


def test_plan_is_near_the_best():
    rng = random.Random(3)
    for _ in range(25):
        items = sorted((rng.randint(5, 40) for _ in range(8)), reverse=True)
        h = {s: items.count(s) for s in items}
        assert check_plan(h, 64) <= best(items, 64) + 1


def test_fill(spark):
    rows = [(i, 0, s, 99) for i, s in enumerate([2048, 1500, 600, 400, 400, 300, 1, 0, 3000, None])] + [(1, 0, 1500, 99)]
    out = pack.fill(spark.createDataFrame(rows, "doc_id bigint, piece bigint, size bigint, bin int")).collect()
    assert len(out) == 8
    load = {}
    for r in out:
        load[r["bin"]] = load.get(r["bin"], 0) + r["size"]
    assert max(load.values()) <= 2048 and sum(load.values()) == 2048 + 1500 * 2 + 600 + 400 * 2 + 300 + 1
    assert len(load) == 4
    assert pack.fill(spark.createDataFrame([], "doc_id bigint, piece bigint, size bigint")).count() == 0


def test_sizes_cut_long_documents(spark):
    df = spark.createDataFrame([(1, "word " * 5000), (2, None), (3, ""), (4, " ")], "doc_id bigint, text string")
    out = sorted((r["doc_id"], r["piece"], r["size"]) for r in pack.sizes(df).collect())
    assert out == [(1, 0, 2048), (1, 1, 2048), (1, 2, 5001 - 4096), (4, 0, 1)]


def test_configurations_are_the_fullest():
    for sizes, left, capacity in (([30, 20, 7], [2, 3, 5], 64), ([13, 11], [9, 9], 50), ([40], [3], 64)):
        config = pack._configuration(sizes, left, capacity)
        total = sum(s * k for s, k in zip(sizes, config))
        everything = [sum(c) for n in range(12) for c in combinations_with_replacement(sizes, n) if all(c.count(s) <= m for s, m in zip(sizes, left))]
        assert total == max(t for t in everything if t <= capacity)


def test_long_quotations_and_names_are_seen_whole():
    said = "“" + "我们的村子很安静" * 12 + "。”老人说完就走了。"
    text = said + "他走了。"
    assert [text[a:b] for a, b in segment.spans(text)] == [said, "他走了。"]
    name = "x" * 70 + ".example"
    assert [(f"See {name} now."[a:b]) for a, b in segment.spans(f"See {name} now.")] == [f"See {name} now."]


def test_a_long_line_with_an_open_bracket_is_cut_in_linear_time():
    text = "He said (and it was so. " + "The mill was closed. " * 48_000  # a line of a million characters
    begun = time.process_time()
    cut = segment.spans(text)
    assert time.process_time() - begun < 20
    assert len(cut) == 48_001


def test_tables_of_the_languages_that_a_text_speaks():
    english = "The mill of the town was closed for a week, and that was it."
    german = "Die Mühle ist in der Stadt und das Haus ist nicht mit dem Wagen zu sehen."
    assert segment.languages_of(english) == ("en",)
    assert segment.languages_of(german, "en") == ("de",)
    assert set(segment.languages_of(f"{english} {german}")) == {"en", "de"}
    assert segment.languages_of("No. 5") == ()
    cut = lambda t: [t[a:b] for a, b in segment.spans(t)]
    # "Nr." is an abbreviation in German, and no English one
    assert len(cut(f"{english} They met in Nr. Ten of them left.")) == 3
    assert len(cut(f"{german} Wir wohnen in Nr. Zehn.")) == 2


@given(st.text(alphabet="ab.!? ()“”„«»[]「」", max_size=60))
@settings(max_examples=200, deadline=None)
def test_pairs_equal_their_patterns(text):
    line = segment.Line(text)
    patterns = {"“": (r"“[^“”]*", r"[^“”]*”"), "„": (r"„[^„“”]*", r"[^„“”]*[“”]"), "(": (r"\([^()]*", r"[^()]*\)"), "«": (r"«[^«»]*", r"[^«»]*»")}
    for pair in segment.INSIDE:
        if pair.opening in patterns:
            left, right = patterns[pair.opening]
            for at in range(len(text) + 1):
                assert pair.holds(line, at) == bool(re.search(f"(?:{left})\\Z", text[:at]) and re.match(right, text[at:]))
    for at in range(len(text) + 1):
        assert segment.BRACKET[0].holds(line, at) == bool(re.search(r"[^\s.!?…。！？]\s*[(（][^()（）]*[)）]\Z", text[:at]))


def test_unify_long_texts_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(unify, "ROWS", 3)
    rows = [H.page(i, [H.block("p", "ｆｕｌｌ " * (40_000 if i == 5 else 2)), H.block("p", "plain")]) for i in range(10)]
    got = {(r["record_id"], r["pos"], r["span_pos"]) for r in unify.unify_pages(H.pages(spark, rows).coalesce(1), True).collect()}
    assert got == {(i, 0, 0) for i in range(10)}
