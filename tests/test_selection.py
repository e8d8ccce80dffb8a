import random

import pytest
from pyspark.sql import functions as F

from pagewright.functions import layout as L
from pagewright.operators import blocks as B
from pagewright.operators import selection as S
from pagewright.operators import state
from pagewright.sources import store


def brute_selected(texts, ref):
    if len(ref) < 50:
        return []
    known = {ref[i : i + 4] for i in range(len(ref) - 3)}
    match, weight = [], []
    for t in texts:
        if not t:
            match.append(None)
        elif len(t) < 4:
            match.append(t in ref)
        else:
            parts = [t[i : i + 4] for i in range(len(t) - 3)]
            match.append(sum(p in known for p in parts) * 2 >= len(parts))
        weight.append(0 if match[-1] is None else len(t) if match[-1] else -len(t))
    best, at, start, total = 0, None, 0, 0
    for i, w in enumerate(weight):
        if total <= 0:
            start, total = i, 0
        total += w
        if total > best:
            best, at = total, (start, i)
    if at is None:
        return []
    inside = range(at[0], at[1] + 1)
    out = []
    for i in inside:
        if match[i] is None:
            left = next((match[j] for j in reversed(inside) if j < i and match[j] is not None), None)
            right = next((match[j] for j in inside if j > i and match[j] is not None), None)
            if left and right:
                out.append(i)
        elif match[i]:
            out.append(i)
    return out


def test_selection_equals_brute_force(spark):
    rng = random.Random(4)
    pages = {}
    for p in range(60):
        good = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 40))) for _ in range(6)]
        texts = [rng.choice([rng.choice(good), "", "".join(rng.choice("xyz") for _ in range(rng.randint(1, 30)))]) for _ in range(rng.randint(1, 12))]
        pages[p] = (texts, "".join(good))
    rows = [(p, i, "p", [(t, False)], t) for p, (texts, _) in pages.items() for i, t in enumerate(texts)]
    blocks = spark.createDataFrame(rows, "page_id bigint, pos int, kind string, spans array<struct<text:string,image:boolean>>, text string")
    refs = spark.createDataFrame([(p, r) for p, (_, r) in pages.items()], "page_id bigint, ref string")
    got = {p: [] for p in pages}
    for r in S.selected(blocks, refs).orderBy("page_id", "pos").collect():
        got[r["page_id"]].append(r["pos"])
    assert got == {p: brute_selected(*v) for p, v in pages.items()}


def test_prefer_own(spark):
    long = "x" * 200
    own = spark.createDataFrame([(1, "a" + long), (1, "b" + long), (2, "a" + long), (2, "b" + long), (3, "short")], "page_id bigint, sentence string")
    other = spark.createDataFrame([(1, "z" * 30), (2, "a" + long), (2, "b" + long)], "page_id bigint, sentence string")
    assert {r["page_id"]: r["prefer"] for r in S.prefer_own(own, other).collect()} == {1: True, 2: False, 3: False}


def test_cleaned(spark):
    rows = [(1, 0, "li", [("ad", 0), (" ", None)]), (1, 1, "p", [("text ", None), ("ad", 0), ("ok", 1)]), (1, 2, "p", [("ok", 1)])]
    blocks = spark.createDataFrame(rows, "page_id bigint, pos int, kind string, spans array<struct<text:string,link:int>>")
    listed = spark.createDataFrame([(1, 0)], "page_id bigint, link int")
    assert sorted((r["pos"], r["removed"], r["unlinked"]) for r in S.cleaned(blocks, listed).collect()) == [(0, True, 0), (1, False, 1)]


def test_recent_and_suggestions(spark):
    rows = [(1, 7, "history", "search", "river mills", None, 1.0), (2, 7, "history", "url", "https://a.example/mills", "Mills 水車", 2.0), (3, 7, "history", "search", "river mills", None, 3.0), (4, 7, "bookmarks", "url", "https://a.example/mills", "Mills 水車", 2.5)]
    df = spark.createDataFrame(rows, "item_id bigint, profile_id bigint, list_name string, kind string, target string, title string, time_s double")
    got = [(r["target"], r["time_s"]) for r in state.recent(df.where("list_name = 'history'").withColumnRenamed("item_id", "id"), "profile_id").orderBy("place").collect()]
    assert got == [("river mills", 3.0), ("https://a.example/mills", 2.0)]
    find = lambda q: [r["target"] for r in state.suggestions(df, "profile_id", q).orderBy("place").collect()]
    assert find("") == ["https://a.example/mills", "river mills"]
    assert find("RIVER mills") == ["river mills"]
    assert find("mills 水車 zzz") == []
    # marked under another title: history is not shown although its own title matches
    more = df.union(spark.createDataFrame([(5, 7, "history", "url", "https://a.example/mills", "Pond", 9.0)], df.schema))
    assert [r["target"] for r in state.suggestions(more, "profile_id", "pond").collect()] == []
    assert [r["target"] for r in state.suggestions(more, "profile_id", "", bookmarks_only=True).collect()] == ["https://a.example/mills"]


def test_layout():
    assert L.width("aあ漢") == 5 and L.width("é") == 1 and L.width("👩‍🌾") >= 2
    assert L.truncate("日本語のテキスト", 7) == "日本語…"
    assert all(L.width(x) <= 20 for x in L.wrap("これは長い文章です。次の行に、句読点が来ないこと。 and some English words too", 20))
    assert not any(x and x[0] in "、。" for x in L.wrap("あ" * 10 + "。" + "い" * 10 + "、う", 20))
    labels = L.hint_labels(40)
    assert len(labels) == 40 and not any(a != b and b.startswith(a) for a in labels for b in labels)


def test_store(spark, tmp_path):
    path = str(tmp_path / "items")
    store.write_items(spark.createDataFrame([("url", "https://a.example/", "A", 1.0)], store.ITEM), path)
    assert [tuple(r) for r in store.read_items(spark, path).collect()] == [("url", "https://a.example/", "A", 1.0)]
    (tmp_path / "list.json").write_text('[{"target": "x"}, {"kind": "search", "target": "y", "extra": 1}]')
    assert sorted(tuple(r) for r in store.read_items(spark, str(tmp_path / "list.json")).collect()) == [("search", "y", "", 0.0), ("url", "x", "", 0.0)]


@pytest.mark.parametrize("reply, texts", [('["a", "b"]', ["a", "b"]), ('[["a", "en"], ["b", "en"]]', ["a", "b"])])
def test_replies(spark, reply, texts):
    assert spark.range(1).select(store.reply_texts(F.lit(reply)).alias("v")).first()["v"] == texts
    marked = spark.range(1).select(store.reply_spans(F.lit("<a i=1>B</a><a i=0>A</a>"), F.lit(2)).alias("v")).first()["v"]
    assert [(m["i"], m["text"]) for m in marked] == [(1, "B"), (0, "A")]


def test_places_in_view_equal_the_scan(spark):
    rng = random.Random(4)
    rows = []
    for n in range(60):
        shown = [rng.choice("abcd") for _ in range(rng.randint(0, 12))]
        body = [rng.choice("abcde") for _ in range(rng.randint(0, 8))]
        rows.append((n, body, shown))
    df = spark.createDataFrame([*rows, (60, None, None)], "n int, body array<string>, shown array<string>")
    got = {r["n"]: r["p"] for r in df.select("n", B.places_in_view("body", "shown").alias("p")).collect()}
    assert got[60] == []
    for n, body, shown in rows:
        at, want = 0, []
        for t in body:
            i = next((i for i in range(at, len(shown)) if shown[i] == t), None)
            want.append(i)
            at = at if i is None else i + 1
        assert got[n] == want


def test_headings_without_anything_below_are_not_read(spark):
    span = "array<struct<text:string,link:int,image:boolean>>"
    kinds = [("h", 2, "Empty"), ("h", 2, "Whole"), ("h", 3, "Part"), ("p", 0, "Some words to read."), ("h", 3, "Last part"), ("hr", 0, ""), ("h", 1, "Top"), ("h", 2, "End")]
    rows = [(1, i, k, level, t, [(t, None, False)]) for i, (k, level, t) in enumerate(kinds)]
    df = spark.createDataFrame(rows, f"page_id bigint, pos int, kind string, level int, text string, spans {span}")
    assert sorted(r["pos"] for r in B.readable(df).collect()) == [1, 2, 3, 6]


def test_items_are_removed_and_found_by_key(spark):
    rows = [(1, 7, "url", "a", "A", 1.0), (2, 7, "url", "a", "B", 2.0), (3, 7, None, None, "C", 3.0), (4, 8, "url", "b", None, 4.0)]
    df = spark.createDataFrame(rows, "item_id bigint, profile_id bigint, kind string, target string, title string, time_s double")
    gone = spark.createDataFrame([("url", "b", "extra"), (None, None, "extra")], "kind string, target string, title string")
    assert sorted(r["item_id"] for r in state.without(df, gone, ["kind", "target"]).collect()) == [1, 2]
    assert [(r["profile_id"], r["item_id"]) for r in state.find(df, "profile_id", "url", "a").collect()] == [(7, 2)]
