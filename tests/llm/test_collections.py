"""Repeats within sites, bodies, prose, languages, records and residue: brute force and odd input."""

import json
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pagewright.llm import bitmaps, collapse, language, prose, prose_fit, repeats, residue, sitetree
from pagewright.llm.common import fold, host_of, line_key
from tests.llm import helpers as H

# ---- shared parts


@pytest.mark.parametrize(
    "url, host",
    [("https://www.A.example:443/x", "a.example"), ("HTTP://u:p@a.example/x?y#z", "a.example"), ("a.example/x", "a.example"), ("//a.example", "a.example"), (None, None), ("", None), ("no host", None)],
)
def test_hosts(url, host):
    assert host_of(url) == host


def test_line_keys():
    assert line_key("Terms · of USE (12)!") == line_key("terms of use") == "termsofuse"
    assert line_key("ZWEI STRASSEN") == line_key("zwei Straßen™")
    assert line_key("Ｔｅrms o​f usе") == "termsofuse"
    assert line_key("— 12 —") == line_key("") == ""
    assert fold("café") == "café"


# ---- bitmaps

def test_cardinalities_equal_sets(spark):
    rng = random.Random(1)
    rows = [(rng.randint(1, 3), 0, rng.randint(1, 40), rng.randint(1, 2), rng.randint(0, 200_000)) for _ in range(20_000)]
    rows += [(9, 0, 5, 1, p) for p in range(0, 140_000, 2)] * 2  # bit sets, and every posting twice
    df = spark.createDataFrame(rows, "site bigint, zone int, key bigint, variant bigint, page_id bigint").repartition(5)
    want = defaultdict(set)
    for s, z, k, _, p in rows:
        want[s, z, k].add(p)
    got = {(r["site"], r["zone"], r["key"]): r["pages"] for r in bitmaps.cardinalities(df).collect()}
    assert got == {k: len(v) for k, v in want.items()}
    assert bitmaps.cardinalities(df.limit(0)).count() == 0


# ---- repeated lines

def line_pages(n):
    rows = []
    for i in range(n):
        b = [H.block("p", f"Share this ({i})\nUnique line number {chr(97 + i % 26)}{chr(97 + i // 26)}"), H.block("table", "", rows=[[[("Share this",)]]])]
        if i % 2:
            b.append(H.block("li", "ｓHARE — this!"))
        rows.append(H.page(i, b, url=f"https://www.a.example/{i}"))
    return rows


def test_repeated_lines(spark):
    rows = line_pages(40) + line_pages(1) + [H.page(100, [H.block("p", "Share this")], url=None), H.page(101, H.ODD_BLOCKS), H.page(102, None), H.page(103, [H.block("p", "Share this")], url="https://b.example/")]
    df = H.pages(spark, rows)
    got = {(r["page_id"], r["pos"], r["line_no"]) for r in repeats.find(df).collect()}
    assert got == {(i, 0, 0) for i in range(40)} | {(i, 2, 0) for i in range(1, 40, 2)}
    clean = {(r["page_id"], r["pos"]): r["text"] for r in repeats.without(df, repeats.find(df)).collect()}
    assert clean[3, 0] == "Unique line number da" and (3, 2) not in clean and clean[100, 0] == "Share this"
    assert repeats.find(df.limit(0)).count() == 0


def test_a_line_below_either_threshold_stays(spark):
    four = [H.page(i, [H.block("p", "same words" if i < 4 else f"other {chr(97 + i)}")]) for i in range(10)]
    assert repeats.find(H.pages(spark, four)).count() == 0
    share = [H.page(i, [H.block("p", "same words" if i < 5 else f"other {chr(97 + i % 26)}{chr(97 + i // 26)}")]) for i in range(51)]
    assert repeats.find(H.pages(spark, share)).count() == 0
    assert repeats.find(H.pages(spark, share[:50])).count() == 5


# ---- bodies

def site_pages(n):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    rows = []
    for i in range(n):
        b = [H.block("li", x, link=0) for x in ("Home", "News", "Contact")]
        b += [H.block("h", f"Teaser {word()}", 0), H.block("h", f"Story {word()}", 1), H.block("p", f"By {word()} for The Alpha Notes")]
        b += [H.block("p", f"Body {word()} {word()} {word()}."), H.block("h", f"Part {word()}", 3), H.block("p", f"More {word()} {word()}.")]
        b += [H.block("p", f"Share this ({i})"), H.block("h", "Most read", 3), H.block("li", f"Other {word()}", link=1), H.block("p", f"Loose {word()} {word()}."), H.block("hr", ""), H.block("p", f"© {2000 + i} The Alpha Notes. All rights.")]
        rows.append(H.page(i, b, url=f"https://a.example/{i}"))
    return rows


def test_bodies(spark):
    rows = site_pages(40)
    rows += [rows[0], H.page(90, H.ODD_BLOCKS), H.page(91, None), H.page(92, [H.block("p", "Alone " * 20_000)], url="https://c.example/")]
    got = defaultdict(list)
    for r in sitetree.boilerplate(H.pages(spark, rows), H.sites(spark)).collect():
        got[r["page_id"]].append(r["pos"])
    for i in range(40):
        assert sorted(got[i]) == [0, 1, 2, 3, 5, 9, 10, 11, 12, 14]
    assert set(got) == set(range(40))
    empty = H.pages(spark, rows).limit(0)
    assert sitetree.boilerplate(empty, H.sites(spark)).count() == 0
    assert sitetree.boilerplate(H.pages(spark, rows[:3]), H.sites(spark).limit(0)).count() >= 0


def test_pictures_are_no_lead_ins(spark):
    rows = []
    for i in range(40):
        picture = ("p", 0, None, [(f"［画像: pic {chr(97 + i % 26)}{chr(97 + i // 26)}］", None, True)], None, False)
        rows.append(H.page(i, [H.block("h", f"Story {i}", 1), picture, H.block("p", f"Read also: other {chr(97 + i % 26)}{chr(97 + i // 26)}")], url=f"https://a.example/{i}"))
    got = {(r["page_id"], r["pos"]) for r in sitetree.boilerplate(H.pages(spark, rows), H.sites(spark)).collect()}
    assert got == {(i, 2) for i in range(40)}


def test_low_contents_travel_with_their_host(spark, monkeypatch):
    df = H.pages(spark, site_pages(40))
    want = {tuple(r) for r in sitetree.boilerplate(df, H.sites(spark)).collect()}
    monkeypatch.setattr(sitetree, "HELD", 3)
    assert {tuple(r) for r in sitetree.boilerplate(df, H.sites(spark)).collect()} == want


# ---- prose and languages

def test_trees_learn_and_calibrate():
    rng = np.random.default_rng(0)
    x = rng.random((800, len(prose.STATS)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.9)).astype(float)
    model = prose.calibrate(prose.fit_trees(x[:600], y[:600]), x[600:700], y[600:700])
    p = prose.probability(model, x[700:])
    assert ((p > 0.5) == (y[700:] == 1)).mean() > 0.93
    assert (p >= 0).all() and (p <= 1).all()


def test_the_model_agrees_with_the_half_of_the_holdout_that_it_never_saw(spark):
    h = json.loads(prose_fit.HOLDOUT.read_text())
    tables = f"/root/testdata/{h['tables']}"
    if not os.path.exists(tables):
        pytest.skip("the holdout's tables are not here")
    told = dict(zip(h["page_id"], h["prose"]))
    got = {r["page_id"]: r["prose"] for r in prose.page_statistics(spark, tables).select("page_id", "prose").collect()}
    measured = list(told)[1::2]
    assert np.mean([(got[i] >= 0.5) == (told[i] == 1) for i in measured]) >= 0.97


def test_the_model_rests_on_many_statistics():
    def splits(node):
        return set() if "v" in node else {node["j"]} | splits(node["l"]) | splits(node["r"])

    assert len(set().union(*map(splits, prose.load_model()["trees"]))) >= 10


def test_weak_labels_do_not_look_at_the_share_of_sentences():
    x = np.random.default_rng(3).random((500, len(prose.STATS))) * 2
    other = x.copy()
    other[:, prose.STATS.index("sentence_share")] = 0
    assert (prose.weak_labels(x) == prose.weak_labels(other)).all()


@pytest.mark.parametrize(
    "text, share",
    [
        ("The mill Anor, A narrow lane Bedd, The old bridge Cero, The school Dunn", 1.0),
        ("The mill was closed, they said, for a week. A lane, which was narrow, led to it.", 0.0),
        ("山小屋はサノト, 粘土の窯はルベミサ, 村のパン屋はポベネ, 山小屋はサノト", 1.0),
        ("", 0.0),
    ],
)
def test_enumerations(text, share):
    counts = dict(zip(prose.COUNTS, prose.count_block(text, "p", 0, frozenset(), None)))
    assert counts["listed"] == share * len(text) and (not share or not counts["sentence_chars"])


SENTENCE = {"en": "The old harbour in the town was closed by the council for a week, and nobody knew why that was so.", "de": "Der alte Hafen in der Stadt wurde von dem Rat für eine Woche geschlossen, und niemand wusste warum das so war.", "fr": "Le vieux port de la ville a été fermé par le conseil pour une semaine, et personne ne savait pourquoi."}
SAMPLES = [(x, t) for x, t in SENTENCE.items()] + [("en", "It is not the first time that this was said to them."), ("de", "Es ist nicht das erste Mal, dass ihnen das gesagt wurde."), ("fr", "Ce n'est pas la première fois que cela leur est dit dans la ville.")]
WORDS = [("en", w) for w in "the of and to in a is that for by was not it".split()] + [("de", w) for w in "der die das in dem und von eine nicht es ist".split()] + [("fr", w) for w in "le la de et un par pour que est dans".split()]


def story(i, lang, declared, extra=()):
    b = [H.block("h", f"Story {i}", 1)] + [H.block("p", f"{SENTENCE[lang]} {SENTENCE[lang]}") for _ in range(3)] + list(extra)
    return H.page(i, b, url=f"https://s{i}.example/", lang=declared)


def test_prose_and_languages(spark):
    junk = [H.block("h", "List", 1)] + [H.block("li", f"item {i}; {i};{i}", link=i) for i in range(30)]
    rows = [story(1, "en", "EN_us"), story(2, "de", "en"), story(3, "fr", None), story(4, "en", " ", [H.block("quote", SENTENCE["de"])]), H.page(5, junk, lang="de"), H.page(6, H.ODD_BLOCKS), H.page(7, None, lang=None), story(2, "de", "en")]
    df = H.pages(spark, rows)
    words = spark.createDataFrame(WORDS, "lang string, word string")
    samples = spark.createDataFrame(SAMPLES, "lang string, text string")
    stats = {r["page_id"]: r["prose"] for r in prose.statistics(df, H.sites(spark), words).collect()}
    assert {i for i, p in stats.items() if p < 0.5} == {5, 6, 7}
    wrong = language.languages(df, H.sites(spark), words, samples, everything=False)
    got = sorted((r["page_id"], r["pos"], r["lang"]) for r in wrong.collect())
    assert got == [(2, -1, "de"), (3, -1, "fr"), (4, -1, "en"), (4, 4, "de")]
    everything = language.languages(df, H.sites(spark), words, samples).collect()
    assert all(0 <= r["confidence"] <= 1 for r in everything)
    assert prose.statistics(df.limit(0), H.sites(spark), words).count() == 0
    assert language.languages(df, H.sites(spark), words, samples.limit(0)).count() == 0


def test_out_of_place_distance_equals_brute_force():
    known = language.Profiles(sorted(SAMPLES))
    texts = ["The council of the town", "und niemand wusste", "", "123", "pourquoi la semaine"]
    far = known.distances(texts)
    for text, row in zip(texts, far):
        owner, code, rank, letters = known._ranked([text])
        if letters[0] < language.LEAST_LETTERS:
            assert not row.any()
            continue
        profile = [{int(c): int(r) for c, r in zip(known.codes, known.ranks[:, j]) if r < language.TOP} for j in range(len(known.langs))]
        for j in range(len(known.langs)):
            total = sum(min(abs(profile[j][int(c)] - int(r)), language.TOP) if int(c) in profile[j] else language.TOP for c, r in zip(code, rank))
            assert row[j] == max(round(total / (len(code) * language.TOP) * 10_000), 1)


# ---- records

ITEMS = "item_id bigint, kind string, target string, title string, h bigint, keep_id string"


def items(spark, rows):
    return spark.createDataFrame([(i, k, t, x, 1, "c") for i, k, t, x in rows], ITEMS)


def test_canonical_forms(spark):
    rows = [
        (1, "url", "https://a.example/x-y?b=2&a=1", "The Story | Alpha"),
        (2, "url", " HTTPS://A.EXAMPLE/x_y/?a=1&b=2&", "ALPHA — the story!"),
        (3, "url", "https://a.example/x-y?b=2&a=2", "The Story | Alpha"),
        (4, "url", "https://a.example/y-x?b=2&a=1", "The Story | Alpha"),
        (5, "search", "old harbour", None),
        (6, "search", "“Old  Harbour”", ""),
        (7, "search", "harbour old", None),
        (8, "search", "old harbour", "x"),
        (9, "url", "old harbour", None),
        (10, None, None, None),
        (11, None, "", "…"),
        (5, "search", "old harbour", None),
        (12, "search", "strasse", "a"),
        (13, "search", "STRASSE", "a"),
        (14, "search", "straße", "a"),
    ]
    got = sorted((r["keep_id"], r["copy_id"]) for r in collapse.copies(items(spark, rows)).collect())
    assert got == [(1, 2), (5, 6), (10, 11), (12, 13), (12, 14)]
    whole = {r["keep_id"]: r["copies"] for r in collapse.collapse(items(spark, rows)).collect()}
    assert sum(whole.values()) == 14 and whole[12] == 3 and whole[3] == 1
    assert collapse.copies(items(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("bits", [1 << 13, 1 << 20])
def test_copies_equal_brute_force_at_any_filter_size(spark, bits):
    rng = random.Random(2)
    rows = [(i, "search", f"w{rng.randint(0, 900)} " + "long " * (2000 if i == 5 else 0), None) for i in range(1500)] + [(5000 + i, "search", "hot one", None) for i in range(800)]
    groups = defaultdict(list)
    for i, _, t, _ in rows:
        groups[t.strip()].append(i)
    want = sorted((min(g), i) for g in groups.values() for i in g if i != min(g))
    got = collapse.copies(items(spark, rows).repartition(4), most_bits=bits)
    assert sorted((r["keep_id"], r["copy_id"]) for r in got.collect()) == want


def test_no_repeat_escapes_the_filter(spark):
    rows = [(i, "search", f"t{i % 700}", None) for i in range(1000)]
    possible, single = collapse.split_repeats(items(spark, rows).repartition(5))
    counts = Counter(t for _, _, t, _ in rows)
    kept = {r["item_id"] for r in possible.collect()}
    assert all(i in kept for i, _, t, _ in rows if counts[t] > 1)
    assert len(kept) + single.count() == 1000 and len(kept) < 650


# ---- residue

CASES = [
    ("Hello {{ user.name }}, a real text follows here.", True),
    ("# %%HEADLINE%%\n\nA real text.", True),
    ("Write `{{title}}` where the heading goes.", False),
    ("In code:\n```\n${name}\n```\nas an example.", False),
    ("[INSERT DATE HERE] and more", True),
    ("See [your account](https://a.example/x) for more.", False),
    ("【ここに本文を入れる】", True),
    ("Placeholder text, please replace. Placeholder text, please replace.", True),
    ("blah blah blah", True),
    ("# Title\n\nIpsum dolor amet lorem velit magna. Nulla ipsum amet dolor.", True),
    ("404 Not Found\n\nThe page you are looking for is not here.", True),
    ("Home | News | Contact\n\nPlease enable JavaScript to view this page.", True),
    ("Fehler 404: Diese Seite wurde nicht gefunden.\n\nArchiv\n© 2023", True),
    ("このページを表示するにはJavaScriptを有効にしてください。", True),
    ("Access denied. Incident 12.", True),
    ("A 404 answer only tells the reader that an address leads nowhere.", False),
    ("She enabled JavaScript in the settings and read on.", False),
    ("Une erreur 404 indique seulement que l'adresse ne mène nulle part.", False),
    ("<|endoftext|> <s> ====", False),
    ("", False),
    ("  \n", False),
    (None, False),
]


def test_residue(spark):
    rows = [(i, t, f"https://a.example/x/slug-{i}", "c") for i, (t, _) in enumerate(CASES)] + [(99, "Real text. " * 60_000 + "{{x}}", None, "c"), (0, CASES[0][0], None, "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, url string, place string")
    got = {r["doc_id"] for r in residue.judge(df).collect()}
    assert got == {i for i, (_, flag) in enumerate(CASES) if flag} | {99}
    assert residue.judge(df.limit(0)).count() == 0


def test_unknown_messages_are_known_by_their_echo(spark):
    text = "Please wait while we check your browser"
    rows = [(i, text, f"https://h{i % 2}.example/story-{chr(97 + i)}") for i in range(4)] + [(9, "Please wait for me by the old gate", "https://h1.example/x")]
    got = {r["doc_id"] for r in residue.judge(spark.createDataFrame(rows, "doc_id bigint, text string, url string")).collect()}
    assert got == {0, 1, 2, 3}


LONG = "".join(f"Mill {i} by the river was repaired and the road along it opened again in May. " for i in range(20))


@pytest.mark.parametrize("text", [LONG + "｛｛ user.name ｝｝", LONG + "{{ us​er.name }​}", "".join(f"Ｌｏｒｅｍ ｉｐｓｕｍ ｄｏｌｏｒ ｓｉｔ ａｍｅｔ nulla pariatur {i}. " for i in range(20))])
def test_residue_in_disguise_at_any_length(spark, text):
    assert len(text) >= 800
    df = spark.createDataFrame([(1, text, "https://a.example/x/mill"), (2, LONG + "é", "https://a.example/x/mill")], "doc_id bigint, text string, url string")
    assert [r["doc_id"] for r in residue.judge(df).collect()] == [1]


def test_messages_under_long_menus(spark):
    menu = "\n".join(" | ".join(f"Section {i}{c}" for c in "abcdef") for i in range(20))
    text = f"{menu}\n404 Not Found\n\nThe page you are looking for is not here.\n© 2023 {'All rights reserved. ' * 20}"
    assert len(text) > 1_280
    df = spark.createDataFrame([(1, text, "https://a.example/x/mill")], "doc_id bigint, text string, url string")
    assert [r["doc_id"] for r in residue.judge(df).collect()] == [1]


@pytest.mark.parametrize("text", ["La pagina non esiste.", "Bitte später erneut versuchen.", "Der Dienst ist zurzeit gestört.", "Retry after 30 seconds."])
def test_every_message_of_the_pattern_is_one(text):
    assert residue.message([text])


@pytest.mark.parametrize(
    "text, is_one",
    [
        ("Something went wrong with the northern pillar, engineers said.", False),
        ("Please log in to the library catalogue before you borrow books.", False),
        ("An error occurred in the ledger that the harbour office kept for years.", False),
        ("Something went wrong while loading this page.", True),
        ("Something went wrong. Please try again later.", True),
        ("Please log in to continue.", True),
        ("An error has occurred.", True),
        ("404 Not Found\nThe page could not be found.\n" + "\n".join("Menu word" for _ in range(80)), True),
        ("404 Not Found\n" + "The archive opens at noon and closes when the last reader leaves. " * 9, False),
    ],
)
def test_phrases_that_real_sentences_use_too(text, is_one):
    title, lines = residue._remaining(text)
    assert residue.message([title, *lines] if title else lines) == is_one


def test_filler_of_many_sentences_and_of_any_stock_word():
    assert residue.filler(" ".join(f"Placeholder text number {i}." for i in range(20)))
    assert residue.filler(" ".join(f"{i} PLACEHOLDER TEXT." for i in range(20)))
    assert residue.filler(" ".join(f"Et ıl tuo testo qui, {i}." for i in range(20)))
    assert residue.filler("Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.")
    assert not residue.filler(LONG + "A placeholder text stood on the wall.")


@pytest.mark.parametrize("text", ["texte de remplissage", "Texte d’exemple", "testo segnaposto", "o seu texto aqui", "il tuo testo va qui", "hier ihr text", "サンプル文", "여기에 글", "текст-заполнитель", "在此填写"])
def test_every_stock_phrase_passes_the_gate(text):
    assert residue._STOCK.search(text) and residue._has_stock(text, text.lower())


HEADED = [
    ("# 404 Not Found\n\nThe page you are looking for is not here.", "forest-walks", True),
    ("# Forest walks\n\nPlease enable JavaScript to view this page.", "forest-walks", True),
    ("# Zugriff verweigert\n\nBitte melden Sie sich an.", "mill", True),
    ("# Not Found\n\nThe page was not found.", "not-found", True),
    ("# Reading a bad gateway log\n\nReading the log of a bad gateway starts with its last line.", "reading-bad-gateway-log", False),
    ("# The old mill\n\nIt was repaired in May.", "old-mill", False),
]


def test_headed_messages(spark):
    rows = [(i, t, f"https://a.example/x/{slug}") for i, (t, slug, _) in enumerate(HEADED)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, url string")
    assert {r["doc_id"] for r in residue.judge(df).collect()} == {i for i, x in enumerate(HEADED) if x[2]}


def test_echoes_under_titles_of_their_own(spark):
    names = ["Forest walks", "River mills", "Night trains", "Clay kilns"]
    rows = [(i, f"# {n}\n\nPlease wait while we check your browser", f"https://h{i % 2}.example/{n.lower().replace(' ', '-')}") for i, n in enumerate(names)]
    rows += [(10 + i, "# Garden gates\n\nPlease close garden gates behind you", f"https://h{i % 2}.example/x-{chr(97 + i)}") for i in range(4)]  # the title names it
    got = {r["doc_id"] for r in residue.judge(spark.createDataFrame(rows, "doc_id bigint, text string, url string")).collect()}
    assert got == {0, 1, 2, 3}


def several_sites():
    """A site with low contents, a small one, and pages without a url, one named in its texts only."""
    rows = site_pages(40)
    small = [H.page(100 + i, rows[i][4], url="https://c.example/x") for i in range(2)]
    bare = [H.page(200, rows[0][4], url=None), H.page(201, rows[1][4], url=None, title="X | The Gamma Post"), H.page(202, [H.block("p", "Lost menus"), *rows[2][4]], url=None)]
    return rows + small + bare, [("a.example", "The Alpha Notes", "en"), ("b.example", "Alpha", "en"), ("c.example", "The Gamma Post", "en")]


@pytest.mark.parametrize("limit, at", [("HELD", 3), ("NAMES", 2)])
def test_bodies_are_the_same_beyond_any_limit(spark, monkeypatch, limit, at):
    rows, known = several_sites()
    df, sites = H.pages(spark, rows), H.sites(spark, known)
    want = {tuple(r) for r in sitetree.boilerplate(df, sites).collect()}
    assert {100, 101, 200, 201, 202} <= {page for page, _ in want}
    monkeypatch.setattr(sitetree, limit, at)
    assert {tuple(r) for r in sitetree.boilerplate(df, sites).collect()} == want


def test_names_of_many_sites(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcde") for _ in range(n))
    names = {f"h{i}.example": word(rng.randint(3, 9)) for i in range(6_000)}
    held, stored = sitetree.Names(names), sitetree.StoredNames(spark.createDataFrame(list(names.items()), "host string, name string"))
    for key in [word(rng.randint(0, 60)) for _ in range(40)] + ["xyz", ""]:
        inside = {n for n in names.values() if n in key}
        want = min((h for h, n in names.items() if n == min(inside, key=lambda n: (-len(n), n))), default=None) if inside else None
        assert held.longest(key) == stored.longest(key) == want
    for host in [*list(names)[:20], "none.example"]:
        assert held.name(host) == stored.name(host) == names.get(host, "")
    assert sitetree._named(None, [list(names.values())[7]], held) is not None  # beyond 5,000 sites


def test_pages_without_paragraphs_have_a_language(spark):
    de, en = SENTENCE["de"], SENTENCE["en"]
    listed = [H.block("h", "Liste", 1), *[H.block("li", de) for _ in range(3)]]
    cells = [H.block("table", "", rows=[[[(de,)], None], None]), H.block("p", "12")]
    picture = ("p", 0, None, [("[image: a dog]", None, True), (de, None, False)], None, False)
    rows = [H.page(1, listed, url="https://s1.example/"), H.page(2, cells, url="https://s2.example/"), H.page(3, [H.block("p", de, caption=True)], url="https://s3.example/")]
    rows += [H.page(4, [H.block("p", de, link=None), H.block("pre", en * 9)], url="https://s4.example/"), H.page(5, [H.block("pre", en * 9)], url="https://s5.example/")]
    rows += [story(6, "en", "en", [picture]), story(7, "en", "en", [H.block("p", de, caption=True)])]
    words, samples = spark.createDataFrame(WORDS, "lang string, word string"), spark.createDataFrame(SAMPLES, "lang string, text string")
    got = {(r["page_id"], r["pos"]): r["lang"] for r in language.languages(H.pages(spark, rows), H.sites(spark), words, samples).collect()}
    assert {i: x for (i, pos), x in got.items() if pos == -1} == {1: "de", 2: "de", 3: "de", 4: "de", 6: "en", 7: "en"}
    assert got[6, 4] == got[7, 4] == "de"
    assert all(pos >= -1 and x for (_, pos), x in got.items())


def test_cleaned_pages_keep_tables_and_every_page(spark):
    rows = line_pages(40) + [H.page(50, [H.block("p", "Share this")], url="https://a.example/50"), H.page(51, [H.block("table", "", rows=[[[("a",)], [("b",)]], [[("c",)]]])], url="https://a.example/51")]
    df = H.pages(spark, rows)
    clean = {(r["page_id"], r["pos"]): r["text"] for r in repeats.without(df, repeats.find(df)).collect()}
    assert clean[3, 1] == "Share this" and clean[51, 0] == "a\tb\nc"
    assert clean[50, -1] == "" and {page for page, _ in clean} == {r[0] for r in rows}


def test_filters_grow_with_the_rows():
    for rows in (0, 1, 10_000, 10**9, 10**11):
        layout = collapse.Layout.of(rows, collapse.MOST_BITS)
        assert layout.bits <= collapse.MOST_BITS and layout.bits * layout.ranges >= collapse.BITS_PER_ROW * rows


@pytest.mark.parametrize("rows, most", [(1_000, 1 << 28), (60_000, 1 << 13), (300_000, 1 << 23)])
def test_few_singletons_pass_the_filters_at_any_layout(rows, most):
    layout = collapse.Layout.of(rows, most)
    h = np.random.default_rng(5).integers(-(1 << 62), 1 << 62, rows)
    h[: rows // 10] = h[rows // 10 : 2 * (rows // 10)]  # a tenth is repeated
    size = -(-layout.bits * layout.ranges // 8 // collapse.CHUNK) * collapse.CHUNK
    again = np.zeros(size, np.uint8)
    once = again.copy()
    for part in np.array_split(h, 7):
        for chunk, seen, twice in collapse._pieces(part, layout):
            at = slice(chunk * collapse.CHUNK, (chunk + 1) * collapse.CHUNK)
            seen, twice = (collapse._bits(pa.py_buffer(x)) for x in (seen, twice))
            again[at] |= twice | (once[at] & seen)
            once[at] |= seen
    passed = collapse._has(again, layout.places(h).ravel()).reshape(-1, collapse.PROBES).all(axis=1)
    repeated = np.isin(h, h[: rows // 10])
    assert passed[repeated].all()
    assert passed[~repeated].mean() < 0.03


def test_copies_are_the_same_in_groups_of_ranges(spark, monkeypatch):
    rows = [(i, "search", f"t{i % 1700}", None) for i in range(2400)]
    want = sorted(tuple(r) for r in collapse.copies(items(spark, rows)).collect())
    monkeypatch.setattr(collapse, "HELD", 2)
    assert collapse.Layout.of(2400, 1 << 13).groups == 3
    assert sorted(tuple(r) for r in collapse.copies(items(spark, rows), 1 << 13).collect()) == want
    assert want == [(i, i + 1700) for i in range(700)]


@pytest.mark.parametrize("limit", ["HELD", "HELD_BYTES"])
def test_repeated_lines_are_the_same_beyond_any_limit(spark, monkeypatch, limit):
    df = H.pages(spark, line_pages(40) + line_pages(3))
    want = {tuple(r) for r in repeats.find(df).collect()}
    lookup = repeats.held(repeats.repeated(repeats.lines(df)))
    clean = sorted(tuple(r) for r in repeats.clean(df, lookup).collect())
    assert clean == sorted(tuple(r) for r in repeats.without(df, repeats.find(df)).collect())
    monkeypatch.setattr(repeats, limit, 0)
    assert repeats.held(repeats.repeated(repeats.lines(df))) is None
    assert {tuple(r) for r in repeats.find(df).collect()} == want


def test_lookup_equals_sets():
    rng = np.random.default_rng(11)
    sets = {(s, k, h): np.unique(rng.integers(0, 1 << 16, n)) for s, k, h, n in [(1, 5, 0, 9), (1, 5, 1, 30_000), (2, 5, 0, 1), (-3, -5, 7, 5_000), (2, 6, 1 << 40, 4)]}
    names = np.array(list(sets), np.int64)
    payload = bitmaps._containers(np.repeat(np.arange(len(sets)), [len(v) for v in sets.values()]), np.concatenate(list(sets.values())), len(sets)).to_pylist()
    lookup = bitmaps.Lookup(names[:, 0], names[:, 1], names[:, 2], payload)
    for (s, k, h), members in sets.items():
        page = np.arange(1 << 16) + (h << 16)
        for site, key in [(s, k), (s, 99), (77, k)]:
            got = lookup.has(np.full(len(page), site), np.full(len(page), key), page)
            want = set(sets.get((site, key, h), ()))
            assert set(np.flatnonzero(got).tolist()) == {int(x) for x in want}
    assert not bitmaps.Lookup(*(np.zeros(0, np.int64),) * 3, []).has(np.array([1]), np.array([1]), np.array([1])).any()
