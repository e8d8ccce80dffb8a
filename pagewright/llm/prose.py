"""Problem 1: per-page text statistics, and by them prose told from lists, tables and junk.

One pass over the texts counts characters, words, common words, symbols, digits, lines and the characters of
sentences in every block; the statistics of a page are those of its main body (``sitetree``). Gradient-boosted trees
score them. The trees are fitted on a bounded sample of pages with weak labels: votes of structure rules, none of which
looks at the share of sentences, and which abstain where they disagree or say nothing. Every tree sees part of the
statistics only, so the score rests on many. Scores become probabilities by a logistic fit on one half of a holdout
labelled by reading (``prose_holdout.json``); the other half measures. The fitted model is ``prose_model.json``, made
by ``python -m pagewright.llm.prose_fit``.

Defined results: a body without text has zero statistics and is not prose; null blocks, spans and texts count as
empty; a redelivered page counts once; an empty table gives none; texts of any length are counted whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import sitetree
from pagewright.llm.common import PAGE_SCHEMA, Flat, pages
from pagewright.llm.repeats import CACHE
from pagewright.plans.stages import materialize
from pagewright.sources.tables import table

#: Counts of a block, in this order.
COUNTS = ("chars", "sentence_chars", "lines", "stopped_lines", "words", "common", "letters", "digits", "symbols", "broken", "separators", "linked", "short_lines", "is_list", "is_table", "is_code", "is_text", "word_chars", "odd", "listed", "distinct")
K = len(COUNTS)
#: Statistics of a page, in this order.
STATS = ("sentence_share", "text_share", "list_share", "table_share", "code_share", "link_share", "mean_line", "stopped_share", "common_share", "symbol_share", "digit_share", "mean_word", "broken_share", "separators_per_line", "short_share", "letter_share", "log_chars", "odd_share", "listed_share", "distinct_share")
RIDGE = 1.0
#: Rows of the table of common words, which is fixed; more are an error, since every task holds them.
COMMON_WORDS = 1_000_000
MODEL = Path(__file__).with_name("prose_model.json")

_STOPS = frozenset(".!?…。！？")
_CLOSERS = " \t\r\xa0”’\"'»“」』）)]"
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")
_SYMBOLS = re.compile(r"[^\w\s.,;:!?'\"()…、。，！？「」“”„«»¿¡·—–（）’\-฀-๿̀-゙゚ͯ]+")
# texts read in a wrong encoding: a lead, and what may follow it
_BROKEN_LEAD, _BROKEN_NEXT = re.compile("[ÃÂÐÑÒØÙãäåæçèéêëìíïâ]+"), re.compile("[¤-¿]+")
_CONSONANT = re.compile("[bcdfghjklmnpqrstvwxzбвгджзклмнпрстфхцчшщ]+", re.I)
_BASIC, _SPACE = re.compile("[A-Za-z]+"), re.compile(r"\s+")
_ODD_MIX = re.compile("[a-z]\\d+[a-z]+\\d")
_SPACELESS = re.compile("[぀-ヿ㐀-鿿฀-๿]+")
_THAI = re.compile("[฀-๿]")
_BLANKLESS_FORM = re.compile("[가-힣а-яё]")
_COMMA = re.compile("[,،、，]")

LETTER, DIGIT, SYMBOL, SPACELESS, LEAD, NEXT, CONSONANT, BASIC, BLANK = (1 << i for i in range(9))
_WIDE = 0x20000


@cache
def _classes() -> np.ndarray:
    """What each character is, as bits; ``_WIDE`` stands for the ideographs beyond, and the place after it for the rest."""
    table = np.zeros(_WIDE + 2, np.uint16)
    every = "".join(" " if 0xD800 <= c < 0xE000 else chr(c) for c in range(_WIDE))
    for bit, pattern in ((LETTER, _LETTERS), (DIGIT, _DIGITS), (SYMBOL, _SYMBOLS), (SPACELESS, _SPACELESS), (LEAD, _BROKEN_LEAD), (NEXT, _BROKEN_NEXT), (CONSONANT, _CONSONANT), (BASIC, _BASIC), (BLANK, _SPACE)):
        for m in pattern.finditer(every):
            table[m.start() : m.end()] |= bit
    table[0xD800:0xE000] = SYMBOL
    table[_WIDE], table[_WIDE + 1] = LETTER, SYMBOL
    return table


class Signs(NamedTuple):
    """The characters of a text by what they are; ``odd`` counts runs of five consonants, ``mixed`` whether a basic letter is followed by a digit."""

    letters: int
    digits: int
    symbols: int
    spaceless: int
    broken: int
    odd: int
    mixed: int
    blanks: int


def signs_of(texts: list[str]) -> list[Signs]:
    """``Signs`` of every text, all texts at once."""
    if not texts:
        return []
    raw = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    if raw.max() >= _WIDE:
        raw = np.where(raw < _WIDE, raw, np.where(raw < 0x323B0, _WIDE, _WIDE + 1))
    is_ = _classes()[raw]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    count = lambda flags: np.add.reduceat(flags, starts, dtype=np.int64)
    follows = np.zeros(len(raw), bool)
    follows[:-1] = (is_[:-1] & LEAD > 0) & (is_[1:] & NEXT > 0)
    follows[:-1] |= (raw[:-1] >= 0xE0) & (raw[:-1] <= 0xEF) & (raw[1:] == 0xA4)
    follows |= raw == 0xFFFD
    consonant = np.r_[False, is_ & CONSONANT > 0, False]
    edges = np.flatnonzero(consonant[1:] != consonant[:-1])
    runs = (edges[1::2] - edges[::2]) // 5
    odd = np.bincount(np.searchsorted(starts, edges[::2][runs > 0], "right") - 1, runs[runs > 0], len(texts)).astype(np.int64)
    mixed = np.zeros(len(raw), bool)
    mixed[:-1] = (is_[:-1] & BASIC > 0) & (is_[1:] & DIGIT > 0)
    columns = [*(count(is_ & bit > 0) for bit in (LETTER, DIGIT, SYMBOL, SPACELESS)), count(follows), odd, count(mixed), count(is_ & BLANK > 0) - 1]
    return list(map(Signs._make, zip(*(c.tolist() for c in columns))))


def _listed(line: str) -> bool:
    """Whether a line without any stop is an enumeration: three short pieces or more, commas between."""
    pieces = _COMMA.split(line)
    if len(pieces) < 3 or len(line) > 45 * len(pieces) or any(c in line for c in ".!?。！？…"):
        return False
    return line.count(" ") <= 6 * len(pieces)


def count_block(text: str, kind: str, linked: int, common: frozenset[str], pieces: re.Pattern | None, signs: Signs | None = None) -> tuple[int, ...]:
    """COUNTS of one block's text; ``signs`` may come from a count of many texts at once."""
    letters, digits, symbols, spaceless, broken, odd, mixed, blanks = signs or signs_of([text])[0]
    n = len(text)
    low = text.lower()
    words = low.split()
    word_count = len(words)
    known = sum(map(common.__contains__, words))
    word_chars = n - blanks
    if mixed:
        odd += len(_ODD_MIX.findall(low))
    separators = text.count(";") + text.count("|") + text.count("\t") + text.count(" · ") + text.count(" / ")
    # odd letter sequences tell against a text where few words are common ones
    doubt = odd if known * 12 < word_count else 0
    distinct = len(set(words))
    if kind == "table" or kind == "pre":
        separators = 0  # they belong there
    blankless = spaceless * 3 > n
    if blankless:  # a script without blanks: two characters count as a word
        word_count = distinct = max(word_count, n // 2)  # which are not told apart
        if pieces is not None:
            known += len(pieces.findall(text))
    lines = text.split("\n")
    stopped = short = sentence = listed = 0
    for line in lines:
        size = len(line)
        short += size < 40
        end = line.rstrip(_CLOSERS)
        ends = end[-1:] in _STOPS and end != ""
        stopped += ends
        if not ends and size > 20 and _listed(line):
            listed += size
            continue
        if kind in ("table", "pre", "h") or kind == "li" and not ends or broken or doubt * 4 >= word_count:
            continue
        if separators and ((line.count(";") + line.count("|")) * 40 > size or "\t" in line):
            continue
        if not ends and (linked * 2 > n or line.count(" / ") + line.count(" · ") > 1):  # collections of links
            continue
        if blankless:
            gaps = line.count(" ")
            if gaps > 4 and size < 7 * gaps:  # single words in a row
                continue
            if ends and size >= 8 or size >= 18 and (size >= 30 or not _THAI.search(line)):
                sentence += size
            continue
        parts = words if len(lines) == 1 else line.lower().split()
        count = len(parts)
        if count < 3 or not ends and count < 8:
            continue
        usual = known if len(lines) == 1 else sum(map(common.__contains__, parts))
        if usual * 4 > count * 3 or not ends and len(set(parts)) * 2 <= count:  # common words or a few words in turn
            continue
        if usual * 10 >= count or count < 10 and usual or ends and count > 3 and not doubt or _BLANKLESS_FORM.search(line.lower()):
            sentence += size
    return n, sentence, len(lines), stopped, word_count, known, letters, digits, symbols, broken, separators, linked, short, n * (kind == "li"), n * (kind == "table"), n * (kind == "pre"), n * (kind in ("p", "quote", "h")), word_chars, odd, listed, distinct


_ASIAN = ("ja", "zh", "th")


def common_rows(common_words: DataFrame) -> list:
    """All rows of the fixed table of common words."""
    rows = common_words.select("lang", "word").distinct().limit(COMMON_WORDS + 1).collect()
    if len(rows) > COMMON_WORDS:
        raise ValueError(f"more than {COMMON_WORDS} common words")
    return rows


def common_sets(rows: list) -> tuple[frozenset[str], str]:
    """The common words of all languages written with blanks, and a pattern of those of the others."""
    words = frozenset(r["word"].lower() for r in rows if r["word"] and r["lang"] not in _ASIAN)
    pieces = sorted({r["word"] for r in rows if r["word"] and r["lang"] in _ASIAN}, key=lambda w: (-len(w), w))
    return words, "|".join(map(re.escape, pieces))


@cache
def _pattern(p: str) -> re.Pattern | None:
    return re.compile(p) if p else None


_short_blocks: dict[tuple, tuple[int, ...]] = {}
_NOTHING = (0,) * K


class CountExtra:
    """Adds ``counts`` (COUNTS of every block, one after another) to the analysis of pages."""

    FIELDS = "counts array<int>"

    def __init__(self, words: frozenset[str], pieces: str):
        self.words, self.pieces = words, pieces

    def __call__(self, b: pa.RecordBatch, flat: Flat, parts: list) -> list[pa.Array]:
        pattern = _pattern(self.pieces)
        linked = flat.linked.tolist()
        texts = [t if t or k != "table" else flat.table_text(i) for i, (k, t) in enumerate(zip(flat.kind, flat.text))]
        short = _short_blocks
        if len(short) > CACHE:
            short.clear()
        out = [_NOTHING if not t else short.get((t, k, n)) if len(t) < 80 else None for t, k, n in zip(texts, flat.kind, linked)]  # menus and prompts recur
        fresh = [i for i, counts in enumerate(out) if counts is None]
        for i, signs in zip(fresh, signs_of([texts[i] for i in fresh])):
            kind, text = flat.kind[i], texts[i]
            out[i] = counts = count_block(text, kind or "p", linked[i], self.words, pattern, signs)
            if len(text) < 80:
                short[text, kind, linked[i]] = counts
        values = np.array(out, np.int32).reshape(-1)
        return [pa.ListArray.from_arrays(pa.array((flat.starts * K).astype(np.int32)), pa.array(values))]


def page_stats(counts: np.ndarray, keep: np.ndarray, page: np.ndarray, pages_: int) -> np.ndarray:
    """STATS of each page, of the counts of its kept blocks."""
    total = np.zeros((pages_, K))
    np.add.at(total, page[keep], counts[keep])
    c = dict(zip(COUNTS, total.T))
    part = lambda a, b: a / np.maximum(b, 1)
    return np.stack([
        part(c["sentence_chars"], c["chars"]), part(c["is_text"], c["chars"]), part(c["is_list"], c["chars"]), part(c["is_table"], c["chars"]), part(c["is_code"], c["chars"]),
        part(c["linked"], c["chars"]), part(c["chars"], c["lines"]), part(c["stopped_lines"], c["lines"]), part(c["common"], c["words"]), part(c["symbols"], c["chars"]),
        part(c["digits"], c["chars"]), part(c["word_chars"], c["words"]), part(c["broken"], c["chars"]), part(c["separators"], c["lines"]), part(c["short_lines"], c["lines"]),
        part(c["letters"], c["chars"]), np.log1p(c["chars"]), part(c["odd"], c["words"]),
        part(c["listed"], c["chars"]), part(c["distinct"], c["words"]),
    ], axis=1)


# ---- gradient-boosted trees -------------------------------------------------------------------------------------


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, least: int = 20, part: int = 3) -> dict:
    """Trees for the log odds of ``y``: second-order boosting of the logistic loss on binned statistics. Tree t sees
    one in ``part`` of the statistics, dealt by t, so that no single one decides."""
    cuts = np.linspace(0, 1, bins + 1)[1:-1]  # bins of equal count and of equal width
    edges = [np.unique(np.r_[np.quantile(c, cuts), c.min() + (c.max() - c.min()) * cuts]) for c in x.T]
    code = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    p0 = np.clip(y.mean(), 0.01, 0.99)
    score = np.full(len(y), np.log(p0 / (1 - p0)))
    model = {"base": float(score[0]) if len(y) else 0.0, "trees": []}
    dealt = np.random.default_rng(7)  # a fixed seed: the same rows give the same model

    def grow(rows: np.ndarray, level: int) -> dict:
        g, h = grad[rows].sum(), hess[rows].sum()
        leaf = {"v": float(-g / (h + 1.0) * rate)}
        if level == depth or len(rows) < 2 * least:
            return leaf
        best = (1e-6, None, None)
        for j in seen:
            e = edges[j]
            if not len(e):
                continue
            gs = np.bincount(code[rows, j], grad[rows], len(e) + 1).cumsum()[:-1]
            hs = np.bincount(code[rows, j], hess[rows], len(e) + 1).cumsum()[:-1]
            ns = np.bincount(code[rows, j], minlength=len(e) + 1).cumsum()[:-1]
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(ns < least) | (len(rows) - ns < least)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k)
        if best[1] is None:
            return leaf
        _, j, k = best
        left = code[rows, j] <= k
        return {"j": int(j), "t": float(edges[j][k]), "l": grow(rows[left], level + 1), "r": grow(rows[~left], level + 1)}

    for t in range(trees):
        if t % part == 0:
            order = dealt.permutation(len(edges))
        seen = order[t % part :: part]
        p = 1 / (1 + np.exp(-score))
        grad, hess = p - y, p * (1 - p)
        tree = grow(np.arange(len(y)), 0)
        model["trees"].append(tree)
        score += _tree(tree, x)
    return model


def _tree(node: dict, x: np.ndarray) -> np.ndarray:
    if "v" in node:
        return np.full(len(x), node["v"])
    left = x[:, node["j"]] <= node["t"]
    out = np.empty(len(x))
    out[left], out[~left] = _tree(node["l"], x[left]), _tree(node["r"], x[~left])
    return out


def raw_score(model: dict, x: np.ndarray) -> np.ndarray:
    return model["base"] + sum((_tree(t, x) for t in model["trees"]), np.zeros(len(x)))


def calibrate(model: dict, x: np.ndarray, y: np.ndarray) -> dict:
    """The logistic fit of scores on a holdout, drawn to slope 1 and offset 0, with targets drawn in as if each class
    had one more of the other."""
    z = raw_score(model, x)
    pos, neg = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-(a * z + b)))
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - t) * z).sum() + RIDGE * (a - 1), (p - t).sum() + RIDGE * b])
        hess = np.array([[(w * z * z).sum() + RIDGE, (w * z).sum()], [(w * z).sum(), w.sum() + RIDGE]])
        step = np.clip(np.linalg.solve(hess, g), -0.5, 0.5)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return model | {"slope": float(a), "offset": float(b)}


def probability(model: dict, x: np.ndarray) -> np.ndarray:
    """The probability that pages of statistics ``x`` are prose."""
    return 1 / (1 + np.exp(-(model["slope"] * raw_score(model, x) + model["offset"])))


def weak_labels(x: np.ndarray) -> np.ndarray:
    """1 prose, 0 structural junk, -1 no opinion: votes of rules on the structure of pages, blind to the share of sentences."""
    s = dict(zip(STATS, x.T))
    running = (s["text_share"] > 0.6) & (s["mean_line"] > 40) & (s["link_share"] < 0.3) & (s["listed_share"] < 0.2)
    clean = (s["broken_share"] < 0.003) & (s["odd_share"] < 0.03) & (s["separators_per_line"] < 0.5) & (s["code_share"] < 0.1) & (s["table_share"] < 0.2)
    prose = (running & clean & (s["stopped_share"] > 0.5)).astype(int) + (
        running & clean & (s["distinct_share"] > 0.25) & (s["mean_line"] > 60) & ((s["stopped_share"] > 0.25) | (s["common_share"] < 0.33))
    )
    junk = sum(
        v.astype(int)
        for v in (
            s["list_share"] > 0.6,
            s["link_share"] > 0.5,
            s["table_share"] + s["code_share"] > 0.5,
            s["separators_per_line"] * 60 > s["mean_line"],
            s["listed_share"] > 0.5,
            s["broken_share"] > 0.03,
            s["odd_share"] > 0.15,
            s["common_share"] > 0.8,
            s["symbol_share"] > 0.2,
            s["distinct_share"] < 0.1,
            (s["stopped_share"] < 0.05) & (s["mean_line"] < 32),
            (s["stopped_share"] < 0.05) & (s["digit_share"] > 0.03),
        )
    )
    return np.where((junk > 0) & (prose == 0) | (junk > 1), 0, np.where((prose > 0) & (junk == 0), 1, -1))


@cache
def load_model(path: str = str(MODEL)) -> dict:
    return json.loads(Path(path).read_text())


# ---- pages ------------------------------------------------------------------------------------------------------


def analysed(page_docs: DataFrame, sites: DataFrame, common_words: DataFrame) -> tuple[DataFrame, sitetree.Low]:
    """The structure of pages with the counts of their blocks, and what decides their bodies."""
    extra = CountExtra(*common_sets(common_rows(common_words)))
    page_docs = page_docs.select("page_id", "url", "title", "blocks")
    structured = materialize(sitetree.analyse(page_docs, sitetree.site_names(sites), extra, extra.FIELDS), "statistics")
    return sitetree.with_low(structured, sitetree.low_contents(structured, sites))


def bodies(b: pa.RecordBatch, low: sitetree.Low) -> np.ndarray:
    """Which blocks of the pages of a batch are body, one after another."""
    out: list[bool] = []
    cols = (b.column(c).to_pylist() for c in ("as_site", "first", "kinds", "levels", "flags", "keys", "low"))
    for as_site, first, kinds, levels, flags, keys, own in zip(*cols):
        is_low, lead_low = low.of(as_site, own)
        out.extend(sitetree.body_flags(first, kinds, levels, flags, keys, is_low, lead_low))
    return np.array(out, bool)


def batch_stats(b: pa.RecordBatch, low: sitetree.Low, body: np.ndarray | None = None) -> np.ndarray:
    body = bodies(b, low) if body is None else body
    counts = b.column("counts")
    values = np.asarray(counts.flatten()).reshape(-1, K)
    page = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(counts.offsets)) // K)
    return page_stats(values, body, page, b.num_rows)


def statistics(page_docs: DataFrame, sites: DataFrame, common_words: DataFrame, model: dict | None = None) -> DataFrame:
    """(page_id, STATS, prose): the statistics of each page's main body and the probability that it is prose."""
    ready, low = analysed(page_docs, sites, common_words)
    model = model or load_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = batch_stats(b, low)
                yield pa.RecordBatch.from_arrays([b.column("page_id"), *map(pa.array, x.T), pa.array(probability(model, x))], ["page_id", *STATS, "prose"])

    fields = ", ".join(f"{s} double" for s in STATS)
    return ready.mapInArrow(run, f"page_id bigint, {fields}, prose double").dropDuplicates(["page_id"])


def page_statistics(spark: SparkSession, data_dir: str) -> DataFrame:
    """p1_statistics: every page's statistics."""
    return statistics(pages(spark, data_dir, PAGE_SCHEMA), table(spark, data_dir, "sites"), table(spark, data_dir, "common_words"))


def found(spark: SparkSession, data_dir: str) -> DataFrame:
    """p1_found: pages whose main body is not natural prose."""
    return page_statistics(spark, data_dir).where("prose < 0.5").select("page_id")
