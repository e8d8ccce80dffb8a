"""Problem 2: the language of pages and of paragraphs in another language, by rank-order profiles.

A profile holds the most frequent n-grams (one and three letters, word edges as a blank) of sentences known to be in a
language, by rank. A text's own most frequent n-grams are compared with each profile by the sum of the distances
between ranks, an n-gram that a profile lacks at the greatest distance; the nearest profile wins, and the gap to the
next gives the confidence. All paragraphs of a batch are ranked together by sorting, without a loop over n-grams.

The body comes from the site style tree (``sitetree``), pages that are not prose from ``prose``.

Defined results: a text of fewer than ``LEAST_LETTERS`` known letters has no language; a page without a paragraph that
has one is judged by the other texts of its body together (headings, items, cells), without code, and has none if
they have none; a paragraph is judged without its pictures' texts; a null, empty, blank or ``und`` label is missing; case, region and script of a label do not
matter; a redelivered page counts once; an empty table gives none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import prose, sitetree
from pagewright.llm.common import PAGE_SCHEMA, Flat, fold, pages
from pagewright.plans.stages import join_small, materialize
from pagewright.sources.tables import table

#: N-grams of a profile, and of a text, that are compared.
TOP = 600
LENGTHS = (1, 3)
LEAST_LETTERS = 6
#: A paragraph is in another language than its body only if it is so much nearer to it; names tell little of a short one.
NEARER, NEARER_SHORT, SHORT = 0.12, 0.18, 80
#: Pages that are judged at a time.
SLICE = 500
#: Labelled sentences that the profiles are fitted on at most: those of the smallest hashes.
SAMPLES = 100_000

_SPACE, _RARE = 1, 2
_WIDE = 0x20000
#: Scripts whose rare letters share a sign of their own.
_SCRIPTS = [("㐀", "鿿"), ("가", "힣"), ("぀", "ヿ"), ("฀", "๿"), ("Ѐ", "ӿ"), ("A", "ɏ")]


def _letters() -> dict[int, str]:
    """The letter that each code point counts as; '' for one that is dropped. Others are blanks."""
    out = {}
    for block in (range(0x2000), range(0x2000, 0x2070), range(0x2F00, 0x2FD6), range(0x3040, 0x3100), range(0x3400, 0xA000), range(0xAC00, 0xD7A4), range(0xFB00, 0xFB07), range(0xFEFF, 0xFFDD)):
        for c in block:
            form = fold(chr(c)).lower()
            if not form or 0x300 <= c <= 0x36F or 0x1160 <= c <= 0x11FF or c in (0x3099, 0x309A):
                out[c] = ""
            elif form[0].isalpha() or 0xE31 <= c <= 0xE4E:
                out[c] = form[0]
    return out


class Profiles:
    """The profiles of all languages, for the comparison of many texts at once."""

    def __init__(self, samples: list[tuple[str, str]]):
        letters = _letters()
        seen = Counter(letters.get(ord(c), " ") for _, t in samples for c in t if ord(c) < _WIDE)
        first = _RARE + len(_SCRIPTS)
        ids = {c: first + i for i, (c, n) in enumerate(sorted(seen.items())) if c.strip() and n > 1}
        self.table = np.full(_WIDE + 1, _SPACE, np.int32)
        for code, letter in letters.items():
            if not letter:
                self.table[code] = -1
            elif letter in ids:
                self.table[code] = ids[letter]
            else:
                self.table[code] = next((_RARE + i for i, (a, z) in enumerate(_SCRIPTS) if a <= letter <= z), 0)
        self.width = max(first + len(ids), 2).bit_length()
        self.langs = sorted({lang for lang, _ in samples})
        texts = [" ".join(t for lang, t in samples if lang == x) for x in self.langs]
        block, code, rank, _ = self._ranked(texts)
        self.codes = np.unique(code)
        self.ranks = np.full((len(self.codes), len(self.langs)), 4 * TOP, np.int32)  # beyond the greatest distance
        self.ranks[np.searchsorted(self.codes, code), block] = rank

    def _ranked(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, n-gram, rank) of each text's TOP n-grams, and the letters of each text."""
        w = self.width
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        raw = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        ids = self.table[np.minimum(raw, _WIDE)]
        block = np.repeat(np.arange(len(texts)), sizes)
        keep = ids >= 0
        ids, block = ids[keep].astype(np.int64), block[keep]
        if len(ids):
            twice = np.zeros(len(ids), bool)
            twice[1:] = (ids[1:] == _SPACE) & (ids[:-1] == _SPACE)
            ids, block = ids[~twice], block[~twice]
        letter = ids != _SPACE
        count = np.bincount(block[letter], minlength=len(texts))
        high = block << (3 * w + 2)
        grams = []
        if 1 in LENGTHS:
            grams.append((high | ids)[letter])
        if 2 in LENGTHS:
            grams.append((high[:-1] | 1 << 3 * w | ids[:-1] << w | ids[1:])[(letter[:-1] | letter[1:]) & (block[:-1] == block[1:])])
        if 3 in LENGTHS:
            grams.append((high[:-2] | 2 << 3 * w | ids[:-2] << 2 * w | ids[1:-1] << w | ids[2:])[letter[1:-1] & (block[:-2] == block[2:])])
        key = np.sort(np.concatenate(grams)) if grams else np.zeros(0, np.int64)
        if not len(key):
            return np.zeros(0, np.int64), key, np.zeros(0, np.int64), count
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        times = np.diff(np.r_[new, len(key)])
        key = key[new]
        owner = key >> (3 * w + 2)
        order = np.argsort((owner << 20) + ((1 << 20) - 1 - np.minimum(times, (1 << 20) - 1)), kind="stable")
        owner = owner[order]
        start = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(texts)))]
        rank = np.arange(len(owner)) - start[owner]
        kept = rank < TOP
        return owner[kept], (key[order] & ((1 << 3 * w + 2) - 1))[kept], rank[kept], count

    def distances(self, texts: list[str]) -> np.ndarray:
        """The distance of each text to each language in 1/10,000 of the greatest; 0 for a text without a language."""
        out = np.zeros((len(texts), len(self.langs)), np.int32)
        if not texts or not len(self.codes):
            return out
        owner, code, rank, letters = self._ranked(texts)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        hit = np.flatnonzero(self.codes[at] == code)
        far = self.ranks[at[hit]]
        far -= rank[hit, None].astype(np.int32)
        np.abs(far, out=far)
        np.minimum(far, TOP, out=far)
        # n-grams in no profile are at the greatest distance from all
        total = np.zeros((len(texts), len(self.langs)))
        owners = owner[hit]
        if len(owners):
            first = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
            total[owners[first]] = np.add.reduceat(far, first, axis=0)
        total += ((np.bincount(owner, minlength=len(texts)) - np.bincount(owners, minlength=len(texts))) * TOP)[:, None]
        ok = letters >= LEAST_LETTERS
        most = np.bincount(owner, minlength=len(texts))[:, None] * float(TOP)
        out[ok] = np.maximum(np.round(total[ok] / most[ok] * 10_000), 1)
        return out


def nearest(distances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest language of each row of distances (-1: none), and the gap to the next as the confidence."""
    best = np.where(distances[:, :1].any(axis=1) if distances.size else np.zeros(len(distances), bool), distances.argmin(axis=1) if distances.size else 0, -1)
    if distances.shape[1] < 2:
        return best, (best >= 0).astype(float)
    two = np.sort(distances, axis=1)[:, :2].astype(float)
    return best, np.where(best >= 0, 1 - two[:, 0] / np.maximum(two[:, 1], 1), 0.0)


def profiles(lang_samples: DataFrame) -> Profiles:
    samples = lang_samples.select("lang", "text").distinct()
    rows = samples.orderBy(F.xxhash64("lang", "text"), "lang", "text").limit(SAMPLES).collect()
    return Profiles(sorted((r["lang"], r["text"]) for r in rows if r["lang"] and r["text"]))


def _told_text(flat: Flat, i: int) -> str:
    """The text of a block without its pictures' texts."""
    if not flat.image[i]:
        return flat.text[i]
    a, z = flat.span_starts[i], flat.span_starts[i + 1]
    return "".join(t for t, image in zip(flat.span_texts[a:z], flat.span_image[a:z].tolist()) if not image)


class LanguageExtra:
    """Adds ``told``, the places of a page's paragraphs and quotes, ``plain``, which of them are no captions and hold no
    picture, and ``far``, the distances of each to all languages (0: none), to the analysis of pages."""

    FIELDS = "told array<int>, plain array<boolean>, far array<int>"

    def __init__(self, known: Profiles):
        self.known = known

    def __call__(self, b: pa.RecordBatch, flat: Flat, parts: list) -> list[pa.Array]:
        at = np.array([i for i, (k, t) in enumerate(zip(flat.kind, flat.text)) if t and (k == "p" or k == "quote")], np.int64)
        far = self.known.distances([_told_text(flat, i) for i in at.tolist()])
        ends = np.searchsorted(at, flat.starts)
        offsets = pa.array(ends.astype(np.int32))
        told = pa.ListArray.from_arrays(offsets, pa.array(flat.pos[at].astype(np.int32)))
        plain = pa.ListArray.from_arrays(offsets, pa.array([not flat.image[i] and not flat.caption[i] for i in at.tolist()], pa.bool_()))
        return [told, plain, pa.ListArray.from_arrays(pa.array((ends * far.shape[1]).astype(np.int32)), pa.array(far.reshape(-1)))]


class _Both:
    def __init__(self, *extras):
        self.extras = extras

    def __call__(self, b: pa.RecordBatch, flat: Flat, parts: list) -> list[pa.Array]:
        return [a for e in self.extras for a in e(b, flat, parts)]


_LABEL = re.compile(r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$")


def label(declared: str | None) -> str | None:
    """The language that a label names, without region and script; None for a missing one."""
    m = _LABEL.match(declared or "")
    lang = m.group(1).lower() if m else None
    return None if lang == "und" else lang


SCHEMA = "page_id bigint, pos bigint, lang string, confidence double, declared string, prose double"
#: The place of a row that stands for a page without a paragraph that can be told.
UNTOLD = -2


def _by_other_texts(page_docs: DataFrame, untold: DataFrame, known: Profiles, everything: bool) -> DataFrame:
    """SCHEMA of the pages of ``untold`` (page_id, declared, prose, body), by all texts of their body but code at once."""
    names = known.langs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            flat = Flat(b)
            bodies, starts = b.column("body").to_pylist(), flat.starts.tolist()
            block = lambda i: flat.table_text(i) if flat.kind[i] == "table" else _told_text(flat, i)
            texts = ["\n".join(block(a + i) for i in body if i < z - a and flat.kind[a + i] != "pre") for body, a, z in zip(bodies, starts, starts[1:])]
            langs, sure = nearest(known.distances(texts))
            rows = zip(*(b.column(c).to_pylist() for c in ("page_id", "declared", "prose")))
            out = [(i, -1, names[x], float(s), d, p) for (i, d, p), x, s in zip(rows, langs.tolist(), sure) if x >= 0 and (everything or d != names[x])]
            if out:
                c = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string(), pa.float64()))], [f.split()[0] for f in SCHEMA.split(", ")])

    return join_small(page_docs.select("page_id", "blocks"), untold, "page_id").mapInArrow(run, SCHEMA)


def languages(page_docs: DataFrame, sites: DataFrame, common_words: DataFrame, lang_samples: DataFrame, everything: bool = True, model: dict | None = None) -> DataFrame:
    """The language of each page (pos -1: that of most of its body's paragraphs, else captions, else all its body's texts
    together) and of each paragraph or quote of its body, with a confidence. Without ``everything``, only what is wrong: pages of prose whose label is missing or
    another, and paragraphs in another language than their page."""
    words, pieces = prose.common_sets(prose.common_rows(common_words))
    known = profiles(lang_samples)
    if not known.langs:
        return page_docs.sparkSession.createDataFrame([], SCHEMA)
    page_docs = page_docs.select("page_id", "url", "title", "lang", "blocks")
    counts, langs_of = prose.CountExtra(words, pieces), LanguageExtra(known)
    fields = f"{counts.FIELDS}, {langs_of.FIELDS}"
    structured = sitetree.analyse(page_docs, sitetree.site_names(sites), _Both(counts, langs_of), fields, keep="lang string")
    structured = materialize(structured, "languages")
    ready, low = sitetree.with_low(structured, sitetree.low_contents(structured, sites))
    model = model or prose.load_model()
    names = known.langs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            body = prose.bodies(b, low)
            p = prose.probability(model, prose.batch_stats(b, low, body))
            counted = np.asarray(b.column("counts").flatten()).reshape(-1, prose.K)
            chars, sentence = counted[:, 0], counted[:, 1]
            least = np.where(counted[:, 6] < SHORT, NEARER_SHORT, NEARER)
            starts = np.asarray(b.column("keys").offsets).astype(np.int64)
            starts = starts - starts[0]
            far = np.zeros((len(body), len(names)), np.int32)
            of = np.repeat(starts[:-1], np.diff(np.asarray(b.column("told").offsets)))
            far[of + np.asarray(b.column("told").flatten())] = np.asarray(b.column("far").flatten()).reshape(-1, len(names))
            langs, sure = nearest(far)
            plain = np.zeros(len(body), bool)
            plain[of + np.asarray(b.column("told").flatten())] = np.asarray(b.column("plain").flatten())
            rows = []
            for i, (page_id, declared) in enumerate(zip(b.column("page_id").to_pylist(), b.column("lang").to_pylist())):
                a, z = int(starts[i]), int(starts[i + 1])
                told = np.flatnonzero(body[a:z] & (langs[a:z] >= 0)) + a
                if not len(told):
                    if everything or p[i] >= 0.5:
                        rows.append((page_id, UNTOLD, None, None, label(declared), float(p[i]), np.flatnonzero(body[a:z]).tolist()))
                    continue
                voting = told[plain[told]] if plain[told].any() else told
                votes = Counter(langs[voting].tolist())
                weight = Counter()
                for t in voting.tolist():
                    weight[int(langs[t])] += int(chars[t])
                main = max(votes, key=lambda x: (votes[x], weight[x], -x))
                same = voting[langs[voting] == main]
                declared = label(declared)
                if everything or p[i] >= 0.5 and declared != names[main]:
                    rows.append((page_id, -1, names[main], float(np.average(sure[same], weights=np.maximum(chars[same], 1))), declared, float(p[i]), None))
                for t in told.tolist():
                    gap = 1 - far[t, langs[t]] / max(far[t, main], 1)  # from the body's own language
                    if everything or p[i] >= 0.5 and langs[t] != main and gap >= least[t] and sentence[t]:
                        rows.append((page_id, t - a, names[langs[t]], float(sure[t] if langs[t] == main else gap), declared, float(p[i]), None))
            if rows:
                c = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string()), pa.array(c[3], pa.float64()), pa.array(c[4], pa.string()), pa.array(c[5], pa.float64()), pa.array(c[6], pa.list_(pa.int32()))],
                    ["page_id", "pos", "lang", "confidence", "declared", "prose", "body"],
                )

    first = materialize(ready.mapInArrow(run, f"{SCHEMA}, body array<int>"), "told")
    untold = first.where(F.col("pos") == UNTOLD).select("page_id", "declared", "prose", "body").dropDuplicates(["page_id"])
    out = first.where(F.col("pos") != UNTOLD).drop("body")
    if untold.limit(1).count():  # else the pages need not be read again
        out = out.unionByName(_by_other_texts(page_docs, untold, known, everything))
    return out.dropDuplicates(["page_id", "pos"])


def page_languages(spark: SparkSession, data_dir: str, everything: bool = True) -> DataFrame:
    """p2_languages: every page's and paragraph's language with a confidence."""
    t = lambda n: table(spark, data_dir, n)
    return languages(pages(spark, data_dir, PAGE_SCHEMA), t("sites"), t("common_words"), t("lang_samples"), everything)


def found(spark: SparkSession, data_dir: str) -> DataFrame:
    """p2_found."""
    return page_languages(spark, data_dir, everything=False).select("page_id", "pos", "lang")
