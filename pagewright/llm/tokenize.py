"""Problem 8: byte-level BPE as an automaton over token labels.

The merges are compiled one after another into a deterministic automaton whose arcs carry tokens. It starts as one
state with an arc for every byte. The gadget of a merge (a, b) -> c gives every state with an arc a an arc c that
leads where b led, and sends arc a to a copy of its old target that lacks arc b. In the end exactly the token
sequences that the merges produce are paths. A state is stored as what the gadgets took from it:

* the target of arc a is the state of a: it lacks b from the step of (a, b) on;
* the state of c = ab is the state that b had at that step, so it lacks what was taken from b before;
* a state has arc c = ab if it had arc a at that step.

So whether arc u leaves the state of token x is read from two chains (x and its right parts, u and its left parts)
and a table of steps; answers are kept. A word is encoded by byte transitions of a trie, longest arc first, stepping
back from a position whose arcs all fail; the path is unique. Decoding emits the bytes of the arcs' labels.

Defined results: a null and an empty text give an empty list; blanks are text; marks of tokenizers in a text are
ordinary text; texts of any length are encoded whole; repeated rows give repeated rows.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.sources.tables import table

#: Folder of the public vocabulary files: a parameter, here its default.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
NAME = "byte_bpe_50k"
#: Fixed value: the pattern that splits a text before the merges of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept with their ids in one worker.
CACHE_WORDS = 400_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, by its rule."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenAutomaton:
    """The automaton of a merge list; ``encode_word`` and ``label`` are its two directions."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        size = max(vocab.values()) + 1
        self.label: list[bytes] = [b""] * size
        never = len(merges) + 1
        self.born = [0] * size  # step at which a token became an arc
        self.left, self.right = [-1] * size, [-1] * size
        self.taken: dict[tuple[int, int], int] = {}  # (x, u): step at which arc u was taken from the state of x
        self.never = never
        arcs: list[int] = []
        for s in alphabet:
            if s in vocab:
                self.label[vocab[s]] = raw(s)
                arcs.append(vocab[s])
        for step, (a, b) in enumerate(merges, 1):
            x, u, c = vocab[a], vocab[b], vocab[a + b]
            self._gadget(step, x, u, c)
            arcs.append(c)
        self._compile_trie(arcs)
        self._may: dict[tuple[int, int], bool] = {}

    def _gadget(self, step: int, x: int, u: int, c: int) -> None:
        """Arc u leaves the state of x; arc c joins every state with an arc x."""
        self.taken.setdefault((x, u), step)
        if not self.label[c]:
            self.label[c] = self.label[x] + self.label[u]
            self.born[c], self.left[c], self.right[c] = step, x, u

    def _compile_trie(self, arcs: list[int]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.accept: list[int] = [-1]
        for t in arcs:
            node = 0
            for byte in self.label[t]:
                to = self.next[node].get(byte)
                if to is None:
                    to = self.next[node][byte] = len(self.next)
                    self.next.append({})
                    self.accept.append(-1)
                node = to
            self.accept[node] = t
        self.shorter = [-1] * len(self.label)  # the longest arc that is a proper prefix of an arc
        stack = [(0, -1)]
        while stack:
            node, last = stack.pop()
            t = self.accept[node]
            if t >= 0:
                self.shorter[t] = last
                last = t
            stack.extend((to, last) for to in self.next[node].values())

    def has_arc(self, x: int, u: int) -> bool:
        """Whether arc u leaves the state that arc x leads to."""
        known = self._may.get((x, u))
        if known is None:
            known = self._may[x, u] = self._has_arc(x, u)
        return known

    def _has_arc(self, x: int, u: int) -> bool:
        taken, born, right, left, never = self.taken, self.born, self.right, self.left, self.never
        until_x = never
        while x >= 0:
            until_u, v = never, u
            while v >= 0:
                step = taken.get((x, v))
                if step is not None and step < until_x and step <= until_u:  # a state that lost arc a at the step of aa has no arc aa
                    return False
                until_u, v = born[v], left[v]
            until_x, x = born[x], right[x]
        return True

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """The labels of the only path that spells ``word``."""
        n, nexts, accept, label, shorter = len(word), self.next, self.accept, self.label, self.shorter
        path: list[int] = []
        dead = set()
        pos, t = 0, -1
        while pos < n:
            if t < 0:
                node, t = 0, -1
                for i in range(pos, n):
                    node = nexts[node].get(word[i], 0)
                    if not node:
                        break
                    if accept[node] >= 0:
                        t = accept[node]
            while t >= 0 and (pos + len(label[t]) in dead or path and not self.has_arc(path[-1], t)):
                t = shorter[t]
            if t >= 0:
                path.append(t)
                pos += len(label[t])
                t = -1
            else:
                dead.add(pos)
                if not path:
                    raise ValueError(f"no path spells {word!r}")
                last = path.pop()
                pos -= len(label[last])
                t = shorter[last]
                if t < 0:
                    t = last  # its end is dead, so this position dies next
        return tuple(path)

    def decode(self, ids) -> str:
        return b"".join(self.label[i] for i in ids).decode("utf-8", "replace")


class _Words(dict):
    """Words with their ids; a missing word is encoded."""

    def __init__(self, automaton: TokenAutomaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE_WORDS:
            self.clear()
            self.automaton._may.clear()
        ids = self.automaton.encode_word(word.encode("utf-8", "surrogatepass"))
        self[word] = ids
        return ids


_loaded: dict[int, tuple] = {}


def load(content: bytes) -> tuple[TokenAutomaton, _Words, object]:
    """The automaton of a vocabulary file's content, with its word table and splitting pattern; kept in the worker."""
    key = hash(content)
    if key not in _loaded:
        import regex

        model = json.loads(content)["model"]
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        automaton = TokenAutomaton(model["vocab"], merges)
        _loaded.clear()
        _loaded[key] = automaton, _Words(automaton), regex.compile(PATTERN)
    return _loaded[key]


def read_vocabulary(folder: str = TOKENIZERS, name: str = NAME) -> bytes:
    with open(os.path.join(folder, f"{name}.json"), "rb") as f:
        return f.read()


def encode_texts(texts: list, content: bytes) -> list[list[int]]:
    _, words, split = load(content)
    get = words.__getitem__
    return [list(chain.from_iterable(map(get, split.findall(t)))) if t else [] for t in texts]


def encode(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """(``id_col``, ids): the ids of every text, without special tokens."""
    spark = documents.sparkSession
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(folder, name))  # a file of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, words, split = load(vocabulary.value)
        get, find = words.__getitem__, split.findall
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                flat: list[int] = []
                offsets = [0]
                for t in b.column(1).to_pylist():
                    if t:
                        flat.extend(chain.from_iterable(map(get, find(t))))
                    offsets.append(len(flat))
                ids = pa.ListArray.from_arrays(np.array(offsets, np.int32), np.array(flat, np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0), ids], ["id", "ids"])

    out = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id bigint, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", folder: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """(``id_col``, text): the bytes of the labels of every list of ids, as text."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(folder, name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = load(vocabulary.value)[0]
        for b in batches:
            texts = [automaton.decode(ids or []) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    out = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id bigint, text string")
    return out.withColumnRenamed("id", id_col)


def ids(spark: SparkSession, data_dir: str) -> DataFrame:
    """p8_ids: doc_id and the ids of each text by byte_bpe_50k."""
    return encode(table(spark, data_dir, "documents", "doc_id bigint, text string"))
