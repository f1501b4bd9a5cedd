"""Benchmark decontamination: one Aho-Corasick automaton over all windows of normalised items.

The automaton's symbols are words: states are the beginnings of windows, with goto, failure and
output links. A text is normalised to words, each word looked up once, and the words run through
the automaton, many stretches of a text side by side in numpy. Matches come back as word positions,
and for the texts that have any, as offsets in the original text.

The automaton is built once, by the driver, and written as arrays to the shared folder; executors
fetch the file and workers map it into memory, so that those of one machine share one copy. A
benchmark over ``AUTOMATON_BYTES`` makes several such files, built one after another; a text's
words still are made once.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common
from .wordhash import Table, Vocabulary, Words

WINDOW = 10
#: Words of a text before lower-casing: digits, letters and all that isn't ASCII.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Benchmark text in one automaton; building takes about 80 bytes of the driver's memory for each.
AUTOMATON_BYTES = 4 << 20
#: Words of a text that one lane of a scan runs through.
LANE = 64


def words(text: bytes) -> list[bytes]:
    return text.translate(common.WORDS).split()


def windows(text: bytes, size: int = WINDOW) -> list[bytes]:
    w = words(text)
    return [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []


class Matcher:
    """Finds windows in texts. ``items``: pairs of an item's id, which may be None, and its text."""

    def __init__(self, items: list[tuple[int | None, bytes]], size: int = WINDOW) -> None:
        self.size = size
        self.words = Vocabulary()
        w = Words([text for _, text in items], common.WORDS)
        ids, _ = self.words.grow(w)
        first = np.cumsum(w.counts) - w.counts
        # a window for each place from which enough words follow; a short item has one
        n = np.where(w.counts > 0, np.maximum(w.counts - size, 0) + 1, 0)
        item = np.repeat(np.arange(len(items)), n)
        start = first[item] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        length = np.minimum(w.counts, size)[item]
        self._trie(ids, start, length)
        self._links()
        # whose windows end in a state
        names = sorted({x for x, _ in items if x is not None})
        place = {x: i for i, x in enumerate(names)}
        whose = np.array([place.get(x, len(names)) for x, _ in items], np.int64)[item]
        pairs = np.unique(self.ends * (len(names) + 1) + whose)
        self.names = np.array(names, np.int64)
        self.owned, self.owner_first = np.unique(pairs // (len(names) + 1), return_index=True)
        self.owners = pairs % (len(names) + 1)

    def _trie(self, ids: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        """States by length: state i + 1 is reached by the i-th key, a state and a word."""
        keys, parents, at = [], [], np.zeros(len(start), np.int64)
        self.levels, made = [0], 1
        for k in range(self.size):
            live = np.flatnonzero(length > k)
            fresh, inverse = np.unique(_key(at[live], ids[start[live] + k]), return_inverse=True)
            at[live] = made + inverse
            keys.append(fresh)
            made += len(fresh)
            self.levels.append(made - 1)
        self.table = Table(np.concatenate(keys))
        # where each word leads from the beginning, which is asked most often
        self.first = np.zeros(max(1, self.words.n), np.int32)
        self.first[keys[0].astype(np.int64)] = np.arange(1, len(keys[0]) + 1)
        self.ends = at
        self.empty = made == 1

    def _links(self) -> None:
        """Failure links, and of the windows that end in a state the longest one's length and the state of the next shorter one."""
        n = self.levels[-1] + 1
        self.fail, self.longest, self.shorter = np.zeros(n, np.int32), np.zeros(n, np.uint8), np.zeros(n, np.int32)
        own = np.zeros(n, bool)
        own[self.ends] = True
        for k in range(self.size):
            some = np.arange(self.levels[k] + 1, self.levels[k + 1] + 1)
            if k:
                keys = self.table.keys[some - 1]
                self.fail[some] = self.step(self.fail[(keys >> np.uint64(32)).astype(np.int64)], (keys & np.uint64(0xFFFFFFFF)).astype(np.int64))
            back = self.fail[some]
            self.shorter[some] = np.where(own[back], back, self.shorter[back])
            self.longest[some] = np.where(own[some], k + 1, self.longest[back])

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The states after reading a word each; a word under 0 is in no window."""
        out = np.zeros(len(state), np.int32)
        left = np.flatnonzero(word >= 0)
        at, word = state[left].astype(np.int64), word[left]
        while len(left):
            begin = at == 0
            out[left[begin]] = self.first[word[begin]]
            left, at, word = left[~begin], at[~begin], word[~begin]
            to = self.table.find(_key(at, word))
            hit = to >= 0
            out[left[hit]] = to[hit] + 1
            left, at, word = left[~hit], self.fail[at[~hit]].astype(np.int64), word[~hit]
        return out

    def scan(self, w: Words) -> np.ndarray:
        """The state after each word. Texts are run through apart from each other."""
        n = len(w.hashes)
        if self.empty or not n:
            return np.zeros(n, np.int32)
        ids = self.words.find(w)
        known = np.flatnonzero(ids >= 0)
        if not len(known):
            return np.zeros(n, np.int32)
        # a word that no window has after each text, and before the first
        warm = self.size - 1
        place = np.arange(n) + np.repeat(np.arange(len(w.counts)), w.counts)
        lanes = -(-(n + len(w.counts)) // LANE)
        line = np.full(warm + lanes * LANE, -1, np.int64)
        line[warm + place] = ids
        # a state depends on no more than the last `size` words, so a lane begins that much earlier
        grid = np.lib.stride_tricks.sliding_window_view(line, LANE + warm)[::LANE]
        out = np.zeros((lanes, LANE), np.int32)
        state = np.zeros(lanes, np.int32)
        for t in range(LANE + warm):
            state = self.step(state, grid[:, t])
            if t >= warm:
                out[:, t - warm] = state
        return out.reshape(-1)[place]

    def items_of(self, state: int) -> set[int | None]:
        """Ids of the items whose windows end in a state, the shorter ones too."""
        out: set[int | None] = set()
        while state:
            k = int(np.searchsorted(self.owned, state))
            if k < len(self.owned) and self.owned[k] == state:
                end = self.owner_first[k + 1] if k + 1 < len(self.owned) else len(self.owners)
                out |= {int(self.names[x]) if x < len(self.names) else None for x in self.owners[self.owner_first[k] : end].tolist()}
            state = int(self.shorter[state])
        return out

    def arrays(self) -> dict[str, np.ndarray]:
        own = {k: getattr(self, k) for k in ("first", "fail", "longest", "shorter", "names", "owned", "owner_first", "owners")}
        return own | {"size": np.array([self.size]), "goto_keys": self.table.keys[: self.table.n], "goto_slots": self.table.slots} | {f"word_{k}": v for k, v in self.words.arrays().items()}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray]) -> Matcher:
        out = cls.__new__(cls)
        out.size = int(arrays["size"][0])
        for k in ("first", "fail", "longest", "shorter", "names", "owned", "owner_first", "owners"):
            setattr(out, k, arrays[k])
        out.table = Table.of(arrays["goto_keys"], arrays["goto_slots"])
        out.words = Vocabulary.of({k.removeprefix("word_"): v for k, v in arrays.items() if k.startswith("word_")})
        out.empty = len(out.fail) == 1
        return out


def _key(state: np.ndarray, word: np.ndarray) -> np.ndarray:
    return (state.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64)


def find(matchers: list[Matcher], texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], list[int | None]]]:
    """Of each text the number of words, disjoint spans of hit words in order, and the sorted ids of the items found, None last."""
    w = Words(texts, common.WORDS)
    first = np.cumsum(w.counts) - w.counts
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[int | None]] = [set() for _ in texts]
    for m in matchers:
        states = m.scan(w)
        length = m.longest[states]
        ends = np.flatnonzero(length)
        docs = np.searchsorted(first, ends, "right") - 1
        for d, e, n, s in zip(docs.tolist(), ends.tolist(), length[ends].tolist(), states[ends].tolist(), strict=True):
            end = e + 1 - int(first[d])
            spans[d].append((end - n, end))
            items[d] |= m.items_of(s)
    return [(n, merged(x), sorted(y, key=lambda i: (i is None, i))) for n, x, y in zip(w.counts.tolist(), spans, items, strict=True)]


def write_arrays(spark, path: str, arrays: dict[str, np.ndarray]) -> None:
    """Arrays as one file of the shared folder, each at a multiple of 64 bytes after a line that lists them."""
    listed, at = [], 0
    for name, a in arrays.items():
        listed.append([name, a.dtype.str, len(a), at])
        at += -(-a.nbytes // 64) * 64
    head = json.dumps(listed).encode()
    head += b" " * (-(len(head) + 1) % 64) + b"\n"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(head))
        for a in arrays.values():
            raw = np.ascontiguousarray(a).tobytes()
            raw += bytes(-len(raw) % 64)
            for k in range(0, len(raw), 4 << 20):
                out.write(bytearray(raw[k : k + (4 << 20)]))
    finally:
        out.close()


def map_arrays(path: str) -> dict[str, np.ndarray]:
    """The arrays of a local file, mapped into memory."""
    with open(path, "rb") as f:
        raw = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    head = raw[: raw.find(b"\n") + 1]
    return {name: np.frombuffer(raw, kind, n, len(head) + at) for name, kind, n, at in json.loads(head)}


def original_offsets(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code points, end exclusive, of spans of words."""
    if not spans:
        return []
    at = [m.span() for m in WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in spans]


def benchmark_blocks(benchmark: DataFrame, most: int = AUTOMATON_BYTES) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items in blocks of at most about ``most`` bytes; the driver holds one block at a time."""
    block: list[tuple[int | None, bytes]] = []
    size = 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        if r["text"]:
            block.append((r["item_id"], raw := r["text"].encode()))
            size += len(raw)
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


NEW = [
    T.StructField("n_words", T.LongType(), False),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False)]), False), False),
    T.StructField("n_hit", T.LongType(), False),
    T.StructField("items", T.ArrayType(T.LongType()), False),
]


def _maker(files: list[str]):
    def make():
        from pyspark import SparkFiles

        matchers = common.kept("/".join(["automata", *files]), lambda: [Matcher.of(map_arrays(SparkFiles.get(x))) for x in files])

        def work(_: pa.RecordBatch, texts: list[bytes]) -> list:
            n, spans, hit, items = [], [], [], []
            for x, (k, found, who) in zip(texts, find(matchers, texts), strict=True):
                n.append(k)
                hit.append(sum(b - a for a, b in found))
                spans.append([{"start": a, "end": b} for a, b in original_offsets(x.decode("utf-8", "replace"), found)])
                items.append(who)
            return [n, spans, hit, items]

        return work

    return make


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def automata(benchmark: DataFrame, size: int = WINDOW) -> list[str]:
    """Build the automata of a benchmark and hand them to the executors; the names of their files."""
    spark, names = benchmark.sparkSession, []
    for block in benchmark_blocks(benchmark):
        path = common.fresh_path(spark, "automaton", keep=True)
        write_arrays(spark, path, Matcher(block, size).arrays())
        spark.sparkContext.addFile(path)
        names.append(os.path.basename(path))
    return names


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs(doc_id, text)`` with n_words, spans (in the text's code points), n_hit and items.

    Null and empty texts have no words. Items without words are skipped; one item id on several
    rows is one item, and so are all rows without an item id: their windows are hits, and ``items``
    has a null for them, last. With an empty benchmark nothing is hit. Repeated documents are treated
    alike. Other columns aren't read.
    """
    rows = docs.select("doc_id", "text")
    return common.map_text(rows, "text", _maker(automata(benchmark, size)), NEW).drop("text")


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without a hit, all columns."""
    return common.keep_rows(docs, "text", _maker(automata(benchmark, size)), NEW, "n_hit = 0")


def items_digest(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
bw AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dwin AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)),
m AS (SELECT doc_id, i, n, item_id FROM dwin JOIN win USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
