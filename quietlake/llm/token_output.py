"""Token-ID output: texts as id lists in Parquet files that allow selective reads.

Files are written by Spark's Parquet writer, format version 2: id lists are packed as deltas or
by dictionary, whichever the writer finds smaller; row groups and pages are bounded, and page
indexes (always written) let a reader with a filter on ``doc_id`` open only the pages it needs.
Metadata columns (``doc_id``, ``part``, ``start_in_part``, ``n_tokens``) are separate column
chunks, so a reader of metadata doesn't touch the ids.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .wordhash import Vocabulary, Words

#: Words whose ids a worker remembers.
CACHE_WORDS = 400_000
END_ID = 1
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10

_LETTERS = "a-zß-öø-ÿ"
_MARKS = r"!\"#$%&()*+,\-./:;=>?@\[\\\]^_`{|}~"
#: Lines that are not a run of letters, whose composed lower case is itself, and then punctuation
#: without an apostrophe or "<"; all others the tokenizer's own pattern splits exactly there.
_NOT_SIMPLE = re.compile(f"^(?![{_LETTERS}]*[{_MARKS}]*$).*$", re.M)
_STEM_END = re.compile(f"(?<=[{_LETTERS}])(?=[{_MARKS}])")


class WordEncoder:
    """Ids of texts, a word at a time.

    Holds for tokenizers that split at white space before merging, end each word's last piece
    with a suffix and don't depend on what surrounds a word; any other is used on whole texts.
    New words are encoded in batches by the same model; words that aren't plain go through the
    whole tokenizer one by one. Words met before are found by hash and compared by their bytes, so
    two words of one hash keep their own ids.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        state = lambda x: x.__getstate__().decode() if x is not None else ""
        suffix = getattr(self.whole.model, "end_of_word_suffix", None)
        split = state(self.whole.pre_tokenizer).replace(" ", "")
        norms = re.findall(r'"type":"(\w+)"', state(self.whole.normalizer).replace(" ", ""))
        self.by_word = bool(suffix) and '"invert":true' in split and "[^\\\\s" in split and [x for x in norms if x != "Sequence"] == ["NFC", "Replace", "Lowercase"] and not any(x.lstrip or x.rstrip for x in self.whole.get_added_tokens_decoder().values())
        if self.by_word:
            vocab = self.whole.get_vocab()
            self.last = np.zeros(max(vocab.values()) + 1, bool)
            self.last[[i for x, i in vocab.items() if x.endswith(suffix)]] = True
            # all three share one model, which holds nearly all of a tokenizer's memory
            self.plain, self.ascii = Tokenizer(self.whole.model), Tokenizer(self.whole.model)
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ascii.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            for x in (self.ascii, self.plain):
                x.normalizer = normalizers.Sequence([])
                x.add_special_tokens(list(self.whole.get_added_tokens_decoder().values()))
            self.whole.model._resize_cache(0)  # each word comes once
        self._forget()

    def _forget(self) -> None:
        self.words = Vocabulary()
        self.pool = np.zeros(1 << 16, "<u4")
        self.offsets = np.zeros(1 << 14, np.int64)
        self.sizes = np.zeros(1 << 14, np.int64)
        self.n = self.used = 0

    def _keep(self, found: list[bytes]) -> None:
        """Put ids into the pool; they get the next places."""
        raw = np.frombuffer(b"".join(found), "<u4")
        sizes = np.array([len(x) // 4 for x in found], np.int64)
        n, used = self.n + len(found), self.used + len(raw)
        for name, need in (("pool", used), ("offsets", n), ("sizes", n)):
            if need > len(old := getattr(self, name)):
                setattr(self, name, np.concatenate([old, np.zeros(max(need, 2 * len(old)) - len(old), old.dtype)]))
        self.pool[self.used : used] = raw
        self.sizes[self.n : n] = sizes
        self.offsets[self.n : n] = self.used + np.cumsum(sizes) - sizes
        self.n, self.used = n, used

    def _whole(self, text: str) -> bytes:
        ids = self.whole.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of the words."""
        lines = b"\n".join(words).decode("utf-8", "replace")
        names = lines.split("\n")
        odd = {x for x in _NOT_SIMPLE.findall(lines) if x}
        parts = _STEM_END.sub(" ", lines).split("\n")
        out = [self._whole(x) if x in odd else b"" for x in names]
        simple = [i for i, x in enumerate(names) if x not in odd]
        for tokenizer, places in ((self.ascii, [i for i in simple if parts[i].isascii()]), (self.plain, [i for i in simple if not parts[i].isascii()])):
            for k in range(0, len(places), 500):
                at = places[k : k + 500]
                some = [parts[i] for i in at]
                ids = np.array(tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
                ends = np.flatnonzero(self.last[ids]) + 1
                pieces = np.cumsum([2 if " " in x else 1 for x in some])
                if len(ends) == pieces[-1] and ends[-1] == len(ids):
                    raw, a = ids.tobytes(), 0
                    for i, b in zip(at, (ends[pieces - 1] * 4).tolist(), strict=True):
                        out[i] = raw[a:b]
                        a = b
                else:
                    for i in at:
                        out[i] = self._whole(names[i])
        return out

    def encode(self, texts: list[bytes], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, each text's followed by ``end``, and each text's number of ids."""
        after = [end] if end is not None else []
        # the special tokens' strings are matched before lower-casing, and over white space
        apart = [i for i, x in enumerate(texts) if not self.by_word or b"<|" in x]
        whole = {i: self._whole(texts[i].decode("utf-8", "replace")) for i in apart}
        if self.n > CACHE_WORDS:
            self._forget()
        words = Words([b"" if i in whole else x for i, x in enumerate(texts)])
        at, new = self.words.grow(words)
        if new:
            self._keep(self._ids(new))
        if self.n != self.words.n:
            raise RuntimeError("the pool and the words differ")
        sizes = self.sizes[at]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.pool[np.arange(total[-1]) + np.repeat(self.offsets[at] - total[:-1], sizes)]
        bounds = total[np.concatenate([[0], np.cumsum(words.counts)])]
        if not whole:
            if after:
                ids = np.insert(ids, bounds[1:], end)
            return ids, np.diff(bounds) + len(after)
        each = [np.frombuffer(whole[i], "<u4") if i in whole else ids[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
        each = [np.concatenate([x, np.array(after, "<u4")]) for x in each]
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType(), False), T.StructField("row_in_part", T.LongType(), False), T.StructField("start_in_part", T.LongType(), False), T.StructField("n_tokens", T.LongType(), False), T.StructField("tokens", T.ArrayType(T.IntegerType(), False), False)])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, partitions: int | None = None) -> None:
    """Write the token ids of ``docs(doc_id, text)`` to ``path`` in ascending ``doc_id`` order.

    Each file holds one range of ``doc_id`` and is sorted; null ids come first, equal ids are
    ordered by text. A null or empty text is written as the end id alone. Other columns of
    ``docs`` are not read. An empty table writes files without rows.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, rows, start = TaskContext.get().partitionId(), 0, 0
        work = common.kept(f"encoder-{tokenizer}", lambda: WordEncoder(tokenizer))
        for batch in batches:
            for piece, texts in common.slices(batch, "text"):
                ids, sizes = work.encode(texts, end_id)
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                tokens = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view("<i4")))
                k = len(sizes)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.full(k, part, np.int32)), pa.array(np.arange(rows, rows + k)), pa.array(start + offsets[:-1]), pa.array(sizes), tokens], names=SCHEMA.names)
                rows, start = rows + k, start + int(offsets[-1])

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    options = {"parquet.writer.version": "PARQUET_2_0", "parquet.block.size": str(ROW_GROUP_BYTES), "parquet.page.size": str(PAGE_BYTES), "parquet.enable.dictionary": "true", "compression": "zstd"}
    ordered.mapInArrow(run, SCHEMA).write.options(**options).parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """The files as written: one row a document, ids in ``tokens``."""
    return spark.read.schema(SCHEMA).parquet(path)


def token_index(spark, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, from the files.

    ``start`` is the number of ids of all documents before it in file order. Only one total for
    each file is brought together, never a row for each document.
    """
    common.prepare(spark)
    files = read_tokens(spark, path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("total")).collect()
    offsets, at = [], 0
    for r in sorted(totals, key=lambda r: r["part"]):
        offsets.append((r["part"], at))
        at += r["total"]
    before = spark.createDataFrame(offsets, "part int, before long")

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(4)
            flat, ends = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4"), lists.offsets.to_numpy()
            view = memoryview(flat).cast("B")
            sums = [zlib.crc32(view[4 * int(x) : 4 * int(y)]) for x, y in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(sums, pa.int64())], names=["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    schema = "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long"
    rows = files.select("doc_id", "part", "start_in_part", "n_tokens", "tokens").mapInArrow(crc, schema)
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` to the shared folder and return :func:`token_index` of the files."""
    spark = docs.sparkSession
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    path = common.fresh_path(spark, "tokens", keep=True)
    write_tokens(docs, path, tokenizer)
    return token_index(spark, path)
