"""Language identification by prediction by partial matching.

One byte context tree a language, of variable order up to ``ORDER``. A symbol seen after its
context costs -log2(c / (n + u)) bits (c: times seen there, n: symbols seen there, u: different
ones); one not seen costs the escape -log2(u / (n + u)) and is coded in the next shorter context,
at last by 8 bits. Statistics are frozen after training, so the code length of a text is exact
and a sum over its bytes; the language with the shortest code wins. Texts are coded whole, many
bytes at a time, through tables of final costs for every context and symbol seen.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .wordhash import Table

ORDER = 3
#: What precedes a text.
PAD = b"\n\n\n"
#: Bytes of sampled training text over all languages, and the longest text that is sampled.
TRAIN_BYTES = 6_000_000
TRAIN_LONGEST = 40_000
UNKNOWN = "und"

_LETTER = re.compile(rb"[A-Za-z]")
_HIGH = re.compile(rb"[\x80-\xff]")


def grams(data: np.ndarray, k: int, start: int) -> np.ndarray:
    """The k bytes that end at each place from ``start`` on, first byte highest."""
    out = np.zeros(len(data) - start, np.uint64)
    for j in range(k):
        out = (out << np.uint64(8)) | data[start - k + 1 + j : len(data) - k + 1 + j]
    return out


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts with PAD before each, as numbers; which places are text; each text's length."""
    data = np.frombuffer(PAD + PAD.join(texts), np.uint8)
    sizes = np.array([len(x) for x in texts], np.int64)
    real = np.ones(len(data), bool)
    starts = np.concatenate([[0], np.cumsum(sizes + len(PAD))])[:-1]
    for j in range(len(PAD)):
        real[starts + j] = False
    return data, real, sizes


class Model:
    """Frozen statistics of all languages as cost tables."""

    def __init__(self, texts: dict[str, list[bytes]]) -> None:
        self.langs = sorted(texts)
        n_lang = len(self.langs)
        counted = []  # for each language and order: symbols' keys and counts
        for lang in self.langs:
            data, real, _ = padded(texts[lang])
            here = np.flatnonzero(real[ORDER:]) + ORDER
            counted.append([np.unique(grams(data, k + 1, ORDER)[here - ORDER], return_counts=True) for k in range(ORDER + 1)])
        #: tables[k]: of order k, places of (context, symbol) and of contexts, costs and escapes by language
        self.tables = []
        if not self.langs:
            return
        lower = lambda keys: np.full((len(keys), n_lang), 8.0)
        for k in range(ORDER + 1):
            keys = np.unique(np.concatenate([c[k][0] for c in counted]))
            ctxs = np.unique(keys >> np.uint64(8))
            cost = lower(keys & np.uint64((1 << 8 * k) - 1) if k else keys)
            esc = np.zeros((len(ctxs), n_lang))
            where = np.searchsorted(ctxs, keys >> np.uint64(8))
            for i in range(n_lang):
                own, n = counted[i][k]
                ctx = np.searchsorted(ctxs, own >> np.uint64(8))
                total, different = np.bincount(ctx, n, len(ctxs)), np.bincount(ctx, minlength=len(ctxs))
                some = total > 0
                esc[some, i] = -np.log2(different[some] / (total[some] + different[some]))
                cost[:, i] += esc[where, i]
                cost[np.searchsorted(keys, own), i] = -np.log2(n / (total[ctx] + different[ctx]))
            self.tables.append((Table(keys), cost.astype(np.float32), Table(ctxs), esc.astype(np.float32)))
            lower = self._coder(k)

    def _coder(self, k: int):
        """Costs of keys of k context bytes and a symbol, by language."""
        symbols, cost, contexts, esc = self.tables[k]

        def code(keys: np.ndarray) -> np.ndarray:
            at = symbols.find(keys)
            out = cost[at]
            if len(miss := np.flatnonzero(at < 0)):
                some = keys[miss]
                ctx = contexts.find(some >> np.uint64(8))
                more = self._coder(k - 1)(some & np.uint64((1 << 8 * k) - 1)) if k else np.full((len(some), len(self.langs)), 8.0, np.float32)
                out[miss] = more + np.where(ctx[:, None] >= 0, esc[ctx], np.float32(0))
            return out

        return code

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language."""
        out = np.zeros((len(texts), len(self.langs)))
        full = [i for i, x in enumerate(texts) if x]
        if not full:
            return out
        data, real, sizes = padded([texts[i] for i in full])
        cost = self._coder(ORDER)(grams(data, ORDER + 1, ORDER))
        cost[~real[ORDER:]] = 0
        starts = np.concatenate([[0], np.cumsum(sizes + len(PAD))])[:-1]
        for i in range(len(self.langs)):
            out[full, i] = np.add.reduceat(cost[:, i], starts, dtype=np.float64)
        return out

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float], list[float]]:
        """Language, score and bits a byte of each text; UNKNOWN without a letter.

        The score is the language's probability when all are equally likely beforehand.
        Equal codes go to the language that sorts first.
        """
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [8.0] * len(texts)
        bits = self.code_lengths(texts)
        best = bits.argmin(1)
        least = bits[np.arange(len(texts)), best]
        score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
        known = [has_letter(x) for x in texts]
        lang = [self.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
        each = least / np.maximum(1, [len(x) for x in texts])
        return lang, [float(s) if k else 0.0 for s, k in zip(score, known, strict=True)], each.tolist()


def has_letter(text: bytes) -> bool:
    return bool(_LETTER.search(text)) or bool(_HIGH.search(text)) and any(c.isalpha() for c in text.decode("utf-8", "replace"))


def crc_class(n: int):
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def train(docs: DataFrame, train_bytes: int = TRAIN_BYTES, longest: int = TRAIN_LONGEST) -> Model:
    """Fit on a sample of ``docs(doc_id, text, lang)``: about ``train_bytes`` over all languages.

    Rows without a language or text are left out, and texts over ``longest`` bytes. Rows are
    chosen by a hash of their id against a threshold that makes each language's share equal, so
    reruns agree and the driver's share is bounded at any size of the table.
    """
    rows = docs.filter("lang IS NOT NULL AND length(text) > 0").select("doc_id", "lang", "text", F.octet_length("text").alias("n")).filter(F.col("n") <= longest)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not sizes:
        return Model({})
    share = train_bytes / len(sizes)
    pick = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(4)), F.lit(1 << 30))
    chosen = None
    for lang, n in sorted(sizes.items()):
        one = (F.col("lang") == lang) & (pick < int(min(1.0, share / n) * (1 << 30)))
        chosen = one if chosen is None else chosen | one
    texts: dict[str, list[bytes]] = {}
    for r in sorted(rows.filter(chosen).select("lang", "text").collect(), key=lambda r: (r["lang"], r["text"])):
        texts.setdefault(r["lang"], []).append(r["text"].encode())
    return Model(texts)


NEW = [T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False), T.StructField("bits_per_byte", T.DoubleType(), False)]
#: A text whose best code is longer than the text itself is in none of the languages.
REJECT_BITS = 8.0


def _maker(model):
    def make():
        m = model.value

        def work(_: pa.RecordBatch, texts: list[bytes]) -> list:
            return list(m.predict(texts))

        return work

    return make


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(doc_id, text)`` with lang_pred, score and bits_per_byte. Null is as empty: ``und``, score 0.

    Only these columns are read; repeated rows give equal results; an empty table gives no rows. A
    null id is carried through, and in the query neither held out nor learnt from.
    """
    return common.map_text(docs.select("doc_id", "text"), "text", _maker(common.broadcast(docs.sparkSession, model)), NEW).drop("text")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` in one of the model's languages, all columns: not ``und``, and coded shorter than they are."""
    return common.keep_rows(docs, "text", _maker(common.broadcast(docs.sparkSession, model)), NEW, f"lang_pred <> '{UNKNOWN}' AND bits_per_byte < {REJECT_BITS}")
