"""Toxicity: a convolutional text classifier, trained here in numpy.

Words (runs of digits, letters and other characters beyond ASCII, A-Z lower-cased) are hashed;
each hash bucket that the training sample touched has an embedding, all others share one of
zeros. Filters of several widths slide over a text's embeddings; the largest value of each
filter over the whole text feeds a logistic output. Before training, an embedding's first number
is the bucket's smoothed log-odds in toxic and other texts, so that filters find the words that
matter among thousands that don't. Output thresholds are calibrated for each language, which is
guessed from the text's own words by naive Bayes over the same buckets.

Counts, filters and thresholds come from all labelled texts: counts by one aggregation; weights by
rounds, in each of which every shard of the texts is trained on from the same weights and the
changes are averaged; thresholds from a histogram of the outputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .wordhash import Table, Words

#: One in so many labelled texts is kept for thresholds and not trained on.
CALIBRATE = 4
#: Words of a shard, which a worker holds; passes over a shard are EPOCHS in all, dealt to the rounds.
SHARD_WORDS, ROUNDS = 2_500_000, 3
#: Buckets with an embedding: so many of the clearest log-odds, and as many of the most texts, by exact counts.
VOCABULARY = 1 << 16
#: Labels are sent to all executors up to so many rows; beyond, they are shuffled.
BROADCAST_ROWS = 1_000_000
#: Parts of one that outputs are told apart by for thresholds; units of a weight's change, so that sums are exact.
STEPS, UNITS = 1024, float(1 << 30)
#: Least positives of a language for a threshold of its own.
CALIBRATE_LEAST = 20
DIM, WIDTHS, FILTERS = 8, (1, 2, 3), 6
#: A batch has so many texts, or words, at most (one longer text is a batch).
EPOCHS, BATCH, BATCH_WORDS, RATE, DECAY = 12, 64, 200_000, 0.08, 1e-4
#: A bucket needs so many texts to have an embedding.
LEAST_TEXTS = 2
#: Buckets of the hash.
HASH_BITS = 40


def buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word of the texts, and each text's number of words."""
    words = Words(texts, common.WORDS)
    return words.hashes >> np.uint64(64 - HASH_BITS), words.counts


def all_buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The same for many texts, a slice at a time, so that memory follows the number of words alone."""
    parts, some, size = [], [], 0
    for x in texts:
        some.append(x)
        size += len(x)
        if size >= common.SLICE_BYTES:
            parts.append(buckets(some))
            some, size = [], 0
    parts.append(buckets(some))
    return np.concatenate([h for h, _ in parts]), np.concatenate([c for _, c in parts])


def _within(out: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """``out`` with the places where a filter would reach into the next text left out of the maximum."""
    ends = np.append(starts[1:], len(out))
    for j in range(1, width):
        out[ends - j] = -1e9
    return out


def _flat(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all texts with zeros (row 0) after each, and where each begins. Empty texts have one row."""
    gap = np.zeros(max(WIDTHS), np.int64)
    parts = [x for i in ids for x in (i, gap)]
    starts = np.cumsum([0, *(len(i) + len(gap) for i in ids[:-1])])
    return np.concatenate(parts), starts


class Model:
    """Embeddings ``emb`` (row 0: unknown), filters ``conv[w][j]``, output weights, thresholds."""

    def __init__(self) -> None:
        self.table = Table()
        self.langs: list[str] = []

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        return self.table.find(hashes).astype(np.int64) + 1

    def fit(self, texts: list[bytes], toxic: np.ndarray, langs: list[str | None], seed: int = 5) -> Model:
        """The same as :func:`train` over texts in memory, as one shard."""
        hashes, counts = all_buckets(texts)
        ends = np.cumsum(counts)
        kind, inverse = np.unique(hashes, return_inverse=True)
        of = np.repeat(np.arange(len(texts)), counts)
        once = np.unique(of * max(1, len(kind)) + inverse)
        doc, at = once // max(1, len(kind)), once % max(1, len(kind))
        seen = np.bincount(at, minlength=len(kind))
        keep = seen >= LEAST_TEXTS
        known = sorted({x for x in langs if x is not None})
        words = np.zeros((int(keep.sum()) + 1, len(known)))
        for i, lang in enumerate(known):
            own = np.bincount(inverse[np.array([x == lang for x in langs])[of]], minlength=len(kind))
            words[1:, i], words[0, i] = own[keep], own[~keep].sum()
        self.start(kind[keep], seen[keep], np.bincount(at, toxic[doc].astype(float), len(kind))[keep], len(texts), float(toxic.sum()), known, words, seed)
        rows = self.rows(hashes)
        ids = [rows[e - c : e] for c, e in zip(counts, ends, strict=True)]
        self._train(ids, toxic.astype(float), np.array([i for i in range(len(texts)) if i % CALIBRATE], np.int64), np.random.default_rng(seed + 1), EPOCHS)
        self._freeze()
        held = np.arange(0, len(texts), CALIBRATE)
        z, lang = self.outputs([ids[i] for i in held])
        self._calibrate(z, lang, toxic[held] > 0, np.ones(len(held)))
        return self

    def start(self, kind: np.ndarray, seen: np.ndarray, hit: np.ndarray, total: float, positive: float, langs: list[str], words: np.ndarray, seed: int = 5) -> None:
        """Weights before training, from the counts of buckets: texts, toxic texts, and words of each language (row 0: other words)."""
        rng = np.random.default_rng(seed)
        self.table.add(kind)
        n = self.table.n
        self.mean = positive / max(1.0, total)
        positive = max(1.0, positive)
        # log-odds, shrunk by their standard error
        a, b = hit + 0.5, seen - hit + 0.5
        odds = np.log(a / (positive + 1 - hit)) - np.log(b / (max(1.0, total - positive) + 1 - (seen - hit)).clip(0.5))
        z = odds / np.sqrt(1 / a + 1 / b)
        first = np.sign(odds) * np.clip(np.abs(z) - 2, 0, 6) / 2
        self.emb = np.concatenate([np.zeros((1, DIM)), rng.normal(0, 0.05, (n, DIM))])
        self.emb[1:, 0] = first
        self.conv = {w: rng.normal(0, 0.3, (w, DIM, FILTERS)) for w in WIDTHS}
        for w in WIDTHS:
            self.conv[w][:, 0] = np.abs(self.conv[w][:, 0])
        self.out = np.full(len(WIDTHS) * FILTERS, 0.1)
        self.bias = -1.0
        self.grad2 = np.full(self.weights().shape, 1e-2)
        # naive Bayes of languages over the same buckets
        self.langs = langs
        self.nb = np.log((words + 0.1) / (words + 0.1).sum(0)).astype(np.float32)

    def weights(self) -> np.ndarray:
        """All weights as rows of DIM: embeddings, filters, output."""
        out = np.zeros(-(-(len(self.out) + 1) // DIM) * DIM)
        out[: len(self.out)], out[len(self.out)] = self.out, self.bias
        return np.concatenate([self.emb, *(self.conv[w].reshape(-1, DIM) for w in WIDTHS), out.reshape(-1, DIM)])

    @staticmethod
    def parts(weights: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray], np.ndarray, np.ndarray]:
        """Views of the rows: embeddings, filters, output weights, bias (of one place)."""
        tail = -(-(len(WIDTHS) * FILTERS + 1) // DIM)
        at = len(weights) - tail - sum(WIDTHS) * FILTERS
        emb, conv, out = weights[:at], {}, weights[len(weights) - tail :].reshape(-1)
        for w in WIDTHS:
            conv[w] = weights[at : at + w * FILTERS].reshape(w, DIM, FILTERS)
            at += w * FILTERS
        return emb, conv, out[: len(WIDTHS) * FILTERS], out[len(WIDTHS) * FILTERS : len(WIDTHS) * FILTERS + 1]

    def take(self, weights: np.ndarray) -> None:
        self.emb, self.conv, self.out, bias = self.parts(weights)
        self.bias = float(bias[0])

    def _pooled(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        x = self.emb[ids]
        outs = []
        for w in WIDTHS:
            o = np.zeros((len(ids), FILTERS))
            for j in range(w):
                o[: len(ids) - j] += x[j:] @ self.conv[w][j]
            outs.append(_within(o, starts, w))
        each = np.concatenate(outs, 1)
        return x, np.maximum.reduceat(each, starts, axis=0), each

    def _train(self, ids: list[np.ndarray], y: np.ndarray, fit_on: np.ndarray, rng, epochs: int) -> None:
        if not len(fit_on):
            return
        mean = min(max(1e-6, self.mean), 1 - 1e-6)
        weight = np.where(y > 0, 0.5 / mean, 0.5 / (1 - mean))
        emb2, conv2, out2, bias2 = self.parts(self.grad2)
        sizes = np.array([len(i) for i in ids], np.int64)
        for _ in range(epochs):
            order = rng.permutation(fit_on)
            for some in batches(order, sizes[order]):
                flat, starts = _flat([ids[i] for i in some])
                x, top, each = self._pooled(flat, starts)
                act = np.maximum(top, 0)
                p = 1 / (1 + np.exp(-np.clip(act @ self.out + self.bias, -30, 30)))
                d = (p - y[some]) * weight[some] / len(some)
                g_out, g_bias = act.T @ d + DECAY * self.out, d.sum()
                g_top = np.where(top > 0, d[:, None] * self.out, 0)
                doc = np.repeat(np.arange(len(some)), np.diff(np.append(starts, len(flat))))
                rows_at, rows_g = [], []
                g_conv = {w: np.zeros_like(self.conv[w]) for w in WIDTHS}
                for f in range(each.shape[1]):
                    w, c = WIDTHS[f // FILTERS], f % FILTERS
                    at = np.flatnonzero(each[:, f] == top[doc, f])
                    which, once = np.unique(doc[at], return_index=True)
                    at = at[once]
                    g = g_top[which, f]
                    live = g != 0
                    at, g = at[live], g[live]
                    for j in range(w):
                        a = np.minimum(at + j, len(flat) - 1)
                        g_conv[w][j, :, c] += g @ x[a]
                        rows_at.append(flat[a])
                        rows_g.append(g[:, None] * self.conv[w][j, :, c])
                at, g = np.concatenate(rows_at), np.concatenate(rows_g)
                hit, inverse = np.unique(at, return_inverse=True)
                total = np.zeros((len(hit), DIM))
                np.add.at(total, inverse, g)
                real = hit > 0  # the unknown row stays zero
                hit, total = hit[real], total[real]
                emb2[hit] += total**2
                self.emb[hit] -= RATE * total / np.sqrt(emb2[hit])
                for w in WIDTHS:
                    conv2[w] += g_conv[w] ** 2
                    self.conv[w] -= RATE * (g_conv[w] + DECAY * self.conv[w]) / np.sqrt(conv2[w])
                out2 += g_out**2
                self.out -= RATE * g_out / np.sqrt(out2)
                bias2 += g_bias**2
                self.bias -= RATE * g_bias / float(np.sqrt(bias2[0]))

    def _freeze(self) -> None:
        """Each row's product with each filter's part, and its languages' costs, in one table."""
        parts = [self.emb @ self.conv[w][j] for w in WIDTHS for j in range(w)]
        self.gather = np.concatenate([*parts, self.nb], 1).astype(np.float32)

    def logits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Output before thresholds, and the place of the guessed language (0 if none is known)."""
        hashes, counts = buckets(texts)
        rows = self.rows(hashes)
        return self._outputs([rows[e - c : e] for c, e in zip(counts, np.cumsum(counts), strict=True)])

    def outputs(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The same for rows of words, a batch at a time."""
        got = [self._outputs([ids[i] for i in some]) for some in batches(np.arange(len(ids)), np.array([len(i) for i in ids], np.int64))]
        return np.concatenate([np.zeros(0), *(z for z, _ in got)]), np.concatenate([np.zeros(0, np.int64), *(x for _, x in got)])

    def _outputs(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat, starts = _flat(ids)
        got = self.gather[flat]
        tops, at = [], 0
        for w in WIDTHS:
            o = got[:, at : at + FILTERS].copy()
            for j in range(1, w):
                o[: len(o) - j] += got[j:, at + j * FILTERS : at + (j + 1) * FILTERS]
            at += w * FILTERS
            tops.append(np.maximum.reduceat(_within(o, starts, w), starts, axis=0))
        act = np.maximum(np.concatenate(tops, 1), 0)
        lang = np.zeros(len(ids), np.int64)
        if len(self.langs) > 1:
            lang = np.add.reduceat(got[:, at:], starts, axis=0).argmax(1)
        return act.astype(float) @ self.out + self.bias, lang

    def _calibrate(self, z: np.ndarray, lang: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
        """Thresholds of the best F1 by guessed language; output z was given to n texts that weren't trained on, of label y."""
        everywhere = best_threshold(z, y, n=n)
        self.thresholds = np.array([best_threshold(z[lang == i], y[lang == i], n=n[lang == i]) if n[y & (lang == i)].sum() >= CALIBRATE_LEAST else everywhere for i in range(max(1, len(self.langs)))])

    def score(self, texts: list[bytes]) -> np.ndarray:
        z, lang = self.logits(texts)
        return 1 / (1 + np.exp(-np.clip(z - self.thresholds[lang], -30, 30)))


def batches(order: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of ``order``, whose texts have so many words, of BATCH texts and BATCH_WORDS words at most."""
    start = words = 0
    for k, n in enumerate(sizes.tolist()):
        if k > start and (k - start == BATCH or words + n > BATCH_WORDS):
            yield order[start:k]
            start, words = k, 0
        words += n
    if start < len(order):
        yield order[start:]


def best_threshold(z: np.ndarray, y: np.ndarray, other: float = 1.0, n: np.ndarray | None = None) -> float:
    """The middle between two outputs where F1 is best; the first of equally good ones from above. n: texts of each output."""
    if not y.any():
        return float(z.max()) + 1 if len(z) else 0.0
    order = np.argsort(-z, kind="stable")
    n = np.ones(len(z)) if n is None else n
    tp, fp = np.cumsum(n[order] * y[order]), np.cumsum(n[order] * ~y[order]) * other
    f1 = 2 * tp / (tp + fp + n[y].sum())
    f1[:-1][z[order][:-1] == z[order][1:]] = -1  # equal outputs can't be parted
    k = int(f1.argmax())
    below = z[order][k + 1] if k + 1 < len(z) else z[order][k] - 1
    return float((z[order][k] + below) / 2)


COUNTS = "bucket long, lang string, seen long, hit long, words long"


def count_words(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of batches of (text, y, lang): COUNTS of each bucket and language; bucket -1 has all texts and words of the language."""
    for batch in parts:
        for part, texts in common.slices(batch, "text", 8 * common.SLICE_BYTES):
            y = np.array(part.column(1).to_pylist(), np.int64)
            names = part.column(2).to_pylist()
            langs = list(dict.fromkeys(names))
            lang = np.array([langs.index(x) for x in names], np.int64)
            hashes, counts = all_buckets(texts)
            kind, inverse = np.unique(hashes, return_inverse=True)
            k = max(1, len(kind))
            of = np.repeat(np.arange(len(texts)), counts)
            once = np.unique(of * k + inverse)
            doc, at = once // k, once % k
            place = lang[doc] * k + at
            seen, hit = (np.bincount(place, w, k * len(langs)).astype(np.int64) for w in (None, y[doc].astype(float)))
            words = np.bincount(lang[of] * k + inverse, minlength=k * len(langs))
            some = np.flatnonzero(seen)
            every = [np.bincount(lang, w, len(langs)).astype(np.int64) for w in (None, y.astype(float), counts.astype(float))]
            code = np.concatenate([some // k, np.arange(len(langs))])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([kind[some % k].astype(np.int64) if len(kind) else some, np.full(len(langs), -1)])), pa.array([langs[i] for i in code.tolist()], pa.string()),
                *(pa.array(np.concatenate([x[some], e])) for x, e in zip((seen, hit, words), every, strict=True)),
            ], names=["bucket", "lang", "seen", "hit", "words"])


def shard(rows: pa.Table) -> pa.Table:
    """One row of all the texts of a shard, in the order of their keys."""
    got = sorted(zip(*(rows.column(c).to_pylist() for c in ("key", "ids", "y", "calibrate")), strict=True))
    return pa.table({
        "shard": pa.array([rows.column("shard")[0].as_py()], pa.int64()), "ids": pa.array([b"".join(r[1] for r in got)], pa.binary()), "counts": pa.array([np.array([len(r[1]) // 4 for r in got], np.int64).tobytes()], pa.binary()),
        "y": pa.array([np.array([r[2] for r in got], np.int8).tobytes()], pa.binary()), "calibrate": pa.array([np.array([r[3] for r in got], np.int8).tobytes()], pa.binary()),
    })


def _texts(row: dict) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of a shard's row: each text's rows of words, labels, and which texts are for thresholds."""
    ids, ends = np.frombuffer(row["ids"], np.int32).astype(np.int64), np.cumsum(np.frombuffer(row["counts"], np.int64))
    return np.split(ids, ends[:-1]), np.frombuffer(row["y"], np.int8), np.frombuffer(row["calibrate"], np.int8) > 0


CHANGES = [f"{x}{i}" for x in "wg" for i in range(DIM)]


def one_round(shards: DataFrame, model: Model, number: int, epochs: int) -> None:
    """Train on every shard from the model's weights; each row of weights gets the mean of the changes that shards made to it."""
    sent = shards.sparkSession.sparkContext.broadcast((model.weights(), model.grad2, model.mean))

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, before2, mean = sent.value
        for row in (r for part in parts for r in part.to_pylist()):
            ids, y, calibrate = _texts(row)
            m = Model()
            m.mean, m.grad2 = mean, before2.copy()
            m.take(before.copy())
            m._train(ids, y.astype(float), np.flatnonzero(~calibrate), np.random.default_rng((number, row["shard"])), epochs)
            change = np.concatenate([m.weights() - before, m.grad2 - before2], 1)
            at = np.flatnonzero(change.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(np.rint(change[at, i] * UNITS).astype(np.int64)) for i in range(2 * DIM))], names=["row", *CHANGES])

    got = shards.mapInArrow(work, ", ".join(f"{c} long" for c in ("row", *CHANGES))).groupBy("row").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in CHANGES]).toArrow()
    at, n = got.column("row").to_numpy(), got.column("n").to_numpy()
    change = np.stack([got.column(c).to_numpy() for c in CHANGES], 1) / UNITS / n[:, None]
    weights = model.weights()
    weights[at] += change[:, :DIM]
    model.grad2[at] += change[:, DIM:]
    model.take(weights)
    sent.destroy()


def calibrate(shards: DataFrame, model: Model) -> None:
    """Thresholds from the outputs of all texts that weren't trained on, counted by steps of 1 / STEPS."""
    sent = shards.sparkSession.sparkContext.broadcast(model)

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for part in parts for r in part.to_pylist()):
            ids, y, calibrate = _texts(row)
            held = np.flatnonzero(calibrate)
            z, lang = sent.value.outputs([ids[i] for i in held])
            step = np.rint(np.clip(z, -30, 30) * STEPS).astype(np.int64)
            some, n = np.unique(np.stack([lang, step, y[held].astype(np.int64)], 1), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(some[:, i]) for i in range(3)), pa.array(n)], names=["lang", "step", "y", "n"])

    got = shards.mapInArrow(work, "lang long, step long, y long, n long").groupBy("lang", "step", "y").agg(F.sum("n").alias("n")).orderBy("lang", "step", "y").toArrow()
    model._calibrate(got.column("step").to_numpy() / STEPS, got.column("lang").to_numpy(), got.column("y").to_numpy() > 0, got.column("n").to_numpy().astype(float))
    sent.destroy()


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on all of ``labels(doc_id, toxic)`` with the whole texts and the languages of ``docs``; reruns agree.

    Null texts are empty ones. Ids with contradicting labels, labels other than 0 and 1, and null
    ids and labels are left out.
    """
    common.prepare(docs.sparkSession)
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.min("toxic").cast("int").alias("y"), F.max("toxic").cast("int").alias("top")).filter("y = top AND y IN (0, 1)").select("doc_id", "y")
    known = common.stored(known, "toxic-labels")
    rows = docs.select("doc_id", "text", "lang").join(common.bounded(known, BROADCAST_ROWS), "doc_id")

    counts = rows.select("text", "y", "lang").mapInArrow(count_words, COUNTS).groupBy("bucket", "lang").agg(*[F.sum(c).alias(c) for c in ("seen", "hit", "words")])
    by_bucket = common.stored(counts.groupBy("bucket").agg(F.sum("seen").alias("seen"), F.sum("hit").alias("hit"), F.collect_list(F.struct("lang", "seen", "hit", "words")).alias("langs")).filter(f"seen >= {LEAST_TEXTS} OR bucket < 0"), "toxic-counts")
    whole = [x for r in by_bucket.filter("bucket < 0").collect() for x in r["langs"]]
    total, positive, n_words = (float(sum(x[c] for x in whole)) for c in ("seen", "hit", "words"))
    langs = sorted(x["lang"] for x in whole if x["lang"] is not None)

    a, b = F.col("hit") + 0.5, F.col("seen") - F.col("hit") + 0.5
    clear = F.abs((F.ln(a / (positive + 1.5 - a)) - F.ln(b / (total - positive + 1.5 - b))) / F.sqrt(1 / a + 1 / b))
    known_buckets = by_bucket.filter("bucket >= 0")
    got = []
    for order in (clear, F.col("seen")):
        some = known_buckets.orderBy(order.desc(), "bucket").limit(VOCABULARY).select("bucket", "seen", "hit", F.explode("langs").alias("l")).select("bucket", "seen", "hit", "l.lang", "l.words").toArrow()
        code = pc.fill_null(pc.index_in(some.column("lang"), pa.array(langs, pa.string())), -1)
        got.append(np.stack([x.to_numpy() for x in (some.column("bucket"), some.column("seen").cast(pa.int64()), some.column("hit"), code.cast(pa.int64()), some.column("words"))], 1))
    rows_of = np.unique(np.concatenate(got), axis=0)
    kind, first, at = np.unique(rows_of[:, 0], return_index=True, return_inverse=True)
    words = np.zeros((len(kind) + 1, len(langs) + 1))
    words[at + 1, rows_of[:, 3]] = rows_of[:, 4]  # no language: the last column
    for x in whole:
        if x["lang"] is not None:
            i = langs.index(x["lang"])
            words[0, i] = x["words"] - words[1:, i].sum()
    m = Model()
    m.start(kind.astype(np.uint64), rows_of[first, 1].astype(float), rows_of[first, 2].astype(float), total, positive, langs, words[:, :-1])

    sent = docs.sparkSession.sparkContext.broadcast(m.table)

    def make():
        table = sent.value

        def encode(_: pa.RecordBatch, texts: list[bytes]) -> list:
            hashes, counts = buckets(texts)
            ids = (table.find(hashes) + 1).astype(np.int32)
            return [pa.array([x.tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])], pa.binary())]

        return encode

    n = max(1, -(-int(n_words) // SHARD_WORDS))
    keyed = rows.select("text", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(n)).alias("shard"), F.xxhash64("doc_id", F.lit(10)).alias("key"), "y", (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(CALIBRATE)) == 0).cast("int").alias("calibrate"))
    coded = common.map_text(keyed, "text", make, [T.StructField("ids", T.BinaryType())]).drop("text")
    shards = common.stored(coded.groupBy("shard").applyInArrow(shard, "shard long, ids binary, counts binary, y binary, calibrate binary"), "toxic-shards", maxRecordsPerFile="1")
    sent.destroy()
    for k in range(ROUNDS):
        one_round(shards, m, k, EPOCHS // ROUNDS)
    m._freeze()
    m.emb = m.grad2 = m.nb = None
    calibrate(shards, m)
    common.drop(known, by_bucket, shards)
    return m


NEW = [T.StructField("score", T.DoubleType(), False), T.StructField("predicted", T.IntegerType(), False)]


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(doc_id, text)`` with score and predicted (1 from 0.5 on).

    Null and empty texts are scored as texts without words. A null id is carried through, has no
    labels, and in the query is neither held out nor learnt from. Only these columns are read;
    repeated rows give equal results; an empty table gives no rows; a model trained on nothing
    gives every text the same score.
    """
    sent = common.broadcast(docs.sparkSession, model)

    def make():
        m = sent.value

        def work(_: pa.RecordBatch, texts: list[bytes]) -> list:
            s = m.score(texts)
            return [s.tolist(), (s >= 0.5).astype(int).tolist()]

        return work

    return common.map_text(docs.select("doc_id", "text"), "text", make, NEW).drop("text")
