"""N-gram Jaccard join by parity sketches, and the groups of near duplicates it gives.

A document's set is its distinct shingles, as 64-bit hashes. XOR-ing shingles into a sketch
keeps, for each place, only the parity of what fell there, so the Hamming distance of two
sketches is at most the size of the sets' symmetric difference; and J >= t allows a difference of
at most (1 - t) / (1 + t) * (|A| + |B|). Two sketches are used:

* a wide one of K segments, K by size band, each segment held as the XOR of its shingles' hashes.
  Of K segments at most d differ, d the allowed difference; so of the non-empty segments, put in
  one order that all documents share, the first d + 1 of both documents have one in common
  (pigeonhole). These d + 1 are the keys of the join. The order puts segments with several rare
  shingles first, and those of common shingles alone last.
* a narrow one of 1024 bits, whose Hamming distance rejects pairs before their texts are compared.

All pairs that pass are verified on the whole texts. Equal word sequences are one node from the
start, told apart by 128 bits of BLAKE2b over the words themselves; a node's number is half of them,
and where two nodes get one number both are numbered anew.
Large groups are not expanded into pairs: rounds of stars (each node against one hub it shares
most keys with) join most of a group, and rounds of nearest partners (each node that is not in
its keys' largest component against the likeliest of some sampled nodes, by sketch) most of the
rest; after them only pairs of nodes in different components that share a key are left, and
every one of those is verified. So no link between components is lost, and no pair within one is
needed. A key with more nodes than a tile holds is dealt out as tiles, each pair of blocks to one,
so that no task ever holds all nodes of a key.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .wordhash import BLANKS, Table, Words, mix

SHINGLE = 5
#: J >= NUM / DEN.
NUM, DEN = 80, 100
SKETCH_BITS = 1024
#: Common shingles are found in every so-many-th document. They only order keys; any set gives the same links.
HOT_SAMPLE, HOT_COUNT, HOT_MOST = 8, 4, 200_000
#: Keys of common shingles alone, and at most so many keys that many of every so-many-th node have, are dealt to so many tasks.
SALTS, HOT_KEYS, HOT_SHARE = 16, 100_000, 64
STAR_ROUNDS, NEAREST_ROUNDS = 2, 2
#: Nodes of a key's largest component, and of its others, among which a nearest partner is sought.
NEAREST_SAMPLE = 64
#: Tables of ids up to so many rows are sent to all executors; larger ones are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: Nodes of one key in one block; a larger key is compared block against block.
BLOCK = 1024
#: Rows that a task holds at once, but for the tile that is being read.
CHUNK_ROWS = 1 << 15
#: A task remembers so many nodes or pairs, so as not to give them twice; later ones it may.
SEEN = 300_000
#: A tile's number is its first block times this and its second.
TILE = 1 << 31
#: Below this size each shingle is its own segment.
SMALL = 64

_A = np.random.default_rng(77).integers(1, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.uint64(0xA24BAED4963EE407)
_ONE = np.uint64(1)
_C = np.arange(SHINGLE, dtype=np.uint64) * _B


def sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes. A text of fewer words is one shingle; none gives none."""
    words = Words(texts)
    w = words.hashes
    many = np.zeros(0, np.uint64)
    if len(w) >= SHINGLE:
        n = len(w) - SHINGLE + 1
        many = mix(sum(w[j : j + n] * _A[j] for j in range(SHINGLE)))
    at = 0
    for c in words.counts.tolist():
        if c >= SHINGLE:
            u = np.sort(many[at : at + c - SHINGLE + 1])
            yield u[np.concatenate([[True], u[1:] != u[:-1]])] if len(u) > 1 else u
        elif c:
            yield mix((w[at : at + c] * _A[:c]).sum(dtype=np.uint64, keepdims=True) + _C[c : c + 1])
        else:
            yield many[:0]
        at += c


def identities(texts: list[bytes]) -> list[bytes]:
    """16 bytes for each text's words in order; the same for texts that differ in case or white space alone."""
    return [hashlib.blake2b(b" ".join(x.translate(BLANKS).split()), digest_size=16).digest() for x in texts]


def halves(identity: bytes, bits: int = 64) -> tuple[int, int]:
    """An identity as a node's number, of so many bits, and its mark, signed."""
    return int.from_bytes(identity[:8], "little", signed=True) >> (64 - bits), int.from_bytes(identity[8:], "little", signed=True)


def sketch(u: np.ndarray) -> np.ndarray:
    """SKETCH_BITS parities as signed 64-bit integers."""
    parity = np.bincount((u & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def most_different(n: int, m: int) -> int:
    """The largest symmetric difference of linked sets of n and m shingles."""
    return (DEN - NUM) * (n + m) // (DEN + NUM)


def bands(n: int) -> list[tuple[int, int]]:
    """(lower end, allowed difference) of the size bands whose joins a set of n takes part in.

    A pair belongs to the band of its smaller set; bands end at powers of two.
    """
    low = 1 << (n.bit_length() - 1)
    out = [(low, most_different(n, n * DEN // NUM))]
    if n * NUM // DEN < low and low > 1:
        # a smaller partner may lie in the band below
        out.append((low >> 1, most_different(n, low - 1)))
    return out


def keys(u: np.ndarray, hot: np.ndarray) -> list[np.ndarray]:
    """The join keys of a set, a signed array for each band; odd ones are of common shingles alone."""
    out = []
    rare = (~hot).astype(np.int64)
    for low, d in bands(len(u)):
        if low < SMALL:
            value, place, cls = u, np.zeros(len(u), np.uint64), rare
        else:
            k = low * 3 // 4
            seg = (u >> np.uint64(17)) % np.uint64(k)
            order = np.argsort(seg, kind="stable")
            s = seg[order]
            first = np.concatenate([[0], np.flatnonzero(s[1:] != s[:-1]) + 1])
            value, place, cls = np.bitwise_xor.reduceat(u[order], first), s[first], np.minimum(3, np.add.reduceat(rare[order], first))
        e = mix(value + mix(place * _B + np.uint64(low)))
        if len(e) > d + 1:
            rank = ((3 - cls).astype(np.uint64) << np.uint64(62)) | (e >> np.uint64(2))
            some = np.argpartition(rank, d)[: d + 1]
            e, cls = e[some], cls[some]
        out.append(((e & ~_ONE) | (cls == 0).astype(np.uint64)).view(np.int64))
    return out


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether DEN * |a and b| >= NUM * |a or b|; empty sets are linked with nothing."""
    if not len(a) or not len(b):
        return False
    common_ = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * common_ >= NUM * (len(a) + len(b) - common_)


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Hashes of shingles that many sampled documents share; at most HOT_MOST."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        table, counts = Table(), np.zeros(0, np.int64)
        for batch in batches:
            for _, texts in common.slices(batch, "text"):
                fresh = []
                for k, u in zip(identities(texts), sets(texts), strict=True):
                    if len(u) and k not in seen:
                        if len(seen) < SEEN:
                            seen.add(k)
                        fresh.append(u)
                if not fresh:
                    continue
                h, c = np.unique(np.concatenate(fresh), return_counts=True)
                at = table.find(h)
                table.add(h[at < 0])
                counts = np.concatenate([counts, np.zeros(table.n - len(counts), np.int64)])
                at = table.find(h)
                counts[at] += c
                if table.n > 1_000_000:  # what was met once is forgotten
                    keep = counts > 1
                    table, counts = Table(table.keys[: table.n][keep]), counts[keep]
        keep = counts > 1
        yield pa.RecordBatch.from_arrays([pa.array(table.keys[: table.n][keep].view(np.int64)), pa.array(counts[keep])], names=["h", "c"])

    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(HOT_SAMPLE)) == 0).select("text")
    found = sample.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).filter(F.col("c") >= HOT_COUNT)
    top = found.orderBy(F.desc("c"), "h").limit(HOT_MOST).select("h").toArrow()
    return top.column(0).to_numpy().astype(np.int64).view(np.uint64)


PRINTS = {"compression": "lz4", "parquet.enable.dictionary": "false"}
FINGERPRINT = [T.StructField("n", T.LongType(), False), T.StructField("node", T.LongType()), T.StructField("mark", T.LongType()), T.StructField("sketch", T.ArrayType(T.LongType(), False)), T.StructField("keys", T.ArrayType(T.LongType(), False))]


def fingerprints(docs: DataFrame, hot: np.ndarray, bits: int = 64) -> DataFrame:
    """doc_id, n, node, mark and, where a task first meets a node in a row with an id, its sketch and keys."""
    sent, key = common.broadcast(docs.sparkSession, hot), uuid.uuid4().hex

    def make():
        table = common.kept(f"hot-{key}", lambda: Table(sent.value))
        seen: set[bytes] = set()

        def work(part: pa.RecordBatch, texts: list[bytes]) -> list:
            n, node, mark, sketches, sigs = [], [], [], [], []
            for known, x, u in zip(part.column("doc_id").is_valid().to_pylist(), identities(texts), sets(texts), strict=True):
                n.append(len(u))
                a, b = halves(x, bits) if len(u) else (None, None)
                node.append(a)
                mark.append(b)
                if not known or not len(u) or x in seen:
                    sketches.append(None)
                    sigs.append(None)
                    continue
                if len(seen) < SEEN:
                    seen.add(x)
                sketches.append(sketch(u))
                sigs.append(np.concatenate(keys(u, table.find(u) >= 0)))
            return [n, node, mark, pa.array(sketches, pa.list_(pa.int64())), pa.array(sigs, pa.list_(pa.int64()))]

        return work

    return common.map_text(docs.select("doc_id", "text"), "text", make, FINGERPRINT).drop("text")


def numbered(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``prints``, in which no two nodes have one number, and its nodes: node, doc_id, n, sketch, mark.

    Numbers are 64 of 128 bits, so two nodes of one number are rare; they are told apart by their
    marks, and get numbers made of both.
    """
    for step in range(100):
        mine = prints.filter("doc_id IS NOT NULL AND node IS NOT NULL")
        nodes = common.stored(mine.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch", ignorenulls=True).alias("sketch"), F.min("mark").alias("mark"), F.max("mark").alias("other")), "near-nodes")
        clash = nodes.filter("mark <> other").select("node")
        if clash.isEmpty():
            return prints, nodes.drop("other")
        clash = clash.withColumn("twice", F.lit(True))
        again = prints.join(_bounded(clash), "node", "left").withColumn("node", F.when(F.col("twice"), F.xxhash64("node", "mark", F.lit(step))).otherwise(F.col("node")))
        prints = common.stored(again.select(*prints.columns), "near-prints", **PRINTS)
    raise RuntimeError("nodes can't be told apart")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Parts of a stream sorted by key, tile and node that end where a tile ends, without repeated rows, and where each tile begins and ends."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def cut(t: pa.Table, at: int) -> tuple[pa.Table, np.ndarray, np.ndarray] | None:
        t = t.slice(0, at)
        key, tile, node = (t.column(c).to_numpy() for c in ("key", "tile", "node"))
        edge = np.ones(len(key), bool)
        edge[1:] = (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])
        fresh = edge.copy()
        fresh[1:] |= node[1:] != node[:-1]
        t, edge = t.filter(pa.array(fresh)), edge[fresh]
        first = np.flatnonzero(edge)
        return t, first, np.append(first[1:], len(edge))

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < CHUNK_ROWS:
            continue
        t = pa.Table.from_batches(held)
        key, tile = t.column("key").to_numpy(), t.column("tile").to_numpy()
        last = np.flatnonzero((key[1:] != key[:-1]) | (tile[1:] != tile[:-1]))
        if not len(last):
            continue
        at = int(last[-1]) + 1
        yield cut(t, at)
        held = t.slice(at).combine_chunks().to_batches()
        rows -= at
    if rows:
        yield cut(pa.Table.from_batches(held), rows)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key and node of keys that several nodes have, or may have in another tile."""
    for t, first, end in _chunks(batches):
        size = np.repeat(end - first, end - first)
        t = t.filter(pa.array((size > 1) | (t.column("tile").to_numpy() > 0))).select(["key", "node"])
        yield from t.combine_chunks().to_batches()


def shared_keys(dealt: DataFrame) -> DataFrame:
    """Of ``dealt(key, node)`` the rows of keys that several nodes have, stored.

    Keys that many of a share of the nodes have, and odd ones, are dealt to SALTS tiles, where none
    is dropped; so the nodes of a hot key never meet in one task. Which keys these are changes
    nothing but the work, so the list can be bounded.
    """
    few = dealt.filter(F.pmod(F.xxhash64("node", F.lit(11)), F.lit(HOT_SHARE)) == 0)
    hot = common.stored(few.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= BLOCK // HOT_SHARE).orderBy(F.desc("c"), "key").limit(HOT_KEYS).select("key", F.lit(True).alias("hot")), "near-hot")
    spread = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = (F.col("key").bitwiseAND(1) == 1) | F.col("hot").isNotNull()
    rows = dealt.join(F.broadcast(hot), "key", "left") if not hot.isEmpty() else dealt.withColumn("hot", F.lit(None).cast("boolean"))
    rows = rows.select("key", F.when(salted, 1 + F.pmod(F.shiftright("node", 7), F.lit(SALTS))).otherwise(F.lit(0)).cast("int").alias("tile"), "node")
    rows = rows.repartition(spread, "key", "tile").sortWithinPartitions("key", "tile", "node")
    return common.stored(rows.mapInArrow(_groups, "key long, node long"), "near-groups")


def _bits(t: pa.Table) -> np.ndarray:
    return t.column("sketch").combine_chunks().flatten().to_numpy().reshape(len(t), -1)


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of nodes that share a key, lie in different components, and pass sizes and sketches.

    A tile of one block compares its nodes with each other, one of two blocks those of the one with
    those of the other.
    """
    seen: set[tuple[int, int]] = set()
    for t, first, end in _chunks(batches):
        node, comp, n, tile, block = (t.column(c).to_numpy() for c in ("node", "comp", "n", "tile", "block"))
        bits = _bits(t)
        for a, b in zip(first.tolist(), end.tolist(), strict=True):
            if b - a < 2 or (comp[a:b] == comp[a]).all():
                continue
            kinds, size = np.unique(comp[a:b], return_counts=True)
            inside = comp[a:b] == kinds[size.argmax()]
            one = tile[a] // TILE == tile[a] % TILE
            left, right = [], []
            for i in (a + np.flatnonzero(~inside)).tolist():
                j = np.arange(a, b)
                j = j[(comp[j] != comp[i]) & (inside | (j > i)) & (DEN * np.minimum(n[j], n[i]) >= NUM * np.maximum(n[j], n[i]))]
                if not one:
                    j = j[block[j] != block[i]]
                if len(j):
                    apart = np.bitwise_count((bits[j] ^ bits[i]).view(np.uint64)).sum(1, dtype=np.int64)
                    j = j[(DEN + NUM) * apart <= (DEN - NUM) * (n[j] + n[i])]
                    left.append(np.full(len(j), node[i]))
                    right.append(node[j])
            if left:
                new = [p for p in zip(np.concatenate(left).tolist(), np.concatenate(right).tolist(), strict=True) if p not in seen]
                if len(seen) < SEEN:
                    seen.update(new)
                if new:
                    yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in new], pa.int64()), pa.array([p[1] for p in new], pa.int64())], names=["a", "b"])


def _some(at: np.ndarray, node: np.ndarray, key: np.ndarray) -> np.ndarray:
    """At most NEAREST_SAMPLE of the places, by a hash of node and key."""
    if len(at) <= NEAREST_SAMPLE:
        return at
    rank = mix(node[at].view(np.uint64) ^ mix(key[at].view(np.uint64)))
    return at[np.argpartition(rank, NEAREST_SAMPLE)[:NEAREST_SAMPLE]]


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For nodes outside their tile's largest component the partner with the closest sketch, in that component if any passes."""
    for t, first, end in _chunks(batches):
        key, node, comp, n = (t.column(c).to_numpy() for c in ("key", "node", "comp", "n"))
        bits = _bits(t)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, b in zip(first.tolist(), end.tolist(), strict=True):
            kinds, size = np.unique(comp[a:b], return_counts=True)
            if len(kinds) < 2:
                continue
            largest = kinds[size.argmax()]
            all_ = np.arange(a, b)
            out = all_[comp[a:b] != largest]
            hubs = np.concatenate([_some(all_[comp[a:b] == largest], node, key), _some(out, node, key)])
            for k in range(0, len(out), 512):
                o = out[k : k + 512]
                apart = np.bitwise_count((bits[o][:, None, :] ^ bits[hubs][None, :, :]).view(np.uint64)).sum(2, dtype=np.int64)
                x, y = n[o][:, None], n[hubs][None, :]
                ok = (comp[o][:, None] != comp[hubs][None, :]) & (DEN * np.minimum(x, y) >= NUM * np.maximum(x, y)) & ((DEN + NUM) * apart <= (DEN - NUM) * (x + y))
                score = np.where(ok, apart + np.where(comp[hubs] == largest, 0, 1 << 20)[None, :], 1 << 40)
                best = score.argmin(1)
                least = score[np.arange(len(o)), best]
                live = least < 1 << 40
                found.append((node[o][live], least[live], node[hubs[best]][live]))
        if found:
            who, score, hub = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((hub, score, who))
            who, score, hub = who[order], score[order], hub[order]
            new = np.concatenate([[True], who[1:] != who[:-1]]) if len(who) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(who[new]), pa.array(score[new]), pa.array(hub[new])], names=["node", "score", "hub"])


def tiled(rows: DataFrame, tops: DataFrame, pairs: bool) -> DataFrame:
    """``rows(key, node, comp, n, sketch)`` dealt out and sorted by key and tile; ``tops(key, m, hub_comp)``, stored, has one row a key.

    A key of up to BLOCK rows is one tile. A larger one is parted into its rows of ``hub_comp``, the
    component that most are likely in, and all others, and both into blocks by a hash of the node.
    For ``pairs`` a block of others meets each block, itself included, in a tile of two, so two rows
    of different components meet in one tile. Else a tile is a share of the key's rows.
    """
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = ("key", "tile", "block", "node", "comp", "n", "sketch")
    large = tops.filter(F.col("m") > BLOCK).select("key", "hub_comp", "m")
    if large.isEmpty():
        out = rows.withColumn("tile", F.lit(0).cast("long")).withColumn("block", F.lit(0))
    else:
        parts = rows.select("key", "comp").join(_bounded(large), "key").groupBy("key").agg(F.first("hub_comp").alias("hub_comp"), F.max("m").alias("m"), F.count_if(F.col("comp") == F.col("hub_comp")).alias("main"))
        parts = common.stored(parts.select("key", "hub_comp", F.ceil(F.col("m") / BLOCK).cast("int").alias("all"), F.greatest(F.lit(1), F.ceil(F.col("main") / BLOCK).cast("int")).alias("x"), F.greatest(F.lit(1), F.ceil((F.col("m") - F.col("main")) / BLOCK).cast("int")).alias("y")), "near-large")
        out = rows.join(_bounded(parts), "key", "left")
        deal = lambda blocks: F.pmod(F.xxhash64("node", F.lit(3)), F.col(blocks)).cast("int")
        if pairs:
            main = F.col("comp") == F.col("hub_comp")
            block = F.when(main, deal("x")).otherwise(F.col("x") + deal("y"))
            # the blocks of others are numbered after the main ones
            meets = F.when(F.col("all").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.when(main, F.col("x")).otherwise(F.lit(0)), F.col("x") + F.col("y") - 1))
            out = out.withColumn("block", F.coalesce(block, F.lit(0))).withColumn("with", F.explode(meets))
            out = out.withColumn("tile", F.least("block", "with").cast("long") * TILE + F.greatest("block", "with"))
        else:
            out = out.withColumn("tile", F.coalesce(deal("all"), F.lit(0)).cast("long")).withColumn("block", F.lit(0))
    return out.select(*cols).repartition(spread, "key", "tile").sortWithinPartitions("key", "tile", "node")


def _bounded(df: DataFrame) -> DataFrame:
    return common.bounded(df, BROADCAST_ROWS)


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Of ``pairs(a, b)`` those that are linked, by their whole texts."""
    one = lambda x: nodes.select(F.col("node").alias(x), F.col("doc_id").alias(f"d{x}"), F.col("n").alias(f"n{x}"), F.col("mark").alias(f"m{x}"), F.col("sketch").alias(f"s{x}"))
    apart = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)
    size = (DEN * F.least("na", "nb") >= NUM * F.greatest("na", "nb")) & ((DEN + NUM) * apart <= (DEN - NUM) * (F.col("na") + F.col("nb")))
    likely = common.stored(pairs.join(one("a"), "a").join(one("b"), "b").filter(size).select("a", "b", "da", "db", "ma", "mb"), "near-likely")
    ids = common.stored(likely.select(F.explode(F.array("da", "db")).alias("doc_id")).distinct(), "near-ids")
    texts = common.stored(docs.join(_bounded(ids), "doc_id", "left_semi").select("doc_id", "text"), "near-texts")
    both = likely.join(texts.select(F.col("doc_id").alias("da"), F.col("text").alias("ta")), "da").join(texts.select(F.col("doc_id").alias("db"), F.col("text").alias("tb")), "db")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, left in common.slices(batch, "ta"):
                ok = []
                for i, (ta, tb) in enumerate(zip(left, part.column("tb").cast(pa.binary()), strict=True)):
                    two = [ta, tb.as_py()]
                    # an id on several rows brings several texts; only the pair's own count
                    if [halves(x)[1] for x in identities(two)] == [part.column(c)[i].as_py() for c in ("ma", "mb")] and linked(*sets(two)):
                        ok.append(i)
                yield part.select(["a", "b"]).take(pa.array(ok, pa.int64()))

    links = common.stored(both.select("a", "b", "ma", "mb", "ta", "tb").mapInArrow(run, "a long, b long").distinct(), "near-links")
    common.drop(likely, ids, texts)
    return links


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` for all ends of ``edges(a, b)``: comp is the smallest node that can be reached.

    Each round takes the least label of a node's neighbours and then the label's own label, so
    long chains take a logarithm of rounds. Every round is stored.
    """
    both = common.stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "cc-edges")
    labels = common.stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp")), "cc-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        new = labels.join(near, "node").select("node", F.least("comp", "near").alias("to"), F.col("comp").alias("was"))
        new = common.stored(new, "cc-near")
        jump = new.alias("x").join(new.select(F.col("node").alias("to"), F.col("to").alias("far")), "to", "left").select("x.node", F.least("x.to", F.coalesce("far", "x.to")).alias("comp"), "x.was")
        after = common.stored(jump, "cc-labels")
        common.drop(labels, new)
        if after.filter("comp <> was").isEmpty():
            common.drop(both)
            return after.select("node", "comp")
        labels = after


def near_duplicates(docs: DataFrame, bits: int = 64) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_shingles and component_id.

    A document without words is a component of its own, with 0 shingles. Rows with a null id
    have no component (null) and link nothing. Several rows with one id and different texts are
    linked through that id only if their texts are; each then shows its own text's component.
    Other columns aren't read. An empty table gives no rows. ``bits`` of a node's number may be few:
    the result is the same, after more renumbering.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    common.prepare(docs.sparkSession)
    known = docs.filter("doc_id IS NOT NULL")
    hot = common_shingles(known)
    prints, nodes = numbered(common.stored(fingerprints(docs, hot, bits), "near-prints", **PRINTS))
    dealt = prints.filter("doc_id IS NOT NULL AND keys IS NOT NULL").select("node", F.explode("keys").alias("key"))
    groups = shared_keys(dealt)
    links, tried, comps = None, None, None
    last = STAR_ROUNDS + NEAREST_ROUNDS
    for step in range(last + 1):
        rows = groups.withColumn("comp", F.col("node")) if comps is None else groups.join(comps, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
        order = F.xxhash64("node", F.lit(step)) if step else F.col("node")
        tops = rows.groupBy("key").agg(F.min(F.struct(order.alias("o"), F.col("node").alias("hub"), F.col("comp").alias("hub_comp"))).alias("top"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("m")).filter("low <> high").select("key", "top.hub", "top.hub_comp", "m")
        pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        if step < STAR_ROUNDS:
            shared = rows.join(tops, "key").filter("comp <> hub_comp").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("c"))
            pairs = shared.groupBy("node").agg(F.max(F.struct("c", "hub")).alias("m")).select(*pair("node", "m.hub")).distinct()
        else:
            tops = common.stored(tops, "near-tops")
            left = rows.join(tops.select("key"), "key", "left_semi").join(nodes.select("node", "n", "sketch"), "node")
            left = tiled(left, tops, pairs=step == last)
            if step < last:
                near = left.mapInArrow(_nearest, "node long, score long, hub long")
                pairs = near.groupBy("node").agg(F.min(F.struct("score", "hub")).alias("m")).select(*pair("node", "m.hub")).distinct()
            else:
                pairs = left.mapInArrow(_cross, "a long, b long").select(*pair("a", "b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = common.stored(pairs, "near-pairs")
        if pairs.isEmpty():
            if step in (0, last):
                break
            continue
        tried = pairs if tried is None else tried.union(pairs)
        found = verified(pairs, nodes, known)
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            comps = components(links)
    if comps is None:
        return prints.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("node")).alias("node")).join(nodes.select("node", F.col("doc_id").alias("first")), "node", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("first", "doc_id")).alias("component_id"))
    least = nodes.join(comps, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), "doc_id")
    firsts = least.groupBy("comp").agg(F.min("doc_id").alias("first"))
    of_node = common.stored(least.join(firsts, "comp").select("node", "first"), "near-components")
    rows = prints.select("doc_id", "n", "node")
    return rows.join(of_node, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("first", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that have the smallest id of their group, all columns. Rows with a null id stay."""
    found = near_duplicates(docs)
    gone = common.stored(found.filter("component_id <> doc_id").select("doc_id").distinct(), "near-gone")
    return docs.join(_bounded(gone), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS sh
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0))),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
u AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, seen) AS (SELECT a, a FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.seen)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least(m.low, w.doc_id), w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node, min(seen) AS low FROM r GROUP BY node) m ON m.node = w.doc_id
"""
