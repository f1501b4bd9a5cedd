import itertools
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quietlake.llm import near_dup, queries
from quietlake.llm.wordhash import BLANKS

from .helpers import awkward, frame


def shingles(text):
    w = (text or "").encode().translate(BLANKS).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and None not in (rows[i][0], rows[j][0]) and 100 * len(a & b) >= 80 * len(a | b):
            up[top(j)] = top(i)
    out = []
    for i, (d, *_) in enumerate(rows):
        group = [rows[j][0] for j in range(len(rows)) if top(j) == top(i)]
        out.append((d, len(sets[i]), None if d is None else min(group) if sets[i] else d))
    return sorted(out, key=repr)


def corpus(seed, n):
    """Chains of edits, a large group of near copies, a passage that many share, short texts."""
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(3000)]
    passage = [rng.choice(vocab) for _ in range(60)]
    origin = [rng.choice(vocab) for _ in range(200)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.3:
            w = list(origin)
            for _ in range(rng.randrange(1, 8)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        elif kind < 0.5 and texts:
            w = rng.choice(texts).split()
            for _ in range(rng.randrange(0, 4)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < 0.3:
                w += [rng.choice(vocab) for _ in range(rng.randrange(20))]
        elif kind < 0.7:
            w = [rng.choice(vocab) for _ in range(rng.randrange(0, 400))] + passage
        else:
            w = [rng.choice(vocab[:6]) for _ in range(rng.randrange(0, 14))]
        texts.append(" ".join(w))
    return [(i, t, None, None) for i, t in enumerate(texts)]


def test_against_all_pairs(spark):
    rows = corpus(1, 260) + [(None if d is None else d + 1000, *x) for d, *x in awkward()]
    got = sorted(map(tuple, near_dup.near_duplicates(frame(spark, rows, clash=True)).collect()), key=repr)
    assert got == brute(rows)


def test_common_shingles_only_order_keys(spark, monkeypatch):
    rows = corpus(2, 120)
    want = brute(rows)
    every = np.concatenate(list(near_dup.sets([t.encode() for _, t, *_ in rows])))
    for hot in (np.unique(every), np.unique(every)[::3]):
        monkeypatch.setattr(near_dup, "common_shingles", lambda docs, hot=hot: hot)
        assert sorted(map(tuple, near_dup.near_duplicates(frame(spark, rows)).collect()), key=repr) == want


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 700), st.randoms(use_true_random=False))
def test_linked_sets_share_a_key(n, rng):
    """The pigeonhole: two sets with J >= 0.8 have a key in common, whatever is common."""
    a = {rng.getrandbits(64) for _ in range(n)}
    b = set(a)
    while True:
        c = set(b)
        if rng.random() < 0.5 and c:
            c.discard(next(iter(c)))
        else:
            c.add(rng.getrandbits(64))
        if 100 * len(a & c) < 80 * len(a | c):
            break
        b = c
        if rng.random() < 0.01:
            break
    if not b:
        return
    x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
    assert near_dup.linked(x, y)
    hot = lambda u: (u % np.uint64(3)) == 0
    kx, ky = (set(np.concatenate(near_dup.keys(u, hot(u))).tolist()) for u in (x, y))
    assert kx & ky
    d = int(np.bitwise_count((near_dup.sketch(x) ^ near_dup.sketch(y)).view(np.uint64)).sum())
    assert d <= len(a ^ b) <= near_dup.most_different(len(a), len(b))


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (200, 200)]
    got = {tuple(r) for r in near_dup.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(i, 100) for i in (100, 101, 103)} | {(200, 200)}


def test_one_of_each(spark):
    rows = corpus(3, 80)
    df = frame(spark, rows, clash=True)
    left = near_dup.one_of_each(df)
    assert left.columns == df.columns
    assert {r["doc_id"] for r in left.collect()} == {d for d, _, c in brute(rows) if d == c}


def test_null_ids_take_no_links(spark):
    """A row without an id comes first in its task, with the text of one that has an id and a near copy."""
    words = [f"w{i}" for i in range(80)]
    text, near = " ".join(words), " ".join([*words[:-1], "other"])
    rows = [(None, text, None, None), (5, text, None, None), (6, near, None, None)]
    df = frame(spark, rows).coalesce(1)
    assert sorted(map(tuple, near_dup.near_duplicates(df).collect()), key=repr) == brute(rows)
    assert {r["doc_id"] for r in near_dup.one_of_each(df).collect()} == {None, 5}


def test_empty(spark):
    assert near_dup.near_duplicates(frame(spark, [])).count() == 0
    assert [tuple(r) for r in near_dup.near_duplicates(frame(spark, [(1, None, None, None)])).collect()] == [(1, 0, 1)]


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(queries.oracle_sql()["op8_ngram_jaccard"]).fetchall()
    assert sorted(map(tuple, queries.op8_ngram_jaccard(spark, sf_dir).select("doc_id", "n_shingles", "component_id").collect())) == sorted(want)


def thue_morse():
    """Two words of 1,024 letters that polynomial hashes modulo a power of two take for one."""
    return "".join("ab"[i.bit_count() & 1] for i in range(1024)), "".join("ba"[i.bit_count() & 1] for i in range(1024))


def test_texts_of_one_word_each_stay_apart(spark):
    rows = [(i, t, None, None) for i, t in enumerate(thue_morse())]
    assert near_dup.identities([t.encode() for _, t, *_ in rows])[0] != near_dup.identities([rows[1][1].encode()])[0]
    assert sorted(map(tuple, near_dup.near_duplicates(frame(spark, rows)).collect())) == [(0, 1, 0), (1, 1, 1)]


@pytest.mark.parametrize("block", [1, 3, 7])
def test_large_keys_in_tiles(spark, monkeypatch, block):
    """Blocks so small that nearly all keys are dealt out in tiles, chunks of a few rows, no rounds before the pairs."""
    for name, x in (("BLOCK", block), ("CHUNK_ROWS", 5), ("STAR_ROUNDS", int(block == 7)), ("NEAREST_ROUNDS", int(block == 3))):
        monkeypatch.setattr(near_dup, name, x)
    rows = corpus(5, 70)
    assert sorted(map(tuple, near_dup.near_duplicates(frame(spark, rows)).collect()), key=repr) == brute(rows)


def test_tiles_hold_each_pair_of_components_once(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    rows = [(1, i, i if i % 3 else 0, 50, [0] * 16) for i in range(40)] + [(2, 100, 100, 50, [0] * 16), (2, 101, 101, 50, [0] * 16)]
    df = spark.createDataFrame(rows, "key long, node long, comp long, n long, sketch array<long>")
    tops = spark.createDataFrame([(1, 40, 0), (2, 2, 100)], "key long, m long, hub_comp long")
    tiles = near_dup.tiled(df, tops, pairs=True)
    got = []
    for part in tiles.rdd.glom().collect():
        for _, tile in itertools.groupby(part, key=lambda r: (r["key"], r["tile"])):
            tile = list(tile)
            assert len(tile) <= 4 * near_dup.BLOCK
            one = tile[0]["tile"] // near_dup.TILE == tile[0]["tile"] % near_dup.TILE
            got += [(a["node"], b["node"]) for a, b in itertools.combinations(tile, 2) if a["comp"] != b["comp"] and (one or a["block"] != b["block"])]
    want = [(a[1], b[1]) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and a[2] != b[2]]
    assert sorted(tuple(sorted(p)) for p in got) == sorted(want)


def test_nodes_of_one_number_are_told_apart(spark):
    """Numbers that say next to nothing: marks part what they would merge."""
    rows = corpus(6, 90)
    assert sorted(map(tuple, near_dup.near_duplicates(frame(spark, rows), bits=4).collect()), key=repr) == brute(rows)
