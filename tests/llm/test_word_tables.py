import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quietlake.llm.wordhash import BLANKS, Store, Table, Words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbé \n\t\x0b|", max_size=20), max_size=8))
def test_words_are_pythons(texts):
    raw = [t.encode() for t in texts]
    w = Words(raw)
    split = [x.translate(BLANKS).split(b" ") for x in raw]
    split = [[y for y in x if y] for x in split]
    assert w.counts.tolist() == [len(x) for x in split]
    flat = [y for x in split for y in x]
    assert [w.word(i) for i in range(len(w.hashes))] == flat
    by = {}
    for h, word in zip(w.hashes.tolist(), flat, strict=True):
        assert by.setdefault(word, h) == h
    assert len(set(by.values())) == len(by)


def test_table():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 50_000, np.uint64))
    t = Table(keys[:10])
    for k in range(10, len(keys), 7001):
        t.add(keys[k : k + 7001])
    assert (t.find(keys) == np.arange(len(keys))).all()
    assert (t.find(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()
    assert (Table().find(keys[:3]) == -1).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=1, max_size=150).map(str.encode), min_size=1, max_size=12))
def test_store_compares_bytes(names):
    store = Store()
    store.add(names[:1])
    store.add(names[1:])
    w = Words([b" ".join(names)])
    for shift in range(len(names)):
        places = (np.arange(len(names)) + shift) % len(names)
        assert store.same(w, places).tolist() == [names[i] == names[j] for i, j in enumerate(places)]
    assert not store.same(w, np.full(len(names), -1)).any()


def test_no_hash_shared_by_patterns():
    """Long words that differ by letters put in pairs, where linear hashes cancel."""
    for n in (64, 65, 1024, 2048):
        a = bytes(97 + (i.bit_count() & 1) for i in range(n))
        b = bytes(195 - x for x in a)
        assert len(set(Words([a + b" " + b]).hashes.tolist())) == 2
