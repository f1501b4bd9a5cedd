import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from quietlake.llm import common, token_output
from quietlake.llm.wordhash import Words

from .helpers import awkward, frame

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["a\x1cb c\x85d  e f <|endoftext|> x<|startoftext|>y don't it's 'll ''s 123abc été ÉTÉ, İstanbul ΣΑΣ ﬁ é. ...','", "", "  \n", "a.b,c--d's...x's É.. ÉA, straße ẞ. <|ENDOFTEXT|>", "Plain words, ÀB. ..x.. =a", "日本語 テキスト한국어", "😀😀 emoji‍joined"]


def test_words_encode_as_whole_texts():
    whole, enc = Tokenizer.from_file(PATH), token_output.WordEncoder(PATH)
    assert enc.by_word
    rng = random.Random(3)
    alphabet = "abcAB éÉß.,!'’\n\t12-|<>&中 ́"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(400)]
    ids, n = enc.encode([t.encode() for t in texts], 1)
    for t, got in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert got.tolist() == whole.encode(t, add_special_tokens=False).ids + [1], t


def test_a_tokenizer_that_needs_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, whole = token_output.WordEncoder(path), Tokenizer.from_file(path)
    assert not enc.by_word
    ids, n = enc.encode([b"two  words", b""], 7)
    assert ids.tolist() == whole.encode("two  words", add_special_tokens=False).ids + [7, 7] and n.tolist() == [len(ids) - 1, 1]


@pytest.fixture(scope="module")
def rows():
    return awkward([(i, t) for i, t in enumerate(ODD, 100)])


def test_round_trip(spark, rows):
    whole = Tokenizer.from_file(PATH)
    got = token_output.token_output(frame(spark, rows, clash=True)).collect()
    want, start = [], 0
    for d, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((d, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_files(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    token_output.write_tokens(frame(spark, rows), path, PATH, partitions=3)
    files = sorted((tmp_path / "t").glob("*.parquet"))
    last = None
    for f in files:
        p = pq.ParquetFile(f)
        if not p.metadata.num_rows:
            continue
        ids = [x for x in p.read(["doc_id"]).column(0).to_pylist() if x is not None]
        assert ids == sorted(ids) and (last is None or not ids or ids[0] >= last)
        last = ids[-1] if ids else last
        for k in range(p.metadata.num_columns):
            c = p.metadata.row_group(0).column(k)
            assert c.has_offset_index
            if "tokens" in c.path_in_schema:
                assert {"DELTA_BINARY_PACKED", "RLE_DICTIONARY"} & set(c.encodings)


def test_empty(spark):
    assert token_output.token_output(frame(spark, [])).count() == 0
    assert common.shared_dir(spark)


def thue_morse(n):
    """A word of ``n`` letters and its complement, which polynomial hashes modulo a power of two take for one."""
    return "".join("ab"[i.bit_count() & 1] for i in range(n)), "".join("ba"[i.bit_count() & 1] for i in range(n))


@pytest.mark.parametrize("clash", [False, True])
def test_words_of_one_hash_keep_their_ids(monkeypatch, clash):
    if clash:  # all words of one length share a hash
        monkeypatch.setattr(Words, "_hash", lambda self: self.sizes.astype(np.uint64))
    whole, enc = Tokenizer.from_file(PATH), token_output.WordEncoder(PATH)
    texts = [" ".join(x for n in (4, 16, 1024, 4096) for x in thue_morse(n)), "one two ten abc " * 3, "two one abc ten", "b a"]
    for some in (texts[:2], texts[:2], [""], texts, ["three more words", *texts]):
        ids, n = enc.encode([t.encode() for t in some], 1)
        for t, got in zip(some, np.split(ids, np.cumsum(n)[:-1]), strict=True):
            assert got.tolist() == whole.encode(t, add_special_tokens=False).ids + [1]
