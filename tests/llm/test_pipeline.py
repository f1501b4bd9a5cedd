"""Each stage on its own input, against brute force."""

import struct
import zlib
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from quietlake.llm import common, decontam, mixing

from .helpers import awkward, frame
from .test_near_dup import brute
from .test_small_operators import brute_hits


def test_stages(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "decontamination", "mixing", "token_output"]
    items = [(r["item_id"], r["text"]) for r in common.table(spark, sf_dir, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = common.stored(stage(spark, docs, sf_dir), f"test-{name}")
        after = docs.collect()
        if name != "token_output":
            assert docs.columns == columns
        ids = Counter(r["doc_id"] for r in after)
        if name == "language_id":
            assert ids == Counter(r["doc_id"] for r in before)  # all are in a learned language
        elif name == "near_duplicates":
            assert set(ids) == {d for d, _, c in brute([(r["doc_id"], r["text"]) for r in before]) if d == c}
        elif name == "decontamination":
            assert set(ids) == {r["doc_id"] for r in before if not brute_hits(r["text"], items)[1]}
        elif name == "mixing":
            plan = mixing.mix_plan(spark.createDataFrame(before, docs.schema)).collect()
            assert ids == +Counter({r["doc_id"]: r["copies"] for r in plan})
        else:
            whole, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
            by_id = sorted(before, key=lambda r: r["doc_id"])
            for r, got in zip(by_id, sorted(after, key=lambda r: r["start"]), strict=True):
                t = whole.encode(r["text"], add_special_tokens=False).ids + [1]
                assert (got["doc_id"], got["start"], got["n_tokens"], got["ids_crc32"]) == (r["doc_id"], start, len(t), zlib.crc32(struct.pack(f"<{len(t)}I", *t)))
                start += len(t)
    assert decontam.WINDOW == 10


def test_entry_lists_them():
    import __spark_entry__ as e

    q = e.queries()
    assert "pipeline" in q and all(any(n.startswith(f"op{k}_") for n in q) for k in range(1, 11))


def tables(spark, path, rows, items):
    frame(spark, rows, clash=True).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_run_on_awkward_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    words = [f"word{i}" for i in range(40)]
    rows = awkward([(50, " ".join(words)), (51, " ".join([*words[:-1], "other"])), (52, "clean text that is about nothing but itself"), (53, "here is one two three four five six seven eight nine ten eleven")])
    items = [(1, "one two three four five six seven eight nine ten eleven"), (None, None), (2, ""), (None, "l'été dernier encore")]
    got = corpus_pipeline.run(spark, tables(spark, tmp_path, rows, items)).collect()
    ids = {r["doc_id"] for r in got}
    # 1 to 3 have no letters; 6 is 5's copy, 51 near to 50; 53 and 7 hold items
    assert ids <= {4, 5, 50, 52, None} and {4, 50} & ids
    assert [r["start"] for r in sorted(got, key=lambda r: r["start"])] == [sum(x["n_tokens"] for x in got if x["start"] < r["start"]) for r in sorted(got, key=lambda r: r["start"])]


def test_run_on_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, [], [])).count() == 0


def test_run_leaves_no_scratch(spark, tmp_path, monkeypatch):
    made, gone = [], []
    monkeypatch.setattr(common, "delete", lambda spark, path, f=common.delete: (gone.append(path), f(spark, path)))
    monkeypatch.setattr(common, "fresh_path", lambda spark, name, keep=False, f=common.fresh_path: made.append(f(spark, name, keep)) or made[-1])
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[2:])
    corpus_pipeline.run(spark, tables(spark, tmp_path, [(1, "one text", "en", "a"), (2, "another text", "en", "b")], [(1, "x y")])).count()
    left = {p.rsplit("/", 1)[-1].rsplit("-", 1)[0] for p in set(made) - set(gone)}
    assert left == {"automaton", "tokens", "pipeline-token_output"}
