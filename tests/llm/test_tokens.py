import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer
from tokenloom.llm import packing, token_files
from tokenloom.llm.encoding import Encoder

NAMES = [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)]


def texts(seed=1, n=400):
    rng = random.Random(seed)
    bits = ["the", "The", "don't", "é", "é", "́", "1234", "漢字", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", " ", "　", "\x85", "!?", "'s", "😀", "<|endoftext|>", "ab", "İ", "Σ", "\x00"]
    made = ["".join(rng.choice(bits) + (" " if rng.random() < 0.4 else "") for _ in range(rng.randrange(0, 60))) for _ in range(n)]
    return [*made, None, "", " ", "  a ", "\n", "a\nb", " a", "a ", "word " * 5000]


def ids(t, s):
    return t.encode(s or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("name", "drops"), NAMES)
def test_chunks_give_the_ids_of_whole_texts(name, drops):
    path = token_files.tokenizer_path(name)
    whole, enc = Tokenizer.from_file(path), Encoder(path, drops, keep=900)
    for seed in range(3):
        tx = texts(seed)
        got, off = enc(pa.array(tx, pa.string()))
        for i, s in enumerate(tx):
            assert got[off[i] : off[i + 1]].tolist() == ids(whole, s), repr(s)
    enc.check[:] = 1  # as if hashes collided
    got, off = enc(pa.array(tx, pa.string()))
    assert got[off[5] : off[6]].tolist() == ids(whole, tx[5])


def test_files_round_trip(spark, tmp_path):
    t = Tokenizer.from_file(token_files.tokenizer_path(token_files.TOKENIZER))
    rows = [(i * 3, s, 1) for i, s in enumerate(texts())]
    spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in token_files.query(spark, str(tmp_path)).collect()}
    start = 0
    for i, s, _ in rows:
        want = [*ids(t, s), 1]
        r = got[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)
    token_files.write_tokens(spark.createDataFrame([(None, "a"), (2, "b"), (2, "b")], "doc_id long, text string"), f"{tmp_path}/t", token_files.tokenizer_path(token_files.TOKENIZER))
    assert sorted((r.id or 0, r.start) for r in token_files.read_tokens(spark, f"{tmp_path}/t").collect()) == [(0, 0), (2, 2), (2, 4)]
    token_files.write_tokens(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/e", token_files.tokenizer_path(token_files.TOKENIZER))
    assert token_files.read_tokens(spark, f"{tmp_path}/e").collect() == []


def test_files_hold_bloom_filters_and_are_pruned(spark, tmp_path):
    docs = spark.range(20_000).selectExpr("id * 2 as doc_id", "'a' as text")
    token_files.write_tokens(docs, f"{tmp_path}/t", token_files.tokenizer_path(token_files.TOKENIZER))
    found = token_files.read_tokens(spark, f"{tmp_path}/t").filter("id = 7000")
    assert [r.start for r in found.collect()] == [7000]
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,7000)" in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("task_items", [200_000, 40])
def test_packing(spark, tmp_path, task_items):
    path = token_files.tokenizer_path(packing.TOKENIZER)
    t = Tokenizer.from_file(path)
    rows = list(enumerate(texts(2)))
    docs = spark.createDataFrame(rows, "id long, text string").repartition(6)
    items = packing.token_pieces(docs, path, 64).cache()
    got = packing.pack(items, 64, task_items=task_items).collect()
    by_doc, by_bin = {}, {}
    for r in got:
        by_doc.setdefault(r.id, []).append(r)
        by_bin.setdefault(r.bin, []).append(r)
    for i, s in rows:
        want, at = [*ids(t, s), 0], 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == 64)
            assert r.ids_crc32 == zlib.crc32(np.array(want[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(want) and (len(by_doc[i]) == 1) == (len(want) <= 64)
    for members in by_bin.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    lower = -(-sum(r.length for r in got) // 64)
    one = len(packing.best_fit(sorted((r.length for r in got), reverse=True), 64))
    assert len(by_bin) <= max(lower, one) * (1.03 if task_items > 40 else 1.15) + 1


def test_packing_of_nothing_and_repeats(spark):
    path = token_files.tokenizer_path(packing.TOKENIZER)
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), path).collect() == []
    df = spark.createDataFrame([(1, None, 2), (1, None, 3), (None, "a b", 4)], "doc_id long, text string, bin int")
    got = packing.pack_documents(df, path).collect()
    assert sorted((r.id or 0, r.length, r.offset) for r in got) == [(0, 3, 0), (1, 1, 3), (1, 1, 4)]
