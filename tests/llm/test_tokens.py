"""BPE and training order: equal to the public library, exact round trips, permutations."""

import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from millrace.llm import bpe, training_order


@pytest.fixture(scope="module")
def own():
    return bpe.ByteBPE(bpe.rank_file())


@pytest.fixture(scope="module")
def public(own):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


AWKWARD = ["", " ", "\n\n a", "it's 'tis we'll'd !'s", "a\x1cb\x85c", "日本語 12½Ⅷ", "\0x\0", "ab" * 40, "  \t  x  ", "<|endoftext|>", "😀😀 e\u0301"]


def test_equals_public_library(own, public):
    rng = random.Random(1)
    texts = AWKWARD + ["".join(rng.choice("ab'sdtlmrev  \n\t12!?é中²😀") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    ids, at = own.encode_batch(texts)
    back, cut = own.decode_batch(ids, at)
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == public.encode_ordinary(t)
        assert back[cut[k] : cut[k + 1]].decode() == t


def test_long_pieces_and_full_store(own, public, monkeypatch):
    for t in ("a" * 9_000, "xy" * 3_000, "中" * 3_000, "!" * 500):
        assert own.encode_batch([t])[0].tolist() == public.encode_ordinary(t)
    monkeypatch.setattr(bpe, "STORE_BYTES", 3)
    for t in ("one two three four", "five six one two"):
        assert own.encode_batch([t])[0].tolist() == public.encode_ordinary(t)


def test_long_and_short_rounds_merge_alike(own):
    rng = random.Random(2)
    for k in range(600):
        p = "".join(rng.choice("aab" if k % 3 else "theranding isbo"[: 4 + k % 12]) for _ in range(rng.randint(1, 90))).encode()
        assert own._merge_long(p).tolist() == own.merge([p])[0].tolist()


def test_many_pieces_over_64_letters(own, public):
    rng = random.Random(7)
    pieces = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(80)) for _ in range(3000)]
    text = " ".join(pieces + pieces[:50])
    began = time.process_time()
    assert own.encode_batch([text])[0].tolist() == public.encode_ordinary(text)
    assert time.process_time() - began < 30
    # places beyond any fixed table still tell pieces apart
    alike = [("x" * 5000) + c + ("y" * k) for c in "ab" for k in (10, 11)]
    for t in alike + alike:
        assert own.encode_batch([t])[0].tolist() == public.encode_ordinary(t)


def test_encode_frame(spark, public):
    df = spark.createDataFrame([(1, "the cat", 7), (2, None, 8), (2, "", 9), (None, "x" * 200_000, 1)], "doc_id long, text string, n_tokens int")
    got = bpe.encode(df, bpe.rank_file(), ids=True).collect()
    assert [r["n_tokens"] for r in got] == [len(public.encode_ordinary(t)) for t in ("the cat", "", "", "x" * 200_000)]
    assert np.frombuffer(got[0]["token_ids"], "<u4").tolist() == public.encode_ordinary("the cat")
    assert bpe.encode(df.where("false"), bpe.rank_file()).count() == 0


def plain_slot(x, n, key):
    """The permutation by its definition, one value at a time."""
    a, b = training_order.sides(n)
    assert n <= a * b < n + a
    while True:
        left, right = divmod(x, b)
        for i, k in enumerate(training_order.round_keys(key)):
            h = xxhash.xxh64_intdigest((left if i % 2 else right).to_bytes(8, "little"), 42)
            h = xxhash.xxh64_intdigest(k.to_bytes(8, "little", signed=True), h)
            h = h - (1 << 64) if h >> 63 else h
            if i % 2:
                right = (right + h % b) % b
            else:
                left = (left + h % a) % a
        x = left * b + right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 64, 65, 1000])
def test_slots_are_a_permutation(spark, n):
    df = spark.range(n).withColumnRenamed("id", "seq")
    a = [r["slot"] for r in training_order.slots(df, n, "k1").orderBy("seq").collect()]
    assert sorted(a) == list(range(n))
    if n >= 64:
        b = [r["slot"] for r in training_order.slots(df, n, "k2").orderBy("seq").collect()]
        assert a != b and a != list(range(n))
        for key, got in (("k1", a), ("k2", b)):
            assert got == [plain_slot(i, n, key) for i in range(n)]


def test_shards_round_trip_and_resume(spark, tmp_path, public):
    texts = ["the cat sat on the mat " * k for k in range(30)] + [None, "", "ß" * 3000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "again"), (None, "no id", "y")], "doc_id long, text string, slot string")
    rows = training_order.ordered(df, bpe.rank_file(), length=16, shard_slots=8)
    rows.cache()
    n = rows.count()
    end = max(public._mergeable_ranks.values()) + 1
    seqs = {}
    for r in rows.collect():
        seqs.setdefault(r["doc_id"], []).append((r["part"], np.frombuffer(r["ids"], "<u2").tolist(), r["n_tokens"]))
    for i, t in enumerate(texts):
        if i == 3:
            continue
        flat = [x for _, ids, k in sorted(seqs[i]) for x in ids[:k]]
        assert flat == [*public.encode_ordinary(t or ""), end]
    path = str(tmp_path / "shards")
    training_order.write_shards(rows, path)
    stride = 16 * 2 + 2
    back = {r["slot"]: bytes(r["ids"]) for r in training_order.read_shards(spark, path, stride, 8).collect()}
    assert back == {r["slot"]: bytes(r["ids"]) for r in rows.collect()} and sorted(back) == list(range(n))
    tail = training_order.read_shards(spark, path, stride, 8, start=n - 5)
    assert sorted(r["slot"] for r in tail.collect()) == list(range(n - 5, n))
    assert training_order.ordered(df.where("false"), bpe.rank_file()).count() == 0
    assert rows.where(F.col("shard") != F.floor(F.col("slot") / 8)).count() == 0


def test_written_shards_lie_in_slot_order_without_a_cache(spark, tmp_path):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("text"), F.col("id")).alias("text"))
    rows = training_order.ordered(df, bpe.rank_file(), length=16, shard_slots=500)
    training_order.write_shards(rows, str(tmp_path / "shards"))
    back = {r["slot"]: bytes(r["ids"]) for r in training_order.read_shards(spark, str(tmp_path / "shards"), 34, 500).collect()}
    assert back == {r["slot"]: bytes(r["ids"]) for r in rows.collect()} and len(back) == 3000
    # materialise_order: each document holds its number, so equal tables of one partition are numbered alike
    df = df.where("doc_id < 400").coalesce(1)
    want = {r["slot"]: bytes(r["ids"]) for r in training_order.ordered(df, bpe.rank_file(), length=16, shard_slots=100).collect()}
    path = training_order.materialise_order(df, bpe.rank_file(), length=16, shard_slots=100)
    assert {r["slot"]: bytes(r["ids"]) for r in training_order.read_shards(spark, path, 34, 100).collect()} == want


def test_op1_writes_shards_and_digests_what_they_hold(spark, monkeypatch):
    written = []
    monkeypatch.setattr(training_order, "SHARD_SLOTS", 64)
    monkeypatch.setattr(training_order, "new_path", lambda s, name, make=training_order.new_path: written.append(make(s, name)) or written[-1])
    monkeypatch.setattr(training_order.read_shards, "__defaults__", (64, 0))
    monkeypatch.setattr(training_order.placed, "__defaults__", (training_order.LENGTH, 64, training_order.KEY, None))
    rows = training_order.op1_training_order(spark, "/root/testdata/sf0.001").collect()
    stride = training_order.LENGTH * 2 + 2
    files = {int(r["shard"]): bytes(r["content"]) for r in spark.read.format("binaryFile").load(next(p for p in written if "/shards-" in p)).collect()}
    assert len(files) == -(-len(rows) // 64) and sum(map(len, files.values())) == len(rows) * stride
    for r in rows:
        at = r["byte_offset"]
        assert r["record_md5"] == hashlib.md5(files[r["shard"]][at : at + stride - 2]).hexdigest()
