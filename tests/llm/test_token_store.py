"""The token store: pieces that share a hash, and damage that the manifest has to show."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossweave.llm import kernels as K
from glossweave.llm import token_store


def level_by_level(leaves):
    level = list(leaves) or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        up = [hashlib.sha256(level[i] + level[i + 1]).digest() for i in range(0, len(level) - 1, 2)]
        level = up + level[len(up) * 2 :]
    return level[0]


def test_streamed_merkle_roots():
    for n in range(40):
        leaves = [hashlib.sha256(b"%d" % i).digest() for i in range(n)]
        assert token_store.merkle(leaves) == level_by_level(leaves)


def test_pieces_with_one_hash(monkeypatch):
    """Pieces are told apart by their bytes, whatever the hash says."""
    real = K.byte_hash
    monkeypatch.setattr(K, "byte_hash", lambda data, starts, ends: real(data, starts, ends) % np.uint64(3))
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    a, b = "".join("xq"[x] for x in bits), "".join("qx"[x] for x in bits)
    e = token_store.Encoder(token_store.vocabulary())
    for texts in ([a, b], [b, a], [f"x {a} the cat", f"y {b} {a}", b, "the cat", " the  dog"], [b, f"the {a}", "cat"]):
        ids, bounds = e.encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids
    assert len(e.key) <= 3


def test_words_of_a_thousand_letters_have_hashes_of_their_own():
    """The Thue-Morse word and its complement, which polynomials modulo 2**64 take for one."""
    bits = [bin(i).count("1") & 1 for i in range(1 << 13)]
    data, offsets = K.buffers(pa.array(["".join(x[b] for b in bits) for x in ("xq", "qx")]))
    assert len(set(K.byte_hash(data, offsets[:-1], offsets[1:]).tolist())) == 2


def test_odd_pieces_equal_whole_texts():
    r = random.Random(4)
    parts = [" ", "  ", "\n", "\t", "a", "é", " the", "'s", "<|endoftext|>", "\x85", " ", "x\x1cy", "日本", "123", "...", "\r\n", " <|endoftext|> "]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(600)]
    e = token_store.Encoder(token_store.vocabulary())
    for lo in range(0, 600, 150):
        some = texts[lo : lo + 150]
        ids, bounds = e.encode(pa.array([*some, None]))
        want = [x.ids for x in e.tokenizer.encode_batch([*some, ""], add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == want


@pytest.fixture()
def written(spark, tmp_path):
    words = [f"w{i}" for i in range(50)]
    r = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(r.choices(words, k=60))) for i in range(40)], "doc_id long, text string")
    folder = f"file://{tmp_path}/store"
    store = token_store.store_documents(docs, token_store.vocabulary(), folder=folder)
    assert store.manifest_errors() == [] and all(x.verified for x in store.verified().collect())
    return spark, folder


def changed(spark, folder, change):
    """The store with its recipes replaced."""
    raw = spark.read.schema(token_store.RECIPES).parquet(f"{folder}/recipes")
    rows = change([x.asDict() for x in raw.collect()])
    table = spark.createDataFrame([tuple(x[n] for n in token_store.RECIPE_NAMES) for x in rows], token_store.RECIPES)
    table.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}-changed/recipes")
    for name in ("packed", "parts"):
        df = spark.read.parquet(f"{folder}/{name}")
        (df.write.partitionBy("kind") if name == "packed" else df.write).parquet(f"{folder}-changed/{name}")
    return token_store.Store(spark, f"{folder}-changed")


def test_a_lost_part_is_noticed(written):
    lost = changed(*written, lambda rows: [x for x in rows if x["part"] != 2])
    got = lost.verified().collect()
    assert 0 < len(got) < 40 and not any(x.verified for x in got)
    assert "part 2" in lost.manifest_errors()


def test_swapped_recipes_are_noticed(written):
    def swap(rows):
        first, second = [x for x in rows if x["kind"] == "recipe" and x["part"] == 1][:2]
        first["root"], second["root"] = second["root"], first["root"]
        first["digests"], second["digests"] = second["digests"], first["digests"]
        first["ends"], second["ends"] = second["ends"], first["ends"]
        return rows

    swapped = changed(*written, swap)
    assert "part 1" in swapped.manifest_errors()
    assert not any(x.verified for x in swapped.verified().select(F.col("verified")).collect())
