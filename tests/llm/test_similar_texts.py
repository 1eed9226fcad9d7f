"""Near copies of the pipeline against brute force over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from glossweave.llm import covering_simhash, similar_texts
from glossweave.llm.staging import Staging

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def components(texts):
    s = [sets(t) for t in texts]
    root = list(range(len(s)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(s)):
        for j in range(i + 1, len(s)):
            if len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]) - 1e-9:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(s))]


def edited(r, text, n):
    w = text.split(" ")
    for i in r.sample(range(len(w)), n):
        w[i] = "new%d" % r.getrandbits(40)
    return " ".join(w)


def test_stage_drops_planted_near_copies(spark):
    r = random.Random(5)
    prose = lambda k: " ".join("w%d" % r.getrandbits(30) for _ in range(k))
    texts = [prose(200) for _ in range(40)]
    texts += [edited(r, t, k) for t in texts[:30] for k in (1, 2, 4)]  # similarity about 0.95, 0.9 and 0.82
    texts += [edited(r, t, 15) for t in texts[30:40]]  # about 0.5
    crowd = prose(120)
    texts += [edited(r, crowd, k % 6) for k in range(120)] + ["", None, " ", "Only TWO", "only two", "only three"]
    want = components(texts)
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(want))


def test_rows_without_an_id_and_equal_ids(spark):
    r = random.Random(6)
    a, b, c = (" ".join("w%d" % r.getrandbits(30) for _ in range(50)) for _ in range(3))
    rows = [(None, a), (7, a), (7, b), (7, b), (None, c), (None, c), (8, edited(r, b, 1))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted((-1 if x.doc_id is None else x.doc_id, x.text) for x in similar_texts.apply_similar_texts(df).collect())
    assert got == sorted([(7, a), (7, b), (-1, c)])


def test_fingerprints_propose_and_shingles_decide(spark, monkeypatch):
    """The masks' pairs alone bring near copies together; texts with one fingerprint and unlike shingles stay, others are left to MinHash."""
    r = random.Random(8)
    prose = lambda k: " ".join("w%d" % r.getrandbits(30) for _ in range(k))
    base = prose(1500)
    loop = prose(5)
    texts = [base, base + " end", *((loop + " ") * 400 + prose(40) for _ in range(2)), prose(60), prose(60)]
    assert (covering_simhash.fingerprint(texts[0].encode(), 5) ^ covering_simhash.fingerprint(texts[1].encode(), 5)).bit_count() <= 2
    assert (covering_simhash.fingerprint(texts[2].encode(), 5) ^ covering_simhash.fingerprint(texts[3].encode(), 5)).bit_count() <= 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    assert covering_simhash.text_pairs(df, Staging(spark, "test")).count() == 2
    # no MinHash key is shared, so what goes goes by its fingerprint
    monkeypatch.setattr(similar_texts, "signatures", lambda docs, shingle: docs.select(similar_texts.text_key().alias("key"), F.lit(1).alias("n"), F.array(similar_texts.text_key()).alias("bands"), F.array(F.lit(0).cast("long")).alias("sketch")))
    kept = corpus_pipeline.near_duplicates(spark, df, "")
    assert sorted(x.doc_id for x in kept.collect()) == [0, 2, 3, 4, 5]
