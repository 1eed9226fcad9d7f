"""Substring dedup against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from glossweave.llm.fm_index import FMIndex, WaveletMatrix
from glossweave.llm.substring_dedup import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, anchor string, n long"


def expected(text, counts, window):
    words = WORD.findall(text or "")
    gone = set()
    for i in range(len(words) - window + 1):
        if counts[tuple(words[i : i + window])] > 1:
            gone.update(range(i, i + window))
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["the", "of", "a", "é" * r.randint(1, 3), "w%d" % r.randint(0, 300)])
    text = lambda n: " ".join(word() for _ in range(n))
    shared, line = text(60), text(13)
    rows = [(i, text(r.randint(0, 120))) for i in range(30)]
    rows += [(100 + i, text(20) + "\n" + shared + " \t" + text(25)) for i in range(25)]
    rows += [(200 + i, text(30) + " " + line + " " + text(30)) for i in range(25)]
    rows += [(300, "a " * 90), (301, "x y " * 40), (302, "a " * 36), (303, "z " * 35), (304, "z " * 34)]
    same = text(80)
    rows += [(400, same), (401, same), (402, same[:-3]), (403, text(40) + " " + same), (403, text(50)), (404, same), (404, same)]
    rows += [(500, None), (501, ""), (502, " \n\t "), (None, same), (None, None), (503, "q" * 5000 + " " + text(50))]
    return [(a, b, "x", 1) for a, b in rows]


@pytest.mark.parametrize(("window", "anchor", "limit"), [(35, 12, 1000), (35, 12, 3), (9, 3, 2), (8, 8, 1000)])
def test_equals_brute_force(spark, window, anchor, limit):
    rows = corpus(window + limit)
    counts = collections.Counter()
    for _, text, *_ in rows:
        words = WORD.findall(text or "")
        counts.update(tuple(words[i : i + window]) for i in range(len(words) - window + 1))
    got = substring_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3), window=window, anchor_words=anchor, group_limit=limit).collect()
    want = collections.Counter((i, *expected(t, counts, window)) for i, t, *_ in rows)
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert sum(w[2] for w in want.elements()) > 0


def test_empty_table(spark):
    assert substring_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_wavelet_rank():
    s = np.random.default_rng(1).integers(0, 11, 500)
    tree = WaveletMatrix(s, 11)
    at = np.arange(501)
    for c in range(11):
        assert (tree.rank(np.full(501, c), at) == [int((s[:i] == c).sum()) for i in at]).all()


def test_index_counts_weighted_windows():
    words = np.array([1, 2, 3, 4, 1, 2, 3, 9, 9, 9, 9])
    index = FMIndex(words, np.array([0, 4, 8, 11]), np.array([1, 1, 2]), 3)
    segment, at = index.repeated_windows(piece=1)
    assert sorted(zip(segment.tolist(), at.tolist())) == [(0, 0), (1, 0), (2, 0)]
