"""Words of large classes have trained factors too."""

import math
import random

import numpy as np
import pytest

pytest.importorskip("glossweave.llm.queries")

from glossweave.llm import kernels as K  # noqa: E402
from glossweave.llm import maxent_lm  # noqa: E402


def test_trees_share_out_their_class(spark):
    """With any weights the words of a large class have a probability each, the places differ, and the sum is one but for leaves without a word."""
    r = np.random.Generator(np.random.PCG64(3))
    hashes = K.signed(K.mix(np.arange(9000, dtype=np.uint64) + np.uint64(5)))
    counts = [5000] * 2 + [1] * 3000 + [int(x) for x in r.integers(8, 16, 5998)]
    vocabulary = spark.createDataFrame([(int(h), c) for h, c in zip(hashes, counts)], "hash long, c long")
    model = maxent_lm._classes(vocabulary)
    assert model.large == [0, 3]
    rows = model.place(vocabulary).collect()
    assert len(rows) == 9000
    model.widest = max(x.place for x in rows) >> maxent_lm.LEAF
    n = len(rows)
    row = {"codes": np.arange(n, dtype="<i4").tobytes(), "hashes": [x.hash for x in rows], "positions": range(n), "counts": [x.c for x in rows], "places": [x.place for x in rows], "sizes": [1] * n}
    block = maxent_lm.Block.read(row | {"positions": np.arange(n)}, model)
    weights = maxent_lm.Weights.zeros(model)
    weights.inner[:] = r.normal(0, 0.5, weights.inner.shape)
    at = np.flatnonzero(block.tree["power"] >= 0)
    total = np.zeros(len(at))
    for who, features, bias, child in block.steps(at):
        z = block.step_logits(features, bias, weights)
        total[who] += z[np.arange(len(who)), child] - np.log(np.exp(z).sum(1))
    assert np.isfinite(total).all()
    names = ("power", "part", "leaf", "place")
    assert len({tuple(int(block.tree[x][i]) for x in names) for i in at}) == len(at) == 8998
    for power in (0, 3):
        assert 0.97 < np.exp(total[block.tree["power"][at] == power]).sum() < 1 + 1e-4


def test_context_tells_words_of_a_large_class_apart(spark):
    """Each of 400 words follows a word of its own; all are about as frequent."""
    r = random.Random(4)
    docs = [" ".join(f"a{k} b{k}" for k in r.choices(range(400), k=50)) for _ in range(1200)]
    got = maxent_lm.score_documents(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(2), block_tokens=20000).collect()
    held = [x for x in got if x.held_out]
    # 800 words as they come cost log2(800) = 9.6 bits a token; half of them are determined by the last word
    bits = -sum(x.score for x in held) / sum(x.n_tokens for x in held) * math.log2(10)
    assert bits < 8.6
