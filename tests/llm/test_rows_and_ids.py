"""Rows without an id, and equal ids with different texts."""

import collections
import random

from glossweave.llm import line_quality, temperature_mixing


def test_every_row_has_its_own_verdict(spark):
    r = random.Random(3)
    good = ["good " + " ".join("w%d" % r.getrandbits(30) for _ in range(30)) for _ in range(4)]
    rows = [(None, good[0], "a"), (None, "too short", "a"), (1, good[1], "a"), (1, "also too short", "a"), (2, good[2], "a"), (2, good[3], None), (3, None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2)
    kept = line_quality.apply_line_quality(df)
    want = collections.Counter((i, t, s) for i, t, s in rows if t in good)
    assert collections.Counter(map(tuple, kept.collect())) == want
    mixed = temperature_mixing.apply_mixing(kept, max_repeats=2.0)
    assert set(map(tuple, mixed.collect())) == set(want)
