"""Verdicts by line frequency, against brute force."""

import collections
import random
import re

import pytest

from glossweave.llm import line_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def expected(rows, max_docs, min_words=20, min_share=0.2):
    """{(id, text, host): (kept, words left, numbers of common lines)} by counting distinct texts per host and line."""
    normal = lambda line: " ".join(WORD.findall(low(line)))
    stands = collections.defaultdict(set)
    for _, text, host in rows:
        for line in (text or "").split("\n"):
            if normal(line):
                stands[host, normal(line)].add(text)
    out = {}
    for i, text, host in rows:
        words = WORD.findall(text or "")
        seen = collections.Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        cover = {k + j for k in range(len(words) - 7) if seen[tuple(words[k : k + 8])] > 1 for j in range(8)}
        gone = [k for k, line in enumerate((text or "").split("\n")) if len(stands.get((host, normal(line)), ())) > max_docs]
        left = len(words) - sum(len(WORD.findall((text or "").split("\n")[k])) for k in gone)
        failed = len(words) < min_words or 100 * len(cover) > 30 * len(words)
        out[i, text, host] = (not failed and left >= min_words and left >= min_share * len(words), left, gone)
    return out


def check(spark, rows, max_docs):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = line_quality._judged(df, max_docs=max_docs).collect()
    want = expected(rows, max_docs)
    by = collections.defaultdict(list)
    for (i, _, host), x in want.items():
        by[i, host].append(x)
    assert len(got) == len(rows)
    for x in got:
        assert (x.kept, x.words_left, list(x.gone_lines)) in by[x.doc_id, x.host]
    return want


@pytest.mark.parametrize(("n_lines", "own"), [(2, 1), (5, 1), (8, 2)])
def test_blocks_of_boilerplate_go(spark, n_lines, own):
    """Pages of one host with the same lines on each, and lines of their own."""
    r = random.Random(n_lines)
    prose = lambda k: " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(k))
    block = [prose(5) for _ in range(n_lines)]
    rows = [(i, "\n".join([block[0], *(prose(30) for _ in range(own)), *block[1:]]), "h") for i in range(100)]
    want = check(spark, rows, 20)
    assert all(kept and gone == [0, *range(own + 1, own + n_lines)] for kept, _, gone in want.values())


def test_verdicts_equal_brute_force(spark):
    r = random.Random(5)
    prose = lambda k: " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(k))
    shared = [prose(r.randint(1, 12)) for _ in range(12)]
    rows = []
    for i in range(150):
        lines = [r.choice(shared).upper() if r.random() < 0.6 else prose(r.randint(0, 15)) for _ in range(r.randint(0, 9))]
        rows.append((i, "\n".join(lines), r.choice(["a", "b", None])))
    copy = "\n".join([prose(20), prose(20)])
    rows += [(200 + i, copy, "a") for i in range(30)]  # copies are one document
    rows += [(300 + i, copy + "\n" + prose(3), "b") for i in range(30)]  # near copies aren't
    rows += [(None, None, "a"), (None, "x\n\ny", None), (7, prose(30), "a"), (8, "", "b"), (9, "a b " * 40, "b"), (10, prose(9000) + "\n" + shared[0], "a")]
    want = check(spark, rows, 6)
    assert all(want[200 + i, copy, "a"][0] for i in range(30))
    assert {x[0] for x in want.values()} == {True, False}


def test_awkward_columns(spark):
    """Input columns with the names that the operator uses inside."""
    names = "doc_id long, text string, source string, host string, text_key string, gone_lines string, left string, row string, at string, of string, _id string, _gone string"
    good = " ".join("w%d" % i for i in range(40))
    df = spark.createDataFrame([(1, good, "s", *["x"] * 9), (2, "short", "s", *["y"] * 9)], names)
    kept = line_quality.apply_line_quality(df)
    assert kept.schema == df.schema and kept.collect() == [df.collect()[0]]
