"""Operators on documents against brute force, with the awkward rows in every table."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from glossweave.llm import covering_simhash, line_quality, maxent_lm, suffix_decontamination, temperature_mixing, token_store

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Names that operators use inside.
SCHEMA = "doc_id long, text string, source string, n_chars long, h string, fp string, row string, hits string, lines string, component string, start string, _id string, _gone string, _times string, _copy string, _key string, _of string, whole string"


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def documents(seed=3, n=60):
    r = random.Random(seed)
    word = lambda: r.choice(["the", "of", "É", "w%d" % r.randint(0, 200), "A%d." % r.randint(0, 50), "x#y"])
    text = lambda k: r.choice((" ", "  ", "\t"))[:1].join(word() + ("\n" if r.random() < 0.08 else "") for _ in range(k))
    rows = [(i, text(r.randint(0, 90)), r.choice("ab")) for i in range(n)]
    base = text(60)
    rows += [(100 + i, base, "a") for i in range(6)]
    rows += [(200 + i, base + " " + word(), "a") for i in range(4)]
    rows += [(300, None, "a"), (301, "", None), (302, " \n \t", "b"), (303, "one", "b"), (304, "one two", None), (305, "z" * 30_000 + " " + text(2000), "b"), (306, base, "a"), (306, base, "a")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, *["clash"] * 14) for i, t, s in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, documents())


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_line_quality_figures(docs):
    want = collections.Counter()
    for i, t, _ in documents():
        t = t or ""
        words = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        seen = collections.Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        cover = {k + j for k in range(len(words) - 7) if seen[tuple(words[k : k + 8])] > 1 for j in range(8)}
        failed = len(words) < 20 or 100 * len(cover) > 30 * len(words)
        want[(i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), failed)] += 1
    got = line_quality.line_quality(docs).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(r.kept == (not r.base_failed) for r in got)


def test_common_lines_go_and_copies_stay(spark):
    r = random.Random(8)
    prose = lambda: " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(25))
    rows = [(i, "Subscribe  TO our list\n" + prose() + "\n" + prose(), "h") for i in range(40)]
    rows += [(100 + i, "subscribe to our list\nSubscribe to our list", "h") for i in range(2)]
    rows += [(200 + i, "Subscribe to our list\n" + prose(), "other") for i in range(5)]
    long = [prose() for _ in range(6)]
    rows += [(400 + i, "\n".join(long), "h") for i in range(50)]  # exact copies
    df = frame(spark, rows)
    got = {x.doc_id: x for x in line_quality.line_quality(df, max_docs=20).collect()}
    assert all(got[i].kept and list(got[i].gone_lines) == [0] for i in range(40))
    assert not got[100].kept and got[100].base_failed
    assert all(got[200 + i].kept and not got[200 + i].gone_lines for i in range(5))
    assert all(got[i].kept for i in range(400, 450))
    kept = line_quality.apply_line_quality(df, max_docs=20)
    assert kept.columns == df.columns
    texts = {x.doc_id: (x.text, x.n_chars) for x in kept.collect()}
    assert texts.keys() == {i for i, _, _ in rows} - {100, 101}
    assert texts[0] == (rows[0][1].split("\n", 1)[1], len(rows[0][1].split("\n", 1)[1]))


def fingerprint(text, n=3):
    words = WORD.findall(low(text or ""))
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def components(fps):
    """{id: smallest reachable id} by brute force."""
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_simhash_components(docs):
    fps = {i: fingerprint(t) for i, t, _ in documents()}
    want = components(fps)
    got = covering_simhash.near_duplicates(docs).collect()
    assert len(got) == len(documents())
    assert {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in got} == {i: (fps[i], want[i]) for i in fps}
    kept = covering_simhash.apply_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


@pytest.mark.parametrize("limit", [2, 512])
def test_every_close_pair_is_linked(spark, tmp_path, limit):
    """A crowd of fingerprints around a few centres, so that buckets are split through all levels."""
    from glossweave.llm.staging import Staging
    from glossweave.operators.graph import connected_components

    r = random.Random(limit)
    centres = [r.getrandbits(64) for _ in range(4)]
    fps = {r.choice(centres) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (r.getrandbits(1) << r.randrange(64)) for _ in range(300)} | {r.getrandbits(64) for _ in range(50)}
    signed = {x - (1 << 64) if x >> 63 else x: x for x in fps}
    staging = Staging(spark, "test")
    edges = covering_simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), staging, bucket_limit=limit)
    got = {signed[x.node]: signed[x.component] for x in connected_components(staging.write(edges, "e"), staging.write).collect()}
    want = components({x: x for x in fps})
    groups = collections.defaultdict(set)
    for x, c in want.items():
        groups[c].add(x)
    found = collections.defaultdict(set)
    for x in fps:
        found[got.get(x, x)].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_masks_cover():
    masks = covering_simhash.covering_masks(list(range(64)))
    assert all(any(not m >> a & 1 and not m >> b & 1 for m in masks) for a in range(64) for b in range(a, 64))


def benchmark_rows():
    texts = [t for _, t, _ in documents() if t]
    w = ALNUM.findall(low(texts[5] + " " + texts[6]))
    long = ALNUM.findall(low(texts[-1]))
    return [(0, " ".join(long[3:30])), (1, "nothing of this stands anywhere in there at all ok so"), (2, "one"), (3, None), (4, ""), (5, " ".join(w[2:9])), (10, "ONE, two!"), (11, "one two"), (6, " ".join(long[5:15]) + " zzz " + " ".join(long[20:31])), (6, "one")]


@pytest.mark.parametrize("block_words", [1_000_000, 1])
def test_decontamination(spark, docs, block_words):
    items = benchmark_rows()
    windows = collections.defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(low(t or ""))
        k = min(10, len(w))
        for j in range(len(w) - k + 1) if k else ():
            windows[tuple(w[j : j + k])].add(str(i))
    want = collections.Counter()
    for i, t, _ in documents():
        w = ALNUM.findall(low(t or ""))
        cover, found = set(), set()
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                if hit := windows.get(tuple(w[j : j + k])):
                    cover |= set(range(j, j + k))
                    found |= hit
        want[(i, len(w), len(cover), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(cover))] += 1
    bm = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, doc_id string")
    got = suffix_decontamination.decontaminate(docs, bm, block_words=block_words).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    assert max(r.longest for r in got) == 27
    kept = suffix_decontamination.apply_decontamination(docs, bm)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {w[0] for w in want if not w[5]}
    in_blocks = suffix_decontamination.apply_decontamination(docs, bm, block_words=block_words)
    assert in_blocks.schema == docs.schema and {r.doc_id for r in in_blocks.collect()} == {r.doc_id for r in kept.collect()}
    nothing = suffix_decontamination.decontaminate(docs, bm.where("item_id > 99")).collect()
    assert len(nothing) == len(documents()) and not any(r.contaminated for r in nothing)


def test_token_store(docs, tmp_path):
    path = token_store.vocabulary()
    rows = [(i, t or "") for i, t, _ in documents()] + [(400, "a   b \n\n  c <|endoftext|> don't  "), (401, " x   y")]
    df = frame(docs.sparkSession, [(i, t, "s") for i, t in rows])
    tokenizer = token_store.encoder(path).tokenizer
    encoded = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in rows}
    store = token_store.store_documents(df, path, folder=f"file://{tmp_path}/store")
    ids = store.documents().collect()
    assert collections.Counter(r.doc_id for r in ids) == collections.Counter(i for i, _ in rows)
    assert all(list(r.ids) == encoded[r.doc_id] for r in ids)
    got = sorted(store.verified().collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(i for i, _ in rows)
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32, r.verified) == (at, len(encoded[r.doc_id]), zlib.crc32(np.array(encoded[r.doc_id], "<u4").tobytes()), True)
        at += r.n_tokens
    digests = [r.digest for r in store.chunks.collect()]
    assert len(digests) == len(set(digests)) < store.places().count()


def test_pieces_equal_whole_texts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_store, "REMEMBERED", 300)
    e = token_store.Encoder(token_store.vocabulary())
    r = random.Random(1)
    parts = ["a", "b", "É", "ß", ".", ",", "..", " ", "  ", "\n", "\t", "1", "!", "'s", "don't", "<|endoftext|>", " ", "中", "_", "Wort", "é.", " x,", "x.", "1,", "\U0001f600", "\x1c", "\u00a0"]
    for _ in range(60):
        texts = ["".join(r.choices(parts, k=r.randint(0, 30))) for _ in range(40)] + [None, ""]
        stream, bounds = e.encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert stream[bounds[i] : bounds[i + 1]].tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids, t
        assert len(e.key) <= 300 + 42 * 31


def test_crc_moves_on():
    r = np.random.default_rng(2)
    ids = r.integers(0, 50_000, 70_000).astype("<u4")
    cuts = [0, 1, 5, 3000, 70_000]
    parts = np.array([zlib.crc32(ids[a:b]) for a, b in zip(cuts, cuts[1:])])
    after = np.array([70_000 - b for b in cuts[1:]])
    assert int(np.bitwise_xor.reduce(token_store.shift_crc(parts, after))) == zlib.crc32(ids)


def test_chunks_follow_content():
    r = np.random.default_rng(3)
    shared = r.integers(0, 50_000, 5000).astype("<u2")
    a, b = (np.concatenate([r.integers(0, 50_000, k).astype("<u2"), shared]) for k in (100, 777))
    ends = [{len(x) - e for e in token_store.chunk_bounds(token_store.cut_points(x), 0, len(x))} for x in (a, b)]
    assert len(ends[0] & ends[1]) > 10


def test_mixing_weights_and_blocks(spark):
    r = random.Random(1)
    rows = [(i, " ".join(["w"] * r.randint(1, 9)), "big" if i % 3 else "mid" if i % 2 else None) for i in range(1200)]
    df = frame(spark, rows)
    tokens = collections.Counter()
    for _, t, s in rows:
        tokens[s] += len(t.split())
    table = {x.source: x for x in temperature_mixing.weights(df, max_repeats=1.5).collect()}
    passes = [x.passes for x in table.values()]
    assert min(passes) == 1 and 1.49 < max(passes) < 1.5001
    assert math.isclose(sum(x.weight for x in table.values()), 1)
    placed = temperature_mixing.mix(df, max_repeats=1.5, blocks=8, range_docs=90).collect()
    times = collections.Counter(x.doc_id for x in placed)
    assert all(1 <= times[i] <= 2 for i, _, _ in rows)
    used = collections.Counter()
    in_block = collections.Counter()
    for x in placed:
        used[x.source] += x.tokens
        in_block[x.block, x.source] += x.tokens
    for s, x in table.items():
        assert x.quota <= used[s] < x.quota + 9
        assert all(abs(in_block[b, s] - x.quota / 8) < 20 for b in range(8))
    target = 1.2
    w = [x.weight for x in temperature_mixing.weights(df, entropy=target).collect()]
    assert math.isclose(-sum(p * math.log2(p) for p in w), target, abs_tol=1e-6)
    few = temperature_mixing.mix(df, budget_tokens=300, max_repeats=2.0).collect()
    assert 300 <= sum(x.tokens for x in few) < 300 + 3 * 9
    out = temperature_mixing.apply_mixing(df, max_repeats=1.5)
    assert out.columns == df.columns
    assert collections.Counter(x.doc_id for x in out.collect()) == times


def test_limits_on_passes_hold_under_a_budget(spark):
    rows = [(i, "w " * (1 + i % 5), "big" if i % 10 else "small") for i in range(500)]
    df = frame(spark, rows)
    total = sum(len(t.split()) for _, t, _ in rows)
    for budget, limit in ((total, 3.0), (2 * total, 2.5), (total // 2, 2.0)):
        table = temperature_mixing.weights(df, max_repeats=limit, budget_tokens=budget).collect()
        assert max(x.passes for x in table) <= limit + 0.02
        assert abs(sum(x.quota for x in table) - budget) <= 4
    equal = temperature_mixing.weights(df, max_repeats=100.0, budget_tokens=total).collect()
    assert math.isclose(equal[0].weight, 0.5) and math.isclose(equal[1].weight, 0.5)
    plain = {x.source: x.passes for x in temperature_mixing.weights(df).collect()}
    assert plain == {"big": 1, "small": 1}
    for wrong in ({"max_repeats": 1.5, "budget_tokens": 2 * total}, {"max_repeats": 0.5}, {"entropy": 1.5}, {"entropy": 0.5, "max_repeats": 2.0}):
        with pytest.raises(ValueError):
            temperature_mixing.weights(df, **wrong)


def test_mixing_takes_awkward_rows(docs):
    placed = temperature_mixing.mix(docs, max_repeats=2.0).collect()
    assert {x.doc_id for x in placed} == {i for i, _, _ in documents()}


def test_language_model(spark):
    r = random.Random(6)
    chain = {w: r.sample("abcdefghij", 2) for w in "abcdefghij"}

    def text(n):
        w, out = "a", []
        for _ in range(n):
            w = r.choice(chain[w])
            out.append(w.upper() if r.random() < 0.2 else w)
            if r.random() < 0.05:
                out.append("rare%d" % r.randint(0, 3000))
        return " ".join(out)

    rows = [(i, text(r.randint(1, 200)), "s") for i in range(400)] + [(i + 700, t, s) for i, t, s in documents() if i >= 300] + [(None, "a b", "s")]
    got = maxent_lm.score_documents(frame(spark, rows), block_tokens=3000).collect()
    words = {i: [*WORD.findall(low(t or "")), " end"] for i, t, _ in rows}
    counts = collections.Counter()
    for i, t, _ in rows:
        if zlib.crc32(str("" if i is None else i).encode()) % 10:
            counts.update(words[i])
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    for x in got:
        w = words[x.doc_id]
        base = sum(math.log10((counts[a] + 0.1) / (n + 0.1 * (v + 1))) for a in w)
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(w), sum(a in counts for a in w), n)
        assert math.isclose(x.base_score, base, rel_tol=1e-9)
    held = [x for x in got if x.held_out and x.doc_id is not None and x.doc_id < 400]
    tokens = sum(x.n_tokens for x in held)
    assert sum(x.score for x in held) / tokens > sum(x.base_score for x in held) / tokens + 0.05


def test_context_tells_words_of_one_class_apart(spark):
    """150 words of one frequency, each followed by one of two: only the factor inside the class can know which."""
    r = random.Random(8)
    names = [f"{a}{b}" for a in "abcdefghijklmno" for b in "pqrstuvwxy"]
    after = {w: r.sample(names, 2) for w in names}

    def text():
        w, out = r.choice(names), []
        for _ in range(120):
            w = r.choice(after[w])
            out.append(w)
        return " ".join(out)

    got = maxent_lm.score_documents(frame(spark, [(i, text(), "s") for i in range(500)]), block_tokens=4000).collect()
    held = [x for x in got if x.held_out]
    tokens = sum(x.n_tokens for x in held)
    gain = sum(x.score - x.base_score for x in held) / tokens
    assert gain > 0.6  # of log10(150 / 2) = 1.9 that a perfect model would gain


def test_probabilities_sum_to_one(spark):
    r = random.Random(3)
    counts = [1] * 300 + [2] * 200 + [9] * 8 + [5] * 40 + [20] * 70 + [900]
    vocabulary = spark.createDataFrame([(r.getrandbits(63), c) for c in counts], "hash long, c long")
    model = maxent_lm._classes(vocabulary)
    rows = vocabulary.collect()
    words = np.array([x.hash for x in rows], np.int64).view(np.uint64)
    n = np.array([x.c for x in rows])
    klass, slot = model.of(words, n), model.slot(words, n)
    share = np.where(slot >= 0, np.exp(model.inner[klass, slot]), n / model.mass[klass])
    # inside every class of seen words the shares are one, whatever the features add to the logits
    assert np.allclose(np.bincount(klass, share, len(model.bias))[1:], 1, rtol=1e-5)
    assert math.isclose(np.exp(model.bias).sum(), 1, rel_tol=1e-5)
    assert (slot >= 0).sum() == 200 + 8 + 40 + 70 and len(set(zip(klass[slot >= 0].tolist(), slot[slot >= 0].tolist()))) == 318


def test_empty_tables(empty, spark):
    bm = spark.createDataFrame([], "item_id long, text string")
    assert line_quality.line_quality(empty).collect() == []
    assert covering_simhash.near_duplicates(empty).collect() == []
    assert suffix_decontamination.decontaminate(empty, bm).collect() == []
    assert temperature_mixing.mix(empty).collect() == []
    assert maxent_lm.score_documents(empty).collect() == []
    assert token_store.store_documents(empty, token_store.vocabulary()).verified().collect() == []
    for apply in (line_quality.apply_line_quality, covering_simhash.apply_near_duplicates, temperature_mixing.apply_mixing):
        assert apply(empty).collect() == []


@pytest.mark.parametrize("block_words", [1_000_000, 1])
def test_rows_without_an_id_are_judged_each(spark, block_words):
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(None, f"so {item} it is", "s"), (None, "clean text", "s"), (7, f"{item}", "s"), (7, "clean too", "s"), (None, None, "s")]
    bm = spark.createDataFrame([(1, item), (2, None), (3, "twelve words that stand nowhere in any of the texts at all here")], "item_id long, text string")
    kept = suffix_decontamination.apply_decontamination(frame(spark, rows), bm, block_words=block_words).collect()
    assert sorted((str(x.doc_id), str(x.text)) for x in kept) == [("7", "clean too"), ("None", "None"), ("None", "clean text")]


def test_decontamination_compares_bytes(monkeypatch):
    """Words of one hash aren't one word."""
    import pyarrow as pa

    from glossweave.llm import kernels as K

    real = K.byte_hash
    monkeypatch.setattr(K, "byte_hash", lambda data, starts, ends: real(data, starts, ends) % np.uint64(2))
    r = random.Random(3)
    texts = [" ".join(r.choices("abcd", k=40)) for _ in range(20)]
    item = texts[3][4:30]
    block = suffix_decontamination.Suffixes.of(["i"], [item], 10)
    got = suffix_decontamination._search(pa.RecordBatch.from_arrays([pa.array(range(20), pa.int64()), pa.array(texts)], ["doc_id", "text"]), block)
    windows = {tuple(item.split()[k : k + 10]) for k in range(len(item.split()) - 9)}
    want = [any(tuple(t.split()[k : k + 10]) in windows for k in range(31)) for t in texts]
    assert [len(h) > 0 for h in got.column("hits").to_pylist()] == want
