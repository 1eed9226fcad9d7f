"""Hashed maximum-entropy language model with class-factored softmax.

log P(word | context) = log P(class | context) + log P(word | class, context).
Classes go by training count: each word that makes up 1/32 of the corpus is a
class of its own (32 at most), all others fall into classes by powers of two of
their count, and words unseen in training are one class with one event.  A power
of two that ``SPLIT`` words or fewer have is split by hash into classes of some
``MEMBERS`` words, so that they stay small: there the second factor is a softmax
over the class's words, of their frequency as bias and hashed features (the class
with the last word, and with the last two).  A class of more words is a tree: a
part of the power of two (``SUBS`` of equal width, their masses as bias), then the
digits, to base ``BASE``, of a leaf's number, which is a hash of the word, then those
of the word's place in its leaf of some ``LEAF_WORDS`` words.  Each node is a softmax with the
same two features, so every word of the vocabulary has trained factors of its own; a leaf
without a word takes its share of the probability with it.  The first factor is a softmax of a bias and hashed features: the
last word, the last two words, and the word before the last (a skip).

The rows of hashed features grow with the square root of the training tokens, from
2**8 to 2**``MAX_BITS`` a kind (twice that in the trees), so the weights stay a bounded broadcast; the counts
grow with the vocabulary and are never broadcast.

A training token's label is the class that its word would have without this
token (leave one out), so the mass of unseen and rare words is what held-out
text needs.  The probabilities of the V + 1 events sum to one at most.

Training: every task takes the current weights and goes through its documents in
mini-batches (Adagrad with one rate for a row of weights); the changes, weighted by tokens, are averaged over the
tasks in a tree of streamed means and added.  Each round takes its own part of
the documents, so after all rounds each training document was used once; blocks
are split into these parts before, so a round reads no others.

Words are known by a 64-bit hash.  Documents are packed in blocks of about
``block_tokens`` tokens with a dictionary of their own; counts meet the blocks by
a join.

A null or empty text is the end token alone.  A null id counts as the text "" for
the split.  Repeated rows each count.  Other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .staging import Staging

END = np.uint64(0x9D5C3B1A70F2E846)  # the end token's hash
START = np.uint64(0x1F83D9ABFB41BD6B)
KINDS, INNER, MAX_BITS = 3, 2, 15
HEAD_SHARE, SPLIT, MEMBERS = 32, 256, 24
BITS, LEAF = 4, 20  # of a digit, of a place in a leaf
SUBS = BASE = 1 << BITS  # parts of a power of two, children of a node
LEAF_WORDS = 10  # of a tree, on average
EVEN = 4096  # a node over more leaves has children of about equal shares
BATCH, FEW, FAN = 1 << 14, 64, 32
SPREAD = np.uint64(0x9E3779B97F4A7C15)
BLOCKS = "block long, doc_ids array<long>, held array<boolean>, sizes array<int>, codes binary, hashes array<long>, train array<int>"
PARTS = "part int, doc_ids array<long>, sizes array<int>, codes binary, hashes binary, counts binary, places binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _held_out(doc_id: int | None, folds: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else b"%d" % doc_id) % folds == 0


def _pack(block_tokens: int, folds: int):
    def block(number: int, parts: list[tuple[list, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids = [i for p in parts for i in p[0]]
        sizes = np.concatenate([p[1] for p in parts])
        tokens = np.concatenate([p[2] for p in parts])
        held = np.array([_held_out(i, folds) for i in ids], bool)
        hashes, codes = np.unique(tokens, return_inverse=True)
        train = np.bincount(codes[np.repeat(~held, sizes)], minlength=len(hashes))
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), one(ids, pa.int64()), one(held, pa.bool_()), one(sizes, pa.int32()), pa.array([codes.astype("<i4").tobytes()], pa.binary()), one(K.signed(hashes), pa.int64()), one(train, pa.int32())],
            ["block", "doc_ids", "held", "sizes", "codes", "hashes", "train"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        parts: list = []
        size = 0
        for batch in batches:
            for part in K.pieces(batch):
                data, offsets = K.buffers(part.column("text"))
                w = K.find_words(data, offsets)
                tokens = np.insert(K.byte_hash(K.LOWER[data], w.starts, w.ends), w.first[1:], END)
                parts.append((part.column("doc_id").to_pylist(), w.per_text + 1, tokens))
                size += len(tokens)
                if size >= block_tokens:
                    yield block(number, parts)
                    number, parts, size = number + 1, [], 0
        if parts:
            yield block(number, parts)

    return run


@dataclass
class Classes:
    """What turns counts into classes, and the classes' sizes; some thousands of numbers at most."""

    n: int
    v: int
    head: dict[int, int] = field(default_factory=dict)  # word hash -> class
    bins: dict[int, int] = field(default_factory=dict)  # floor(log2 count) -> first class
    parts: dict[int, int] = field(default_factory=dict)  # floor(log2 count) -> number of classes
    mass: np.ndarray = field(default_factory=lambda: np.ones(1))  # of the training counts of a class's words
    bias: np.ndarray = field(default_factory=lambda: np.zeros(1, np.float32))
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # of small classes, sorted
    slots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # their places in their classes
    inner: np.ndarray = field(default_factory=lambda: np.zeros((1, 1), np.float32))  # log shares by class and place
    tree: np.ndarray = field(default_factory=lambda: np.zeros((64, SUBS, 2), np.int64))  # mass and leaves of the parts of large classes

    @property
    def bits(self) -> int:
        """Of a hashed feature."""
        return min(max(round(math.log2(self.n + 1) / 2), 8), MAX_BITS)

    @property
    def tree_bits(self) -> int:
        """Of a hashed feature in the trees; a token has several nodes there."""
        return self.bits + 1

    def of(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Classes; 0 is the unseen words'."""
        first, parts = np.zeros(64, np.int64), np.ones(64, np.int64)
        # a count whose bin is empty in the corpus (a neighbour under leave-one-out) takes the next lower one
        for b in range(64):
            if b in self.bins:
                first[b], parts[b] = self.bins[b], self.parts.get(b, 1)
            elif b:
                first[b], parts[b] = first[b - 1], parts[b - 1]
        b = np.frexp(np.maximum(counts, 1))[1] - 1
        out = np.where(counts > 0, first[b] + (K.mix(hashes) % parts[b].astype(np.uint64)).astype(np.int64), 0)
        for h, k in self.head.items():
            out[hashes == np.uint64(h & (1 << 64) - 1)] = k
        return out

    def slot(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Places of words in small classes; -1 for all others."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where((self.words[at] == hashes) & (counts > 0), self.slots[at], -1)

    @property
    def large(self) -> list[int]:
        """Powers of two whose class is a tree."""
        return np.flatnonzero(self.tree[:, :, 1].any(1)).tolist()

    @cached_property
    def shares(self) -> np.ndarray:
        """Log shares of a node's children: of the parts of each power of two, then of the digits of ``EVEN`` numbers or fewer, by the largest number."""
        out = np.zeros((64 + EVEN, BASE))
        out[:64, :SUBS] = self.tree[:, :, 0]
        out[64:] = (np.arange(EVEN)[:, None] - np.arange(BASE)) // BASE + 1
        with np.errstate(divide="ignore"):
            return np.log(out / np.maximum(out.sum(1, keepdims=True), 1)).astype(np.float32)

    def place(self, vocabulary: DataFrame) -> DataFrame:
        """(hash, c, place): of a word in a tree its place in its leaf and, shifted by ``LEAF`` bits, the leaf's words; else 0."""
        b = _power(F.col("c"))
        in_tree = (F.col("c") * HEAD_SHARE < self.n) & b.isin(self.large) if self.large else F.lit(False)
        leaves = F.array(*[F.lit(int(x)) for x in self.tree[:, :, 1].ravel()])
        x = vocabulary.where(in_tree).withColumn("b", b).withColumn("sub", _sub(F.col("c"), F.col("b")))
        x = x.withColumn("leaf", F.shiftrightunsigned("hash", 20) % F.get(leaves, F.col("b") * SUBS + F.col("sub")))
        mine = Window.partitionBy("b", "sub", "leaf")
        k, at = F.count("*").over(mine), F.row_number().over(mine.orderBy("hash")) - 1
        return x.select("hash", "c", (k * (1 << LEAF) + at).alias("place")).unionByName(vocabulary.where(~in_tree).select("hash", "c", F.lit(0).cast("long").alias("place")))


def _power(c: Column) -> Column:
    return F.floor(F.log2(c)).cast("int")  # exact for counts below 2**48


def _sub(c: Column, b: Column) -> Column:
    """The part of its power of two that a count is in."""
    width = F.pow(F.lit(2.0), b)
    return F.floor((c - width) * SUBS / width).cast("int")


def _classes(vocabulary: DataFrame) -> Classes:
    seen = vocabulary.where("c > 0")
    total = seen.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    if not total.v:
        return Classes(0, 0)
    out = Classes(int(total.n), int(total.v))
    head = seen.where(F.col("c") * HEAD_SHARE >= out.n).orderBy("hash").collect()  # HEAD_SHARE words at most
    rest = seen.where(F.col("c") * HEAD_SHARE < out.n).withColumn("b", _power(F.col("c")))
    by_bin = {r.b: (int(r.m), int(r.w)) for r in rest.groupBy("b").agg(F.sum("c").alias("m"), F.count("*").alias("w")).collect()}  # 64 at most
    small = [b for b, (_, w) in by_bin.items() if w <= SPLIT]
    members = rest.where(F.col("b").isin(small)).orderBy("b", "hash").collect() if small else []  # 64 * SPLIT words at most
    parts = rest.groupBy("b", _sub(F.col("c"), F.col("b")).alias("sub")).agg(F.sum("c").alias("m"), F.count("*").alias("w")).collect()  # 64 * SUBS at most
    for r in parts:
        if r.b not in small:
            out.tree[r.b, r.sub] = r.m, -(-r.w // LEAF_WORDS)
    n_classes = 1
    for b in sorted(by_bin):
        out.bins[b], out.parts[b] = n_classes, -(-by_bin[b][1] // MEMBERS) if b in small else 1
        n_classes += out.parts[b]
    out.head = {r.hash: n_classes + i for i, r in enumerate(head)}
    n_classes += len(head)
    out.mass = np.zeros(n_classes)
    out.mass[0] = 1
    for b in by_bin:
        if b not in small:
            out.mass[out.bins[b]] = by_bin[b][0]
    for r in head:
        out.mass[out.head[r.hash]] = r.c
    if members:
        hashes = np.array([r.hash for r in members], np.int64).view(np.uint64)
        counts = np.array([r.c for r in members], np.int64)
        klass = out.of(hashes, counts)
        np.add.at(out.mass, klass, counts)
        order = np.argsort(klass, kind="stable")
        slot = np.empty(len(klass), np.int64)
        slot[order] = np.arange(len(klass)) - np.searchsorted(klass[order], klass[order])
        out.inner = np.full((n_classes, int(slot.max()) + 1), -np.inf, np.float32)
        out.inner[klass, slot] = np.log(counts / out.mass[klass])
        by_hash = np.argsort(hashes)
        out.words, out.slots = hashes[by_hash], slot[by_hash]
    left_out = {r.b1: int(r.m) for r in rest.groupBy(F.when(F.col("c") == 1, -1).otherwise(_power(F.col("c") - 1)).alias("b1")).agg(F.sum("c").alias("m")).collect()}
    label = np.full(n_classes, 0.5)
    for b, m in left_out.items():
        near = next((x for x in range(b, -1, -1) if x in out.bins), None) if b >= 0 else None
        mine = slice(0, 1) if near is None else slice(out.bins[near], out.bins[near] + out.parts[near])
        label[mine] += m * out.mass[mine] / max(out.mass[mine].sum(), 1)
    for r in head:
        label[out.head[r.hash]] += r.c
    out.bias = np.log(label / label.sum()).astype(np.float32)
    return out


@dataclass
class Weights:
    """Of the class, of the child of a tree's node and of the word in a small class, by hashed feature."""

    outer: np.ndarray
    inner: np.ndarray
    small: np.ndarray

    @classmethod
    def zeros(cls, model: Classes) -> Weights:
        table = lambda kinds, width, more=0: np.zeros((kinds, 1 << model.bits + more, width), np.float32)
        return cls(table(KINDS, len(model.bias)), table(INNER, BASE, model.tree_bits - model.bits) if model.large else table(INNER, 1), table(INNER, model.inner.shape[1]))

    @classmethod
    def squares(cls, model: Classes) -> Weights:
        """Adagrad's sums, one for a row of weights."""
        x = cls.zeros(model)
        return cls(*(np.zeros(w.shape[:2], np.float32) for w in (x.outer, x.inner, x.small)))

    def copy(self) -> Weights:
        return Weights(self.outer.copy(), self.inner.copy(), self.small.copy())

    def pieces(self) -> list[np.ndarray]:
        """Views of some hundred kilobytes each, in a fixed order."""
        return [p for w in (self.outer, self.inner, self.small) for kind in w for p in np.array_split(kind, max(1, kind.size >> 16))]


@dataclass
class Block:
    """The tokens of a block with their counts, classes and features."""

    row: dict
    model: Classes
    sizes: np.ndarray
    counts: np.ndarray
    klass: np.ndarray
    label: np.ndarray
    slot: np.ndarray
    features: np.ndarray
    near: np.ndarray  # features inside the class
    codes: np.ndarray
    contexts: tuple[np.ndarray, np.ndarray]
    tree: dict[str, np.ndarray]  # of each word in a tree: power of two (-1 for all others), part, leaf, place, words of the leaf

    @classmethod
    def read(cls, row: dict, model: Classes) -> Block:
        codes = np.frombuffer(row["codes"], "<i4")
        sizes = np.asarray(row["sizes"], np.int64)
        hashes = np.asarray(row["hashes"], np.int64).view(np.uint64)
        known = row.get("positions", slice(None))  # of the words that have a count
        counts, place = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        counts[known], place[known] = row["counts"], row["places"]
        klass = model.of(hashes, counts)
        label = model.of(hashes, np.maximum(counts - 1, 0))
        first = np.cumsum(sizes) - sizes
        word = hashes[codes]
        last = np.empty_like(word)
        last[1:] = word[:-1]
        last[first] = START
        skip = np.empty_like(word)
        skip[2:] = word[:-2]
        skip[first] = START
        second = first + 1
        skip[second[sizes > 1]] = START
        shift = np.uint64(64 - model.bits)
        both = K.mix(last * np.uint64(3) + K.mix(skip))
        row_of = lambda f: ((f * SPREAD) >> shift).astype(np.uint16)
        features = np.stack([row_of(f) for f in (last, both, skip)])
        mine = K.mix(klass.astype(np.uint64) + np.uint64(11))[codes]
        near = np.stack([row_of(f ^ mine) for f in (last, both)])
        power = np.frexp(np.maximum(counts, 1))[1] - 1
        part = ((counts - (1 << power)) * SUBS >> power) * (place > 0)
        leaves = np.maximum(model.tree[power, part, 1], 1)
        leaf = (hashes >> np.uint64(20)) % leaves.astype(np.uint64)
        tree = {"power": np.where(place > 0, power, -1), "part": part, "leaf": leaf, "place": place & (1 << LEAF) - 1, "words": place >> LEAF, "leaves": leaves}
        tree = {n: x.astype(np.int32) for n, x in tree.items()}
        return cls(row, model, sizes, counts[codes], klass[codes].astype(np.int16), label[codes].astype(np.int16), model.slot(hashes, counts)[codes].astype(np.int16), features, near, codes, (last, both), tree)

    def logits(self, at: np.ndarray | slice, weights: Weights) -> np.ndarray:
        out = weights.outer[0].take(self.features[0][at], axis=0)
        for k in range(1, KINDS):
            out += weights.outer[k].take(self.features[k][at], axis=0)
        out += self.model.bias
        return out

    def inner_logits(self, at: np.ndarray, weights: Weights) -> np.ndarray:
        """Of the words of each token's class; places that the class doesn't fill are minus infinity."""
        out = self.model.inner.take(self.klass[at], axis=0)
        for k in range(INNER):
            out += weights.small[k].take(self.near[k][at], axis=0)
        return out

    def steps(self, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Down the trees of the tokens at ``at``: which of them, features, log shares of the children, and the child taken."""
        code = self.codes[at]
        power, part = self.tree["power"][code], self.tree["part"][code]
        contexts = [f[at] for f in self.contexts]
        shift = np.uint64(64 - self.model.tree_bits)
        shares = self.model.shares

        def features(who: np.ndarray, node: np.ndarray) -> list[np.ndarray]:
            return [((f[who] ^ node) * SPREAD >> shift).view(np.int64) for f in contexts]

        node = K.mix(power.astype(np.uint64) + np.uint64(17))
        yield np.arange(len(at)), features(slice(None), node), shares.take(power, axis=0), part
        node += part.astype(np.uint64) + np.uint64(1)
        node *= SPREAD
        # the digits of the leaf, then those of the place in it, lowest first; numbers up to ``most`` are in use
        for number, most in (("leaf", "leaves"), ("place", "words")):
            most = self.tree[most][code] - 1
            who = np.flatnonzero(most > 0)
            number, most = self.tree[number][code[who]], most[who]
            while len(who):
                here, child = node[who], number & BASE - 1
                yield who, features(who, here), shares.take(np.minimum(most, EVEN - 1) + 64, axis=0), child
                here += child.astype(np.uint64) + np.uint64(1)
                node[who] = here * SPREAD
                number, most = number >> BITS, most - child >> BITS
                more = np.flatnonzero(most > 0)
                who, number, most = who[more], number[more], most[more]

    def step_logits(self, rows: np.ndarray, bias: np.ndarray, weights: Weights) -> np.ndarray:
        """Changes ``bias`` into the logits."""
        for k in range(INNER):
            bias += weights.inner[k].take(rows[k], axis=0)
        return bias

    def scores(self, weights: Weights, held: bool) -> pa.RecordBatch:
        n, v = self.model.n, self.model.v
        log_word = np.log(np.maximum(self.counts, 1) / self.model.mass[self.klass])

        def own(z: np.ndarray, wanted: np.ndarray) -> np.ndarray:
            z, _, total = _exp(z)
            return z.ravel()[np.arange(len(z)) * z.shape[1] + wanted] - np.log(total)

        for lo in range(0, len(self.klass), BATCH // 2):
            at = slice(lo, lo + BATCH // 2)
            small = lo + np.flatnonzero(self.slot[at] >= 0)
            if len(small):
                log_word[small] = own(self.inner_logits(small, weights), self.slot[small])
            deep = lo + np.flatnonzero(self.tree["power"][self.codes[at]] >= 0)
            if len(deep):
                log_word[deep] = 0
                for who, rows, bias, child in self.steps(deep):
                    log_word[deep[who]] += own(self.step_logits(rows, bias, weights), child)
            log_word[at] += own(self.logits(at, weights), self.klass[at])
        base = np.log10((self.counts + 0.1) / (n + 0.1 * (v + 1)))
        first = np.cumsum(self.sizes) - self.sizes
        add = lambda x: np.add.reduceat(x, first)  # noqa: E731  no size is zero
        columns = [
            (self.row["doc_ids"], pa.int64()), (np.full(len(first), held), pa.bool_()), (self.sizes, pa.int64()), (add((self.counts > 0).astype(np.int64)), pa.int64()),
            (np.full(len(first), n), pa.int64()), (add(base), pa.float64()), (add(log_word) / np.log(10), pa.float64()),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], [c.split()[0] for c in SCORES.split(", ")])

    def train(self, weights: Weights, squares: Weights, rate: float) -> int:
        """Adagrad through the block's documents; changes the arrays in place."""
        for lo in range(0, len(self.klass), BATCH):
            at = slice(lo, lo + BATCH)
            _step(weights.outer, squares.outer, self.features[:, at], self.logits(at, weights), self.label[at], rate)
            # a token whose word would leave its class is no example of the class
            i = lo + np.flatnonzero(self.label[at] == self.klass[at])
            deep, i = i[self.tree["power"][self.codes[i]] >= 0], i[self.slot[i] >= 0]
            if len(deep):
                for _, rows, bias, child in self.steps(deep):
                    _step(weights.inner, squares.inner, rows, self.step_logits(rows, bias, weights), child, rate)
            if len(i):
                _step(weights.small, squares.small, self.near[:, i], self.inner_logits(i, weights), self.slot[i], rate)
        return len(self.klass)


def _exp(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits, their exponentials and the sums of these by row; the rows' largest logits are taken off only if that is needed."""
    ones = np.ones(z.shape[1], np.float32)
    with np.errstate(over="ignore", invalid="ignore"):
        e = np.exp(z)
        total = e @ ones
    if not (total.min() > 1e-30 and total.max() < 1e30):
        z = z - z.max(1, keepdims=True)
        e = np.exp(z)
        total = e @ ones
    return z, e, total


def _sums(p: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of ``f``, and the sum of the rows of ``p`` that each has."""
    order = np.argsort(f.astype(np.uint16), kind="stable")
    f = f[order]
    ends = np.append(np.flatnonzero(f[1:] != f[:-1]) + 1, len(f))
    first = np.append(0, ends[:-1])
    times = ends - first
    by_times = np.argsort((len(f) - times).astype(np.uint16), kind="stable")
    first, times = first[by_times], times[by_times]
    out = p.take(order[first], axis=0)
    # the k-th row of every value that has one, as long as many do; then the rest of the few values that are left
    longer = len(times) - np.cumsum(np.bincount(times))
    k = 1
    while k < len(longer) and longer[k] > FEW:
        out[: longer[k]] += p.take(order[first[: longer[k]] + k], axis=0)
        k += 1
    if k < len(longer):
        left = times[: longer[k]] - k
        rest = order[K.spread(first[: longer[k]] + k, left)]
        out[: longer[k]] += np.add.reduceat(p.take(rest, axis=0), np.cumsum(left) - left)
    return f[first], out


def _step(weights: np.ndarray, squares: np.ndarray, features: np.ndarray, logits: np.ndarray, wanted: np.ndarray, rate: float) -> None:
    """One Adagrad step of a softmax on a mini-batch; a row of weights has one rate."""
    _, p, total = _exp(logits)
    scale = np.float32(1 / 16)
    p *= (scale / total)[:, None]
    p.ravel()[np.arange(len(p)) * p.shape[1] + wanted] -= scale
    for k, f in enumerate(features):
        rows, gradient = _sums(p, f)
        seen = squares[k].take(rows) + np.einsum("ij,ij->i", gradient, gradient) / np.float32(gradient.shape[1])
        squares[k][rows] = seen
        gradient *= (np.float32(rate) / np.sqrt(seen + np.float32(1)))[:, None]
        whole = weights[k].view(f"V{4 * weights.shape[2]}")[:, 0]
        whole[rows] = (weights[k].take(rows, axis=0) - gradient).view(whole.dtype)[:, 0]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    def value(name: str, x: pa.Scalar):
        if name == "doc_ids" or not (pa.types.is_list(x.type) or pa.types.is_binary(x.type)):
            return x.as_py()
        if pa.types.is_list(x.type):
            return x.values.to_numpy(zero_copy_only=False)
        data = x.as_buffer().to_pybytes()
        return data if name == "codes" else np.frombuffer(data, "<i8")

    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: value(n, batch.column(n)[i]) for n in batch.schema.names}


def _part(rounds: int):
    """A block's documents by the round that trains on them; those held out are part ``rounds``.  Each part has the words that stand in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            codes, sizes, known = np.frombuffer(row["codes"], "<i4"), row["sizes"], row["positions"]
            counts, places = np.zeros((2, len(row["hashes"])), "<i8")
            counts[known], places[known] = row["counts"], row["places"]
            part_of = np.where(row["held"], rounds, np.arange(len(sizes)) % rounds)
            for part in range(rounds + 1):
                mine = part_of == part
                if mine.any():
                    own = codes[np.repeat(mine, sizes)]
                    used = np.zeros(len(counts), bool)
                    used[own] = True
                    own = (np.cumsum(used) - 1).astype("<i4")[own]
                    columns = [
                        pa.array([part], pa.int32()), pa.array([[x for x, here in zip(row["doc_ids"], mine) if here]], pa.list_(pa.int64())), pa.array([sizes[mine]], pa.list_(pa.int32())),
                        *(pa.array([x.tobytes()], pa.binary()) for x in (own, row["hashes"][used], counts[used], places[used])),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PARTS.split(", ")])

    return run


CHANGES = "piece int, part int, tokens long, change binary"


def _means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token-weighted means of the changes of each (piece, part); rows come key by key, and one sum is held at a time."""
    key, tokens, total = None, 0, np.zeros(0)

    def done() -> pa.RecordBatch:
        mean = (total / max(tokens, 1)).astype(np.float16).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([tokens], pa.int64()), pa.array([mean], pa.binary())], ["piece", "part", "tokens", "change"])

    for batch in batches:
        for i in range(batch.num_rows):
            here = batch.column("piece")[i].as_py(), batch.column("part")[i].as_py()
            n, x = batch.column("tokens")[i].as_py(), np.frombuffer(batch.column("change")[i].as_buffer(), np.float16)
            if here != key:
                if key is not None:
                    yield done()
                key, tokens, total = here, 0, np.zeros(len(x))
            tokens += n
            total += x * np.float64(n)
    if key is not None:
        yield done()


def train(ready: DataFrame, model: Classes, rounds: int, rate: float) -> Weights:
    """The weights after all rounds."""
    spark = ready.sparkSession
    weights = Weights.zeros(model)
    for number in range(rounds if model.n else 0):
        mine = ready.where(F.col("part") == number)
        tasks = mine.rdd.getNumPartitions()
        held = spark.sparkContext.broadcast((model, weights))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            model, start = held.value
            w, squares, tokens = start.copy(), Weights.squares(model), 0
            for row in _rows(batches):
                tokens += Block.read(row, model).train(w, squares, rate)
            if tokens:
                change = [(a - b).astype(np.float16).tobytes() for a, b in zip(w.pieces(), start.pieces())]
                n, task = len(change), TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([task // FAN] * n, pa.int32()), pa.array([tokens] * n, pa.int64()), pa.array(change, pa.binary())], ["piece", "part", "tokens", "change"])

        means, groups = mine.mapInArrow(run, CHANGES), tasks
        while groups:
            # FAN changes come together in a task at a time, level by level
            means = means.repartition("piece", "part").sortWithinPartitions("piece", "part").mapInArrow(_means, CHANGES)
            groups = -(-groups // FAN)
            if groups == 1:
                break
            means = means.withColumn("part", F.floor(F.col("part") / FAN).cast("int"))
        pieces = weights.pieces()
        for r in means.collect():  # the size of the weights
            pieces[r.piece] += np.frombuffer(r.change, np.float16).reshape(pieces[r.piece].shape).astype(np.float32)
        held.destroy()
    return weights


def score_documents(docs: DataFrame, folds: int = 10, rounds: int = 3, rate: float = 0.3, block_tokens: int = 1 << 20, staging: Staging | None = None) -> DataFrame:
    """One row per document: fold, tokens, known tokens, training tokens, base score and the model's score."""
    staging = staging or Staging(docs.sparkSession, "maxent_lm")
    spark = docs.sparkSession
    # a bucketed table in the warehouse: the blocks stay where they are when counts are joined to them
    table = f"lm_blocks_{uuid.uuid4().hex}"
    packed = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pack(block_tokens, folds), BLOCKS)
    try:
        packed.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").option("compression", "zstd").saveAsTable(table)
        blocks = spark.table(table)
        words = blocks.select("block", F.posexplode(F.arrays_zip("hashes", "train")).alias("position", "x")).select("block", "position", F.col("x.hashes").alias("hash"), F.col("x.train").alias("train"))
        vocabulary = staging.write(words.groupBy("hash").agg(F.sum("train").alias("c")).where("c > 0"), "vocabulary")
        model = _classes(vocabulary)
        placed = vocabulary.withColumn("place", F.lit(0).cast("long"))
        if model.large:
            placed = staging.write(model.place(vocabulary), "placed")
        counts = words.select("block", "position", "hash").join(placed, "hash").groupBy("block").agg(*(F.collect_list(c).alias(n) for c, n in (("position", "positions"), ("c", "counts"), ("place", "places"))))
        empty: Column = F.array().cast("array<int>")
        joined = blocks.drop("train").join(counts, "block", "left").withColumns({"positions": F.coalesce("positions", empty), "counts": F.coalesce("counts", empty.cast("array<long>")), "places": F.coalesce("places", empty.cast("array<long>"))})
        parts = max(rounds, 1)
        ready = staging.write(joined.mapInArrow(_part(parts), PARTS), "ready", partition_by="part")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    staging.keep("ready")
    weights = train(ready, model, rounds, rate)
    held = spark.sparkContext.broadcast((model, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, weights = held.value
        for row in _rows(batches):
            yield Block.read(row, model).scores(weights, row["part"] == parts)

    return ready.mapInArrow(run, SCORES)
