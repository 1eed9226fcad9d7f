"""Benchmark decontamination with suffix arrays over the training text.

Every task turns its training texts into shards of a fixed size and builds the
suffix array of each: all word positions in the order of the words that follow,
by prefix doubling, as deep as a window.  Every suffix of the benchmark's items
is binary-searched in it, unless a word of its first window stands nowhere in the
shard; the range of its places, each followed on word by word, gives the longest
verbatim matches and where they stand.  Words are compared by 64-bit hashes, and
the matches found then by their bytes.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z.  An item
with fewer than ``window`` words, but some, is one window of all its words.
The benchmark is the stated query set: it goes to the executors in blocks of at
most ``block_words`` words (a longer item alone), one after the other, so what is
broadcast has a fixed bound and training text is never shuffled.

Nulls and empty texts have no words: nothing hits them, and as items they hit
nothing.  Equal items with several ids each count; a repeated id counts once, and
an item without an id has the id "".  Rows come out one per input row, with or
without an id; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .staging import Staging

HITS = "doc_id long, n_words long, hits array<struct<item:string,start:int,length:int,item_start:int,item_words:int>>, covered binary"
SHARD_BYTES = 4 << 20


def _words(column: pa.Array) -> tuple[np.ndarray, K.Words, np.ndarray]:
    """Lower-cased bytes, words and their hashes."""
    data, offsets = K.buffers(column)
    data = K.LOWER[data]
    w = K.find_words(data, offsets, K.NOT_ALNUM)
    return data, w, K.byte_hash(data, w.starts, w.ends)


@dataclass
class Suffixes:
    """The words of a block of items, ready to be searched for."""

    ids: list[str]
    data: np.ndarray
    spans: K.Words
    words: np.ndarray
    window: int

    @classmethod
    def of(cls, ids: list[str], texts: list[str], window: int) -> Suffixes:
        return cls(ids, *_words(pa.array(texts, pa.string())), window)

    def __post_init__(self) -> None:
        self.first = self.spans.first
        need = np.minimum(np.diff(self.first), self.window)  # words of an item's windows
        self.starts: dict[int, np.ndarray] = {}
        for k in sorted({int(x) for x in need if x}):
            items = np.flatnonzero(need == k)
            n = np.diff(self.first)[items] - k + 1
            self.starts[k] = K.spread(self.first[items], n)

    def item_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, "right") - 1


class SuffixArray:
    """All positions of a shard in the order of the words from there on, up to ``depth`` words at least."""

    def __init__(self, words: np.ndarray, depth: int):
        self.vocabulary, rank = np.unique(words, return_inverse=True)
        self.codes = np.append(rank + 1, 0)  # what follows the last word is less than any word
        rank, done = rank + 1, 1
        self.positions = np.argsort(rank, kind="stable")
        while done < depth:
            after = np.zeros_like(rank)
            after[: max(0, len(rank) - done)] = rank[done:]
            key = rank * (len(rank) + 1) + after
            self.positions = np.argsort(key, kind="stable")
            k = key[self.positions]
            up = np.ones(len(k), np.int64)
            up[1:] = k[1:] != k[:-1]
            rank = np.empty_like(rank)
            rank[self.positions] = np.cumsum(up)
            done *= 2

    def code(self, words: np.ndarray) -> np.ndarray:
        """Codes of words; -1 for those that stand nowhere in the shard."""
        if not len(self.vocabulary):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at + 1, -1)

    def bounds(self, pattern: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the array whose suffixes begin with ``pattern[a : a + n]``, by binary search for all ``a`` at once."""
        out = []
        last = len(self.codes) - 1
        for after in (False, True):
            lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(self.positions), np.int64)
            while (open_ := lo < hi).any():
                mid = np.where(open_, (lo + hi) // 2, 0)
                here = self.positions[mid]
                less, equal = np.zeros(len(at), bool), np.ones(len(at), bool)
                for j in range(n):
                    a, b = self.codes[np.minimum(here + j, last)], pattern[at + j]
                    less |= equal & (a < b)
                    equal &= a == b
                    if not equal.any():
                        break
                right = open_ & (less | equal if after else less)
                lo, hi = np.where(right, mid + 1, lo), np.where(open_ & ~right, mid, hi)
            out.append(lo)
        return out[0], out[1]


def blocks(benchmark: DataFrame, item_id: str, window: int, block_words: int) -> Iterator[Suffixes]:
    """The items in blocks of a bounded number of words; the driver holds one block at a time."""
    rows: list = []
    size = 0
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    for row in items.toLocalIterator(prefetchPartitions=False):
        n = len(row.text) // 2 + 1  # words at most
        if rows and size + n > block_words:
            yield Suffixes.of([r.id for r in rows], [r.text for r in rows], window)
            rows, size = [], 0
        rows.append(row)
        size += n
    if rows:
        yield Suffixes.of([r.id for r in rows], [r.text for r in rows], window)


def _same_bytes(data: np.ndarray, w: K.Words, place: np.ndarray, block: Suffixes, suffix: np.ndarray, length: np.ndarray) -> np.ndarray:
    """How many words of each match are the same in their bytes too."""
    i, j = K.spread(place, length), K.spread(suffix, length)
    size, other = (w.ends - w.starts)[i], (block.spans.ends - block.spans.starts)[j]
    same = size == other
    k = np.flatnonzero(same)
    differs = data[K.spread(w.starts[i[k]], size[k])] != block.data[K.spread(block.spans.starts[j[k]], size[k])]
    if len(k):
        same[k] = np.add.reduceat(differs, np.cumsum(size[k]) - size[k]) == 0
    bad = np.where(same, np.iinfo(np.int64).max, np.arange(len(i)) - np.repeat(np.cumsum(length) - length, length))
    return np.minimum(length, np.minimum.reduceat(bad, np.cumsum(length) - length)) if len(length) else length


def _search(part: pa.RecordBatch, block: Suffixes) -> pa.RecordBatch:
    data, w, h = _words(part.column("text"))
    text_of = w.text_of()
    edge = np.zeros(len(h) + 1, np.int32)
    found: list[tuple[np.ndarray, ...]] = []
    if len(h) and block.starts:
        array = SuffixArray(h, max(block.starts))
        codes = array.code(block.words)
        absent = np.concatenate([[0], np.cumsum(codes < 0)])
        for k, at in block.starts.items():
            at = at[absent[at + k] == absent[at]]
            lo, hi = array.bounds(codes, at, k)
            width = hi - lo
            suffix, place = np.repeat(at, width), array.positions[K.spread(lo, width)]
            inside = place + k <= w.first[text_of[place] + 1]
            suffix, place = suffix[inside], place[inside]
            # the longest match from each place: on while both go on alike
            item = block.item_of(suffix)
            length = np.full(len(suffix), k, np.int64)
            going = np.arange(len(suffix))
            while len(going):
                a, b = place[going] + length[going], suffix[going] + length[going]
                on = (a < w.first[text_of[place[going]] + 1]) & (b < block.first[item[going] + 1])
                going, a, b = going[on], a[on], b[on]
                going = going[h[a] == block.words[b]]
                length[going] += 1
            length = _same_bytes(data, w, place, block, suffix, length)
            good = length >= k
            place, suffix, item, length = place[good], suffix[good], item[good], length[good]
            places = np.unique(place)
            np.add.at(edge, places, 1)
            np.add.at(edge, places + k, -1)
            found.append((place, suffix, item, length))
    hit = np.cumsum(edge)[: len(h)] > 0
    n = part.num_rows
    if found:
        place, suffix, item, length = (np.concatenate(x) for x in zip(*found))
        # keep the matches that can't be extended to the left
        inner = (place > w.first[text_of[place]]) & (suffix > block.first[item]) & (h[np.maximum(place - 1, 0)] == block.words[np.maximum(suffix - 1, 0)])
        place, suffix, item, length = (x[~inner] for x in (place, suffix, item, length))
        order = np.lexsort((item, place))
        place, suffix, item, length = (x[order] for x in (place, suffix, item, length))
    else:
        place = suffix = item = length = np.zeros(0, np.int64)
    per = np.bincount(text_of[place], minlength=n) if len(place) else np.zeros(n, np.int64)
    hits = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()),
        pa.StructArray.from_arrays(
            [pa.array([block.ids[i] for i in item], pa.string()), *(pa.array(x, pa.int32()) for x in (place - w.first[text_of[place]], length, suffix - block.first[item], np.diff(block.first)[item]))],
            ["item", "start", "length", "item_start", "item_words"],
        ),
    )
    bits = [np.packbits(hit[a:b]).tobytes() if hit[a:b].any() else b"" for a, b in zip(w.first[:-1], w.first[1:])]
    return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(w.per_text, pa.int64()), hits, pa.array(bits, pa.binary())], ["doc_id", "n_words", "hits", "covered"])


DIGEST = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest int, hits array<struct<item:string,start:int,length:int,item_start:int,item_words:int>>"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            items = sorted({h["item"] for h in r["hits"]})
            bits = np.zeros(0, np.uint8)
            for b in r["covered"]:
                b = np.frombuffer(b, np.uint8)
                bits = np.pad(bits, (0, max(0, len(b) - len(bits)))) | np.pad(b, (0, max(0, len(bits) - len(b))))
            n_hit = int(np.bitwise_count(bits).sum())
            rows.append((r["doc_id"], r["n_words"], n_hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), n_hit > 0, max((h["length"] for h in r["hits"]), default=0), r["hits"]))
        names = [c.split()[0] for c in DIGEST.split(", ")]
        columns = list(zip(*rows)) if rows else [[]] * len(names)
        kinds = [pa.int64()] * 4 + [pa.string(), pa.bool_(), pa.int32(), batch.schema.field("hits").type]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names)


def _covered_once(part: pa.RecordBatch) -> pa.RecordBatch:
    """The column ``covered`` as lists of one, which is how several blocks' bits come together."""
    one = pa.ListArray.from_arrays(pa.array(range(part.num_rows + 1), pa.int32()), part.column("covered"))
    return part.set_column(part.schema.get_field_index("covered"), "covered", one)


def _searched(rows: DataFrame, block: Suffixes) -> DataFrame:
    """What a block hits, per row."""
    held = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.pieces(batch, limit=SHARD_BYTES):
                hits = _search(part, held.value)
                yield from _digest(iter([_covered_once(hits)]))

    return rows.mapInArrow(run, DIGEST)


def _by_row(rows: DataFrame, found: Iterator[Suffixes], staging: Staging) -> DataFrame:
    """(row, hits, covered) of the rows (row, text) that any block hits; each block's hits are written before the next block is read."""
    out: DataFrame | None = None
    for number, block in enumerate(found):
        held = rows.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in K.pieces(batch, limit=SHARD_BYTES):
                    hits = _search(part, held.value)
                    hits = hits.set_column(0, "row", part.column("doc_id"))
                    yield hits.filter(pc.greater(pc.list_value_length(hits.column("hits")), 0))

        one = staging.write(rows.select(F.col("row").alias("doc_id"), "text").mapInArrow(run, HITS.replace("doc_id", "row")), f"hits{number}")
        held.unpersist()
        out = one if out is None else out.unionByName(one)
    return out.groupBy("row").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.collect_list("covered").alias("covered"), F.max("n_words").alias("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, item_id: str = "item_id", window: int = 10, block_words: int = 1_000_000, staging: Staging | None = None) -> DataFrame:
    """One row per document: words, words hit, items found, verdict, and the longest matches with their places."""
    source = docs.select(F.col("doc_id").cast("long"), "text")
    found = blocks(benchmark, item_id, window, block_words)
    first = next(found, None) or Suffixes.of([], [], window)
    second = next(found, None)
    if second is None:
        return _searched(source, first)
    # rows get their numbers once, in a table, as every block is a scan of its own
    staging = staging or Staging(docs.sparkSession, "decontamination")
    rows = staging.write(source.withColumn("row", F.monotonically_increasing_id()), "rows")
    hits = _by_row(rows.select("row", "text"), chain([first, second], found), staging)
    nothing = Suffixes.of([], [], window)
    clean = _searched(rows.join(hits, "row", "left_anti").select("doc_id", "text"), nothing)
    hit = rows.select("row", "doc_id").join(hits, "row").select("doc_id", "n_words", "hits", "covered").mapInArrow(_digest, DIGEST)
    return clean.unionByName(hit)


def apply_decontamination(docs: DataFrame, benchmark: DataFrame, item_id: str = "item_id", window: int = 10, block_words: int = 1_000_000, staging: Staging | None = None) -> DataFrame:
    """The rows in whose texts no window of a benchmark item occurs, as they were, with or without an id.

    With one block the rows are filtered where they lie.
    """
    found = blocks(benchmark, item_id, window, block_words)
    first = next(found, None)
    if first is None:
        return docs
    second = next(found, None)
    if second is None:
        held = docs.sparkSession.sparkContext.broadcast(first)
        text = docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in K.pieces(batch, limit=SHARD_BYTES):
                    ids = pa.array(range(part.num_rows), pa.int64())
                    hits = _search(pa.RecordBatch.from_arrays([ids, part.column(text)], ["doc_id", "text"]), held.value)
                    yield part.filter(pc.equal(pc.list_value_length(hits.column("hits")), 0))

        return docs.mapInArrow(run, docs.schema)
    staging = staging or Staging(docs.sparkSession, "decontamination")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    rows = staging.write(docs.select(whole, F.monotonically_increasing_id().alias("row")), "rows")
    hits = _by_row(rows.select("row", F.col("whole.text").alias("text")), chain([first, second], found), staging)
    return rows.join(hits.select("row"), "row", "left_anti").select("whole.*")
