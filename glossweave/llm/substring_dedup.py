"""Removal of word sequences that repeat anywhere in the corpus, with FM-indexes.

Which documents a shard's index must hold is settled by content.  Of every
window of ``window`` words the smallest-hashed run of ``anchor_words`` words is
its anchor; neighbouring windows with one anchor form a segment.  Equal windows
have equal anchors, so they meet in one shard, and no window is searched in more
than one.  A segment whose anchor stands nowhere else can't hold a repeated
window and needs no search.

Of segments that look equal by anchor and content hash the index takes the words
of the first and of the last one, so it finds a repetition in the text itself and
trusts no hash.  A shard is a run of whole anchor groups: its segments are
indexed, then streamed through backward search, which gives the matching
statistics and so the windows that occur twice or more.

An anchor inside a very common passage has as many different segments as the
passage has surroundings.  In groups of more than ``group_limit`` segments the
anchor is made longer, up to the window: each window of theirs is a segment of its
own, goes to a group by its own hash, and is searched in the same way.  The result
is the same for every limit.

Windows are judged on the input.  Nulls and texts of fewer than ``window`` words
lose nothing.  Repeated rows are documents of their own, ids may repeat or be
null.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .fm_index import FMIndex
from .staging import Staging

SEGMENTS = "doc_id long, text_key long, n_words int, anchors array<long>, contents array<long>, starts array<int>, windows array<int>, twice array<boolean>"
TEXTS = "anchor long, content long, last boolean, n long, hot boolean, text binary, hashes array<long>"
VERDICTS = "anchor long, content long, runs array<struct<at:int,windows:int>>"
SHARD_WORDS = 400_000


def _sliding_min(g: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimum of each ``w`` neighbours, and how often it stands among them."""
    best, many, done = None, None, 0
    power, count, size = g, np.ones(len(g), np.int32), 1
    while True:
        if w & size:
            if best is None:
                best, many = power, count
            else:
                m = len(g) - done - size + 1
                a, b = best[:m], power[done : done + m]
                many = np.where(a <= b, many[:m], 0) + np.where(b <= a, count[done : done + m], 0)
                best = np.minimum(a, b)
            done += size
        size *= 2
        if size > w:
            return best, many
        m = len(g) - size + 1
        a, b = power[:m], power[size // 2 : size // 2 + m]
        count = np.where(a <= b, count[:m], 0) + np.where(b <= a, count[size // 2 : size // 2 + m], 0)
        power = np.minimum(a, b)


def _lists(values: np.ndarray, per: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), pa.array(values, kind))


def _segments(part: pa.RecordBatch, window: int, anchor_words: int) -> pa.RecordBatch:
    data, offsets = K.buffers(part.column("text"))
    w = K.find_words(data, offsets)
    h = K.byte_hash(data, w.starts, w.ends)
    n = part.num_rows
    starts = ends = anchor = content = twice = np.zeros(0, np.int64)
    per = np.zeros(n, np.int64)
    if len(h) >= window:
        span = window - anchor_words + 1
        low, many = _sliding_min(K.grams(h, anchor_words), span)
        text_of = w.text_of()
        whole = np.flatnonzero(w.whole(window))
        if len(whole):
            lw, tw = low[whole], text_of[whole]
            new = np.ones(len(whole), bool)
            new[1:] = (lw[1:] != lw[:-1]) | (tw[1:] != tw[:-1])
            at = np.flatnonzero(new)
            starts, ends = whole[at], whole[np.append(at[1:], len(whole)) - 1] + 1
            anchor, content = K.signed(lw[at]), K.signed(K.range_hash(K.grams(h, window), starts, ends))
            twice = (np.maximum.reduceat(many[whole], at) > 1) | (ends - starts > span)
            per = np.bincount(tw[at], minlength=n)
            starts, ends = starts - w.first[tw[at]], ends - w.first[tw[at]]
    return pa.RecordBatch.from_arrays(
        [part.column("doc_id"), part.column("text_key"), pa.array(w.per_text, pa.int32()), _lists(anchor, per, pa.int64()), _lists(content, per, pa.int64()), _lists(starts, per, pa.int32()), _lists(ends - starts, per, pa.int32()), _lists(twice, per, pa.bool_())],
        ["doc_id", "text_key", "n_words", "anchors", "contents", "starts", "windows", "twice"],
    )


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")


def _same_document(a: DataFrame, b: DataFrame) -> Column:
    return a.doc_id.eqNullSafe(b.doc_id) & (a.text_key == b.text_key)


def _ends() -> Column:
    """The first and the last of ``n`` places, with the counts that they stand for."""
    first, last = (F.struct(F.col(c).alias("at"), F.lit(c == "to").alias("last"), n.cast("long").alias("n")) for c, n in (("from", F.lit(1)), ("to", F.col("n") - 1)))
    return F.when(F.col("n") > 1, F.array(first, last)).otherwise(F.array(first))


def _extract(window: int):
    """Texts of the wanted segments, words joined by one space; for hot groups also the hash of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.pieces(batch, limit=8 << 20):
                rows = []
                for text, wanted in zip(part.column("text"), part.column("wanted").to_pylist()):
                    words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                    for s in wanted:
                        chosen = words[s["start"] : s["start"] + s["windows"] + window - 1]
                        hashes = None
                        if s["hot"]:
                            raw = b" ".join(chosen)
                            data = np.frombuffer(raw, np.uint8)
                            w = K.find_words(data, np.array([0, len(data)]))
                            hashes = K.signed(K.grams(K.byte_hash(data, w.starts, w.ends), window)).tolist()
                        rows.append((s["anchor"], s["content"], s["last"], s["n"], s["hot"], b" ".join(chosen), hashes))
                columns = list(zip(*rows)) if rows else [[]] * 7
                kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["anchor", "content", "last", "n", "hot", "text", "hashes"])

    return run


def _shard(keys: list[tuple[int, int]], counts: list[int], texts: list[bytes], window: int) -> pa.RecordBatch:
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    w = K.find_words(data, offsets)
    # words by number, exactly: the index compares no hashes
    code: dict[bytes, int] = {}
    words = np.fromiter((code.setdefault(x, len(code)) for t in texts for x in t.split(b" ")), np.int64, len(w.starts))
    index = FMIndex(words, w.first, np.array(counts, np.int64), window)
    segment, at = index.repeated_windows()
    order = np.lexsort((at, segment))
    segment, at = segment[order], at[order]
    new = np.ones(len(at) + 1, bool)
    new[1:-1] = (segment[1:] != segment[:-1]) | (at[1:] != at[:-1] + 1)
    edges = np.flatnonzero(new)
    begin, size = edges[:-1], np.diff(edges)
    owner, where = segment[begin], at[begin]
    per = np.bincount(owner, minlength=len(keys))
    some = np.flatnonzero(per)
    runs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per[some])]), pa.int32()), pa.StructArray.from_arrays([pa.array(where, pa.int32()), pa.array(size, pa.int32())], ["at", "windows"]))
    return pa.RecordBatch.from_arrays([pa.array([keys[i][0] for i in some], pa.int64()), pa.array([keys[i][1] for i in some], pa.int64()), runs], ["anchor", "content", "runs"])


def _index_shards(window: int):
    """Rows come by anchor; a shard ends with an anchor once it has enough words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[tuple[int, int]] = []
        counts: list[int] = []
        texts: list[bytes] = []
        size, last = 0, None
        for batch in batches:
            for anchor, content, n, text in zip(batch.column("anchor").to_pylist(), batch.column("content").to_pylist(), batch.column("n").to_pylist(), batch.column("text").to_pylist()):
                if anchor != last and size > SHARD_WORDS:
                    yield _shard(keys, counts, texts, window)
                    keys, counts, texts, size = [], [], [], 0
                last = anchor
                keys.append((anchor, content))
                counts.append(n)
                texts.append(text)
                size += text.count(b" ") + 1
        if keys:
            yield _shard(keys, counts, texts, window)

    return run


def _search(texts: DataFrame, window: int) -> DataFrame:
    by_anchor = texts.select("anchor", "content", "n", "text").repartition("anchor").sortWithinPartitions("anchor", "content")
    return by_anchor.mapInArrow(_index_shards(window), VERDICTS)


def repeated_intervals(docs: DataFrame, window: int = 35, anchor_words: int = 12, group_limit: int = 1000, staging: Staging | None = None) -> DataFrame:
    """(doc_id, text_key, runs): first window and number of windows of each repeated interval, for documents that have any."""
    staging = staging or Staging(docs.sparkSession, "substring_dedup")
    keyed = _keyed(docs)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.pieces(batch):
                yield _segments(part, window, anchor_words)

    found = staging.write(keyed.mapInArrow(scan, SEGMENTS), "segments")
    anchors = found.select(F.explode(F.arrays_zip("anchors", "twice")).alias("x")).groupBy(F.col("x.anchors").alias("anchor")).agg(F.sum(F.when(F.col("x.twice"), 2).otherwise(1)).alias("times"))
    each = found.select("doc_id", "text_key", F.explode(F.arrays_zip("anchors", "contents", "starts", "windows")).alias("x")).select("doc_id", "text_key", F.col("x.anchors").alias("anchor"), F.col("x.contents").alias("content"), F.col("x.starts").alias("start"), F.col("x.windows").alias("windows"))
    candidates = staging.write(each.join(anchors.where("times > 1").select("anchor"), "anchor", "left_semi"), "candidates")
    place = F.struct("doc_id", "text_key", "start", "windows")
    distinct = candidates.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(place).alias("from"), F.max(place).alias("to"))
    groups = distinct.groupBy("anchor").agg((F.count("*") > group_limit).alias("hot"))
    wanted = distinct.join(groups, "anchor").select("anchor", "content", "hot", F.explode(_ends()).alias("x")).select("x.at.*", "anchor", "content", "x.last", "x.n", "hot")
    wanted = wanted.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("anchor", "content", "last", "n", "hot", "start", "windows")).alias("wanted"))
    texts = keyed.join(wanted, _same_document(keyed, wanted)).select("text", "wanted").mapInArrow(_extract(window), TEXTS)
    texts = staging.write(texts, "texts")
    verdicts = _search(texts.where("NOT hot"), window)
    if not texts.where("hot").isEmpty():
        # rows of a document that stands in the table twice give their texts twice
        hot = texts.where("hot").dropDuplicates(["anchor", "content", "last"])
        single = hot.select("anchor", "content", "last", "n", F.posexplode("hashes").alias("at", "hash"))
        spot = F.struct("anchor", "content", "last", "at")
        repeated = single.groupBy("hash").agg(F.sum("n").alias("n"), F.min(spot).alias("from"), F.max(spot).alias("to")).where("n > 1")
        chosen = repeated.select("hash", F.explode(_ends()).alias("x")).select("hash", "x.at.*", "x.n").groupBy("anchor", "content", "last").agg(F.collect_list(F.struct("hash", "n", "at")).alias("picks"))
        with_text = hot.select("anchor", "content", "last", "text").join(chosen, ["anchor", "content", "last"])
        words = F.split(F.col("text").cast("string"), " ")
        windows = with_text.select(words.alias("words"), F.explode("picks").alias("x")).select(F.col("x.hash").alias("anchor"), F.col("x.hash").alias("content"), F.col("x.n").alias("n"), F.array_join(F.slice("words", F.col("x.at") + 1, window), " ").cast("binary").alias("text"))
        good = _search(windows, window).select(F.col("anchor").alias("hash"))
        back = single.join(good, "hash", "left_semi").groupBy("anchor", "content").agg(F.transform(F.sort_array(F.collect_set("at")), lambda x: F.struct(x.alias("at"), F.lit(1).alias("windows"))).alias("runs"))
        verdicts = verdicts.unionByName(back)
    verdicts = staging.write(verdicts, "verdicts")
    runs = candidates.join(verdicts, ["anchor", "content"]).select("doc_id", "text_key", "start", F.explode("runs").alias("x"))
    # a set, as rows that share id and text bring the same runs
    each = F.collect_set(F.struct((F.col("x.at") + F.col("start")).alias("at"), F.col("x.windows").alias("windows")))
    out = staging.write(runs.groupBy("doc_id", "text_key").agg(each.alias("runs")), "intervals")
    staging.keep("intervals")
    return out


def _removed(part: pa.RecordBatch, window: int, keep_text: bool) -> pa.RecordBatch:
    n_words, n_removed, digests, texts = [], [], [], []
    for text, runs in zip(part.column("text"), part.column("runs")):
        words = text.as_buffer().to_pybytes().split() if text.is_valid else []
        kept = words
        if runs.is_valid and len(runs):
            r = np.array([(x["at"], x["windows"]) for x in runs.as_py()], np.int64)
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, r[:, 0], 1)
            np.add.at(edge, r[:, 0] + r[:, 1] + window - 1, -1)
            gone = np.cumsum(edge)[:-1] > 0
            kept = [w for w, g in zip(words, gone.tolist()) if not g]
        joined = b" ".join(kept)
        n_words.append(len(words))
        n_removed.append(len(words) - len(kept))
        digests.append(hashlib.sha256(joined).hexdigest())
        texts.append(joined.decode("utf-8", "replace") if keep_text else None)
    return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def substring_dedup(docs: DataFrame, keep_text: bool = True, window: int = 35, **options) -> DataFrame:
    """One row per input row: words, words removed, and the kept words (digest, and text if asked for)."""
    intervals = repeated_intervals(docs, window, **options)
    keyed = _keyed(docs)
    joined = keyed.join(intervals, _same_document(keyed, intervals), "left").select(keyed.doc_id, keyed.text, "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.pieces(batch, limit=8 << 20):
                yield _removed(part, window, keep_text)

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
