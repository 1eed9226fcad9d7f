"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint has 64 bits: a bit is 1 if it is set in over half of the
XXH64 hashes (seed 42) of the text's word shingles, repeats included.  Texts
whose fingerprints differ in at most two bits are linked.

Covering masks: bit i gets a nonzero vector m(i) of three bits, and the table of
each nonzero vector v keeps the bits with an odd m(i).v.  Two differing bits
leave some v with both products even, so the pair agrees on everything that
table keeps and *every* pair within the radius meets in one of the 7 tables.

Work goes over distinct fingerprints.  Buckets with more than ``bucket_limit``
fingerprints aren't compared as they are: covering masks over the bits that the
first ones ignore split them again, and then those over the remaining bits,
which leaves at most 64 fingerprints in a bucket.  Inside a bucket the verified
links are reduced to a spanning forest.

Nulls and texts without a word have fingerprint zero and are linked like any
other.  With fewer words than a shingle has, the whole sequence is the shingle.
Repeated ids are one document: a component is about ids.  A row without an id
links others like any row, and its component is the smallest id that it reaches,
or null if there is none.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from . import kernels as K
from . import similar_texts
from .staging import Staging

RADIUS = 2


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The fingerprint of one text in UTF-8."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    hash_ = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) < shingle:
        return hash_(joined, 42)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    hashes = np.fromiter((hash_(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist())), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):  # so that a very long text needs little memory
        ones += np.unpackbits(hashes[lo : lo + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of every document, as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            fps = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else None, shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(K.signed(fps))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def covering_masks(bits: list[int]) -> list[int]:
    """Seven masks over the given bits; any two bits are both outside one of them."""
    vector = {b: 1 + i % 7 for i, b in enumerate(bits)}
    return [sum(1 << b for b in bits if (vector[b] & v).bit_count() & 1) for v in range(1, 8)]


def mask_levels() -> list[list[int]]:
    """Masks of each level; a level's mask keeps all that its parent kept, and some of the bits ignored there."""
    levels = [covering_masks(list(range(64)))]
    for _ in range(2):
        levels.append([m | x for m in levels[-1] for x in covering_masks([b for b in range(64) if not m >> b & 1])])
    return levels


def _as_long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Spanning links of the components that the fingerprints of one bucket form."""
    n = len(fps)
    root = np.arange(n)
    links = []
    for i in range(n - 1):
        near = i + 1 + np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= RADIUS)
        for j in near[root[near] != root[i]]:
            if root[j] != root[i]:
                links.append((int(fps[i]), int(fps[j])))
                root[root == root[j]] = root[i]
    return links


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of whole buckets that come one after the other."""
    rest_key: np.ndarray = np.zeros((0, 2), np.int64)
    rest_fp: np.ndarray = np.zeros(0, np.int64)

    def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        out: list[tuple[int, int]] = []
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(fp)]):
            if b - a > 1:
                out += _forest(fp[a:b].view(np.uint64))
        pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["src", "dst"])

    for batch in batches:
        key = np.stack([batch.column("mask").to_numpy(zero_copy_only=False), batch.column("key").to_numpy(zero_copy_only=False)], 1)
        key, fp = np.concatenate([rest_key, key]), np.concatenate([rest_fp, batch.column("fp").to_numpy(zero_copy_only=False)])
        if not len(fp):
            continue
        last = np.flatnonzero((key != key[-1]).any(1))
        done = int(last[-1]) + 1 if len(last) else 0
        if done:
            yield links(key[:done], fp[:done])
        rest_key, rest_fp = key[done:], fp[done:]
    if len(rest_fp):
        yield links(rest_key, rest_fp)


def links(distinct: DataFrame, staging: Staging, bucket_limit: int = 512) -> DataFrame:
    """(src, dst): links between distinct fingerprints that leave their components as all links would."""
    levels = mask_levels()
    todo = distinct.select("fp", F.lit(-1).alias("parent"))
    out: DataFrame | None = None
    for depth, masks in enumerate(levels):
        children = F.sequence(F.col("parent") * 7, F.col("parent") * 7 + 6) if depth else F.sequence(F.lit(0), F.lit(6))
        table = F.array(*[F.lit(_as_long(m)) for m in masks])
        keyed = todo.select("fp", F.explode(children).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.element_at(table, F.col("mask") + 1)))
        sizes = keyed.groupBy("mask", "key").agg(F.count("*").alias("size")).where("size > 1")
        keyed = staging.write(keyed.join(sizes, ["mask", "key"]), f"buckets{depth}")
        small = keyed if depth == len(levels) - 1 else keyed.where(F.col("size") <= bucket_limit)
        found = small.select("mask", "key", "fp").repartition("mask", "key").sortWithinPartitions("mask", "key", "fp").mapInArrow(_bucket_links, "src long, dst long")
        out = found if out is None else out.unionByName(found)
        todo = keyed.where(F.col("size") > bucket_limit).select("fp", F.col("mask").alias("parent"))
        if todo.isEmpty():
            break
    return out.distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, bucket_limit: int = 512, staging: Staging | None = None) -> DataFrame:
    """(doc_id, fp, component_id, n_docs, group): each document's fingerprint, the smallest id it is linked with, documents of its fingerprint, and the least fingerprint reached."""
    staging = staging or Staging(docs.sparkSession, "covering_simhash")
    prints = staging.write(fingerprints(docs, shingle), "fingerprints")
    classes = staging.write(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_docs")), "classes")
    edges = staging.write(links(classes.select("fp"), staging, bucket_limit), "links")
    groups = connected_components(edges, lambda df, name: staging.write(df, name))
    joined = classes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    of = joined.join(least, "component").select("fp", "component_id", "n_docs", F.col("component").alias("group"))
    of = staging.write(of, "components")
    staging.keep("fingerprints", "components")
    return prints.join(of, "fp").select("doc_id", "fp", "component_id", "n_docs", "group")


def text_pairs(docs: DataFrame, staging: Staging, shingle: int = 5, bucket_limit: int = 512) -> DataFrame:
    """(src, dst): pairs of text keys that the fingerprints propose: a text with the first one of its fingerprint, and the first ones of linked fingerprints."""
    keyed = docs.select(similar_texts.text_key().alias("doc_id"), "text")
    prints = staging.write(fingerprints(keyed, shingle).distinct().withColumnRenamed("doc_id", "key"), "prints")
    classes = staging.write(prints.groupBy("fp").agg(F.min("key").alias("first")), "print_classes")
    equal = prints.join(classes, "fp").where("key <> first").select(F.col("first").alias("src"), F.col("key").alias("dst"))
    first = lambda side: classes.select(F.col("fp").alias(f"{side}_fp"), F.col("first").alias(side))
    near = links(classes.select("fp"), staging, bucket_limit).toDF("src_fp", "dst_fp").join(first("src"), "src_fp").join(first("dst"), "dst_fp").select("src", "dst")
    pairs = equal.unionByName(near).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return staging.write(pairs, "print_pairs")


def apply_near_duplicates(docs: DataFrame, similarity: float | None = None, **options) -> DataFrame:
    """One row of each component, as it was: of the smallest id, and of its rows that of the least text hash; rows without an id come last.

    With a ``similarity`` of shingle sets, the pairs that the covering masks find are
    verified on the shingles, and `similar_texts` adds the links between their
    components that differ in more bits than masks can cover.
    """
    if similarity is not None:
        staging = options.pop("staging", None) or Staging(docs.sparkSession, "covering_simhash")
        shingle = options.get("shingle", 5)
        pairs = text_pairs(docs, staging, shingle, options.pop("bucket_limit", 512))
        return similar_texts.apply_similar_texts(docs, similarity=similarity, pairs=pairs, staging=staging, **options)
    prints = near_duplicates(docs, **options)
    # a component without any id goes by the smallest fingerprint that it reaches
    wanted = prints.groupBy("group").agg(F.min("component_id").alias("least"), F.min("fp").alias("first"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    by_id = whole.join(wanted.where("least IS NOT NULL").select("least"), F.col("row.doc_id").cast("long") == F.col("least"), "left_semi")
    rows = by_id.withColumn("key", F.xxhash64("row.text")).groupBy("row.doc_id").agg(F.min_by("row", "key").alias("row"))
    out = rows.select("row.*")
    nameless = wanted.where("least IS NULL")
    if nameless.isEmpty():
        return out
    texts = whole.where("row.doc_id IS NULL").select("row", F.col("row.text").alias("text"), F.lit(None).cast("long").alias("doc_id"))
    marked = texts.select("row", F.xxhash64("text").alias("key"), "text")
    of = fingerprints(texts.select(F.xxhash64("text").alias("doc_id"), "text").distinct(), options.get("shingle", 3))
    first = marked.join(of.withColumnRenamed("doc_id", "key"), "key").join(nameless.select(F.col("first").alias("fp")), "fp", "left_semi")
    return out.unionByName(first.groupBy("fp").agg(F.min_by("row", "key").alias("row")).select("row.*"))
