"""Near copies by verified similarity of their word shingles: what `covering_simhash` can't reach of a similarity.

Pairs that fingerprints propose come in first: they are verified, and their
components are taken as they are.  Texts of similarity 0.8 differ in some ten of 64
SimHash bits, and masks that cover such a radius would keep next to nothing, so the
links between those components come from MinHash.

Two texts are linked if their sets of ``shingle``-word shingles (A-Z
lower-cased) have a Jaccard similarity of at least ``similarity``.  Pairs are
proposed by MinHash bands: ``BANDS`` keys of ``ROWS`` minima each.  A pair of
similarity 0.8 shares no key with probability (1 - 0.8**6)**40, or 5 in a
million; one of 0.9 with 2e-14.  Every proposed pair is verified on the shingles
themselves, so nothing else is linked.

Every text also has a sketch, four bits of each of the 240 minima.  Two texts of
similarity 0.8 agree in 195 of them on the average, with a deviation of 6; pairs
that agree in fewer than five deviations less go no further (3 in ten million of
those that should), so few pairs of unlike texts ever meet as texts.

Buckets of up to ``SMALL`` texts are compared pair by pair.  In larger ones four
members are compared with all others first; of what that leaves in different
components, pairs come out of the join that agree enough by their sketches.  So a
crowd of copies costs its size, not the square of it; a crowd of texts that only
share a passage emits next to nothing, but the join still looks at its pairs.

Nulls and texts without a word are one text.  With fewer words than a shingle
has, the whole sequence is the shingle.  Rows are told apart by id and text: of
a component the row with the smallest id stays, rows without an id come last,
and equal ids with texts that aren't alike stay side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from . import kernels as K
from .staging import Staging

BANDS, ROWS, SMALL = 40, 6, 8
PAIR_ROWS = 1000  # two texts each
SKETCH = BANDS * ROWS // 16  # longs
_SEEDS = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)


def text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def shingles(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every distinct shingle, in order; each text has one at least."""
    data, offsets = K.buffers(column)
    words = K.find_words(data, offsets)
    h = K.byte_hash(K.LOWER[data], words.starts, words.ends)
    ok = np.flatnonzero(words.whole(shingle))
    short = np.flatnonzero(words.per_text < shingle)
    text = np.concatenate([words.text_of()[ok], short])
    value = np.concatenate([K.grams(h, shingle)[ok], K.range_hash(h, words.first[short], words.first[short + 1])])
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[new], value[new]


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """(key, n, bands, sketch): number of distinct shingles, band keys and sketch of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.pieces(batch):
                text, value = shingles(part.column("text"), shingle)
                n = np.bincount(text, minlength=part.num_rows)
                first = np.concatenate([[0], np.cumsum(n)[:-1]])
                keys = np.zeros((part.num_rows, BANDS), np.uint64)
                sketch = np.zeros((part.num_rows, SKETCH), np.uint64)
                for b in range(BANDS):
                    key = np.full(part.num_rows, b + 1, np.uint64)
                    for i in range(b * ROWS, (b + 1) * ROWS):
                        least = np.minimum.reduceat((value ^ _SEEDS[0, i]) * _SEEDS[1, i], first)
                        key = K.mix(key + least)
                        sketch[:, i // 16] |= (K.mix(least) >> np.uint64(60)) << np.uint64(i % 16 * 4)
                    keys[:, b] = key
                bands = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * BANDS, pa.int32()), pa.array(K.signed(keys.ravel())))
                sketches = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * SKETCH, pa.int32()), pa.array(K.signed(sketch.ravel())))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(n), bands, sketches], ["key", "n", "bands", "sketch"])

    return docs.select(text_key().alias("key"), "text").mapInArrow(run, "key long, n long, bands array<long>, sketch array<long>")


def agreeing(a: str, b: str) -> Column:
    """In how many places two sketches agree."""
    out = F.lit(0)
    for i in range(SKETCH):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        out = out + 16 - F.bit_count(x)
    return out


def least_agreement(similarity: float) -> int:
    """Places in which texts of a similarity agree, five deviations below the mean."""
    n, p = SKETCH * 16, similarity + (1 - similarity) / 16
    return max(0, int(n * p - 5 * (n * p * (1 - p)) ** 0.5))


def _verify(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (src, dst) that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.pieces(batch, "a"):
                sides = [shingles(part.column(c), shingle) for c in ("a", "b")]
                text, value = (np.concatenate(x) for x in zip(*sides))
                order = np.lexsort((value, text))
                text, value = text[order], value[order]
                both = np.bincount(text[1:][(text[1:] == text[:-1]) & (value[1:] == value[:-1])], minlength=part.num_rows)
                union = np.bincount(text, minlength=part.num_rows) - both
                yield pa.RecordBatch.from_arrays([part.column("src"), part.column("dst")], ["src", "dst"]).filter(pa.array(both >= union * similarity - 1e-9))

    joined = pairs.join(texts.withColumnsRenamed({"key": "src", "text": "a"}), "src").join(texts.withColumnsRenamed({"key": "dst", "text": "b"}), "dst")
    return joined.select("src", "dst", "a", "b").mapInArrow(run, "src long, dst long")


def _first_links(docs: DataFrame, pairs: DataFrame, staging: Staging, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The given pairs that are similar enough, and (node, component) of what they link."""
    wanted = staging.write(pairs.select(F.explode(F.array("src", "dst")).alias("key")).distinct(), "given_keys")
    texts = docs.select(text_key().alias("key"), F.coalesce("text", F.lit("")).alias("text")).join(wanted, "key", "left_semi").dropDuplicates(["key"])
    found = staging.write(_verify(pairs, staging.write(texts, "given_texts"), shingle, similarity), "given_links", rows=PAIR_ROWS)
    return found, connected_components(found, lambda df, name: staging.write(df, f"given_{name}"))


def links(docs: DataFrame, staging: Staging, shingle: int = 5, similarity: float = 0.8, pairs: DataFrame | None = None) -> DataFrame:
    """(src, dst): links between text keys that leave their components as all links would; ``pairs`` (src, dst) are tried first."""
    near = F.least("m", "n") >= F.greatest("m", "n") * similarity - 1e-9
    signed = staging.write(signatures(docs, shingle), "signatures")
    distinct = signed.dropDuplicates(["key"])
    first = None
    if pairs is not None:
        first, groups = _first_links(docs, pairs, staging, shingle, similarity)
        distinct = distinct.join(groups.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    else:
        distinct = distinct.withColumn("component", F.col("key"))
    members = distinct.select("key", "n", "component", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    buckets = staging.write(members.join(sizes, "bucket"), "buckets")
    enough = agreeing("sketch", "other_sketch") >= least_agreement(similarity)
    lengths = buckets.groupBy("key").agg(F.first("n").alias("n"), F.first("component").alias("component"))
    sketches = staging.write(signed.dropDuplicates(["key"]).join(lengths.select("key"), "key", "left_semi").select("key", "sketch"), "sketches")
    other_sketches = sketches.select(F.col("key").alias("dst"), F.col("sketch").alias("other_sketch"))
    texts = docs.select(text_key().alias("key"), F.coalesce("text", F.lit("")).alias("text")).join(lengths.select("key"), "key", "left_semi").dropDuplicates(["key"])
    texts = staging.write(texts, "texts")

    apart = F.col("component") != F.col("other")
    small = buckets.where(F.col("size") <= SMALL).select("bucket", "key", "n", "component")
    within = small.join(small.select("bucket", F.col("key").alias("dst"), F.col("n").alias("m"), F.col("component").alias("other")), "bucket").where((F.col("key") < F.col("dst")) & near & apart)
    large = buckets.where(F.col("size") > SMALL).select("bucket", "key", "n")
    leaders = large.groupBy("bucket").agg(F.array_compact(F.array(*[F.min(F.when(F.pmod("key", F.lit(4)) == j, F.col("key"))) for j in range(4)])).alias("leaders"))
    led = large.join(leaders, "bucket").select("key", F.explode("leaders").alias("dst")).where("key <> dst").distinct()
    led = led.join(lengths, "key").join(lengths.select(F.col("key").alias("dst"), F.col("n").alias("m"), F.col("component").alias("other")), "dst").where(near & apart)
    ordered = lambda df: df.select(F.least("key", "dst").alias("src"), F.greatest("key", "dst").alias("dst")).distinct()
    proposed = ordered(within.select("key", "dst").unionByName(led.select("key", "dst")))
    alike = proposed.join(sketches.withColumnRenamed("key", "src"), "src").join(other_sketches, "dst").where(enough).select("src", "dst")
    tried = staging.write(alike, "pairs0")
    found = staging.write(_verify(tried, texts, shingle, similarity), "links0", rows=PAIR_ROWS)
    if first is not None:
        found = found.unionByName(first)
    if large.isEmpty():
        return found
    groups = connected_components(found, lambda df, name: staging.write(df, f"first_{name}"))
    large = large.join(groups.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    large = staging.write(large, "large")
    mixed = large.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    large = staging.write(large.join(mixed, "bucket").join(sketches, "key").select("bucket", "key", "n", "component", "sketch"), "mixed")
    other = large.select("bucket", F.col("key").alias("dst"), F.col("n").alias("m"), F.col("component").alias("other"), F.col("sketch").alias("other_sketch"))
    rest = large.join(other, "bucket").where((F.col("key") < F.col("dst")) & apart & near & enough)
    rest = staging.write(ordered(rest).join(tried, ["src", "dst"], "left_anti"), "pairs1")
    return found.unionByName(staging.write(_verify(rest, texts, shingle, similarity), "links1", rows=PAIR_ROWS))


def apply_similar_texts(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, staging: Staging | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """One document of each component, once, as it was."""
    staging = staging or Staging(docs.sparkSession, "similar_texts")
    edges = staging.write(links(docs, staging, shingle, similarity, pairs), "links")
    groups = connected_components(edges, lambda df, name: staging.write(df, name))
    # the input's columns go in one struct, so that no name can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), text_key().alias("key"))
    first = rows.groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("least"))
    first = first.join(groups.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    keep = first.groupBy("component").agg(F.min(F.struct("least", "key")).alias("x")).select(F.col("x.least.id").alias("least"), F.col("x.key").alias("of"))
    keep = staging.write(keep, "keep")
    staging.keep("keep")
    kept = rows.join(keep, (F.col("key") == F.col("of")) & F.col("id").eqNullSafe(F.col("least")), "left_semi")
    return kept.dropDuplicates(["id", "key"]).select("row.*")
