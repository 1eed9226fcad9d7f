"""Quality rules by cross-document line frequency.

Lines are normalised (A-Z lower-cased, words joined by one space) and hashed.
Per host, a line is *common* if it stands in more than ``max_docs`` distinct
documents; documents with the same text are one, so a text isn't rejected for
being copied.  Common lines go; a document left with fewer than ``min_words``
words, or less than ``min_share`` of them, is depleted and rejected.

Nulls and empty texts have no words and fail the base rules.  A null host is a
host of its own.  Rows that share an id, or have none, are judged row by row on the text.
Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .staging import Staging

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
WINDOW = 8

STATS = (
    "doc_id long, host string, text_key long, n_words long, word_chars long, n_symbols long, "
    "n_dup_lines long, n_repeat_words long, lines array<struct<no:int,h:long,first:boolean,words:int>>"
)


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    out = np.zeros(len(k), bool)
    out[order] = same[1:] | same[:-1]
    return out


def _measure(part: pa.RecordBatch) -> pa.RecordBatch:
    data, offsets = K.buffers(part.column("text"))
    n = part.num_rows
    words = K.find_words(data, offsets)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    h = K.byte_hash(K.LOWER[data], words.starts, words.ends)
    text_of = words.text_of()
    # lines: cut at every newline and at the ends of texts
    cuts = np.union1d(np.flatnonzero(data == 10) + 1, offsets)
    line_start = cuts[:-1]
    line_end = cuts[1:].copy()
    line_end -= (data[line_end - 1] == 10) if len(line_end) else 0
    w0, w1 = np.searchsorted(words.starts, line_start), np.searchsorted(words.starts, line_end)
    line_no = np.arange(len(line_start)) - np.searchsorted(line_start, offsets[:-1])[np.searchsorted(offsets, line_start, "right") - 1]
    real = w1 > w0
    line_start, line_end, w0, w1, line_no = line_start[real], line_end[real], w0[real], w1[real], line_no[real]
    line_text = np.searchsorted(offsets, line_start, "right") - 1
    salt = K.mix(np.arange(n).astype(np.uint64) + np.uint64(7))
    exact = K.byte_hash(data, line_start, line_end) ^ salt[line_text]
    _, at = np.unique(exact, return_index=True)
    n_lines = np.bincount(line_text, minlength=n)
    dups = n_lines - np.bincount(line_text[at], minlength=n)
    # words in repeated windows; here the exact words count, not lower-cased ones
    g = K.grams(K.byte_hash(data, words.starts, words.ends), WINDOW)
    ok = np.flatnonzero(words.whole(WINDOW))
    rep = ok[_repeats(g[ok] ^ salt[text_of[ok]])]
    repeat_words = K.per_text(K.covered(len(h), rep, WINDOW), words.first)
    # normalised lines; a line that the text has again isn't a first one
    lh = K.range_hash(h, w0, w1)
    first = np.zeros(len(lh), bool)
    first[np.unique(lh ^ salt[line_text], return_index=True)[1]] = True
    per = np.bincount(line_text, minlength=n)
    lines = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()),
        pa.StructArray.from_arrays([pa.array(line_no, pa.int32()), pa.array(K.signed(lh)), pa.array(first), pa.array(w1 - w0, pa.int32())], ["no", "h", "first", "words"]),
    )
    chars = lead[words.ends] - lead[words.starts]
    symbols = np.zeros(len(data) + 1, np.int64)
    np.cumsum(SYMBOL[data], out=symbols[1:])
    longs = [words.per_text, K.per_text(chars, words.first), symbols[offsets[1:]] - symbols[offsets[:-1]], dups, repeat_words]
    return pa.RecordBatch.from_arrays(
        [part.column("doc_id"), part.column("host"), part.column("text_key"), *(pa.array(np.asarray(x, np.int64)) for x in longs), lines],
        ["doc_id", "host", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"],
    )


def measure(docs: DataFrame, host: str = "source") -> DataFrame:
    """Base figures and normalised lines of every document, in one scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.pieces(batch):
                yield _measure(part)

    return docs.select(F.col("doc_id").cast("long"), F.col(host).cast("string").alias("host"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text").mapInArrow(run, STATS)


def common_lines(stats: DataFrame, max_docs: int) -> DataFrame:
    """(host, h) of the lines above the limit; a host or a line comes together only as counts."""
    texts = stats.groupBy("host", "text_key").agg(F.any_value("lines").alias("lines"))
    lines = texts.select("host", F.explode("lines").alias("x")).where("x.first").select("host", "x.h")
    return lines.groupBy("host", "h").agg(F.count("*").alias("docs")).where(F.col("docs") > max_docs).select("host", "h")


def _judged(docs: DataFrame, host: str = "source", max_docs: int = 20, min_words: int = 20, min_share: float = 0.2, max_repeat_percent: int = 30, staging: Staging | None = None) -> DataFrame:
    """What ``line_quality`` gives, with host, text key and whether there is an id."""
    staging = staging or Staging(docs.sparkSession, "line_quality")
    stats = staging.write(measure(docs, host).withColumn("row", F.monotonically_increasing_id()), "stats")
    common = staging.write(common_lines(stats, max_docs), "common")
    lines = stats.select("row", "host", F.explode("lines").alias("x")).select("row", "host", "x.h", "x.no", "x.words")
    same = (lines.host.eqNullSafe(common.host)) & (lines.h == common.h)
    gone = lines.join(common, same, "left_semi").groupBy("row").agg(F.sum("words").alias("gone_words"), F.sort_array(F.collect_list("no")).alias("gone_lines"))
    out = stats.drop("lines").join(gone, "row", "left")
    left = F.col("n_words") - F.coalesce("gone_words", F.lit(0))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    depleted = (left < min_words) | (left < F.col("n_words") * min_share)
    return out.select(
        "doc_id", "host", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), left.alias("words_left"),
        F.coalesce("gone_lines", F.array().cast("array<int>")).alias("gone_lines"),
    )


def line_quality(docs: DataFrame, **options) -> DataFrame:
    """One row per input row: base figures, verdict, words left and numbers of the removed lines."""
    return _judged(docs, **options).drop("host", "text_key")


def apply_line_quality(docs: DataFrame, host: str = "source", **options) -> DataFrame:
    """The documents that are kept, without their common lines; the columns stay the same.

    The verdict goes to rows by host and text, which it depends on alone, so rows
    without an id and rows that share one are judged each.
    """
    judged = _judged(docs, host=host, **options).where("kept")
    verdict = judged.groupBy("host", "text_key").agg(F.any_value("gone_lines").alias("gone_lines"))
    # the input's columns go in one struct, so that no name can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumns({"at": F.col(f"row.`{host}`").cast("string"), "of": F.xxhash64(F.coalesce("row.text", F.lit("")))})
    kept = rows.join(verdict, F.col("at").eqNullSafe(F.col("host")) & (F.col("of") == F.col("text_key")))
    lines = F.split("row.text", "\n", -1)
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone_lines"), lambda i: F.get(lines, i))
    out = kept.withColumn("left", F.when(F.size("gone_lines") == 0, F.col("row.text")).otherwise(F.array_join(left, "\n")))
    changed = {"text": F.col("left")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("left").cast(docs.schema["n_chars"].dataType)
    return out.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
