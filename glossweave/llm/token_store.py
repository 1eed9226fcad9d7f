"""Token ids in a content-addressed store.

Encoding.  Texts are cut before spaces, each distinct piece is encoded once by the
tokenizer and the ids are gathered by position.  The byte-level pre-tokenizer
never joins across such a cut, so this equals encoding the whole text; texts with
a space that has white space on both sides (or ends the text so) are encoded
whole.

Format, all under one folder, ids as 16-bit little-endian if the vocabulary
allows it, else 32-bit:

* ``chunks/``: one row per distinct chunk: its SHA-256, number of ids, and bytes.
  A gear hash over the last 16 ids cuts a stream wherever its low bits are zero,
  so equal passages give equal chunks wherever they stand.
* ``recipes/``: one row per document, in ascending order of id, each with its
  chunks' digests, the number of ids before it in its part, and its Merkle root.
* ``parts/``: the manifest: per part of the recipes its ids, documents, ids before
  it and the Merkle root over its documents' roots, and the root over all parts.

Reading verifies the whole way up: chunk bytes against digests, digests against
the documents' roots, these against the parts' roots, and the parts against the
store's root.  If a part is missing or differs, no document counts as verified.

Every document ends with id ``end_id``, so it has at least one id.  A null text
is empty; a null id sorts first; rows that share an id stay separate documents,
ordered by their first digest.  Other columns are not stored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .staging import Staging

GEAR_IDS, MIN_IDS, MAX_IDS, MASK_BITS = 16, 64, 2048, 8
REMEMBERED, JOINED = 1_000_000, 64
_ODD_SPACE = r"[\s\pZ\x{85}\x0b\x1c-\x1f] ([\s\pZ\x{85}\x0b\x1c-\x1f]|$)"
#: A piece of a space and what begins and ends with something else.
_INNER = r"(?s)^ [^\s\pZ\x{85}\x0b\x1c-\x1f](.*[^\s\pZ\x{85}\x0b\x1c-\x1f])?$"
PACKED = "kind string, key binary, n_ids int, data binary, doc_id long, ends array<int>, digests array<binary>"


class Encoder:
    """A tokenizer that encodes each distinct piece of text once, as long as it remembers it.

    The pieces of a batch are made distinct by Arrow, on their bytes.  A piece is
    looked for among the remembered ones by a 64-bit hash and taken for known only
    if its bytes are equal too; one that shares the hash of another is encoded
    each time.  Memory is a few dozen bytes a piece.  Beyond ``REMEMBERED`` pieces
    the half that was longest unused is given up.
    """

    FIELDS = ("key", "at", "size", "byte_at", "byte_size", "used")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.wide = size > 1 << 16
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        # bytes that a token stands for: a letter each in the byte-level alphabet
        self.token_bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)
        self.key = np.zeros(0, np.uint64)
        self.at, self.size, self.byte_at, self.byte_size, self.used = (np.zeros(0, np.int64) for _ in range(5))
        self.pool = np.zeros(0, self.dtype)
        self.bytes = np.zeros(0, np.uint8)
        self.clock = 0

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after the other, and how many each has."""
        ids: list[np.ndarray] = []
        for lo in range(0, len(texts), 20_000):
            ids += [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts[lo : lo + 20_000], add_special_tokens=False)]
        return np.concatenate([np.zeros(0, self.dtype), *ids]), np.fromiter(map(len, ids), np.int64, len(ids))

    def _joined(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces that begin with a space, stood in a row: no token reaches over such a place.

        Ids are dealt to pieces by the bytes they stand for; where that doesn't
        come out even, the pieces are encoded one by one.
        """
        if not len(pieces):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        rows = [pieces[lo : lo + JOINED] for lo in range(0, len(pieces), JOINED)]
        ids, n = self._whole(["".join(r.to_pylist()) for r in rows])
        reach = np.concatenate([[0], np.cumsum(self.token_bytes[ids])])
        ends = np.cumsum(pc.binary_length(pieces).to_numpy(zero_copy_only=False), dtype=np.int64)
        if reach[-1] == ends[-1]:
            cut = np.searchsorted(reach, ends)
            row_ends = np.cumsum(n)
            if (reach[cut] == ends).all() and (cut[np.append(np.arange(JOINED - 1, len(ends) - 1, JOINED), len(ends) - 1)] == row_ends).all():
                return ids, np.diff(cut, prepend=0)
        return self._whole(pieces.to_pylist())

    def _encode_new(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, ids, sizes) of pieces; ``order`` says which piece each stretch of ids belongs to."""
        safe = pc.match_substring_regex(pieces, _INNER).to_numpy(zero_copy_only=False)
        inner, other = np.flatnonzero(safe), np.flatnonzero(~safe)
        a, n = self._joined(pieces.take(pa.array(inner)))
        b, m = self._whole(pieces.take(pa.array(other)).to_pylist())
        return np.concatenate([inner, other]), np.concatenate([a, b]), np.concatenate([n, m])

    def _forget(self) -> None:
        if len(self.key) <= REMEMBERED:
            return
        keep = self.used > np.partition(self.used, len(self.used) // 2)[len(self.used) // 2]
        for name in self.FIELDS:
            setattr(self, name, getattr(self, name)[keep])
        self.pool = self.pool[K.spread(self.at, self.size)]
        self.at = np.cumsum(self.size) - self.size
        self.bytes = self.bytes[K.spread(self.byte_at, self.byte_size)]
        self.byte_at = np.cumsum(self.byte_size) - self.byte_size

    def _pieces(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places in the pool, and numbers of ids, of distinct pieces."""
        self.clock += 1
        self._forget()
        data, offsets = K.buffers(distinct)
        length = np.diff(offsets)
        key = K.byte_hash(data, offsets[:-1], offsets[1:])
        place = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
        known = np.zeros(len(key), bool)
        if len(self.key):
            known = (self.key[place] == key) & (self.byte_size[place] == length)
            i = np.flatnonzero(known)
            differs = self.bytes[K.spread(self.byte_at[place[i]], length[i])] != data[K.spread(offsets[i], length[i])]
            known[i] = np.add.reduceat(np.append(differs, False), np.cumsum(length[i]) - length[i]) == 0 if len(i) else known[i]
        at, size = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        at[known], size[known] = self.at[place[known]], self.size[place[known]]
        self.used[place[known]] = self.clock
        new = np.flatnonzero(~known)
        if len(new):
            order, ids, n = self._encode_new(distinct.take(pa.array(new)))
            mine = new[order]
            at[mine], size[mine] = len(self.pool) + np.cumsum(n) - n, n
            self.pool = np.concatenate([self.pool, ids])
            # of pieces with one hash the first is remembered, unless an old one has it
            _, first = np.unique(key[new], return_index=True)
            kept = new[first]
            if len(self.key):
                kept = kept[self.key[place[kept]] != key[kept]]
            b = length[kept]
            spot = np.searchsorted(self.key, key[kept])
            added = (key[kept], at[kept], size[kept], len(self.bytes) + np.cumsum(b) - b, b, np.full(len(kept), self.clock))
            self.bytes = np.concatenate([self.bytes, data[K.spread(offsets[kept], b)]])
            for name, values in zip(self.FIELDS, added):
                setattr(self, name, np.insert(getattr(self, name), spot, values))
        return at, size

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text begins in it."""
        n = len(column)
        column = pc.fill_null(column, "")
        odd = pc.match_substring_regex(column, _ODD_SPACE).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", column) if odd.any() else column
        data, offsets = K.buffers(plain)
        begins = data == 0x20
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(begins)
        stream, bounds = np.zeros(0, self.dtype), np.zeros(n + 1, np.int64)
        if len(starts):
            edges = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
            coded = pa.Array.from_buffers(pa.large_string(), len(starts), [None, edges, pa.py_buffer(data)]).dictionary_encode()
            which = coded.indices.to_numpy()
            at, size = self._pieces(coded.dictionary)
            size = size[which]
            stream = self.pool[K.spread(at[which], size)]
            bounds = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(starts, offsets)]
        if odd.any():
            rows = np.flatnonzero(odd)
            ids, sizes = self._whole(column.filter(pa.array(odd)).to_pylist())
            whole = dict(zip(rows.tolist(), np.split(ids, np.cumsum(sizes)[:-1])))
            each = [whole[i] if i in whole else stream[bounds[i] : bounds[i + 1]] for i in range(n)]
            stream = np.concatenate(each)
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in each])])
        return stream, bounds


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


_GEAR = K.mix(np.arange(1 << 16).astype(np.uint64) + np.uint64(0x5DEECE66D)).astype(np.uint32)


def cut_points(ids: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash asks for a cut."""
    h = _GEAR[ids & 0xFFFF]
    if ids.dtype.itemsize > 2:
        h = h ^ (ids >> 16).astype(np.uint32) * np.uint32(0x9E3779B1)
    size = 1
    while size < GEAR_IDS:
        moved = np.zeros_like(h)
        moved[size:] = h[:-size]
        h = (moved << np.uint32(size)) + h
        size *= 2
    return np.flatnonzero((h >> np.uint32(GEAR_IDS - MASK_BITS)) & np.uint32((1 << MASK_BITS) - 1) == 0) + 1


def chunk_bounds(cuts: np.ndarray, start: int, end: int) -> list[int]:
    """Ends of the chunks of one document's ids."""
    out, here = [], start
    for c in cuts[np.searchsorted(cuts, start + MIN_IDS) : np.searchsorted(cuts, end)].tolist():
        while c - here > MAX_IDS:
            here += MAX_IDS
            out.append(here)
        if c - here >= MIN_IDS:
            out.append(c)
            here = c
    while end - here > MAX_IDS:
        here += MAX_IDS
        out.append(here)
    out.append(end)
    return out


class Merkle:
    """A Merkle tree that takes its leaves one by one and keeps one digest a level."""

    def __init__(self):
        self.levels: list[bytes | None] = []

    def add(self, leaf: bytes) -> None:
        for i, left in enumerate(self.levels):
            if left is None:
                self.levels[i] = leaf
                return
            self.levels[i] = None
            leaf = hashlib.sha256(left + leaf).digest()
        self.levels.append(leaf)

    def root(self) -> bytes:
        """The root so far; an odd one out moves up as it is."""
        out = None
        for left in self.levels:
            if left is not None:
                out = left if out is None else hashlib.sha256(left + out).digest()
        return out if out is not None else hashlib.sha256(b"").digest()


def merkle(leaves: Iterable[bytes]) -> bytes:
    """Root over digests."""
    tree = Merkle()
    for x in leaves:
        tree.add(x)
    return tree.root()


def _pack(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        task, rows = TaskContext.get().partitionId(), 0
        sent: set[bytes] = set()  # chunks this task has passed on: at most its own input
        for batch in batches:
            for part in K.pieces(batch, limit=4 * K.SLICE_BYTES):
                stream, bounds = enc.encode(part.column("text"))
                n = part.num_rows
                # each document's end id goes in
                stream = np.insert(stream, bounds[1:], end_id).astype(enc.dtype)
                bounds = bounds + np.arange(n + 1)
                cuts = cut_points(stream)
                chunks: list[tuple[bytes, int, bytes]] = []
                all_ends, digests = [], []
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    own_ends, own_digests, here = [], [], a
                    for c in chunk_bounds(cuts, a, b):
                        raw = stream[here:c].tobytes()
                        key = hashlib.sha256(raw).digest()
                        if key not in sent:
                            sent.add(key)
                            chunks.append((key, c - here, raw))
                        own_ends.append(c - a)
                        own_digests.append(key)
                        here = c
                    all_ends.append(own_ends)
                    digests.append(own_digests)
                k = len(chunks)
                doc_ids = part.column("doc_id")
                # a recipe's key only spreads recipes over partitions and keeps them apart
                marks = [hashlib.sha256(b"recipe %d %d" % (task, rows + i)).digest() for i in range(n)]
                rows += n
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(["chunk"] * k + ["recipe"] * n),
                        pa.array([c[0] for c in chunks] + marks, pa.binary()),
                        pa.array([c[1] for c in chunks] + [e[-1] for e in all_ends], pa.int32()),
                        pa.array([c[2] for c in chunks] + [None] * n, pa.binary()),
                        pa.concat_arrays([pa.nulls(k, pa.int64()), doc_ids]),
                        pa.array([None] * k + all_ends, pa.list_(pa.int32())),
                        pa.array([None] * k + digests, pa.list_(pa.binary())),
                    ],
                    ["kind", "key", "n_ids", "data", "doc_id", "ends", "digests"],
                )

    return run


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids before each document in this part and its Merkle root; a last row for the part itself."""
    before, docs, part, tree = 0, 0, None, Merkle()
    for batch in batches:
        n = batch.column("n_ids").to_numpy(zero_copy_only=False).astype(np.int64)
        starts = before + np.cumsum(n) - n
        before, docs = before + int(n.sum()), docs + batch.num_rows
        roots = [merkle(d) for d in batch.column("digests").to_pylist()]
        for r in roots:
            tree.add(r)
        if batch.num_rows:
            part = batch.column("part")[0].as_py()
        kind = pa.array(["recipe"] * batch.num_rows)
        yield pa.RecordBatch.from_arrays([kind, batch.column("part"), pa.array(starts), batch.column("doc_id"), pa.array(n), batch.column("ends"), batch.column("digests"), pa.array(roots, pa.binary())], RECIPE_NAMES)
    if part is not None:
        last = [["part"], [part], [docs], [None], [before], [None], [None], [tree.root()]]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(last, kinds)], RECIPE_NAMES)


#: Rows of kind ``part`` have the part's documents in ``start``, and its ids in ``n_ids``.
RECIPES = "kind string, part int, start long, doc_id long, n_ids long, ends array<int>, digests array<binary>, root binary"
RECIPE_NAMES = [c.split()[0] for c in RECIPES.split(", ")]


def _recipes(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    return spark.read.schema(RECIPES).parquet(f"{folder}/recipes").where(F.col("kind") == kind).drop("kind")


def _packed(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    return spark.read.schema(PACKED).parquet(f"{folder}/packed").where(F.col("kind") == kind)


def write_store(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> None:
    """Encode every document and write chunks, recipes and parts under ``folder``.

    One exchange, by digest, brings equal chunks together; every task sends a
    chunk at most once.  The recipes are then put in order of id by range.
    """
    spark = docs.sparkSession
    packed = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pack(tokenizer, end_id), PACKED)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    unique = packed.repartition(partitions, "key").dropDuplicates(["key"])
    unique.write.mode("overwrite").option("compression", "zstd").partitionBy("kind").parquet(f"{folder}/packed")
    recipes = _packed(spark, folder, "recipe")
    order = (F.col("doc_id").asc_nulls_first(), F.col("digests")[0])
    ordered = recipes.select("doc_id", "n_ids", "ends", "digests").repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    numbered = ordered.withColumn("part", F.spark_partition_id()).mapInArrow(_number, RECIPES)
    numbered.write.mode("overwrite").option("compression", "zstd").partitionBy("kind").parquet(f"{folder}/recipes")
    # one row per part: as many as there are shuffle partitions
    rows = _recipes(spark, folder, "part").select("part", "n_ids", F.col("start").alias("n_docs"), "root").orderBy("part").collect()
    total, table = 0, []
    for r in rows:
        table.append((r.part, r.n_ids, r.n_docs, total, r.root))
        total += r.n_ids
    top = merkle(bytes(r.root) for r in rows)
    spark.createDataFrame([(*t, top) for t in table], PARTS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/parts")


PARTS = "part int, n_ids long, n_docs long, before long, root binary, store_root binary"


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents, ids and Merkle root of whole parts; rows come part by part, in order."""
    part, docs, ids, tree, sound = None, 0, 0, Merkle(), True

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([docs], pa.int64()), pa.array([ids], pa.int64()), pa.array([tree.root()], pa.binary()), pa.array([sound])], ["part", "docs", "ids", "found", "in_order"])

    for batch in batches:
        for p, start, n, root in zip(*(batch.column(c).to_pylist() for c in ("part", "start", "n_ids", "root"))):
            if p != part:
                if part is not None:
                    yield done()
                part, docs, ids, tree, sound = p, 0, 0, Merkle(), True
            sound = sound and start == ids
            docs, ids = docs + 1, ids + n
            tree.add(root)
    if part is not None:
        yield done()


class Store:
    """A written store, for reading."""

    def __init__(self, spark: SparkSession, folder: str):
        chunks = _packed(spark, folder, "chunk")
        self.chunks = chunks.select(F.col("key").alias("digest"), "n_ids", "data")
        # parts has one row per shuffle partition of the writer
        self.parts = spark.read.schema(PARTS).parquet(f"{folder}/parts")
        of = self.parts.select("part", "before")
        self.recipes = _recipes(spark, folder, "recipe").join(F.broadcast(of), "part").withColumn("start", F.col("start") + F.col("before")).drop("before")
        self.own = _recipes(spark, folder, "recipe").select("part", "start", "n_ids", "root")

    def manifest_errors(self) -> list[str]:
        """What differs between the manifest and the recipes as they lie there, from the parts' roots to the store's."""
        by_part = self.own.repartition("part").sortWithinPartitions("part", "start").mapInArrow(_rebuilt, "part int, docs long, ids long, found binary, in_order boolean")
        rows = self.parts.join(by_part, "part", "full_outer").orderBy("part").collect()  # as many as the writer had shuffle partitions
        out = [f"part {r.part}" for r in rows if r.root != r.found or r.n_docs != r.docs or r.n_ids != r.ids or not r.in_order]
        if rows and (len({r.store_root for r in rows}) > 1 or merkle(bytes(r.root) for r in rows if r.root is not None) != rows[0].store_root):
            out.append("store root")
        before = 0
        for r in rows:
            if r.before != before:
                out.append(f"place of part {r.part}")
            before += r.n_ids or 0
        return out

    def places(self) -> DataFrame:
        """One row per chunk of each document: where it stands and what is to come after it."""
        of = self.recipes.select("start", "doc_id", "n_ids", F.posexplode(F.arrays_zip("digests", "ends")).alias("no", "x"))
        return of.select("start", "doc_id", "no", F.col("x.digests").alias("digest"), (F.col("n_ids") - F.col("x.ends")).alias("after"))

    def documents(self) -> DataFrame:
        """(doc_id, start, ids): every document put together from its chunks."""
        wide = self.chunks.mapInArrow(_widen, "digest binary, ids array<int>")
        got = self.places().join(wide, "digest").groupBy("start").agg(F.any_value("doc_id").alias("doc_id"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", "ids"))), lambda x: x.ids)).alias("ids"))
        return got.select("doc_id", "start", "ids")

    def verified(self) -> DataFrame:
        """Per document, from the files: start, ids, their CRC-32, and whether everything from its chunks to the store's root holds.

        The CRC of a sequence is the exclusive or of its chunks' CRCs, each moved
        on by the bytes that follow it, so chunk bytes are read where they lie
        and only sums travel.
        """
        sums = self.chunks.mapInArrow(_check, "digest binary, crc long, read_ids int, sound boolean")
        # arrays are dropped before the exchange, and each reference is one small row
        moved = self.places().join(sums, "digest").mapInArrow(_shift, "start long, crc long, read_ids int, sound boolean")
        got = moved.groupBy("start").agg(F.bit_xor("crc").alias("crc"), F.sum("read_ids").cast("long").alias("n_tokens"), F.bool_and("sound").alias("sound"))
        roots = self.recipes.select("start", "doc_id", "digests", "root").mapInArrow(_roots, "start long, doc_id long, root_holds boolean")
        whole = not self.manifest_errors()
        holds = F.lit(whole) & F.coalesce("sound", F.lit(False)) & F.col("root_holds")
        return roots.join(got, "start", "left").select("doc_id", "start", "n_tokens", F.col("crc").alias("ids_crc32"), holds.alias("verified"))


def _ids(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype("<u4")


def _widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = [_ids(d.as_py(), n.as_py()).astype(np.int32) for d, n in zip(b.column("data"), b.column("n_ids"))]
        yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(ids, pa.list_(pa.int32()))], ["digest", "ids"])


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        crc, n_read, sound = [], [], []
        for digest, n, data in zip(b.column("digest").to_pylist(), b.column("n_ids").to_pylist(), b.column("data").to_pylist()):
            ids = _ids(data, n)
            crc.append(zlib.crc32(ids))
            n_read.append(len(ids))
            sound.append(hashlib.sha256(data).digest() == digest and len(ids) == n)
        yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(crc, pa.int64()), pa.array(n_read, pa.int32()), pa.array(sound, pa.bool_())], ["digest", "crc", "read_ids", "sound"])


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        holds = [merkle(d) == r for d, r in zip(b.column("digests").to_pylist(), b.column("root").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("start"), b.column("doc_id"), pa.array(holds, pa.bool_())], ["start", "doc_id", "root_holds"])


def _shift_tables() -> np.ndarray:
    """For each power of two k: tables of 4 x 256 that move a CRC on by 4 * 2**k zero bytes."""
    poly = 0xEDB88320

    def apply(columns: list[int], x: int) -> int:
        out = 0
        for i in range(32):
            if x >> i & 1:
                out ^= columns[i]
        return out

    step = [poly, *[1 << i for i in range(31)]]  # by one bit
    tables = []
    for doubling in range(5 + 31):
        if doubling >= 5:
            tables.append([[apply(step, v << (8 * byte)) for v in range(256)] for byte in range(4)])
        step = [apply(step, c) for c in step]
    return np.array(tables, np.uint32)


_TABLES: list[np.ndarray] = []


def shift_crc(crc: np.ndarray, ids_after: np.ndarray) -> np.ndarray:
    """What each CRC adds to that of a sequence which goes on for so many 4-byte ids."""
    if not _TABLES:
        _TABLES.append(_shift_tables())
    out = crc.astype(np.uint32)
    for k, t in enumerate(_TABLES[0]):
        if not (ids_after >> k).any():
            break
        on = (ids_after >> k & 1).astype(bool)
        x = out[on]
        out[on] = t[0][x & 255] ^ t[1][x >> 8 & 255] ^ t[2][x >> 16 & 255] ^ t[3][x >> 24]
    return out


def _shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        crc = shift_crc(b.column("crc").to_numpy(zero_copy_only=False), b.column("after").to_numpy(zero_copy_only=False).astype(np.int64))
        yield pa.RecordBatch.from_arrays([b.column("start"), pa.array(crc.astype(np.int64)), b.column("read_ids"), b.column("sound")], ["start", "crc", "read_ids", "sound"])


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return str(Path(public_tokenizers.path(name)))


def store_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None) -> Store:
    """Write the documents' store, in the shared folder unless one is named, and open it."""
    folder = folder or Staging(docs.sparkSession, "token_store").path("store")
    write_store(docs, folder, tokenizer, end_id)
    return Store(docs.sparkSession, folder)
