"""Exact deduplication with counting quotient filters.

Every partition builds counting quotient filters of its texts' 64-bit fingerprints: the high
bits of a fingerprint (the quotient) name a run, the low bits (the remainder) are kept sorted in
the run, each with a count, in real slots with three metadata bits.  Filters of the same range merge without
loss in one pass over their sorted remainders that adds counts.  Only texts whose fingerprint has a merged count
above one are moved and compared byte for byte.

Defined cases: a null text counts as empty, and all empty texts are equal.  Texts are equal when
identical after lower-casing A-Z.  The row with the largest id stays; a null id is smaller than
any other.  Rows that repeat both id and text are one document and get the same decision; rows that repeat an id with
different texts are different documents.  Other columns are ignored (``keep_one`` hands them on), so their names may
clash with the result's.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SLOTS = 0.75  # greatest load of a new filter


@dataclass
class QuotientFilter:
    """A counting quotient filter over the fingerprints of one block.

    A fingerprint's high ``64 - low`` bits are its quotient (from ``base`` on), its ``low`` bits the remainder.  Runs of
    sorted remainders lie in slots from their quotient's on, shifted right behind longer runs; each slot has the
    bits occupied (its quotient has a run), continuation (not the first of a run) and shifted (not in its own slot).
    """

    base: int
    low: int
    occupied: np.ndarray
    continuation: np.ndarray
    shifted: np.ndarray
    remainders: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray) -> QuotientFilter:
        """From sorted distinct fingerprints."""
        n = len(fingerprints)
        low = 0
        # the widest remainder for which the slots from the first to the last quotient still number enough
        while n and low < 56 and (int(fingerprints[-1] >> C.U64(low + 8)) - int(fingerprints[0] >> C.U64(low + 8)) + 1) * SLOTS >= n:
            low += 8
        while n and low < 63 and (int(fingerprints[-1] >> C.U64(low + 1)) - int(fingerprints[0] >> C.U64(low + 1)) + 1) * SLOTS >= n:
            low += 1
        quotient = (fingerprints >> C.U64(low)).astype(C.U64)
        base = int(quotient[0]) if n else 0
        home = (quotient - C.U64(base)).astype(np.int64)
        # an entry lies in its own slot, or in the one behind the entry before it
        slot = np.arange(n) + np.maximum.accumulate(home - np.arange(n)) if n else home
        size = int(max(slot[-1], home[-1])) + 1 if n else 0
        occupied, continuation, shifted = np.zeros(size, bool), np.zeros(size, bool), np.zeros(size, bool)
        remainders, held = np.zeros(size, C.U64), np.zeros(size, np.int64)
        occupied[home] = True
        continuation[slot[1:]] = home[1:] == home[:-1]
        shifted[slot] = slot != home
        remainders[slot] = fingerprints & C.U64((1 << low) - 1)
        held[slot] = counts
        return cls(base, low, occupied, continuation, shifted, remainders, held)

    def used(self) -> np.ndarray:
        """The slots that hold an entry."""
        return np.flatnonzero(self.counts > 0)

    def fingerprints(self) -> np.ndarray:
        """All entries in order: the k-th run belongs to the k-th occupied slot."""
        used = self.used()
        run = np.cumsum(~self.continuation[used]) - 1
        quotient = np.flatnonzero(self.occupied)[run].astype(C.U64) + C.U64(self.base)
        return (quotient << C.U64(self.low)) | self.remainders[used]

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        return self.fingerprints(), self.counts[self.used()]

    def merge(self, other: QuotientFilter) -> QuotientFilter:
        """All entries of both in one pass over their sorted remainders; equal ones become one with the sum of counts."""
        mine, counts = self.entries()
        theirs, more = other.entries()
        at = np.searchsorted(mine, theirs)
        same = np.zeros(len(theirs), bool)
        inner = at < len(mine)
        same[inner] = mine[at[inner]] == theirs[inner]
        counts[at[same]] += more[same]
        return QuotientFilter.of(np.insert(mine, at[~same], theirs[~same]), np.insert(counts, at[~same], more[~same]))

    def to_bytes(self) -> bytes:
        """Head, the three bits of each slot, remainders of used slots cut to whole bytes, then the counts above one with their places."""
        used = self.used()
        counts = self.counts[used]
        often = np.flatnonzero(counts > 1)
        width = -(-self.low // 8)
        head = np.array([self.base, self.low, len(self.occupied), len(used), len(often)], C.U64)
        low = self.remainders[used].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        filled = np.zeros(len(self.occupied), bool)
        filled[used] = True
        bits = (np.packbits(x).tobytes() for x in (self.occupied, self.continuation, self.shifted, filled))
        return b"".join([head.tobytes(), *bits, low.tobytes(), often.astype(np.uint32).tobytes(), counts[often].astype(np.int64).tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> QuotientFilter:
        base, low, size, n, often = np.frombuffer(data, C.U64, 5).tolist()
        at, packed, width = 40, -(-size // 8), -(-low // 8)
        bits = []
        for _ in range(4):
            bits.append(np.unpackbits(np.frombuffer(data, np.uint8, packed, at), count=size).astype(bool))
            at += packed
        used = np.flatnonzero(bits[3])
        grid = np.zeros((n, 8), np.uint8)
        grid[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
        at += n * width
        remainders, counts = np.zeros(size, C.U64), np.zeros(size, np.int64)
        remainders[used] = grid.view("<u8").ravel()
        counts[used] = 1
        counts[used[np.frombuffer(data, np.uint32, often, at)]] = np.frombuffer(data, np.int64, often, at + 4 * often)
        return cls(base, low, *bits[:3], remainders, counts)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long, digest binary): the SHA-256 of each normalised text and its first eight bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = C.string_parts(batch.column(1))
            view = data.tobytes() if len(data) < 1 << 20 else memoryview(data)
            digests = b"".join(hashlib.sha256(bytes(view[a:b]).lower()).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            grid = np.frombuffer(digests, np.uint8).reshape(-1, 32)
            fp = np.ascontiguousarray(grid[:, :8]).view(np.int64).ravel()
            full = pa.Array.from_buffers(pa.binary(), len(grid), [None, pa.py_buffer((np.arange(len(grid) + 1) * 32).astype(np.int32)), pa.py_buffer(digests)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), full], names=["doc_id", "fp", "digest"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(C.tidied(work), "doc_id long, fp long, digest binary")


def partition_filters(prints: DataFrame, blocks: int) -> DataFrame:
    """(block, filter): the counting quotient filters of each partition."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            held, size = [], 0

            def flush():
                keys, counts = np.unique(np.concatenate(held), return_counts=True)
                for block, (k, c) in C.packed(blocks, keys, counts.astype(np.int64)):
                    yield block, [QuotientFilter.of(np.frombuffer(k, C.U64), np.frombuffer(c, np.int64)).to_bytes()]

            for batch in batches:
                held.append(batch.column(0).to_numpy(zero_copy_only=False).view(C.U64))
                size += len(held[-1])
                if size > C.FLUSH_ENTRIES:
                    yield from flush()
                    held, size = [], 0
            if held:
                yield from flush()

        yield from C.block_batches(rows(), ["filter"])

    return prints.select("fp").mapInArrow(C.tidied(work), "block int, filter binary")


def repeated_fingerprints(filters: DataFrame) -> DataFrame:
    """(fp, n) of the fingerprints that the merged filters count more than once."""

    def work(table: pa.Table) -> pa.Table:
        pool = [QuotientFilter.from_bytes(x) for x in table.column("filter").to_pylist()]
        while len(pool) > 1:
            pool = [a.merge(b) for a, b in zip(pool[::2], pool[1::2], strict=False)] + (pool[-1:] if len(pool) % 2 else [])
        prints, counts = pool[0].entries()
        return pa.table({"fp": prints[counts > 1].view(np.int64), "n": counts[counts > 1]})

    return C.per_block(filters, work, "fp long, n long")


def candidate_texts(docs: DataFrame, bits: np.ndarray, size: int) -> DataFrame:
    """(doc_id, norm) of the rows whose fingerprint may be repeated; ``norm`` is the text with A-Z lower-cased."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = C.string_parts(batch.column(1))
            pairs = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            fp = np.frombuffer(b"".join(hashlib.sha256(bytes(data[a:b]).lower()).digest()[:8] for a, b in pairs), C.U64)
            keep = np.flatnonzero(C.passes(sent.value, size, fp))
            texts = pa.array([bytes(data[a:b]).lower() for a, b in (pairs[i] for i in keep.tolist())], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), texts], names=["doc_id", "norm"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(C.tidied(work), "doc_id long, norm string")


def _groups(docs: DataFrame) -> tuple[DataFrame, DataFrame, int, tuple[np.ndarray, int]]:
    """(digests of all rows, groups (digest, keep_id, group_size) of two equal texts or more, number of rows, sketch of repeated fingerprints)."""
    prints = C.cut(fingerprints(docs))
    total = prints.count()
    repeated = C.cut(repeated_fingerprints(partition_filters(prints, C.n_blocks(docs.sparkSession, total))))
    sketch = C.membership(repeated, "fp", repeated.count())
    # Equal strings are grouped as whole byte strings, with partial groups before the shuffle: the byte verification.
    groups = candidate_texts(docs, *sketch).groupBy("norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return prints, C.cut(groups.where("group_size > 1").select(F.unhex(F.sha2("norm", 256)).alias("digest"), "keep_id", "group_size")), total, sketch


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prints, groups, total, _ = _groups(docs)
    out = C.attach(prints, groups, "digest", "group_size", total)
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame, share: int = 1000) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: of equal texts the one with the largest id; of rows repeating id and text one.

    Only rows whose fingerprint may be repeated are shuffled.  A group of at least a ``share``-th of all rows is decided by a
    broadcast (there are at most ``share`` such groups) before that.
    """
    _, groups, total, sketch = _groups(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    sent = docs.sparkSession.sparkContext.broadcast(sketch)

    def suspect(texts: pa.Array) -> pa.Array:
        data, at = C.string_parts(texts)
        digests = [hashlib.sha256(bytes(data[a:b]).lower()).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        maybe = C.passes(*sent.value, np.frombuffer(b"".join(x[:8] for x in digests), C.U64))
        return pa.array([x if m else None for x, m in zip(digests, maybe.tolist(), strict=True)], pa.binary())

    digest, keep, size = (C.unused(name, docs) for name in ("digest", "keep_id", "group_size"))
    marked = docs.withColumn(digest, F.arrow_udf(suspect, "binary").asNondeterministic()(F.col("text").cast("string")))
    groups = groups.select(F.col("digest").alias(digest), F.col("keep_id").alias(keep), F.col("group_size").alias(size))
    stays = F.col(size).isNull() | F.col("doc_id").cast("long").eqNullSafe(F.col(keep))
    some = marked.where(F.col(digest).isNotNull())
    for part in (F.broadcast(groups.where(F.col(size) >= max(total // share, 2))), groups.where(F.col(size) < max(total // share, 2))):
        some = some.join(part, digest, "left").where(stays).drop(keep, size)
    return marked.where(F.col(digest).isNull()).select(*docs.columns).unionByName(some.dropDuplicates([digest]).select(*docs.columns))
