"""Shared parts of the training-data operators.

Texts reach Python as Arrow batches and are worked on as byte arrays in slices of about a
megabyte, so that memory does not follow the batch.  What tasks exchange in bulk (postings,
counts, fingerprints) travels as *packed blocks*: one row holds the part of a task's array
that belongs to one range of hash values.  A block's size is bounded by the number of blocks,
and equal keys of a task are combined before they leave it.
"""

from __future__ import annotations

import ctypes
import gc
import os
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import freed

CHUNK_BYTES = 1 << 19
FLUSH_ENTRIES = 1 << 20
BLOCK_ENTRIES = 1 << 22
U64 = np.uint64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, U64), np.ones(1, U64)]


# ---------------------------------------------------------------- lineage and tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's setting.  Where it is unset, a local master (as in tests) gets a folder of its own; a cluster is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), "liftloom-checkpoints")
    return found


def cut(df: DataFrame, free: bool = False) -> DataFrame:
    """``df`` computed once and written to the shared folder; what follows survives lost executors.  With ``free`` its shuffle files go then."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    if not free:
        return df.checkpoint(eager=True)
    with freed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder for a written table."""
    return f"{shared_dir(spark).rstrip('/')}/liftloom-{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def n_blocks(spark: SparkSession, entries: int = 0) -> int:
    """Blocks of the hash space: at least a shuffle's partitions, and so many that a block holds about ``BLOCK_ENTRIES`` entries."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries // BLOCK_ENTRIES))


def n_blocks_of(df: DataFrame, block_bytes: int = 1 << 27) -> int:
    """Blocks for what a whole input gives: at least a shuffle's partitions, and one for each 128 MB of the tables it is read from."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return max(n_blocks(df.sparkSession), -(-size // block_bytes) if size < 1 << 55 else 1)  # unknown sizes count as 2**63


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores before it until no column of ``frames`` is called so (in any case)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, share: int = 1000) -> DataFrame:
    """``rows`` left-joined with one row of ``groups`` per ``key``, without dealing a hot key to one task.

    Groups of at least ``total / share`` rows number at most ``share``, so they can be broadcast;
    the rows of all others are shuffled.  ``groups`` must be cheap to read twice (see ``cut``).
    """
    limit = max(total // share, 2)
    hot = groups.where(F.col(size) >= limit)
    cold = groups.where(F.col(size) < limit)
    large = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left")
    return large.unionByName(rest)


ARROW_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Set the session to hand at most ``ARROW_ROWS`` rows at a time to Python; a smaller setting is kept.

    Texts are long: batches of Spark's 10,000 rows cost each task over 100 MB outside the heap.  This is
    for applications (the registered queries and the pipeline call it); the operators leave the session as it is.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


# ---------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 2 * CHUNK_BYTES)
        inverse = pow(_BASE, -1, 1 << 64)
        for i, base in enumerate((_BASE, inverse)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """``h`` with ``(h[e] - h[s]) * inverse_power[s]`` the polynomial hash of bytes s..e-1."""
    power, _ = powers(len(data))
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * power, out=out[1:])
    return out


def to_block(keys: np.ndarray, blocks: int) -> np.ndarray:
    """The block of each 64-bit key: equal ranges of the hash space, so sorted keys have sorted blocks."""
    return ((keys >> U64(32)) * U64(blocks)) >> U64(32)


# ---------------------------------------------------------------- texts

_held: dict = {}


def held() -> dict:
    """What a Python worker keeps from task to task of one operator (see ``string_parts``)."""
    return _held


def trim() -> None:
    """Hand memory that is free but kept by the allocators back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def tidied(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work``, followed by ``trim``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            trim()

    return run


def _release() -> None:
    """Drop what another operator's tasks left in this worker."""
    if _held:
        _held.clear()
        gc.collect()
        trim()


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text.  (An operator that keeps a cache in ``held`` does not use this.)"""
    _release()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    if not pa.types.is_large_string(column.type) and not pa.types.is_string(column.type) and not pa.types.is_binary(column.type):
        column = column.cast(pa.string())
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offs, data = column.buffers()
    if offs is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offs, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def slices(at: np.ndarray, limit: int = CHUNK_BYTES, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of rows (at most ``rows``) whose texts have about ``limit`` bytes together; a longer text is alone."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        hi = min(hi, n, n if rows is None else lo + rows)
        yield lo, hi
        lo = hi


def chunks(column: pa.Array, limit: int = CHUNK_BYTES, rows: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) for each slice of a text column."""
    data, at = string_parts(column)
    for lo, hi in slices(at, limit, rows):
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased) of a slice, and the first word of each text (+ end)."""
    data = LOWER[data]
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    inside = np.append(inside, False)
    starts = np.flatnonzero(inside & (~before | edge))
    ends = np.flatnonzero(before & (~inside | edge))
    h = prefix_hash(data)
    _, inverse = powers(len(data) + 1)
    return mix((h[ends] - h[starts]) * inverse[starts]), np.searchsorted(starts, at)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles; with fewer words the whole sequence is one."""
    rolled = roll(hashes, width)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(rolled[a : b - width + 1])
        elif b > a:
            yield roll(hashes[a:b], b - a) ^ U64(b - a)
        else:
            yield np.zeros(0, U64)


def roll(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` consecutive values."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, U64)
    for k in range(width):
        out = out * U64(0xD6E8FEB86659FD93) + hashes[k : k + n]
    return mix(out)


# ---------------------------------------------------------------- packed blocks


def packed(blocks: int, keys: np.ndarray, *columns: np.ndarray, form: Callable[[np.ndarray], bytes] = np.ndarray.tobytes) -> Iterator[tuple[int, list[bytes]]]:
    """(block, bytes of each array) for arrays sorted by ``keys``; ``form`` may be ``planes``."""
    if len(keys):
        block = to_block(keys, blocks)
        cuts = np.flatnonzero(np.diff(block)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
            yield int(block[a]), [form(x[a:b]) for x in (keys, *columns)]


def block_batches(rows: Iterator[tuple[int, list[bytes]]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Record batches of (block int, one binary column per name)."""
    kinds = [pa.field("block", pa.int32()), *(pa.field(n, pa.binary()) for n in names)]
    held, size = [], 0
    for block, parts in rows:
        held.append((block, *parts))
        size += sum(map(len, parts))
        if size > 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kinds, strict=True)], schema=pa.schema(kinds))
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kinds, strict=True)], schema=pa.schema(kinds))


def unpack(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    """The values of all rows of a binary column, one after another."""
    parts = [np.frombuffer(data, np.uint8)[at[0] : at[-1]] for data, at in (string_parts(c) for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column]))]
    return np.concatenate(parts).view(dtype) if parts else np.zeros(0, dtype)


def planes(x: np.ndarray) -> bytes:
    """The bytes of an array, first bytes of all values first: the even high bytes of small numbers compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def unplanes(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    """The values of all rows that ``planes`` made."""
    width = np.dtype(dtype).itemsize
    parts = [np.ascontiguousarray(np.frombuffer(x.as_buffer(), np.uint8).reshape(width, -1).T).view(dtype).ravel() for x in column if x.is_valid and len(x.as_buffer())]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def per_block(df: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``work`` on the rows of each block."""

    def run(table: pa.Table) -> pa.Table:
        out = work(table)
        if table.nbytes > CHUNK_BYTES:
            trim()
        return out

    return df.groupBy("block").applyInArrow(run, schema)


def sum_by_key(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with their summed counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


# ---------------------------------------------------------------- membership bits

BITS_MOST = 1 << 30
PROBES = 3
PARTS = 64


def bits_for(entries: int) -> int:
    """Size of a membership sketch: 16 bits for an entry, in powers of two, never over 128 MB (67 million entries)."""
    size = 1 << 16
    while size < 16 * entries and size < BITS_MOST:
        size *= 2
    return size


def membership(df: DataFrame, key: str, entries: int) -> tuple[np.ndarray, int]:
    """A Bloom filter of the 64-bit keys of ``df``: no member is missed, one in 200 others passes.

    Its size follows ``entries`` up to a proven bound of 128 MB, from where on ever more others pass; each task
    gives the slices that its keys fall into, which are joined by OR before the one filter reaches the
    driver.  Users follow it with an exact join or grouping, so it only spares work.
    """
    size = bits_for(entries)
    width = size // PARTS

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(list(probes(batch.column(0).to_numpy(zero_copy_only=False).view(U64), size))))
            cuts = np.searchsorted(at, np.arange(PARTS + 1) * width)
            rows = [(p, at[a:b] - p * width) for p, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1].astype(np.uint32).tobytes() for r in rows], pa.binary())], names=["part", "at"])

    def join(table: pa.Table) -> pa.Table:
        bits = np.zeros(width, bool)
        for x in table.column("at"):
            bits[np.frombuffer(x.as_buffer(), np.uint32)] = True
        return pa.table({"part": table.column("part")[:1].cast(pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    marks = df.select(F.col(key).cast("long")).where(F.col(key).isNotNull()).mapInArrow(tidied(mark), "part int, at binary")
    out = np.zeros(size // 8, np.uint8)
    for row in marks.groupBy("part").applyInArrow(join, "part int, bits binary").toLocalIterator():
        out[row.part * width // 8 : (row.part + 1) * width // 8] = np.frombuffer(row.bits, np.uint8)
    return out, size


def probes(keys: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The positions of each key's bits."""
    h = mix(keys.astype(U64, copy=False))
    step = (h >> U64(32)) | U64(1)
    for k in range(PROBES):
        yield ((h + U64(k) * step) & U64(size - 1)).astype(np.int64)


def passes(bits: np.ndarray, size: int, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be a member."""
    ok = np.ones(len(keys), bool)
    for at in probes(keys, size):
        ok &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return ok


# ---------------------------------------------------------------- components

LOCAL_EDGES = 1 << 20


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node that it reaches) for all ends of the edges."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], least)
        np.minimum.at(root, root[y], least)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            return nodes, nodes[root]


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (a, b) reaches.

    Edges are gathered in tasks of at most ``LOCAL_EDGES``, which contract them to stars; a single task is the
    whole answer.  With more edges, large-star and small-star rounds follow: every node hands
    its neighbours to the least of them, until nothing changes, in a logarithmic number of rounds, each
    written to the shared folder.  A node with many neighbours is grouped by partial minima and never gathered.
    """

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_a, held_b = [], []
        for batch in batches:
            held_a.append(batch.column(0).to_numpy())
            held_b.append(batch.column(1).to_numpy())
        if held_a:
            node, root = contract(np.concatenate(held_a), np.concatenate(held_b))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "component"])

    start = cut(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b"))
    count = start.count()
    tasks = max(1, -(-count // LOCAL_EDGES))
    found = cut(start.coalesce(tasks).mapInArrow(tidied(stars), "node long, component long"))
    if tasks == 1:
        return found
    now = found.select(F.col("node").alias("u"), F.col("component").alias("v")).where("u <> v").distinct()
    now = cut(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        after = cut(small)
        if after.count() == now.count() and after.join(now, ["u", "v"], "left_anti").isEmpty():
            return after.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(after.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        now = after
