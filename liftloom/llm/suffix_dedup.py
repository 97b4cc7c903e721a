"""Removal of repeated byte strings by merging shard Burrows-Wheeler transforms.

A byte goes if it lies in a string of ``SPAN`` bytes that also starts in a document with a smaller id.

Candidates.  Every window of ``SPAN`` bytes has a minimizer, the least hash of its ``GRAM``-byte
grams, which its content alone decides.  Equal windows share it, so only runs of windows whose minimizer occurs in two tasks,
or in two texts of a task, can repeat.  Such runs are cut out as *pieces* and meet by minimizer in blocks of the hash space.
A task sends one piece for each content and settles its other holders itself, so a passage that very many documents
share does not gather in one block.

Merging.  In a block, equal pieces collapse into one that keeps the least id.  The different pieces
that share a minimizer are dealt into shards; each shard's suffixes are sorted once and give its
Burrows-Wheeler transform.  The transforms are merged by refining their interleave: from the order by the first
k symbols, one stable pass over the two symbols before each suffix gives the order by k + 2.  Borders
between unequal neighbours are carried along, so after ``SPAN / 2`` passes the runs without a border are the intervals
of suffixes with a common prefix of ``SPAN`` bytes, without sorting the suffixes of all shards again.

Defined cases: a null text is empty; texts of under ``SPAN`` bytes lose nothing.  A text equal to one
with a smaller id loses everything.  Rows with a null id lose nothing and remove nothing.
Rows repeating id and text lose nothing to each other.  Other columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SPAN, GRAM = 50, 24
GRAMS = SPAN - GRAM + 1
SHARDS = 4
FLUSH_BYTES, MERGE_BYTES, SKIPPED = 1 << 21, 1 << 20, 1 << 21
STOP = 0xFF  # no byte of UTF-8


def minimizer_runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer's hash, first window, windows) of each run of consecutive windows of one text with one minimizer."""
    none = np.zeros(0, np.int64)
    if len(data) < SPAN:
        return none.astype(np.uint64), none, none
    h = C.prefix_hash(data)
    _, inverse = C.powers(len(data) + 1)
    gram = C.mix((h[GRAM:] - h[:-GRAM]) * inverse[: len(data) - GRAM + 1])
    width, least = 1, gram
    while 2 * width <= GRAMS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = GRAMS - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    ends = np.repeat(at[1:], np.diff(at))[: len(least)]
    windows = np.arange(len(least))
    valid = windows + SPAN <= ends
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (ends[1:] != ends[:-1]) | ~valid[:-1]
    start = np.flatnonzero(new & valid)
    stop = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True)) + 1
    count = stop - start
    if (count > GRAMS).any():  # a gram repeats within its window: cut long runs
        pieces = -(-count // GRAMS)
        step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, stop = np.repeat(start, pieces) + step * GRAMS, np.repeat(stop, pieces)
        count = np.minimum(stop - start, GRAMS)
    # Minimizers are small hashes; mixed again they spread evenly over blocks.
    return C.mix(~least[start]), start, count


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, sig): the SHA-256 of each text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = C.string_parts(batch.column(1))
            sigs = [hashlib.sha256(data[a:b]).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), pa.array(sigs, pa.binary())], names=["doc_id", "n_bytes", "sig"])

    return docs.mapInArrow(C.tidied(work), "doc_id long, n_bytes long, sig binary")


def copies_of(rows: DataFrame, same: DataFrame) -> DataFrame:
    """Ids of documents equal to one with a smaller id.

    They lose everything whatever else repeats, so leaving them out of the search only spares work.
    """
    least = rows.where("doc_id is not null").join(same.select("sig", "least"), "sig", "left")
    return C.cut(least.groupBy("doc_id").agg(F.bool_and(F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))).alias("gone")).where("gone").select("doc_id"))


def searched(docs: DataFrame, gone: DataFrame):
    """The documents to search, and a broadcast of the sorted ids among them to leave out.

    At most ``SKIPPED`` ids (16 MB) are sent to the tasks; of more the documents are parted by a join, which moves the texts once.
    """
    ids, context = np.zeros(0, np.int64), docs.sparkSession.sparkContext
    if gone.count() <= SKIPPED:
        ids = np.sort(np.array([r.doc_id for r in gone.toLocalIterator()], np.int64))
    else:
        named = docs.where("doc_id is not null").join(gone, "doc_id", "left_anti")
        docs = C.cut(named.unionByName(docs.where("doc_id is null")))
    return docs, context.broadcast(ids)


def without(batch: pa.RecordBatch, skip: np.ndarray) -> pa.RecordBatch:
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    if not len(skip) or not len(ids):
        return batch
    at = np.minimum(np.searchsorted(skip, ids), len(skip) - 1)
    return batch.filter(pa.array(skip[at] != ids))


def minimizers(docs: DataFrame, skip, blocks: int) -> DataFrame:
    """Packed minimizers (block, keys, several) of each task; ``several``: in two texts or more."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            seen: set[bytes] = set()
            held: list[np.ndarray] = []
            size = 0

            def flush():
                keys, counts = np.unique(np.concatenate(held), return_counts=True)
                yield from C.packed(blocks, keys, counts > 1)

            for batch in batches:
                for lo, hi, data, at in C.chunks(without(batch, skip.value).column(1)):
                    fresh = np.zeros(hi - lo, bool)
                    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                        name = hashlib.sha256(data[a:b]).digest()
                        if name not in seen:
                            seen.add(name)
                            fresh[i] = True
                    keys, start, _ = minimizer_runs(data, at)
                    text = np.searchsorted(at, start, "right") - 1
                    some = fresh[text]
                    if some.any():
                        # once for each text
                        order = np.lexsort((text[some], keys[some]))
                        k, t = keys[some][order], text[some][order]
                        first = np.ones(len(k), bool)
                        first[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
                        held.append(k[first])
                        size += int(first.sum())
                        if size > C.FLUSH_ENTRIES:
                            yield from flush()
                            held.clear()
                            size = 0
            if held:
                yield from flush()

        yield from C.block_batches(rows(), ["keys", "several"])

    return docs.where("doc_id is not null").mapInArrow(C.tidied(work), "block int, keys binary, several binary")


def repeated_minimizers(packed: DataFrame) -> DataFrame:
    def merge(table: pa.Table) -> pa.Table:
        keys, times = C.sum_by_key(C.unpack(table.column("keys"), np.uint64), 1 + C.unpack(table.column("several"), np.uint8).astype(np.int64))
        return pa.table({"minimizer": keys[times > 1].view(np.int64)})

    return C.per_block(packed, merge, "minimizer long")


class Pieces:
    """Pieces of text with the document, text and place that they come from."""

    COLUMNS = ("anchor", "doc", "tid", "start", "count")
    TYPES = (np.uint64, np.int64, np.uint32, np.uint32, np.uint8)

    def __init__(self, anchor, doc, tid, start, count, data):
        self.anchor, self.doc, self.tid, self.start, self.count, self.data = anchor, doc, tid, start, count, data
        size = count.astype(np.int64) + SPAN - 1
        self.ends = np.cumsum(size)
        self.begins = self.ends - size

    def take(self, rows: np.ndarray) -> Pieces:
        return Pieces(self.anchor[rows], self.doc[rows], self.tid[rows], self.start[rows], self.count[rows], _cut(self.data, self.begins[rows], self.ends[rows]))

    def contents(self) -> np.ndarray:
        """A hash of minimizer and bytes."""
        out = np.empty(len(self.doc), np.uint64)
        for a, b in C.slices(np.concatenate([[0], self.ends])):
            lo = int(self.begins[a])
            h = C.prefix_hash(self.data[lo : int(self.ends[b - 1])])
            _, inverse = C.powers(len(h))
            begins, ends = self.begins[a:b] - lo, self.ends[a:b] - lo
            out[a:b] = (h[ends] - h[begins]) * inverse[begins]
        return C.mix(out ^ C.mix(self.anchor + self.count))

    def holders(self) -> tuple[np.ndarray, np.ndarray]:
        """(rows in order of content, document and place; whether a smaller document has the row's content)."""
        key = self.contents()
        order = np.lexsort((self.start, self.doc, key))
        k, d = key[order], self.doc[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, int)
        least = np.repeat(d[first], np.diff(np.append(first, len(k))))
        return order, d > least


def _cut(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of several ranges, one after another."""
    size = ends - begins
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.uint8)
    shift = np.repeat(begins - (np.cumsum(size) - size), size)
    return data[np.arange(total) + shift]


def pieces_of(docs: DataFrame, skip, bits: np.ndarray, size: int, blocks: int) -> DataFrame:
    """Packed pieces (block, and the columns of Pieces), and packed findings that a task made itself (block null)."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    names = [*Pieces.COLUMNS, "data"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int32()), *((n, pa.binary()) for n in names)])
        seen: dict[bytes, int] = {}
        held: list[Pieces] = []
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            every = Pieces(*(np.concatenate([getattr(p, c) for p in held]) for c in names))
            order, later = every.holders()
            rows = []
            if later.any():
                some = order[later]
                rows.append((None, b"", *(C.planes(getattr(every, c)[some]) for c in Pieces.COLUMNS[1:]), b""))
            sent_rows = order[~later]
            sent_rows = sent_rows[np.argsort(every.anchor[sent_rows], kind="stable")]
            block = C.to_block(every.anchor[sent_rows], blocks)
            cuts = np.flatnonzero(np.diff(block)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)], strict=True):
                if b > a:
                    p = every.take(sent_rows[a:b])
                    rows.append((int(block[a]), *(C.planes(getattr(p, c)) for c in Pieces.COLUMNS), p.data.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            batch = without(batch, skip.value)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, at in C.chunks(batch.column(1)):
                keys, start, count = minimizer_runs(data, at)
                some = np.flatnonzero(C.passes(sent.value, size, keys))
                if not len(some):
                    continue
                keys, start, count = keys[some], start[some], count[some]
                text = np.searchsorted(at, start, "right") - 1
                tids = np.zeros(hi - lo, np.uint32)
                use = np.zeros(hi - lo, bool)
                for i in np.unique(text).tolist():
                    name = hashlib.sha256(data[at[i] : at[i + 1]].tobytes()).digest()
                    tids[i] = int.from_bytes(name[:4], "little")
                    doc = int(ids[lo + i])
                    # of equal texts only the least id of the task so far matters
                    if doc < seen.get(name, doc + 1):
                        seen[name] = doc
                        use[i] = True
                keep = np.flatnonzero(use[text])
                if len(keep):
                    keys, start, count, text = keys[keep], start[keep], count[keep], text[keep]
                    held.append(Pieces(keys, ids[lo + text].astype(np.int64), tids[text], (start - at[text]).astype(np.uint32), count.astype(np.uint8), _cut(data, start, start + count + SPAN - 1)))
                    total += len(held[-1].data)
                    if total > FLUSH_BYTES:
                        yield from flush()
                        held.clear()
                        total = 0
        if held:
            yield from flush()

    schema = "block int, " + ", ".join(f"{n} binary" for n in names)
    return docs.where("doc_id is not null").mapInArrow(C.tidied(work), schema)


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Rotations of a cyclic text in order, by doubling the compared length."""
    n = len(text)
    rank = text.astype(np.uint64)
    for k in range(1, 8):  # the first eight symbols at once
        rank = (rank << np.uint64(8)) | np.roll(text, -k)
    width = 8
    while True:
        order = np.argsort(rank)
        new = np.ones(n, bool)
        new[1:] = rank[order[1:]] != rank[order[:-1]]
        place = np.empty(n, np.int64)
        place[order] = np.cumsum(new) - 1
        if new.all() or width >= n:
            return order
        rank = place * n + np.roll(place, -width)
        width *= 2


def merged_intervals(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, interval) of each place in the order of all shards' suffixes by their first ``depth`` symbols.

    A transform gives for each suffix of its shard the two symbols before it as one number, so a
    pass leads from the order by k symbols to that by k + 2; ``depth`` is even.  Suffixes of one
    interval agree in ``depth`` symbols.  The suffixes of a shard keep their order: its
    j-th place is its j-th suffix.
    """
    symbols = np.concatenate(transforms)
    shard = np.repeat(np.arange(len(transforms), dtype=np.uint8), [len(t) for t in transforms])
    interval = np.zeros(len(symbols), np.int32)
    before = np.empty_like(symbols)
    for _ in range(depth // 2):
        before[np.argsort(shard, kind="stable")] = symbols  # the symbols before each suffix, in the present order
        step = np.argsort(before, kind="stable")
        shard, moved, first = shard[step], interval[step], before[step]
        border = np.zeros(len(step), np.int32)
        border[1:] = (first[1:] != first[:-1]) | (moved[1:] != moved[:-1])
        interval = np.cumsum(border, dtype=np.int32)
    return shard, interval


def window_classes(pieces: Pieces, shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, window, class) of each window of the pieces; windows of a class are equal."""
    n = len(pieces.doc)
    size = (pieces.ends - pieces.begins) + 1
    whole = np.full(int(size.sum()), STOP, np.uint8)
    begins = np.cumsum(size) - size
    whole[np.arange(len(pieces.data)) + np.repeat(begins - pieces.begins, size - 1)] = pieces.data
    cuts = np.searchsorted(np.append(begins, len(whole)), np.linspace(0, len(whole), max(1, min(shards, n)) + 1).astype(int))
    cuts = np.unique(np.concatenate([[0], cuts[1:-1], [n]]))
    edges = np.append(begins, len(whole))[cuts]
    orders, transforms = [], []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        text = whole[a:b]
        order = suffix_order(text)
        orders.append(order + a)
        transforms.append((text[order - 2].astype(np.uint16) << np.uint16(8)) | text[order - 1])
    shard, interval = merged_intervals(transforms, SPAN)
    place = np.empty(len(whole), np.int64)
    place[np.argsort(shard, kind="stable")] = np.concatenate(orders)
    piece = np.searchsorted(begins, place, "right") - 1
    window = place - begins[piece]
    ok = window < pieces.count[piece]
    return piece[ok], window[ok], interval[ok]


def findings_of(table: pa.Table) -> pa.Table:
    """Windows (doc, tid, start, count) that start with bytes of a smaller document, packed by document."""
    every = Pieces(*(C.unplanes(table.column(c), t) for c, t in zip(Pieces.COLUMNS, Pieces.TYPES, strict=True)), C.unpack(table.column("data"), np.uint8))
    order, later = every.holders()
    out = [(every.doc[order[later]], every.tid[order[later]], every.start[order[later]], every.count[order[later]].astype(np.int64))]
    # The least holders of each content; several if its document holds it more than once.
    rows = order[~later]
    key = every.contents()[rows]
    first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    alone = rows[first]
    anchors, times = np.unique(every.anchor[alone], return_counts=True)
    some = np.flatnonzero(times[np.searchsorted(anchors, every.anchor[alone])] > 1)
    # Minimizers are independent of each other: merge the pieces of some of them at a time.
    some = some[np.argsort(every.anchor[alone[some]], kind="stable")]
    size = np.cumsum(every.ends[alone[some]] - every.begins[alone[some]])
    anchor = every.anchor[alone[some]]
    border = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(some) else np.zeros(0, int)
    batch = (size[border] // MERGE_BYTES) if len(some) else border
    starts = border[np.flatnonzero(np.concatenate([[True], batch[1:] != batch[:-1]]))] if len(some) else border
    holders = (np.flatnonzero(first), np.append(np.flatnonzero(first)[1:], len(rows)))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(some)], strict=False):
        out += merged_findings(every, rows, holders, some[a:b], alone)
    return pa.table(dict(zip(("doc", "tid", "start", "count"), (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)))


def merged_findings(every: Pieces, rows: np.ndarray, holders: tuple[np.ndarray, np.ndarray], some: np.ndarray, alone: np.ndarray) -> list[tuple]:
    """Findings among the different contents ``some``, for all rows that hold them."""
    different = every.take(alone[some])
    piece, window, kind = window_classes(different)
    least = np.full(int(kind.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, kind, different.doc[piece])
    gone = least[kind] < different.doc[piece]
    piece, window = piece[gone], window[gone]
    if not len(piece):
        return []
    sort = np.lexsort((window, piece))
    piece, window = piece[sort], window[sort]
    new = np.ones(len(piece), bool)
    new[1:] = (piece[1:] != piece[:-1]) | (window[1:] != window[:-1] + 1)
    at = np.flatnonzero(new)
    lengths = np.diff(np.append(at, len(piece)))
    content = some[piece[at]]
    times = holders[1][content] - holders[0][content]
    run = np.repeat(np.arange(len(at)), times)
    step = np.arange(len(run)) - np.repeat(np.cumsum(times) - times, times)
    holder = rows[holders[0][content][run] + step]
    return [(every.doc[holder], every.tid[holder], every.start[holder] + window[at][run], lengths[run])]


def pack_findings(doc, tid, start, count, blocks: int) -> Iterator[tuple[int, list[bytes]]]:
    key = C.mix(doc.astype(np.int64).view(np.uint64))
    order = np.argsort(key, kind="stable")
    yield from C.packed(blocks, key[order], doc[order].astype(np.int64), tid[order].astype(np.uint32), start[order].astype(np.uint32), count[order].astype(np.uint32))


FOUND = ["doc", "tid", "start", "count"]


def findings(docs: DataFrame, skip, bits: np.ndarray, size: int, blocks: int) -> DataFrame:
    """Packed findings (block by document, doc, tid, start, count)."""
    pieces = pieces_of(docs, skip, bits, size, blocks)

    def shared(table: pa.Table) -> pa.Table:
        if not table.column("block")[0].is_valid:
            doc, tid, start, count = (C.unplanes(table.column(c), t) for c, t in zip(Pieces.COLUMNS[1:], Pieces.TYPES[1:], strict=True))
        else:
            t = findings_of(table)
            doc, tid, start, count = (t.column(c).to_numpy() for c in FOUND)
        batches = list(C.block_batches(((b, parts[1:]) for b, parts in pack_findings(doc, tid, start, count, blocks)), FOUND))
        empty = pa.table({"block": pa.array([], pa.int32()), **{c: pa.array([], pa.binary()) for c in FOUND}})
        return pa.concat_tables([empty, *(pa.Table.from_batches([b]) for b in batches)])

    schema = "block int, " + ", ".join(f"{c} binary" for c in FOUND)
    # A task's own findings are dealt by a number drawn from its rows, so that they spread like blocks do.
    spread = F.coalesce(F.col("block").cast("long"), -1 - F.pmod(F.xxhash64("doc"), F.lit(blocks)))
    return pieces.withColumn("grp", spread).groupBy("grp").applyInArrow(lambda key, table: shared(table.drop_columns(["grp"])), schema)


def spans_of(start: np.ndarray, count: np.ndarray) -> list[tuple[int, int]]:
    """Maximal removed byte runs of runs of windows."""
    spans: list[list[int]] = []
    for a, b in sorted(zip(start.tolist(), (start + count + SPAN - 1).tolist(), strict=True)):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    return [tuple(s) for s in spans]


def removals(docs: DataFrame, found: DataFrame, blocks: int) -> DataFrame:
    """(doc_id, sig, n_removed, n_spans, kept_sha256, kept) of the documents with findings."""
    ids = C.per_block(found, lambda t: pa.table({"doc": np.unique(C.unpack(t.column("doc"), np.int64))}), "doc long")
    ids = C.cut(ids)
    bits, size = C.membership(ids, "doc", ids.count())
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            some = pa.array(np.flatnonzero(C.passes(sent.value, size, doc)))
            block = C.to_block(C.mix(doc), blocks).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(block).take(some), batch.column(0).take(some), batch.column(1).take(some)], names=["block", "doc_id", "text"])

    moved = docs.where("doc_id is not null").mapInArrow(C.tidied(texts), "block int, doc_id long, text string")

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if len(left) and len(right):
            doc, tid, start, count = (C.unpack(right.column(c), t) for c, t in (("doc", np.int64), ("tid", np.uint32), ("start", np.uint32), ("count", np.uint32)))
            order = np.lexsort((tid, doc))
            doc, tid, start, count = doc[order], tid[order], start[order], count[order]
            for i, text in zip(left.column("doc_id").to_pylist(), left.column("text"), strict=True):
                a, b = np.searchsorted(doc, i, "left"), np.searchsorted(doc, i, "right")
                if a == b or not text.is_valid:
                    continue
                raw = text.as_buffer().to_pybytes()
                sig = hashlib.sha256(raw).digest()
                mine = np.flatnonzero(tid[a:b] == int.from_bytes(sig[:4], "little")) + a
                if len(mine):
                    spans = spans_of(start[mine], count[mine])
                    edges = [0, *(x for s in spans for x in s), len(raw)]
                    kept = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                    rows.append((i, sig, sum(y - x for x, y in spans), len(spans), hashlib.sha256(kept).hexdigest(), kept))
        kinds = [("doc_id", pa.int64()), ("sig", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]
        columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
        return pa.table({n: pa.array(c, t) for (n, t), c in zip(kinds, columns, strict=True)})

    return moved.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(remove, "doc_id long, sig binary, n_removed long, n_spans long, kept_sha256 string, kept binary")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per document; with ``full`` also the kept bytes of documents that lose some."""
    blocks = C.n_blocks(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = C.cut(describe(docs))
    same = C.cut(rows.where("doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    distinct, skip = searched(docs, copies_of(rows, same))
    repeated = C.cut(repeated_minimizers(minimizers(distinct, skip, blocks)))
    bits, size = C.membership(repeated, "minimizer", repeated.count())
    found = C.cut(findings(distinct, skip, bits, size, blocks))
    gone = removals(distinct, found, blocks).dropDuplicates(["doc_id", "sig"])
    placed = C.attach(rows, same, "sig", "copies", rows.count()).drop("copies")
    out = placed.join(gone if full else gone.drop("kept"), ["doc_id", "sig"], "left")
    whole = (F.col("doc_id") > F.col("least")) & (F.col("n_bytes") >= SPAN)
    columns = [
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sig")))).alias("kept_sha256"),
    ]
    if full:
        columns.append(F.when(whole, F.lit(b"")).otherwise(F.col("kept")).alias("kept"))
    return out.select(*columns)
