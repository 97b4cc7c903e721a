"""Exact n-gram Jaccard join in the metric space of word-shingle sets.

Two documents link when the Jaccard similarity of their sets of five-word shingles is at least 0.75,
a Jaccard distance of at most 0.25.  The join is exact and runs in these steps:

1. Documents with equal sets form one class; only classes go on.
2. Shingles are put in one global order: rare ones, then those of ``FREQUENT`` classes or more, then *hot* ones, of ``HOT``
   or more.  If two sets link, the first shingle that they share lies in the first ``n - ceil(0.75 n) + 1`` of each
   and in the first ``n - ceil(6/7 n) + 1`` of the smaller; and the first ``n - ceil(0.75 n) + SHARED`` of each have at
   least ``SHARED`` in common.  So shingles that are not hot meet in blocks of the hash space and count for
   each pair of their classes, and a pair needs ``SHARED`` less its hot ones.  Only sets whose first part reaches
   hot shingles meet by those: of a template that makes up less than three quarters of a page nothing is sent.
3. A hot shingle makes its least class a *pivot* and the others members of its Voronoi region, so that no large
   group gives all its pairs.  A region is joined by
   distances to its pivot: whoever is within 0.25 links.  By the triangle inequality a member at
   distance d only links with others in the window [d - 0.25, d + 0.25]; boundary documents whose
   window reaches beyond the pivot's ball stay with those outside, which are joined recursively with a pivot of their own.
4. A region of over ``REGION`` classes is dealt out in chunks that each get the pivot and are joined
   alike; classes that are not connected with the pivot then are joined, chunk by chunk, with all in their window.
5. The links' components are found by star contraction.

Defined cases: a null or blank text has an empty set and is linked with nothing.  Fewer than five words
make one shingle of all.  Rows with a null id are returned with a null component and take no part.
Each row is a document of its own, also where ids repeat.  Other columns are ignored (``keep_one`` hands them on).  An empty table gives no rows.
Shingles are 64-bit hashes; equal hashes within a pair of sets are taken as equal shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WIDTH, LIKE, SHARED = 5, 75, 4
SMALL_LIST, REGION, FREQUENT, HOT = 64, 256, 4, 64
FEW_REGIONS = 100_000  # rows of two numbers that may be broadcast: 2 MB
# Low bits of a posted id: least count less one, a set too small for counts, a hot shingle, one in the first part of a smaller set.
NEED, TINY, BY_HOT, FIRST, FLAGS = (np.uint64(x) for x in (3, 4, 8, 16, 31))


def set_id(shingles: np.ndarray) -> tuple[bytes, int]:
    """(128-bit name of a set, its 64-bit id with the bits of ``FLAGS`` empty)."""
    name = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return name, int.from_bytes(name[:8], "little") & ~int(FLAGS)


def sets_of(column: pa.Array) -> Iterator[np.ndarray]:
    for _, _, data, at in C.chunks(column):
        yield from C.shingles(*C.words(data, at), WIDTH)


def describe(docs: DataFrame, blocks: int) -> DataFrame:
    """Rows of documents (doc_id, n, sig, id) and, apart, packed counts (block, keys, counts) of shingles that a task sees in two sets or more."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("id", pa.int64()), ("block", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
        seen: set[bytes] = set()
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts > 1
            for block, (k, c) in C.packed(blocks, keys[often], counts[often].astype(np.int64)):
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([block], pa.int32()), pa.array([k], pa.binary()), pa.array([c], pa.binary())], schema=schema)

        for batch in batches:
            ns, sigs, ids = [], [], []
            for s in sets_of(batch.column(1)):
                ns.append(len(s))
                if not len(s):
                    sigs.append(None)
                    ids.append(None)
                    continue
                name, low = set_id(s)
                sigs.append(name)
                ids.append(np.uint64(low).view(np.int64).item())
                if name not in seen:
                    seen.add(name)
                    held.append(s)
                    size += len(s)
                    if size > 2 * C.FLUSH_ENTRIES:
                        yield from flush()
                        held.clear()
                        size = 0
            k = len(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(sigs, pa.binary()), pa.array(ids, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())], schema=schema)
        if held:
            yield from flush()

    return docs.mapInArrow(C.tidied(work), "doc_id long, n long, sig binary, id long, block int, keys binary, counts binary")


def frequent_shingles(described: DataFrame) -> DataFrame:
    """(shingle, n) of the shingles counted ``FREQUENT`` times or more in tasks that saw them twice."""

    def merge(table: pa.Table) -> pa.Table:
        keys, counts = C.sum_by_key(C.unpack(table.column("keys"), np.uint64), C.unpack(table.column("counts"), np.int64))
        often = counts >= FREQUENT
        return pa.table({"shingle": keys[often].view(np.int64), "n": counts[often]})

    return C.per_block(described.where("block is not null").select("block", "keys", "counts"), merge, "shingle long, n long")


def prefix(shingles: np.ndarray, often: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingles that a set is posted under, their flags), by the global order: rare, ``often``, ``hot``, each by hash."""
    n = len(shingles)
    least = -(-LIKE * n // 100)
    longest, first, smaller = min(n, n - least + SHARED), n - least + 1, n - -(-2 * LIKE * n // (100 + LIKE)) + 1
    ordered = np.concatenate([shingles[~often & ~hot], shingles[often & ~hot], shingles[hot]]) if often.any() or hot.any() else shingles
    calm = n - int(hot.sum())
    base = min(max(SHARED - max(0, longest - calm), 1), SHARED) - 1 | (int(TINY) if n < 2 * SHARED + 1 else 0)
    flags = np.full(min(longest, calm), base, np.uint64)
    if calm >= first:
        return ordered[: len(flags)], flags
    by_hot = np.full(first - calm, BY_HOT, np.uint64)
    by_hot[: max(0, smaller - calm)] |= FIRST
    return ordered[:first], np.concatenate([flags, by_hot])


def postings(docs: DataFrame, often: tuple[np.ndarray, int], hot: tuple[np.ndarray, int], blocks: int) -> DataFrame:
    """Packed (shingle, class with flags) of the prefixes of each task's distinct sets."""
    sent = docs.sparkSession.sparkContext.broadcast((often, hot))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            seen: set[bytes] = set()
            keys, ids, held = [], [], 0

            def flush():
                k, i = np.concatenate(keys), np.concatenate(ids)
                order = np.argsort(k, kind="stable")
                yield from C.packed(blocks, k[order], i[order])

            for batch in batches:
                for s in sets_of(batch.column(1)):
                    if not len(s):
                        continue
                    name, low = set_id(s)
                    if name in seen:
                        continue
                    seen.add(name)
                    often = C.passes(*sent.value[0], s)
                    top = often.copy()
                    top[often] = C.passes(*sent.value[1], s[often])
                    p, flags = prefix(s, often, top)
                    # Prefixes hold small hashes; mixed again they spread evenly over blocks.
                    keys.append(C.mix(~p))
                    ids.append(np.uint64(low) | flags)
                    held += len(p)
                    if held > C.FLUSH_ENTRIES:
                        yield from flush()
                        keys, ids, held = [], [], 0
            if keys:
                yield from flush()

        yield from C.block_batches(rows(), ["keys", "ids"])

    return docs.where("doc_id is not null").mapInArrow(C.tidied(work), "block int, keys binary, ids binary")


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal sorted keys."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return starts, np.diff(np.append(starts, len(keys)))


def meet(table: pa.Table, blocks: int) -> Iterator[tuple[int, list[bytes]]]:
    """Packed pairs (pivot, other, shared) of the classes that meet in one block; ``shared`` counts up to ``SHARED``, from what the pair needs less."""
    keys, ids = C.unpack(table.column("keys"), np.uint64), C.unpack(table.column("ids"), np.uint64)
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
    keys, ids = keys[fresh], ids[fresh]
    starts, lengths = runs(keys)
    # Under a hot shingle only those pairs meet of which one has it in the first part of a smaller set.
    by_hot = (ids[starts] & BY_HOT) > 0 if len(keys) else np.zeros(0, bool)
    reached = np.add.reduceat(((ids & FIRST) > 0).astype(np.int64), starts) > 0 if len(keys) else by_hot
    wanted = ~by_hot | reached
    left, right, shared = [], [], []

    def add(a: np.ndarray, b: np.ndarray, certain: bool) -> None:
        enough = certain | (((a | b) & TINY) > 0) | ((a & BY_HOT) > 0)
        need = np.maximum(a & NEED, b & NEED).astype(np.uint8) + 1
        left.append(a & ~FLAGS)
        right.append(b & ~FLAGS)
        shared.append(np.where(enough, SHARED, 1).astype(np.uint8) | (need << 4))

    large = (lengths > SMALL_LIST) & wanted
    if large.any():
        add(np.repeat(ids[starts[large]], lengths[large]), ids[np.repeat(large, lengths)], True)
    for n in range(2, SMALL_LIST + 1):
        rows = starts[(lengths == n) & wanted]
        if len(rows):
            grid = ids[rows[:, None] + np.arange(n)[None, :]]
            x, y = np.triu_indices(n, 1)
            a, b = grid[:, x].ravel(), grid[:, y].ravel()
            some = ((a & BY_HOT) == 0) | (((a | b) & FIRST) > 0)
            add(a[some], b[some], False)
    if left:
        a, b, c = np.concatenate(left), np.concatenate(right), np.concatenate(shared)
        keep = a != b
        yield from _by_pair(a[keep], b[keep], c[keep], blocks)


def _sum_pairs(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs; of ``c`` the counts (low four bits) are added, up to ``SHARED``, and the largest need (high bits) stays."""
    order = np.lexsort((b, a))
    a, b, c = a[order], b[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    count = np.minimum(np.add.reduceat((c & 15).astype(np.int64), first), SHARED).astype(np.uint8)
    return a[first], b[first], count | (np.maximum.reduceat(c >> 4, first) << 4)


def _by_pair(a, b, c, blocks):
    if len(a):
        a, b, c = _sum_pairs(a, b, c)
        key = C.mix(a * np.uint64(0x9FB21C651E98DF25) + b)
        order = np.argsort(key)
        yield from C.packed(blocks, key[order], a[order], b[order], c[order])


def region_members(posted: DataFrame, blocks: int) -> DataFrame:
    """(p, x): class x is in the region of pivot p (ids)."""

    def lists(table: pa.Table) -> Iterator[pa.Table]:
        for batch in C.block_batches(((b, parts[1:]) for b, parts in meet(table, blocks)), ["a", "b", "c"]):
            yield pa.Table.from_batches([batch])

    def total(table: pa.Table) -> pa.Table:
        a, b, c = C.unpack(table.column("a"), np.uint64), C.unpack(table.column("b"), np.uint64), C.unpack(table.column("c"), np.uint8)
        if len(a):
            a, b, c = _sum_pairs(a, b, c)
        keep = (c & 15) >= (c >> 4)
        return pa.table({"p": a[keep].view(np.int64), "x": b[keep].view(np.int64)})

    def whole(table: pa.Table) -> pa.Table:
        return pa.concat_tables([*lists(table), pa.table({"block": pa.array([], pa.int32()), "a": pa.array([], pa.binary()), "b": pa.array([], pa.binary()), "c": pa.array([], pa.binary())})])

    met = C.per_block(posted, whole, "block int, a binary, b binary, c binary")
    return C.per_block(met, total, "p long, x long")


def fetch_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, sig, items): the sets of the documents that may be in ``wanted`` (rep)."""
    bits, size = C.membership(wanted, "rep", wanted.count())
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = pa.array(np.flatnonzero(C.passes(sent.value, size, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))))
            ids, texts = batch.column(0).take(some), batch.column(1).take(some)
            for lo in range(0, len(ids), 256):
                sets = list(sets_of(texts.slice(lo, 256)))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, 256), pa.array([set_id(s)[0] if len(s) else None for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "sig", "items"])

    return docs.where("doc_id is not null").mapInArrow(C.tidied(work), "rep long, sig binary, items binary")


class Region:
    """Sets with the test of one against the others."""

    def __init__(self, ids: np.ndarray, items: list[bytes]):
        self.ids = ids
        self.sets = [np.frombuffer(x, np.uint64) for x in items]
        self.n = np.array([len(s) for s in self.sets])

    def against(self, pivot: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(linked, distance) of each of ``others`` to the pivot, by exact counts."""
        mine = self.sets[pivot]
        both = np.concatenate([self.sets[i] for i in others])
        at = np.minimum(np.searchsorted(mine, both), len(mine) - 1)
        n = self.n[others]
        shared = np.add.reduceat((mine[at] == both).astype(np.int64), np.cumsum(n) - n)
        union = len(mine) + n - shared
        return 100 * shared >= LIKE * union, 1 - shared / union

    def join(self, first: int, joined: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Links that connect all that link, the pivot ``first`` first; ``joined`` marks members known to be connected."""
        root = np.arange(len(self.ids))
        if joined is not None and joined.any():
            root[joined] = np.flatnonzero(joined)[0]
        links = []
        active = np.concatenate([[first], np.delete(np.arange(len(self.ids)), first)])
        window = 1 - LIKE / 100 + 1e-9
        while len(active) > 1 and len(np.unique(root[active])) > 1:
            pivot, others = active[0], active[1:]
            linked, d = self.against(pivot, others)
            for i in others[linked].tolist():
                if root[i] != root[pivot]:
                    links.append((int(self.ids[pivot]), int(self.ids[i])))
                    root[root == root[i]] = root[pivot]
            far = others[~linked]
            if not len(far):
                break
            near = others[linked][d[linked] + window >= d[~linked].min()]
            active = np.concatenate([far, near])
        return links


def _regions(table: pa.Table):
    """(pivot, chunk, rows) of each region in a table."""
    table = table.sort_by([("p", "ascending"), ("chunk", "ascending"), ("node", "ascending")])
    p, chunk = table.column("p").to_numpy(), table.column("chunk").to_numpy()
    if len(p):
        cuts = np.flatnonzero((np.diff(p) != 0) | (np.diff(chunk) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(p)], strict=True):
            yield int(p[a]), int(chunk[a]), table.slice(a, b - a)


def _distinct(rows: pa.Table) -> pa.Table:
    nodes = rows.column("node").to_numpy()
    return rows.take(pa.array(np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]]))))


def solve(table: pa.Table) -> pa.Table:
    """Links (a, b) within regions, or within the chunks of large ones; for those also (p, a, pivot b, distance d)."""
    out: list[tuple] = []
    for p, _, rows in _regions(table):
        large = rows.column("m")[0].as_py() > REGION
        rows = _distinct(rows)
        nodes = rows.column("node").to_numpy()
        if len(nodes) < 2:
            continue
        region = Region(nodes, rows.column("items").to_pylist())
        own = np.flatnonzero(rows.column("x").to_numpy() == p)
        pivot = int(own[0]) if len(own) else 0
        out += [(None, a, b, None) for a, b in region.join(pivot)]
        if large:
            others = np.delete(np.arange(len(nodes)), pivot)
            _, d = region.against(pivot, others)
            out += zip([p] * len(others), nodes[others].tolist(), [int(nodes[pivot])] * len(others), d.tolist(), strict=True)
    columns = list(zip(*out, strict=True)) or [[]] * 4
    kinds = [("p", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("d", pa.float64())]
    return pa.table({n: pa.array(c, t) for (n, t), c in zip(kinds, columns, strict=True)})


def join_chunks(table: pa.Table) -> pa.Table:
    """Links between the chunks that meet here; ``joined`` marks those known to be connected with the pivot."""
    links = []
    for _, _, rows in _regions(table):
        rows = _distinct(rows)
        region = Region(rows.column("node").to_numpy(), rows.column("items").to_pylist())
        joined = rows.column("joined").to_numpy(zero_copy_only=False).astype(bool)
        apart = np.flatnonzero(~joined)
        if len(apart):
            links += region.join(int(apart[0]), joined)
    return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})


def links_of(docs: DataFrame, members: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, component) of the classes that have links."""
    total = members.count()
    batches = max(C.n_blocks(docs.sparkSession), -(-2 * total // 4096))
    columns = ["p", "x", "node", "items", "chunk", "m"]
    sizes = C.cut(members.groupBy("p").agg(F.count(F.lit(1)).alias("m")))
    large = sizes.where(F.col("m") > REGION)
    few = large.count() <= FEW_REGIONS
    rows = members.join(F.broadcast(large) if few else large, "p", "left").unionByName(sizes.select("p", F.col("p").alias("x"), "m"))
    named = C.cut(rows.withColumn("m", F.coalesce("m", F.lit(1))).join(classes.select(F.col("id").alias("x"), "node", "rep", "sig"), "x"))
    full = named.join(fetch_sets(docs, named.select("rep").distinct()), ["rep", "sig"])
    chunks = F.greatest(F.lit(1), F.ceil(F.col("m") / REGION)).cast("int")
    each = F.when(F.col("x") == F.col("p"), F.sequence(F.lit(0), chunks - 1)).otherwise(F.array(F.pmod(F.xxhash64("x"), chunks).cast("int")))
    placed = full.withColumn("chunk", F.explode(each)).withColumn("grp", F.pmod(F.xxhash64("p", "chunk"), F.lit(batches)))
    solved = C.cut(placed.select("grp", *columns).groupBy("grp").applyInArrow(solve, "p long, a long, b long, d double"))
    links = solved.where("p is null").select("a", "b")
    labels = C.components(links)
    measured = solved.where("p is not null").select("p", F.col("a").alias("node"), F.col("b").alias("pivot"), "d")
    if measured.isEmpty():
        return labels
    # Between the chunks of a large region: whoever is not connected with the pivot yet, against all in reach.
    mine = labels.select("node", F.col("component").alias("own"))
    pivots = labels.select(F.col("node").alias("pivot"), F.col("component").alias("theirs"))
    state = measured.join(mine, "node", "left").join(pivots, "pivot", "left")
    state = C.cut(state.withColumn("joined", F.coalesce("own", "node") == F.coalesce("theirs", "pivot")).select("p", "node", "d", "joined"))
    least = C.cut(state.where(~F.col("joined")).groupBy("p").agg(F.min("d").alias("least")))
    n = least.count()
    if n == 0:
        return labels
    rest = state.join(F.broadcast(least) if n <= FEW_REGIONS else least, "p").where(~F.col("joined") | (F.col("d") + (1 - LIKE / 100 + 1e-9) >= F.col("least")))
    rest = C.cut(rest.select("p", "node", "joined").join(classes.select("node", F.col("id").alias("x"), "rep", "sig"), "node"))
    left = rest.groupBy("p").agg(F.count(F.lit(1)).alias("m"))
    again = rest.join(F.broadcast(left) if n <= FEW_REGIONS else left, "p")
    parts = F.ceil(F.col("m") / REGION).cast("int")
    at = F.pmod(F.xxhash64("x"), parts).cast("int")
    # chunk i meets chunk j in the group i * parts + j with i <= j
    pairs = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.least(at, j) * parts + F.greatest(at, j))
    again = again.join(fetch_sets(docs, rest.select("rep").distinct()), ["rep", "sig"]).withColumn("chunk", F.explode(pairs))
    again = again.withColumn("grp", F.pmod(F.xxhash64("p", "chunk"), F.lit(batches)))
    more = again.select("grp", *columns, "joined").groupBy("grp").applyInArrow(join_chunks, "a long, b long")
    return C.components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))


def _classified(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(rows (doc_id, n, sig), classes (sig, node, rep, copies, component, first), number of rows).

    ``component`` is the least node that a class reaches, ``first`` the least doc_id in its component.
    """
    blocks = C.n_blocks_of(docs)
    described = C.cut(describe(docs, blocks))
    rows = described.where("block is null").select("doc_id", "n", "sig", "id").withColumn("sig", F.when(F.col("doc_id").isNotNull(), F.col("sig")))
    frequent = C.cut(frequent_shingles(described))
    hot = frequent.where(F.col("n") >= HOT)
    often = C.membership(frequent, "shingle", frequent.count()), C.membership(hot, "shingle", hot.count())
    classes = rows.where("sig is not null").groupBy("sig", "id").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = C.cut(classes.withColumn("node", F.monotonically_increasing_id()))  # written once, so numbers stay
    members = C.cut(region_members(postings(docs, *often, blocks), blocks))
    labels = links_of(docs, members, classes)
    named = classes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    linked = named.where("component <> node").select("component").distinct()
    firsts = named.join(linked, "component", "left_semi").groupBy("component").agg(F.min("rep").alias("first"))
    return rows, C.cut(named.join(firsts, "component", "left").withColumn("first", F.coalesce("first", "rep"))), rows.count()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) per document."""
    rows, named, total = _classified(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    out = C.attach(rows, named.select("sig", "copies", F.col("first").alias("component")), "sig", "copies", total)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, of which each component keeps the one with the least id; documents without an id or words stay.

    Rows are told apart by id and set, so a row whose id is repeated goes only if its own text does; of rows that repeat both, one
    stays.  Of classes that share the least id, that of the least node stays.  Only rows whose id may occur in a component of two rows or
    more are shuffled.
    """
    rows, named, total = _classified(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    grouped = named.where("component <> node or copies > 1").select("component").distinct()
    several = named.join(grouped, "component", "left_semi")
    best = several.where("rep = first").groupBy("component").agg(F.min("node").alias("best"))
    several = C.cut(several.join(best, "component").select("sig", "copies", F.when(F.col("node") == F.col("best"), F.col("rep")).alias("keep")))
    found = C.attach(rows.where("sig is not null").select("doc_id", "sig"), several, "sig", "copies", total).where("copies is not null")
    found = C.cut(found.select("doc_id", "sig", F.coalesce(F.col("doc_id") == F.col("keep"), F.lit(False)).alias("stays")).distinct())
    sent = docs.sparkSession.sparkContext.broadcast(C.membership(found, "doc_id", found.count()))

    def suspect(ids: pa.Array) -> pa.Array:
        return pa.array(C.passes(*sent.value, ids.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)) & ids.is_valid().to_numpy(zero_copy_only=False))

    def name(texts: pa.Array) -> pa.Array:
        return pa.array([set_id(s)[0] if len(s) else None for s in sets_of(texts)], pa.binary())

    number, sig, stays, key = (C.unused(label, docs) for label in ("number", "sig", "stays", "key"))
    marked = docs.withColumn(number, F.col("doc_id").cast("long"))
    maybe = F.arrow_udf(suspect, "boolean")(F.col(number))
    some = marked.where(maybe).withColumn(sig, F.arrow_udf(name, "binary").asNondeterministic()(F.col("text").cast("string")))
    some = some.join(found.select(F.col("doc_id").alias(number), F.col("sig").alias(sig), F.col("stays").alias(stays)), [number, sig], "left")
    some = some.where(F.coalesce(F.col(stays), F.lit(True)))
    # a row of no group is alone, whatever it looks like
    some = some.withColumn(key, F.when(F.col(stays), F.hex(sig)).otherwise(F.concat(F.lit("row "), F.monotonically_increasing_id())))
    return marked.where(~maybe).select(*docs.columns).unionByName(some.dropDuplicates([number, key]).select(*docs.columns))
