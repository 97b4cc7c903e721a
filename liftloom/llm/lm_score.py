"""Language-model scores from a weighted backoff automaton.

The model is a smoothed trigram model learnt from the training documents.  The states of the automaton are the
seen contexts: two tokens, one token, the begin of a text, and the root.  A state has an arc for each
seen continuation and a failure arc to the state of the next shorter context; the root has an arc for every token.  A text is scored
in one left-to-right traversal that carries the state: follow the arc of the next token, or take failure arcs until a
state has one, and add up the log-probabilities.

With c counts, N tokens and V distinct tokens in training, and h' the context h without its first token:
    p(w)     = (c(w) + 1) / (N + V + 1)                       at the root
    m(h)     = MASS * c(h) ** GROWTH                          what a context leaves to h'
    p(w | h) = (c(h, w) + m(h) * p(w | h')) / (c(h) + m(h))   the arc, if c(h, w) > 0
    fail(h)  = m(h) / (c(h) + m(h))
so the probabilities of all tokens after a context sum to 1.

The automaton of the whole corpus fits no single task, so each part of the documents (about ``PART_BYTES`` of text)
gets the slice that its own texts can reach: a part sends its distinct n-grams, with its training counts, to blocks of the
hash space; a block adds the counts up and answers every part.  No hot word or n-gram weighs more than one entry
for a part.  Tokens and bigrams go first.  A trigram is only asked for where other parts hold both of its bigrams: if
one of them is in no other part, the part's own count of the trigram is the whole.
All counts are exact 64-bit sums over 64-bit hashes; on the way they take as many bytes as the largest needs, and keys are
sent as differences.

Defined cases: a null text is empty; an empty text is the end token alone.  A null id counts as the
empty string for the fold and passes through.  Repeated rows count and are scored each.  Other
columns are ignored.  An empty table gives no rows; without training rows every token is unknown.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BEGIN, END = np.uint64(0x5BD1E995C0FFEE01), np.uint64(0x27D4EB2F165667C5)
MASS, GROWTH = 5.0, 0.75
PART_BYTES = 1 << 23
HELD_OUT_FOLD, FOLDS = 2, 7


class Tokens:
    """Token hashes of a table of texts, text after text with an end token after each."""

    def __init__(self, texts: pa.ChunkedArray | pa.Array):
        hashes, first = [], [np.zeros(1, np.int64)]
        base = 0
        for _, _, data, at in C.chunks(texts):
            h, f = C.words(data, at)
            n = len(f) - 1
            out = np.empty(len(h) + n, np.uint64)
            ends = f[1:] + np.arange(n)
            inside = np.ones(len(out), bool)
            inside[ends] = False
            out[inside], out[ends] = h, END
            hashes.append(out)
            first.append(base + ends + 1)
            base += len(out)
        self.seq = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.first = np.concatenate(first)

    def ngrams(self) -> list[np.ndarray]:
        """Hashes of the token, bigram and trigram that end at each place; the first token of a text follows ``BEGIN``, and its trigram is its bigram."""
        before = np.empty_like(self.seq)
        before[1:] = self.seq[:-1]
        before[self.first[:-1]] = BEGIN
        two = C.mix(before * np.uint64(0x9FB21C651E98DF25) + self.seq)
        three = np.empty_like(two)
        three[1:] = C.mix(two[:-1] * np.uint64(0xD6E8FEB86659FD93) + self.seq[1:])
        three[self.first[:-1]] = two[self.first[:-1]]
        return [self.seq, two, three]

    def spread(self, per_text: np.ndarray) -> np.ndarray:
        return np.repeat(per_text, np.diff(self.first))


def folded(docs: DataFrame) -> DataFrame:
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(FOLDS)) == HELD_OUT_FOLD
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held.alias("held_out"))


def totals(docs: DataFrame, blocks: int) -> tuple[int, int]:
    """(tokens, distinct tokens) of the training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            for batch in batches:
                for lo in range(0, len(batch), 256):
                    k, n = np.unique(Tokens(batch.column(0).slice(lo, 256)).seq, return_counts=True)
                    keys, counts = np.concatenate([keys, k]), np.concatenate([counts, n])
                    if len(keys) > 2 * C.FLUSH_ENTRIES:
                        keys, counts = C.sum_by_key(keys, counts)
                        if len(keys) > C.FLUSH_ENTRIES:
                            yield from C.packed(blocks, keys, counts, form=C.planes)
                            keys, counts = keys[:0], counts[:0]
            yield from C.packed(blocks, *C.sum_by_key(keys, counts), form=C.planes)

        yield from C.block_batches(rows(), ["keys", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        keys, counts = C.sum_by_key(C.unplanes(table.column("keys"), np.uint64), C.unplanes(table.column("counts"), np.int64))
        return pa.table({"n": pa.array([int(counts.sum())], pa.int64()), "v": pa.array([len(keys)], pa.int64())})

    packed = docs.where("not held_out").select("text").mapInArrow(C.tidied(count), "block int, keys binary, counts binary")
    row = C.per_block(packed, merge, "n long, v long").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    return int(row.n or 0), int(row.v or 0)


class Automaton:
    """The slice of the backoff automaton that a part's texts can reach.

    States: 0 the root, 1 the begin of a text, then one for each token and each bigram of the slice (used where it was
    seen).  ``kinds`` names the token, bigram and trigram at each place of the texts, by their numbers in the slice.
    """

    def __init__(self, kinds: list[np.ndarray], starts: np.ndarray, counts: list[np.ndarray], n: int, v: int, begins: int):
        one, two, three = counts
        token, pair, triple = kinds
        self.seen = [two > 0, three > 0]
        self.first_pair = 2 + len(one)
        contexts = np.concatenate([[0, begins], one, two]).astype(float)
        left = MASS * contexts**GROWTH
        with np.errstate(divide="ignore", invalid="ignore"):
            self.fail_log = np.where(contexts > 0, np.log10(left / (contexts + left)), 0.0)  # an unseen context costs nothing
        self.fail = np.zeros(len(contexts), np.int64)
        self.fail[self.first_pair + pair] = 2 + token  # the state of a pair fails to that of its second token
        # arcs of the root, of single tokens and of pairs: probabilities by token, pair and triple
        root = (one + 1) / (n + v + 1)
        context = self._before(2 + token, starts, 1)
        lower = root[token]
        arcs = [root]
        for number, count in ((pair, two), (triple, three)):
            p = np.zeros(len(count))
            p[number] = (count[number] + left[context] * lower) / np.maximum(contexts[context] + left[context], 1e-300)
            arcs.append(p)
            context, lower = self._before(self.first_pair + pair, starts, 1), p[number]
        self.root_log = np.log10(root)
        with np.errstate(divide="ignore"):
            self.arc_log = [np.log10(arcs[1]), np.log10(arcs[2])]
        # The state that the traversal is in after a token: the longest seen context that ends there, whatever came before,
        # as an arc or a failure leads there from any state.  So the states of all steps are known at once.
        after = np.where(self.seen[0][pair], self.first_pair + pair, np.where(one[token] > 0, 2 + token, 0))
        self.states = self._before(after, starts, 1)
        self.fail[1] = 0
        self.known = one > 0

    @staticmethod
    def _before(states: np.ndarray, starts: np.ndarray, begin: int) -> np.ndarray:
        """The state before each token: that after the one before it, at the start of a text the state ``begin``."""
        out = np.empty_like(states)
        out[1:] = states[:-1]
        out[starts] = begin
        return out

    def traverse(self, kinds: list[np.ndarray], starts: np.ndarray) -> np.ndarray:
        """Log-probability of each token: the arc of its state, or failure arcs first."""
        token, pair, triple = kinds
        out, state = np.zeros(len(token)), self.states.copy()
        todo = np.arange(len(token))
        while len(todo):
            s = state[todo]
            of_pair, of_one = s >= self.first_pair, (s > 0) & (s < self.first_pair)
            found = s == 0
            found[of_pair] = self.seen[1][triple[todo[of_pair]]]
            found[of_one] = self.seen[0][pair[todo[of_one]]]
            for mask, table, number in ((of_pair & found, self.arc_log[1], triple), (of_one & found, self.arc_log[0], pair), (s == 0, self.root_log, token)):
                out[todo[mask]] += table[number[todo[mask]]]
            todo, s = todo[~found], s[~found]
            out[todo] += self.fail_log[s]
            state[todo] = self.fail[s]
        return out


def narrow(x: np.ndarray) -> bytes:
    """The byte planes of non-negative integers, as many as the largest needs, compressed."""
    x = x.astype(np.uint64)
    width = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
    data = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), 8)[:, :width].T).tobytes()
    return np.array([len(x), width], np.int64).tobytes() + pa.compress(data, codec="zstd", asbytes=True)


def widen(data: memoryview) -> np.ndarray:
    """What ``narrow`` made, as unsigned 64-bit integers."""
    n, width = np.frombuffer(data[:16], np.int64).tolist()
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(pa.decompress(data[16:], decompressed_size=n * width, codec="zstd"), np.uint8).reshape(width, n).T
    return out.view(np.uint64).ravel()


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [widen(memoryview(x.as_buffer())) if x.is_valid else np.zeros(0, np.uint64) for x in column]


def parted(docs: DataFrame, part_bytes: int) -> DataFrame:
    """(part, rows binary): the rows of each task in parts of about ``part_bytes`` of text, compressed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def part() -> pa.RecordBatch:
            out = pa.BufferOutputStream()
            table = pa.Table.from_batches(held)
            with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_table(table)
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | count], pa.int64()), pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["part", "rows"])

        for batch in batches:
            _, at = C.string_parts(batch.column(1))
            for lo, hi in C.slices(at, part_bytes // 8):
                held.append(batch.slice(lo, hi - lo))
                size += int(at[hi] - at[lo]) + 16 * (hi - lo)
                if size >= part_bytes:
                    yield part()
                    held, size, count = [], 0, count + 1
        if held:
            yield part()

    return docs.mapInArrow(C.tidied(work), "part long, rows binary")


class Part:
    """The n-grams of the texts of a part."""

    def __init__(self, rows: pa.Scalar):
        self.table = pa.ipc.open_stream(rows.as_buffer()).read_all()
        self.tokens = Tokens(self.table.column(1))
        self.starts = self.tokens.first[:-1]
        self.train = self.tokens.spread(~self.table.column(2).to_numpy(zero_copy_only=False).astype(bool))
        self.keys, self.kinds, self.places = [], [], []
        for values in self.tokens.ngrams():
            keys, place, at = np.unique(values, return_index=True, return_inverse=True)
            self.keys.append(keys)
            self.places.append(place)
            self.kinds.append(at)

    def own(self, kind: int) -> np.ndarray:
        """The counts of each n-gram in this part's training texts."""
        return np.bincount(self.kinds[kind][self.train], minlength=len(self.keys[kind]))

    def shared(self, elsewhere: np.ndarray) -> np.ndarray:
        """Which trigrams may occur in other parts, given whether each bigram does."""
        here = elsewhere[self.kinds[1]]
        both = np.zeros(len(here), bool)
        both[1:] = here[1:] & here[:-1]
        both[self.starts] = False
        return both[self.places[2]]


def requests(part: int, asked: dict[int, tuple[np.ndarray, np.ndarray]], blocks: int) -> pa.Table:
    """Rows (block, part, keys and counts of each kind) for sorted n-grams with counts, by kind."""
    sent: dict[int, list] = {}
    for k, (keys, counts) in enumerate(asked.values()):
        cuts = np.searchsorted(C.to_block(keys, blocks), np.arange(blocks + 1, dtype=np.uint64))
        for block in np.flatnonzero(np.diff(cuts)).tolist():
            some = slice(cuts[block], cuts[block + 1])
            row = sent.setdefault(block, [None] * 2 * len(asked))
            row[2 * k], row[2 * k + 1] = narrow(np.diff(keys[some], prepend=np.uint64(0))), narrow(counts[some])
    names = ["block", "part", *(f"{x}{kind}" for kind in asked for x in ("keys", "counts"))]
    columns = list(zip(*((block, part, *row) for block, row in sent.items()), strict=True)) or [()] * len(names)
    return pa.table([pa.array(c, t) for c, t in zip(columns, [pa.int32(), pa.int64(), *[pa.binary()] * 2 * len(asked)], strict=True)], names=names)


def answered(asked: DataFrame, kinds: tuple[int, ...]) -> DataFrame:
    """(part, block, counts of each kind): for the n-grams that each part asked for, in its order, twice the sum over all parts, and one more if several parts asked."""

    def answer(table: pa.Table) -> pa.Table:
        out = [table.column("part"), table.column("block")]
        for kind in kinds:
            keys = [np.cumsum(x, dtype=np.uint64) for x in _arrays(table.column(f"keys{kind}"))]
            counts = np.concatenate(_arrays(table.column(f"counts{kind}"))).astype(np.int64)
            every = np.concatenate(keys)
            order = np.argsort(every, kind="stable")
            every, counts = every[order], counts[order]
            fresh = np.ones(len(every), bool)
            fresh[1:] = every[1:] != every[:-1]
            sums = np.zeros(len(every), np.int64)
            if len(every):
                starts = np.flatnonzero(fresh)
                holders = np.diff(np.append(starts, len(every)))
                sums[order] = (2 * np.add.reduceat(counts, starts) + (holders > 1))[np.cumsum(fresh) - 1]
            ends = np.cumsum([len(x) for x in keys])
            out.append(pa.array([narrow(sums[e - len(x) : e]) for x, e in zip(keys, ends.tolist(), strict=True)], pa.binary()))
        return pa.table(out, names=["part", "block", *(f"counts{kind}" for kind in kinds)])

    return C.per_block(asked, answer, "part long, block int, " + ", ".join(f"counts{kind} binary" for kind in kinds))


def lm_scores(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per document."""
    docs = folded(docs)
    blocks = C.n_blocks_of(docs)
    with C.freed(docs.sparkSession):
        n, v = totals(docs, blocks)
        begins = docs.where(~F.col("held_out")).count()
    # Written once, so that the uses below see the same parts whatever executors are lost.
    parts = C.cut(parted(docs, part_bytes))

    def counts_of(answers: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """(count, whether other parts hold it) of each n-gram that was asked for."""
        both = np.concatenate([*_arrays(answers.column(f"counts{kind}")), np.zeros(0, np.uint64)]).astype(np.int64)
        return both >> 1, both & 1 == 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = Part(rows)
                yield from requests(number, {k + 1: (part.keys[k], part.own(k)) for k in (0, 1)}, blocks).to_batches()

    def ask_shared(texts: pa.Table, answers: pa.Table) -> pa.Table:
        part = Part(texts.column("rows")[0])
        some = part.shared(counts_of(answers.sort_by("block"), 2)[1])
        return requests(texts.column("part")[0].as_py(), {3: (part.keys[2][some], part.own(2)[some])}, blocks)

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        part = Part(texts.column("rows")[0])
        answers = answers.sort_by("block")
        pairs, elsewhere = counts_of(answers, 2)
        counts = [counts_of(answers, 1)[0], pairs, part.own(2)]
        counts[2][part.shared(elsewhere)] = counts_of(answers, 3)[0]
        machine = Automaton(part.kinds, part.starts, counts, n, v, begins)
        log_p = machine.traverse(part.kinds, part.starts)
        table, token = part.table, part.kinds[0]
        C.trim()
        return pa.table({
            "doc_id": table.column(0), "held_out": table.column(2), "n_tokens": pa.array(np.diff(part.tokens.first)),
            "n_known": pa.array(np.add.reduceat(machine.known[token].astype(np.int64), part.starts)), "train_tokens": pa.array(np.full(len(table), n, np.int64)),
            "base_score": pa.array(np.add.reduceat(machine.root_log[token], part.starts)), "score": pa.array(np.add.reduceat(log_p, part.starts)),
        })

    asked = parts.mapInArrow(C.tidied(ask), "block int, part long, keys1 binary, counts1 binary, keys2 binary, counts2 binary")
    first = C.cut(answered(asked, (1, 2)), free=True)  # frees the requests, the bulk of what is shuffled
    asked = parts.groupBy("part").cogroup(first.groupBy("part")).applyInArrow(ask_shared, "block int, part long, keys3 binary, counts3 binary")
    every = first.unionByName(answered(asked, (3,)), allowMissingColumns=True)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return parts.groupBy("part").cogroup(every.groupBy("part")).applyInArrow(score, schema)
