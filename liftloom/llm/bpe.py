"""Byte-pair encoding and decoding with a contiguous rank array per word.

A text is normalised, split into words, and each distinct word is encoded once per task: an array
holds the boundaries of its parts, another the rank of the merge of each part with its right
neighbour.  The array is scanned for the least rank, that boundary is deleted, and the ranks of
the two neighbouring pairs are refreshed, until no pair has a rank.  The new words of a slice of texts go through this
together, words of about the same length as rows of one matrix of parts and one of ranks.  Words are short, so a scan
beats a heap; words over ``HEAP_FROM`` parts keep a heap of the same ranks, with the same result.

Letters, numbers, compositions and combining classes follow the Unicode versions of the library whose results are
to be matched, not those of Python: see the fixed values below.

The vocabulary file is a parameter and is read on the driver; its tables (under 5 MB, fixed by the
file) are sent to the executors.  Handled are BPE models whose words end in a suffix or whose
pre-tokeniser is byte level, with the normalisers and splits that such files name.

Defined cases: a null text is empty and has no tokens; its decoded text is empty.  Special tokens
written out in a text become their ids, as in the library.  Repeated rows give repeated results;
null ids pass through; other columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

HEAP_FROM = 64
CACHE_WORDS = 150_000
CACHED_LENGTH = 64
BATCH_WORDS = 8192
SLICE_ROWS = 256
NO_RANK = 1 << 60

# Fixed values, as ranges of code points: what the packages used here take for letters and numbers and the library does not.
NOT_LETTERS = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB "
    "11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 "
    "1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
NOT_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"
# Marks and parts of compositions that the library's normaliser leaves where they are, as it knows no class or composition of theirs.
NOT_MARKS = (
    "07FD 0898-089F 08CA-08D3 09FE 0C3C 0D3B-0D3C 0EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 11070 1133B 1145E "
    "11839-1183A 11930 11935 11938 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"
)
# Capitals (ranges) that the library lowers and Python may not, with the first small letter.
LOWERED = "1C89:1C8A A7CB:0264 A7CC:A7CD A7CE:A7CF A7D2:A7D3 A7D4:A7D5 A7DA:A7DB A7DC:019B 10D50-10D65:10D70 16EA0-16EB8:16EBB"


def is_odd(text: str) -> bool:
    """Whether a text holds a code point of the fixed values below."""
    if text.isascii():
        return False
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return bool(ODD[points[points >= LEAST_ODD]].any())


# Split patterns whose matches never hold white space.
SPACELESS = (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",)


def _class(ranges: str) -> str:
    """The inside of a character class."""
    return "".join("-".join(rf"\U{int(x, 16):08X}" for x in r.split("-")) for r in ranges.split())


def _lower_table() -> dict[int, int]:
    out = {}
    for item in LOWERED.split():
        span, to = item.split(":")
        first, *last = (int(x, 16) for x in span.split("-"))
        out |= {c: int(to, 16) + c - first for c in range(first, (last or [first])[0] + 1)}
    return out


LOWER_TABLE = _lower_table()
CAPITALS = " ".join(x.split(":")[0] for x in LOWERED.split())
ODD = np.zeros(0x110000, bool)
for _first, *_last in ([int(x, 16) for x in r.split("-")] for r in " ".join((NOT_LETTERS, NOT_NUMBERS, NOT_MARKS, CAPITALS)).split()):
    ODD[_first : (_last or [_first])[0] + 1] = True
LEAST_ODD = int(ODD.argmax())
STILL = re.compile(f"([{_class(NOT_MARKS)}])")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, shift = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + shift)
            shift += 1
    return out


class Codec:
    """Encodes and decodes texts as the vocabulary file's tokenizer does, without special tokens added."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(a, b): rank for rank, (a, b) in reversed(list(enumerate(merges)))}
        self.decoder = spec.get("decoder")
        if self.decoder is not None and self.decoder["type"] != "ByteLevel":
            raise ValueError(f"unknown decoder {self.decoder['type']}")
        steps = spec.get("normalizer")
        self.steps = [] if steps is None else steps["normalizers"] if steps["type"] == "Sequence" else [steps]
        self.replacements = [(regex.compile(s["pattern"]["Regex"]), s["content"]) if s["type"] == "Replace" else None for s in self.steps]
        split = spec["pre_tokenizer"]
        stages = split["pretokenizers"] if split["type"] == "Sequence" else [split]
        patterns = [s["pattern"]["Regex"] for s in stages if s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"]]
        if not patterns:
            raise ValueError("the vocabulary's pre-tokeniser is not one that keeps the matches of a pattern")
        self.pattern = regex.compile(patterns[0])
        letters, numbers = rf"[\p{{L}}--[{_class(NOT_LETTERS)}]]", rf"[\p{{N}}--[{_class(NOT_NUMBERS)}]]"
        self.odd_pattern = regex.compile(patterns[0].replace(r"\p{L}", letters).replace(r"\p{N}", numbers), regex.V1)
        # Where no word holds white space, what replaces white space by a blank changes no word.
        self.idle = [s["type"] == "Replace" and s["pattern"].get("Regex") == r"\s+" and s["content"] == " " and patterns[0] in SPACELESS for s in self.steps]
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.heads = {t[0] for t in self.added}
        self.letters = byte_letters()
        self.cache: dict[str, tuple[bytes, int, str]] = {}
        self.table = self._table()

    def _table(self) -> tuple | None:
        """(ids of letters inside a word, and at its end; sorted pairs of ids with their ranks; the id that each rank makes), or None where a part has no id."""
        get = self.vocab.get
        ends = [[get(c + end, -1) for c in self.letters] for end in ("", self.suffix)]
        merges = sorted((get(a, -1), get(b, -1), rank, get(a + b, -1)) for (a, b), rank in self.ranks.items())
        grid = np.array(merges, np.int64).reshape(-1, 4)
        if min(map(min, ends)) < 0 or (grid < 0).any() or not len(grid):
            return None
        made = np.zeros(grid[:, 2].max() + 1, np.int64)
        made[grid[:, 2]] = grid[:, 3]
        return np.array(ends[0]), np.array(ends[1]), grid[:, 0] << 32 | grid[:, 1], grid[:, 2].copy(), made

    @classmethod
    def from_file(cls, path: str) -> Codec:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def normalise(self, text: str, odd: bool) -> str:
        for step, how, idle in zip(self.steps, self.replacements, self.idle, strict=True):
            if step["type"] == "Lowercase":
                # Letter by letter where the whole string's case rules look at neighbours (final sigma).
                text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
                if odd:
                    text = text.translate(LOWER_TABLE)
            elif step["type"] in ("NFC", "NFD", "NFKC", "NFKD"):
                if odd:
                    text = "".join(part if i % 2 else unicodedata.normalize(step["type"], part) for i, part in enumerate(STILL.split(text)))
                elif not text.isascii():
                    text = unicodedata.normalize(step["type"], text)
            elif step["type"] == "Replace":
                if not idle:
                    text = how[0].sub(how[1], text)
            else:
                raise ValueError(f"unknown normaliser {step['type']}")
        return text

    def words(self, text: str) -> list[str]:
        """The words of a text, normalised."""
        odd = is_odd(text)
        return (self.odd_pattern if odd else self.pattern).findall(self.normalise(text, odd))

    def parts(self, word: str) -> list[str]:
        """The tokens of one pre-tokenised word (not yet in byte letters)."""
        symbols = [self.letters[b] for b in word.encode("utf-8")]
        if self.suffix:
            symbols[-1] += self.suffix
        return self.merged_heap(symbols) if len(symbols) > HEAP_FROM else self.merged(symbols)

    def merged(self, symbols: list[str]) -> list[str]:
        ranks, none = self.ranks, 1 << 60
        pair = [ranks.get(p, none) for p in zip(symbols, symbols[1:], strict=False)]
        while pair:
            least = min(pair)
            if least == none:
                break
            i = pair.index(least)
            symbols[i] += symbols[i + 1]
            del symbols[i + 1], pair[i]
            if i:
                pair[i - 1] = ranks.get((symbols[i - 1], symbols[i]), none)
            if i < len(pair):
                pair[i] = ranks.get((symbols[i], symbols[i + 1]), none)
        return symbols

    def merged_many(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of many words of at most ``HEAP_FROM`` bytes: ``merged`` on all rows of a matrix at once."""
        inner, last, keys, ranks, made = self.table
        out: list = [None] * len(words)
        sizes = np.array([len(w) for w in words])

        def rank_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            key = a << 32 | b
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            return np.where((keys[at] == key) & (a >= 0) & (b >= 0), ranks[at], NO_RANK)

        for low in (0, 4, 8, 16, 32):
            rows = np.flatnonzero((sizes > low) & (sizes <= (max(4, 2 * low))))
            if not len(rows):
                continue
            width = int(sizes[rows].max())
            parts = np.full((len(rows), width), -1)
            parts[np.arange(width) < sizes[rows, None]] = inner[np.frombuffer(b"".join([words[i] for i in rows.tolist()]), np.uint8)]
            parts[np.arange(len(rows)), sizes[rows] - 1] = last[[words[i][-1] for i in rows.tolist()]]
            pair = rank_of(parts[:, :-1], parts[:, 1:]) if width > 1 else np.full((len(rows), 1), NO_RANK)
            while len(rows):
                at = pair.argmin(1)
                least = pair[np.arange(len(rows)), at]
                for r in np.flatnonzero(least == NO_RANK).tolist():
                    out[rows[r]] = parts[r][parts[r] >= 0]
                live = least < NO_RANK
                rows, at, least = rows[live], at[live], least[live]
                if not len(rows):
                    break
                n, width = np.arange(len(rows)), parts.shape[1] - 1
                parts, pair = parts[live], pair[live]
                parts[n, at] = made[least]
                parts = np.take_along_axis(parts, np.arange(width) + (np.arange(width) > at[:, None]), 1)
                if width == 1:
                    pair = np.full((len(rows), 1), NO_RANK)
                    continue
                pair = np.take_along_axis(pair, np.arange(width - 1) + (np.arange(width - 1) >= at[:, None]), 1)
                before, after = at > 0, at < width - 1
                pair[n[before], at[before] - 1] = rank_of(parts[n[before], at[before] - 1], parts[n[before], at[before]])
                pair[n[after], at[after]] = rank_of(parts[n[after], at[after]], parts[n[after], at[after] + 1])
        return out

    def merged_heap(self, symbols: list[str]) -> list[str]:
        """The same merges for long words: n log n instead of n squared."""
        n, ranks = len(symbols), self.ranks
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in ranks]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ranks.get((symbols[i], symbols[j])) != rank:
                continue
            symbols[i] += symbols[j]
            alive[j], after[i] = False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := ranks.get((symbols[a], symbols[b]))) is not None:
                    heapq.heappush(heap, (r, a))
        return [s for s, ok in zip(symbols, alive, strict=True) if ok]

    def word(self, word: str) -> tuple[bytes, int, str]:
        """(ids as little-endian 32-bit integers, their number, the tokens joined as decode does)."""
        ids = [i for p in self.parts(word) if (i := self.vocab.get(p)) is not None]
        out = np.array(ids, "<u4").tobytes(), len(ids), self.glue([self.names[i] for i in ids])
        if len(word) <= CACHED_LENGTH:
            self.cache[word] = out
        return out

    def learn(self, words: set[str]) -> None:
        """Encode the words that the cache lacks, short ones together."""
        if len(self.cache) + len(words) > CACHE_WORDS:
            self.cache.clear()
        new = [w for w in words if w not in self.cache and len(w) <= CACHED_LENGTH]
        raw = [w.encode("utf-8") for w in new]
        short = [i for i, b in enumerate(raw) if len(b) <= HEAP_FROM] if self.table else []
        names = self.names.__getitem__
        for lo in range(0, len(short), BATCH_WORDS):
            some = short[lo : lo + BATCH_WORDS]
            for i, ids in zip(some, self.merged_many([raw[i] for i in some]), strict=True):
                self.cache[new[i]] = ids.astype("<u4").tobytes(), len(ids), self.glue(list(map(names, ids.tolist())))

    def glue(self, tokens: list[str]) -> str:
        """Tokens of one word in one string; words are joined by ``between``."""
        return self.between.join(tokens)

    @property
    def between(self) -> str:
        return "" if self.decoder else " "

    def pieces(self, text: str) -> list[list[str] | str]:
        """The text in order: lists of words, and special tokens."""
        found = [(m.start(), m.end()) for m in self.special.finditer(text)] if self.special and any(c in text for c in self.heads) else []
        if not found:
            return [self.words(text)]
        out, at = [], 0
        for s, e in [*found, (len(text), len(text))]:
            if s > at:
                out.append(self.words(text[at:s]))
            if e > s:
                out.append(text[s:e])
            at = e
        return out

    def encode_many(self, texts: list[str]) -> Iterator[tuple[bytes, int, list[str]]]:
        """(ids, their number, glued tokens of each word) of each text."""
        pieces = [self.pieces(t) for t in texts]
        self.learn(set(itertools.chain.from_iterable(p for some in pieces for p in some if isinstance(p, list))))
        get, word = self.cache.get, self.word
        for some in pieces:
            ids, glued, n = [], [], 0
            for p in some:
                if isinstance(p, list):
                    coded = [get(w) or word(w) for w in p]
                    ids += [c[0] for c in coded]
                    glued += [c[2] for c in coded if c[1]]
                    n += sum([c[1] for c in coded])
                else:
                    ids.append(np.array([self.added[p]], "<u4").tobytes())
                    glued.append(p)
                    n += 1
            yield b"".join(ids), n, glued

    def encode(self, text: str) -> tuple[bytes, int, list[str]]:
        return next(self.encode_many([text]))

    def decode(self, ids: list[int]) -> str:
        """The text of any ids, special tokens kept."""
        return self.spell(self.between.join(self.names[i] for i in ids if i in self.names))

    def spell(self, glued: str) -> str:
        if self.decoder is None:
            return glued
        value = {c: b for b, c in enumerate(self.letters)}
        return bytes(value[c] for c in glued if c in value).decode("utf-8", "replace")


def _codec(spec: str) -> Codec:
    """One codec, with its cache of words, per Python worker and vocabulary, until another operator runs there."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    held = C.held()
    if key not in held:
        held.clear()
        held[key] = Codec(json.loads(spec))
    return held[key]


def bpe_codes(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", full: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per document; with ``full`` also ids array<int> and decoded string.

    ``keep`` names further columns of ``docs`` to carry through (none named like a result).

    ``vocabulary`` is a path that the driver reads.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()
    Codec(json.loads(spec))  # refuses what it does not know before any task runs
    sent = docs.sparkSession.sparkContext.broadcast(spec)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent.value)
        sha = hashlib.sha256
        for batch in batches:
            for lo in range(0, len(batch), SLICE_ROWS):
                rows, ids_out, said = [], [], []
                for ids, n, glued in codec.encode_many([text or "" for text in batch.column(1).slice(lo, SLICE_ROWS).to_pylist()]):
                    decoded = codec.spell(codec.between.join(glued))
                    rows.append((n, sha(ids).hexdigest(), sha(decoded.encode("utf-8")).hexdigest()))
                    if full:
                        ids_out.append(np.frombuffer(ids, "<u4").astype(np.int32))
                        said.append(decoded)
                n, a, b = zip(*rows, strict=True)
                columns = [batch.column(0).slice(lo, SLICE_ROWS), pa.array(n, pa.int64()), pa.array(a), pa.array(b)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if full:
                    columns += [pa.array(ids_out, pa.list_(pa.int32())), pa.array(said, pa.string())]
                    names += ["ids", "decoded"]
                columns += [batch.column(2 + i).slice(lo, SLICE_ROWS) for i in range(len(keep))]
                names += keep
                yield pa.RecordBatch.from_arrays(columns, names=names)
        codec.cache.clear()  # workers wait idle between tasks, more of them than run

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * full
    schema += "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), *keep).mapInArrow(C.tidied(work), schema)
