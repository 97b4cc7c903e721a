"""Language identification by hierarchical discrimination.

A text's letters give hashed byte trigrams.  Linear support vector machines first decide the
language family (one-versus-one between families), then the language among those of that family
(one-versus-one).  The machines are fitted on the driver from a bounded sample of labelled
rows, ``per_language`` of each language with the smallest hashes of their ids (the documented
bound); everything else is a map over whole texts.

Defined cases: a text that is null or has no letter is ``und`` with score 0.  Without any labelled
training row every text is ``und``.  Rows with a null language train nothing.  A null id counts as
the empty string for the fold and passes through.  Repeated rows give repeated results; other columns are
ignored.  Ties go to the language that sorts first.  An empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

BUCKETS = 1 << 13
PER_LANGUAGE = 250
SLICE_ROWS = 64  # texts whose trigrams are counted at once: 4 MB of counts

# Families of languages by ISO 639-1 code; a language that is not named is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nl", "no", "nb", "nn", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu", "se"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "sinitic": ("zh", "yue"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

# Letters keep their (lower-case) byte, every other ASCII byte is a blank.
_SHAPE = C.LOWER.copy()
_SHAPE[[b for b in range(128) if not (97 <= b <= 122 or 65 <= b <= 90)]] = 32


def sparse_features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of the trigrams of a slice of texts: square roots of trigram shares, each row of length 1."""
    shape = _SHAPE[data].astype(np.uint32)
    rows = len(at) - 1
    if len(shape) < 3:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.float32)
    gram = (shape[:-2] << np.uint32(16)) | (shape[1:-1] << np.uint32(8)) | shape[2:]
    bucket = ((gram * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64)
    row = np.repeat(np.arange(rows), np.diff(at))[: len(bucket)]
    keep = (np.arange(2, len(shape)) < at[row + 1]) & (gram != 0x202020)
    counts = np.bincount(row[keep] * BUCKETS + bucket[keep], minlength=rows * BUCKETS)
    found = np.flatnonzero(counts)
    row, counts = found // BUCKETS, counts[found]
    total = np.bincount(row, counts, minlength=rows)
    return row, found % BUCKETS, np.sqrt(counts / total[row], dtype=np.float32, casting="unsafe")


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``sparse_features`` as a dense row per text (0 for a text without trigrams); for the bounded training sample."""
    row, bucket, value = sparse_features(data, at)
    out = np.zeros((len(at) - 1, BUCKETS), np.float32)
    out[row, bucket] = value
    return out


def fit_svm(x: np.ndarray, positive: np.ndarray, penalty: float = 1e-4, rounds: int = 300) -> np.ndarray:
    """Weights (bias last) of a linear machine with squared hinge loss; both classes weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    y = np.where(positive, 1.0, -1.0).astype(np.float32)
    share = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum())).astype(np.float32)
    w = ahead = np.zeros(x.shape[1], np.float32)
    step, t = 1 / (4 + penalty), 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        after = ahead - step * (penalty * ahead - 2 * (x.T @ (share * y * slack)))
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        ahead = after + (last - 1) / t * (after - w)
        w = after
    return w


@dataclass
class Discriminator:
    """Pairs of families, then pairs of languages within each family; one column of weights for each pair."""

    languages: list[str]
    families: list[str]
    family_pairs: list[tuple[int, int]]
    language_pairs: list[tuple[int, int]]
    weights: np.ndarray

    @classmethod
    def fit(cls, labels: list[str], x: np.ndarray) -> Discriminator:
        languages = sorted(set(labels))
        family = [FAMILY_OF.get(code, code) for code in languages]
        families = sorted(set(family))
        of_row = np.array([languages.index(v) for v in labels], int)
        family_of = np.array([families.index(f) for f in family], int)
        row_family = family_of[of_row] if len(of_row) else of_row
        family_pairs = list(itertools.combinations(range(len(families)), 2))
        language_pairs = [(a, b) for a, b in itertools.combinations(range(len(languages)), 2) if family[a] == family[b]]
        columns = []
        for kind, pairs in ((row_family, family_pairs), (of_row, language_pairs)):
            for a, b in pairs:
                rows = (kind == a) | (kind == b)
                columns.append(fit_svm(x[rows], kind[rows] == a))
        return cls(languages, [families[i] for i in family_of], family_pairs, language_pairs, np.array(columns, np.float32).T.reshape(BUCKETS + 1, -1))

    def predict(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, score in 0..1) of each text of a slice."""
        row, bucket, value = sparse_features(data, at)
        x = range(len(at) - 1)
        margin = np.stack([np.bincount(row, value * w[bucket], minlength=len(x)) + w[-1] for w in self.weights.T] or [np.zeros(len(x))], 1)
        families = sorted(set(self.families))
        members = np.array([families.index(f) for f in self.families])
        k = len(self.family_pairs)
        family, p_family = self._vote(margin[:, :k], self.family_pairs, len(families), np.ones((len(x), len(families)), bool))
        language, p_language = self._vote(margin[:, k:], self.language_pairs, len(members), members[None, :] == family[:, None])
        return language, np.clip(p_family * p_language, 0, 1)

    @staticmethod
    def _vote(margin: np.ndarray, pairs: list[tuple[int, int]], n: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The winner of most pairs (then of the larger margins), and its least probability in them."""
        votes, least = np.zeros((len(allowed), n)), np.ones((len(allowed), n))
        for j, (a, b) in enumerate(pairs):
            p = 1 / (1 + np.exp(-3 * margin[:, j].astype(float)))
            for side, q in ((a, p), (b, 1 - p)):
                votes[:, side] += (q > 0.5) + 0.01 * q
                least[:, side] = np.minimum(least[:, side], q)
        best = np.where(allowed, votes, -1).argmax(1)
        return best, least[np.arange(len(best)), best]


def fold(id_column: Column, folds: int = 5) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))), F.lit(folds))


def fit_language_model(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Discriminator:
    """Fit on the rows outside fold 0 that have a language."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 0))
    # First the smallest of each of many parts of a language, so that a frequent one is not dealt to one task.
    chosen = labelled.select("doc_id", "lang").distinct().withColumn("draw", F.xxhash64("doc_id")).withColumn("part", F.pmod("draw", F.lit(16)))
    for by in (["lang", "part"], ["lang"]):
        order = Window.partitionBy(*by).orderBy("draw", "doc_id")
        chosen = chosen.withColumn("at", F.row_number().over(order)).where(F.col("at") <= per_language)
    chosen = chosen.select("doc_id", "lang")
    rows = labelled.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])  # at most per_language rows of each language

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in C.chunks(batch.column(2), rows=SLICE_ROWS):
                x = features(data, at).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array([v.tobytes() for v in x], pa.binary())], names=["doc_id", "lang", "x"])

    table = rows.mapInArrow(C.tidied(work), "doc_id long, lang string, x binary").toPandas().sort_values(["lang", "doc_id"]).drop_duplicates(["lang", "doc_id"])
    x = np.frombuffer(b"".join(table["x"]), np.float16).reshape(-1, BUCKETS).astype(np.float32)
    return Discriminator.fit(table["lang"].tolist(), x)


def identify(docs: DataFrame, model: Discriminator) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per document; only the text decides."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            letters = pc.fill_null(pc.match_substring_regex(batch.column(2), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            for lo, hi, data, at in C.chunks(batch.column(2), rows=SLICE_ROWS):
                said, score = np.full(hi - lo, "und", object), np.zeros(hi - lo)
                if m.languages:
                    best, p = m.predict(data, at)
                    ok = letters[lo:hi]
                    said[ok] = np.array(m.languages, object)[best[ok]]
                    score[ok] = p[ok]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(said, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id"), (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(C.tidied(work), "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, model: Discriminator, least_score: float = 0.0) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language and at least ``least_score``; only texts go to Python."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def recognised(texts: pa.Array) -> pa.Array:
        m = sent.value
        keep = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False).copy()
        if not m.languages:
            keep[:] = False
        elif least_score > 0:
            for lo, hi, data, at in C.chunks(texts, rows=SLICE_ROWS):
                keep[lo:hi] &= m.predict(data, at)[1] >= least_score
        return pa.array(keep)

    return docs.where(F.arrow_udf(recognised, "boolean")(F.col("text").cast("string")))


def language_id(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    return identify(docs, fit_language_model(docs, per_language))
