"""The registered queries on sf0.001 against their SQL or a brute force."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from liftloom.llm import queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def documents(spark):
    return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = db.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, SF).toPandas()[list(want.columns)]
    assert Counter(map(tuple, got.astype(str).to_numpy())) == Counter(map(tuple, want.astype(str).to_numpy()))


def test_op4(spark):
    from tests.llm.test_documents import brute_lm

    texts = [(i, zlib.crc32(str(i).encode()) % 7 == 2, [*WORD.findall((t or "").encode().lower()), None]) for i, t in documents(spark)]
    n, _, walk, _, _ = brute_lm([t[1:] for t in texts])
    got = {r.doc_id: r for r in queries.op4_backoff_lm(spark, SF).collect()}
    assert len(got) == len(texts)
    for i, held, words in texts:
        known, base, score = walk(words)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, len(words), known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_op7(spark):
    rows = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect())
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    got = {(r.query_id, r["rank"]): r for r in queries.op7_hilbert_neighbours(spark, SF).collect()}
    hits = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((ids, d))[:10]
        mine = [got[ids[q], k + 1] for k in range(10)]
        hits += len({r.vec_id for r in mine} & set(ids[best].tolist()))
        total += 10
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        assert all(r.score == pytest.approx(d[np.searchsorted(ids, r.vec_id)], rel=1e-12) for r in mine)
    assert hits >= 0.9 * total


def test_op8(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary_path())
    want = Counter()
    for i, t in documents(spark):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(map(tuple, queries.op8_bpe(spark, SF).collect())) == want


def test_op5(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.op5_language_id(spark, SF).collect()
    assert {r.doc_id for r in got} == set(truth)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_op1_finds_every_notice(spark):
    """Every exact occurrence of a template's words is reported."""
    from liftloom.llm.license_scan import TEMPLATES

    got = {(r.doc_id, r.license) for r in queries.op1_license_scan(spark, SF).where("coverage = 1").collect()}
    plain = lambda t: " " + " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))) + " "
    want = {(i, name) for i, t in documents(spark) for name, body in TEMPLATES.items() if plain(body) in plain(t or "")}
    assert want and want <= got


def test_op1_against_brute_force(spark):
    """Every reported match is a common subsequence of its span; every stretch of a template's length that covers enough of it is reported, or lies within a better match."""
    from liftloom.llm.license_scan import LEAST_COVERAGE, TEMPLATES

    pattern = re.compile(rb"[0-9a-z\x80-\xff]+")
    lower = lambda text: bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    wanted = {name: pattern.findall(lower(body)) for name, body in TEMPLATES.items()}
    got = {}
    for r in queries.op1_license_scan(spark, SF).collect():
        got.setdefault(r.doc_id, []).append(r)
    seen = 0
    for i, text in documents(spark):
        raw = lower(text or "")
        places = [(m.start(), m.end()) for m in pattern.finditer(raw)]
        words = [raw[a:b] for a, b in places]
        mine = got.get(i, [])
        for r in mine:
            span = [raw[a:b] for a, b in places if r.byte_start <= a and b <= r.byte_end]
            assert r.n_template == len(wanted[r.license]) and r.coverage == r.n_matched / r.n_template >= LEAST_COVERAGE
            assert common(wanted[r.license], span) == r.n_matched and span[0] in wanted[r.license] and span[-1] in wanted[r.license]
        for name, template in wanted.items():
            n, need, known = len(template), LEAST_COVERAGE * len(template), set(template)
            inside = [w in known for w in words]
            for s in range(max(1, len(words) - n + 1)):
                if sum(inside[s : s + n]) < need or common(template, words[s : s + n]) < need:
                    continue
                seen += 1
                first, last = places[s][0], places[min(s + n, len(words)) - 1][1]
                assert any(r.byte_start < last and first < r.byte_end and (r.license == name or r.n_matched >= need) for r in mine), (i, name, s)
    assert seen


def test_op5_against_brute_force(spark):
    """The same machines, walked pair by pair over trigrams in a dictionary."""
    from liftloom.llm import language_id as L

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.fit_language_model(docs)
    got = {r.doc_id: r for r in queries.op5_language_id(spark, SF).collect()}
    families = sorted(set(model.families))
    for i, text in documents(spark):
        shape = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in (text or "").encode())
        grams = Counter(shape[j : j + 3] for j in range(len(shape) - 2) if shape[j : j + 3] != b"   ")
        counts = Counter()
        for g, n in grams.items():
            counts[(int.from_bytes(g, "big") * 2654435761 % 2**32) >> 19] += n
        total = sum(counts.values())
        margin = [sum((n / total) ** 0.5 * float(w[b]) for b, n in counts.items()) + float(w[-1]) for w in model.weights.T]

        def decide(pairs, margins, members):
            votes, least = {m: 0.0 for m in members}, {m: 1.0 for m in members}
            for (a, b), value in zip(pairs, margins, strict=True):
                p = 1 / (1 + np.exp(-3 * value))
                for side, q in ((a, p), (b, 1 - p)):
                    if side in votes:
                        votes[side] += (q > 0.5) + 0.01 * q
                        least[side] = min(least[side], q)
            best = max(members, key=lambda m: (votes[m], -m))
            return best, least[best]

        if not any(c.isalpha() for c in text or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        k = len(model.family_pairs)
        family, p = decide(model.family_pairs, margin[:k], range(len(families)))
        language, q = decide(model.language_pairs, margin[k:], [m for m, f in enumerate(model.families) if families.index(f) == family])
        assert got[i].lang_pred == model.languages[language] and got[i].score == pytest.approx(p * q, abs=1e-4)
