"""Each operator on hard rows, against brute force."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, copy int, score string, block int, p int"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def rows_of(seed=5):
    """Nulls, empty and very long texts, ties, repeated rows, copies and near copies."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    base, passage = prose(120), prose(70)
    words = base.split()
    texts = [None, "", "   \n\t", "one", "one two three", "A b C d e", "a B c D E", base, base.upper(), base, "ß É é 中文 \x00 🙂 " * 9]
    texts += [" ".join(words[:i] + ["edit"] + words[i + 1 :]) for i in range(5, 115, 10)]
    texts += [prose(40) + " " + passage + " " + prose(40) for _ in range(5)]
    texts += [passage, prose(30000), "a" * 700, "a" * 300, "ab" * 400, "x" * 49, "x" * 50, "x" * 51]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}", 1, "k", 7, "s", 3, 4) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], rows[12], (None, base, "en", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(text):
    return (text or "").encode().lower()


def test_exact_dedup(docs, empty):
    from liftloom.llm.exact_dedup import exact_dedup, keep_one

    groups = defaultdict(list)
    for r in rows_of():
        groups[lowered(r[1])].append(r[0])
    want = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), i == keep, hashlib.sha256(text).hexdigest())] += 1
    assert Counter(map(tuple, exact_dedup(docs).collect())) == want
    assert exact_dedup(empty).count() == 0
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(lowered(r.text) for r in kept.collect()) == Counter(groups.keys())


CLASHING = "doc_id long, text string, digest string, text_sha256 string, keep_id string, group_size string, sig int, stays string, key string, number string, node int"


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    from liftloom.llm import exact_dedup, jaccard_join

    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    near = a + " more"
    rows = [(1, a), (1, b), (2, a), (5, c), (5, b + " x"), (2, a), (7, "one"), (7, "two"), (8, ""), (8, " "), (9, near)]
    df = spark.createDataFrame([(*r, "u", "v", "w", "x", 1, "y", "z", "q", 2) for r in rows], CLASHING).repartition(3)
    kept = exact_dedup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted({r for r in rows} - {(1, a)})
    assert {tuple(r)[2:] for r in kept.collect()} == {("u", "v", "w", "x", 1, "y", "z", "q", 2)}
    kept = jaccard_join.keep_one(df)
    assert kept.columns == df.columns
    # {a of 1, a of 2, near of 9}: least id 1; {b of 1, b x of 5}: least id 1
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(1, a), (1, b), (5, c), (7, "one"), (7, "two"), (8, ""), (8, " ")])
    assert {tuple(r)[2:] for r in kept.collect()} == {("u", "v", "w", "x", 1, "y", "z", "q", 2)}


def test_quotient_filter_slots():
    from liftloom.llm.exact_dedup import SLOTS, QuotientFilter

    rng = np.random.default_rng(1)
    for keys in (np.zeros(0, np.uint64), np.array([7], np.uint64), np.arange(50, dtype=np.uint64), np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64)), np.array([0, 2**64 - 1], np.uint64)):
        f = QuotientFilter.of(keys, np.arange(1, len(keys) + 1))
        assert np.array_equal(f.fingerprints(), keys) and np.array_equal(f.entries()[1], np.arange(1, len(keys) + 1))
        assert len(f.occupied) * SLOTS <= 3 * len(keys) + 1
        # runs are sorted and every slot right of its quotient's is marked
        home = (keys >> np.uint64(f.low)).astype(object) - f.base if len(keys) else []
        assert [bool(x) for x in f.shifted[f.used()]] == [int(h) != s for h, s in zip(home, f.used().tolist(), strict=True)]


def test_quotient_filters_merge_without_loss():
    from liftloom.llm.exact_dedup import QuotientFilter

    rng = np.random.default_rng(0)
    pools = [rng.integers(0, 2**63, 500, dtype=np.uint64) >> np.uint64(s) for s in (0, 10, 54)] * 2
    filters = [QuotientFilter.of(*(lambda k, c: (k, c.astype(np.int64)))(*np.unique(x, return_counts=True))) for x in pools]
    merged = filters[0]
    for f in filters[1:]:
        merged = merged.merge(QuotientFilter.from_bytes(f.to_bytes()))
    keys, counts = np.unique(np.concatenate(pools), return_counts=True)
    assert np.array_equal(merged.fingerprints(), keys) and np.array_equal(merged.entries()[1], counts)


def shingles(text):
    w = WORD.findall(lowered(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def test_jaccard_join(docs, empty):
    from liftloom.llm.jaccard_join import jaccard_components, keep_one

    want = brute_components([(r[0], r[1]) for r in rows_of()])
    got = jaccard_components(docs).collect()
    assert len(got) == len(rows_of())
    for r in got:
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)
    sizes = {i: len(shingles(t)) for i, t, *_ in rows_of() if i is not None}
    assert all(r.n_shingles == sizes[r.doc_id] for r in got if r.doc_id is not None)
    assert jaccard_components(empty).count() == 0
    assert {r.doc_id for r in keep_one(docs).where("doc_id is not null").collect()} == set(want.values())


def test_jaccard_join_sends_no_pairs_of_a_shared_template(spark, monkeypatch):
    """Pages of one template of 30 words and 10 own ones (similarity 0.57), and a few near copies: what is sent at most doubles with the pages."""
    from liftloom.llm import jaccard_join

    whole, sent = jaccard_join.region_members, []

    def counted(posted, blocks):
        out = whole(posted, blocks)
        sent.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "region_members", counted)
    template = [f"t{i}" for i in range(30)]
    for n in (600, 1200):
        rows = [(i, " ".join(template + [f"own{i}x{k}" for k in range(10)])) for i in range(n)]
        rows += [(n + i, rows[i][1] + " more") for i in range(0, n, 20)]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df).collect()}
        assert got == {i: i if i < n else i - n for i, _ in rows}
        assert sent[-1] <= 2 * n / 20
    assert sent[1] <= 2 * sent[0] + 1


def test_jaccard_join_of_large_groups(spark, monkeypatch):
    """Chains of near copies in regions of many chunks."""
    from liftloom.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "REGION", 8)
    monkeypatch.setattr(jaccard_join, "SMALL_LIST", 4)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(150):
        if i % 3 == 0:  # drift: far from the first, near to the one before
            words[rng.randrange(90)] = f"d{i}"
        other = list(words)
        for _ in range(rng.randint(0, 3)):
            other[rng.randrange(90)] = f"e{rng.random()}"
        rows.append((i, " ".join(other)))
    want = brute_components(rows)
    assert 1 < len(set(want.values())) < 140
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df).collect()} == want


def brute_lm(texts):
    """n, and a function that walks the automaton of order 3 through words: (n_known, base, score); texts: (held out, words with None as end)."""
    from liftloom.llm.lm_score import GROWTH, MASS

    count, context = Counter(), Counter({(): 0})
    for held, words in texts:
        if not held:
            padded = ["<begin>", *words]
            for i in range(1, len(padded)):
                for k in range(3):
                    if i - k >= 0:
                        context[tuple(padded[i - k : i])] += 1
                        count[tuple(padded[i - k : i + 1])] += 1
    n, v = sum(c for h, c in count.items() if len(h) == 1), sum(1 for h in count if len(h) == 1)

    def p(h, w):
        if not h:
            return (count[w,] + 1) / (n + v + 1)
        c = context[h]
        m = MASS * c**GROWTH
        return (count[(*h, w)] + m * p(h[1:], w)) / (c + m)

    def walk(words):
        state, score = ("<begin>",), 0.0
        for w in words:
            while state and not count[(*state, w)]:  # failure arcs
                m = MASS * context[state] ** GROWTH
                score += math.log10(m / (context[state] + m))
                state = state[1:]
            score += math.log10(p(state, w))
            state = (*state, w)[-2:]
            while state and not context[state]:
                state = state[1:]
        return sum(count[w,] > 0 for w in words), sum(math.log10(p((), w)) for w in words), score

    return n, p, walk, [w for (w, *more) in count if not more], context


def test_lm_scores(docs, empty):
    from liftloom.llm.lm_score import lm_scores

    name = lambda i: b"" if i is None else str(i).encode()
    texts = [(i, zlib.crc32(name(i)) % 7 == 2, [*WORD.findall(lowered(t)), None]) for i, t, *_ in rows_of()]
    n, p, walk, words, context = brute_lm([t[1:] for t in texts])
    for h in [("<begin>",), *[h for h in context if h and None not in h and len(h) == 2][:10], *[(w,) for w in words if w][:10]]:  # all tokens and one unknown sum to 1
        assert math.isclose(sum(p(h, w) for w in words) + p(h, "?"), 1, rel_tol=1e-9)
    want = defaultdict(list)
    for i, held, w in texts:
        known, base, score = walk(w)
        want[i].append((held, len(w), known, n, base, score))
    got = defaultdict(list)
    for r in lm_scores(docs, part_bytes=2000).collect():
        got[r.doc_id].append((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score))
    assert got.keys() == want.keys()
    for i in want:
        for a, b in zip(sorted(got[i]), sorted(want[i]), strict=True):
            assert a == pytest.approx(b, rel=1e-9)
    assert lm_scores(empty).count() == 0
    nothing = lm_scores(docs.where(F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(7)) == 2)).collect()
    assert nothing and all(r.train_tokens == r.n_known == 0 and r.score == r.base_score == 0 for r in nothing)


def test_lm_scores_free_their_requests(spark, docs):
    from liftloom.llm.lm_score import lm_scores

    files = lambda: str(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")).count("/shuffle_")
    n, before = docs.count(), files()
    scores = lm_scores(docs, part_bytes=2000)
    deadline = time.time() + 20
    while files() > before and time.time() < deadline:
        time.sleep(0.2)
    assert files() <= before
    assert scores.count() == n


def test_lm_counts_beyond_32_bits():
    import pyarrow as pa

    from liftloom.llm import common
    from liftloom.llm.lm_score import narrow, widen

    for values in ([], [0], [1, 255, 3], [2**33 + 5, 1], [2**63, 7]):
        x = np.array(values, np.uint64)
        assert np.array_equal(widen(memoryview(narrow(x))), x)
    keys, sums = common.sum_by_key(np.array([5, 5, 9], np.uint64), np.array([4 * 10**9, 4 * 10**9, 1]))
    assert keys.tolist() == [5, 9] and sums.tolist() == [8 * 10**9, 1] and pa.array(sums).to_pylist()[0] > 2**32


def test_language_id(spark, docs, empty):
    from liftloom.llm.language_id import accepted, fit_language_model, language_id

    got = language_id(docs).collect()
    assert len(got) == len(rows_of())
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[0].lang_pred == by_id[1].lang_pred == by_id[2].lang_pred == "und" and by_id[0].score == 0
    assert {r.lang_pred for r in got} == {"en", "und"}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in by_id.values())
    assert language_id(empty).count() == 0
    assert {r.lang_pred for r in language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = accepted(docs, fit_language_model(docs))
    assert kept.columns == docs.columns
    assert not {0, 1, 2} & {r.doc_id for r in kept.collect()}


def test_language_id_learns(spark):
    from liftloom.llm.language_id import language_id

    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = language_id(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count()
    assert got.where("score < 0 or score > 1").isEmpty()


def removed_spans(rows, span=50):
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - span + 1):
            w = b[s : s + span]
            least[w] = min(least.get(w, i), i)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - span + 1):
            if least[b[s : s + span]] < i:
                gone[s : s + span] = b"\1" * span
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("skipped", [1 << 21, 0], ids=["ids sent", "joined"])
def test_suffix_dedup(docs, empty, monkeypatch, skipped):
    from liftloom.llm import suffix_dedup as module
    from liftloom.llm.suffix_dedup import suffix_dedup

    monkeypatch.setattr(module, "SKIPPED", skipped)
    want = removed_spans([(r[0], r[1]) for r in rows_of() if r[0] is not None])
    got = suffix_dedup(docs).collect()
    assert len(got) == len(rows_of())
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == r.n_spans == 0
        else:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r
    assert suffix_dedup(empty).count() == 0


def test_merged_transforms_find_equal_windows():
    from liftloom.llm.suffix_dedup import Pieces, window_classes

    rng = np.random.default_rng(1)
    pool = rng.integers(97, 100, 400).astype(np.uint8)
    texts = [pool[a : a + n].tobytes() for a, n in zip(rng.integers(0, 300, 40), rng.integers(50, 84, 40), strict=True)]
    count = np.array([len(t) - 49 for t in texts], np.uint8)
    zero = np.zeros(40, np.int64)
    for shards in (1, 3):
        piece, window, kind = window_classes(Pieces(zero.astype(np.uint64), zero, zero.astype(np.uint64), zero, count, np.frombuffer(b"".join(texts), np.uint8)), shards)
        assert len(piece) == count.astype(int).sum()
        strings = [texts[p][w : w + 50] for p, w in zip(piece.tolist(), window.tolist(), strict=True)]
        assert len(set(zip(strings, kind.tolist(), strict=True))) == len(set(strings)) == len(set(kind.tolist()))


def test_bpe(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from liftloom.llm.bpe import bpe_codes

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = Counter()
    for i, t, *_ in rows_of():
        ids = library.encode(t or "", add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe_codes(docs, path).collect())) == want
    assert bpe_codes(empty, path).count() == 0
    full = bpe_codes(docs, path, full=True, keep=("lang",)).where("doc_id = 7").first()
    assert full.decoded == library.decode(full.ids, skip_special_tokens=False) and full.lang == "en"


def test_bpe_odd_texts_and_both_merge_orders():
    import public_tokenizers
    from tokenizers import Tokenizer

    from liftloom.llm.bpe import Codec

    path = public_tokenizers.path("word_bpe_49k.json")
    codec, library = Codec.from_file(path), Tokenizer.from_file(path)
    rng = random.Random(2)
    texts = ["ΑΣ ΑΣ. İ ǅ ﬁ", "a<|endoftext|>b <|startoftext|>", "'sT'LL it'S", "½²5٣ x", "ab\x1c\x85 c", "é ẛ̣"]
    texts += ["".join(rng.choices("abcdeéöß中🙂 '-12\n", k=rng.randint(1, 400))) for _ in range(200)]
    for t in texts:
        assert np.frombuffer(codec.encode(t)[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
        words = codec.words(t)
        many = codec.merged_many([w.encode() for w in words if len(w.encode()) <= 64])
        for word in words:
            letters = [codec.letters[b] for b in word.encode()]
            letters[-1] += codec.suffix
            want = codec.merged(list(letters))
            assert want == codec.merged_heap(list(letters))
            if len(word.encode()) <= 64:
                assert [codec.names[i] for i in many.pop(0).tolist()] == want


def test_bpe_agrees_on_every_code_point_and_on_runs_of_marks():
    import unicodedata

    import public_tokenizers
    from tokenizers import Tokenizer

    from liftloom.llm.bpe import ODD, Codec

    path = public_tokenizers.path("word_bpe_49k.json")
    codec, library = Codec.from_file(path), Tokenizer.from_file(path)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rng = random.Random(9)
    marks = [c for c in points if unicodedata.category(c)[0] == "M"]
    cased = [c for c in points if c.lower() != c]
    odd = [chr(c) for c in np.flatnonzero(ODD)]
    texts = ["".join(f"a{c}b {c} 1{c}{c} " for c in points[i : i + 16]) for i in range(0, len(points), 16)]
    for pool in (points, marks, cased, odd, marks + odd):
        texts += ["".join(rng.choices(pool, k=rng.randint(1, 12))) for _ in range(4000)]
    for lo in range(0, len(texts), 4096):
        some = texts[lo : lo + 4096]
        for t, (ids, _, glued), want in zip(some, codec.encode_many(some), library.encode_batch(some, add_special_tokens=False), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == want.ids, t
            assert codec.spell(codec.between.join(glued)) == library.decode(want.ids, skip_special_tokens=False), t


def test_poisson_mixing(spark, docs, empty):
    from liftloom.llm.mixing import inverse_poisson, poisson_mixing

    out = poisson_mixing(docs)
    assert out.columns == [*docs.columns, "rate", "_copy"]
    clash = docs.selectExpr("doc_id", "source", "'a' as rate", "'b' as _source", "'c' as _n", "'d' as _key", "'e' as KEY", "text as source_name", "'f' as n")
    mixed = poisson_mixing(clash)
    assert mixed.columns == [*clash.columns, "_rate", "copy"]
    assert set(map(tuple, mixed.select(clash.columns).collect())) <= set(map(tuple, clash.collect()))
    assert poisson_mixing(empty).count() == 0
    assert poisson_mixing(docs, total=0).count() == 0
    again = poisson_mixing(docs.repartition(2), partitions=3)
    assert Counter(map(tuple, out.select("doc_id", "_copy").collect())) == Counter(map(tuple, again.select("doc_id", "_copy").collect()))
    with pytest.raises(ValueError):
        poisson_mixing(docs, {"s0": -1.0})
    only = poisson_mixing(docs, {"s0": 1.0}, total=400)
    assert {r.source for r in only.select("source").distinct().collect()} == {"s0"}
    assert abs(only.count() - 400) < 5 * 20
    u = [0.001, 0.2, 0.5, 0.9, 0.999999]
    for mean in (0.01, 1.0, 7.5, 300.0):
        got = spark.createDataFrame([(x,) for x in u], "u double").select(inverse_poisson(F.col("u"), F.lit(mean)).alias("k")).collect()
        for x, row in zip(u, got, strict=True):
            k, p = 0, math.exp(-mean)
            cdf = p
            while x > cdf:
                k += 1
                p = p * mean / k
                cdf += p
            assert row.k == k


def test_mixing_reaches_target_weights(spark):
    from liftloom.llm.mixing import poisson_mixing

    df = spark.range(30000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'a' when id % 30 = 1 then 'b' else 'c' end as source", "'t' as text")
    got = {r.source: r["count"] for r in poisson_mixing(df, {"a": 1, "b": 2, "c": 1}, total=40000).groupBy("source").count().collect()}
    for source, want in (("a", 10000), ("b", 20000), ("c", 10000)):
        assert abs(got[source] - want) < 6 * want**0.5 + 0.05 * want


def test_mixing_draws_large_rates(spark):
    from liftloom.llm.mixing import inverse_poisson, poisson_mixing

    u = [1e-9, 0.001, 0.2, 0.5, 0.9, 0.999999]
    for mean in (700.0, 700.5, 720.0, 1000.25, 3e4, 1e6):
        got = spark.createDataFrame([(x,) for x in u], "u double").select(inverse_poisson(F.col("u"), F.lit(mean)).alias("k")).collect()
        k = np.arange(max(0, int(mean - 15 * mean**0.5)), int(mean + 15 * mean**0.5))
        cdf = np.cumsum(np.exp([i * math.log(mean) - mean - math.lgamma(i + 1) for i in k.tolist()]))
        assert [r.k for r in got] == k[np.searchsorted(cdf, u)].tolist()
    df = spark.createDataFrame([(i, "a", "t") for i in range(120)], "doc_id long, source string, text string")
    for rate in (650.0, 700.5, 5000.0):
        n = [r["count"] for r in poisson_mixing(df, total=120 * rate).groupBy("doc_id").count().collect()]
        assert len(n) == 120 and abs(np.mean(n) - rate) < 5 * (rate / 120) ** 0.5
        assert 0.5 * rate < np.var(n) < 1.7 * rate


def test_secret_scan(spark, empty):
    from liftloom.llm.secret_scan import RULES, scan_ledger, secret_scan

    texts = [None, "", "ü token = 'abcdefghijkl' x", "PASSWORD:short secret=abcdefghijklmnop", "AKIA" + "Z" * 14 + " AKIAAKIA" + "Q" * 20, "deadbeefdeadbeef " * 3, "é" * 9 + " api_key=0123456789abcdef0123", "token=secret=abcdefghijklm", "x" * 100000 + "0123456789abcdef", "-----BEGIN RSA PRIVATE KEY-----", "token: password: abcdefghijkl"]
    rows = [(i, t, "n") for i, t in enumerate(texts)] + [(2, texts[2], "n"), (99, texts[2], "n"), (None, texts[5], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, blob string").repartition(3)
    kinds = (("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16))
    want = Counter()
    for i, t, _ in rows:
        found = sorted((m.start(), k, m.end(), name) for k, (name, r, g, n) in enumerate(kinds) for m in r.finditer(t or "") if len(m[g]) >= n)
        tags = ",".join(f"{name}:{a}:{b}" for a, _, b, name in found)
        count = Counter(f[3] for f in found)
        want[i, count["assign"], count["access"], count["hex"], hashlib.sha256(tags.encode()).hexdigest()] += 1
    got = secret_scan(df).collect()
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    assert next(r for r in got if r.doc_id == 9).spans == "pem:0:31"
    assert secret_scan(empty).count() == 0
    # an incremental run scans new blobs and new rule versions only, and ends like a full one
    first = df.where("doc_id < 6")
    _, found, ledger = scan_ledger(first)
    found, ledger = spark.createDataFrame(found.collect(), found.schema), spark.createDataFrame(ledger.collect(), ledger.schema)
    _, after, ledger2 = scan_ledger(df, ledger, found)
    _, whole, _ = scan_ledger(df)
    assert Counter(map(tuple, after.collect())) == Counter(map(tuple, whole.collect()))
    assert ledger2.count() == len({t or "" for t in texts}) * len(RULES)


def test_secret_ledger_scans_unseen_pairs_only(spark, monkeypatch):
    """A new version of one rule scans that rule alone, and replaces what its old version found."""
    from dataclasses import replace

    from liftloom.llm import secret_scan as S

    rows = [(1, "token = abcdefghijkl deadbeefdeadbeef"), (2, "deadbeefdeadbeef"), (3, "AKIA" + "Z" * 14), (4, "nothing")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    asked = []
    whole = S.scan
    monkeypatch.setattr(S, "scan", lambda texts, rules: asked.append([(r.text[:4], sorted(r.todo)) for r in texts.collect()]) or whole(texts, rules))
    _, found, ledger = S.scan_ledger(df)
    new = tuple(replace(r, version=2, pattern="[0-9a-f]{16}", least=16) if r.kind == "hex" else r for r in S.RULES)
    _, after, ledger2 = S.scan_ledger(df.unionByName(spark.createDataFrame([(5, "api_key=0123456789abcdef0123")], "doc_id long, text string")), ledger, found, new)
    every = sorted(r.kind for r in S.RULES)
    assert sorted(asked[0]) == [("AKIA", every), ("dead", every), ("toke", every)]
    assert sorted(asked[1]) == [("AKIA", ["hex"]), ("api_", every), ("dead", ["hex"]), ("toke", ["hex"])]
    assert ledger2.count() == 5 * len(S.RULES) + 4  # the old versions of four blobs stay on record
    _, full, _ = S.scan_ledger(df.unionByName(spark.createDataFrame([(5, "api_key=0123456789abcdef0123")], "doc_id long, text string")), rules=new)
    assert Counter(map(tuple, after.collect())) == Counter(map(tuple, full.collect()))
    S.scan_ledger(df, ledger2, after, new)
    assert asked[-1] == []


def test_license_scan(spark, docs, empty):
    from liftloom.llm.license_scan import TEMPLATES, align, license_scan, winnow

    mit = TEMPLATES["MIT"]
    words = mit.split()
    holed = " ".join(w for i, w in enumerate(words) if i % 11 != 5)
    rows = [(1, "Intro. " + mit + " end"), (2, "x\n" * 50 + holed), (3, mit[: len(mit) // 4]), (4, "released UNDER the mit   license!"), (5, None), (6, ""), (None, "Licensed under CC BY 4.0."), (7, "All about nothing here " * 500), (8, ("Released under the MIT License. " + "z " * 40) * 30)]
    got = license_scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert [(r.license, r.coverage) for r in by[1]] == [("MIT", 1.0)]
    text = rows[0][1].encode()[by[1][0].byte_start : by[1][0].byte_end].decode()
    assert text.startswith("Permission is") and text.endswith("Software")
    assert [r.license for r in by[2]] == ["MIT"] and 0.75 <= by[2][0].coverage < 1
    assert 3 not in by and 5 not in by and 6 not in by and 7 not in by
    assert [(r.license, r.byte_start, r.byte_end) for r in by[4]] == [("MIT-notice", 0, 32)]
    assert [r.license for r in by[None]] == ["CC-BY-4.0-notice"]
    assert len(by[8]) == 30
    assert license_scan(docs).count() == 0 == license_scan(empty).count()
    # alignment equals the longest common subsequence where the band holds all of it
    rng = np.random.default_rng(4)
    for _ in range(60):
        a, b = rng.integers(0, 4, 9).astype(np.uint64), rng.integers(0, 4, 10).astype(np.uint64)
        table = [[0] * 11 for _ in range(10)]
        for i in range(9):
            for j in range(10):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        m, x, y = align(a, b, 0, 12)
        assert m == table[9][10] and (m == 0 or (a == b[x]).any() and 0 <= x < y <= 10)
    hashes = rng.integers(0, 1000, 50).astype(np.uint64)
    kept = set(winnow(hashes, 4).tolist())
    assert all(kept & set(range(i, i + 4)) for i in range(47))


def test_outermost_matches():
    from liftloom.llm.license_scan import outermost

    rng = np.random.default_rng(0)
    for _ in range(200):
        found = [(int(a), int(a + n), int(t), int(m), 30) for a, n, t, m in zip(rng.integers(0, 40, 25), rng.integers(1, 20, 25), rng.integers(0, 3, 25), rng.integers(1, 20, 25), strict=True)]
        best = []
        for f in sorted(set(found), key=lambda f: (-f[3], f[4], f[0], f[2])):
            if not any(g[0] <= f[0] and f[1] <= g[1] for g in best):
                best.append(f)
        assert outermost(found) == sorted(best)


def test_whole_license_texts(spark):
    from liftloom.llm.license_scan import TEMPLATES, license_scan

    texts = {name: body for name, body in TEMPLATES.items() if name.endswith("-text")}
    rows = [(i, "Copyright 2020 Someone\n\n" + body + "\n") for i, body in enumerate(texts.values())]
    got = {(r.doc_id, r.license): r.coverage for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i, name] == 1 for i, name in enumerate(texts))


def test_license_scan_of_changed_notices(spark):
    from liftloom.llm.license_scan import LEAST_COVERAGE, TEMPLATES, license_scan

    split = lambda text: re.sub(r"[^A-Za-z0-9]+", " ", text).lower().split()
    rng = random.Random(2)
    texts = ["Released under the MIT Licence.", "Licensed under CC BY 4"]
    for name, notice in sorted(TEMPLATES.items()):
        words = split(notice)
        texts += [" ".join([*words[:i], *new, *words[i + 1 :]]) for i in range(len(words)) for new in ([], ["zzz"])]
        for _ in range(10):
            gone = set(rng.sample(range(len(words)), len(words) // 4))
            texts.append("aa bb " + " ".join("zzz" if i in gone else w for i, w in enumerate(words)) + " cc")
        gone = {i for i in range(3, len(words), 4)}
        texts.append(" ".join("zzz" if i in gone else w for i, w in enumerate(words)))

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old, row = row, [0] * (len(b) + 1)
            for j, y in enumerate(b):
                row[j + 1] = old[j] + 1 if x == y else max(row[j], old[j + 1])
        return row[-1]

    got = defaultdict(int)
    for r in license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got[r.doc_id] = max(got[r.doc_id], r.n_matched)
    want = {}
    for i, text in enumerate(texts):
        found = [(common(split(t), split(text)), len(split(t))) for t in TEMPLATES.values()]
        want[i] = max([m for m, n in found if m >= LEAST_COVERAGE * n], default=0)
    missed = [(texts[i], want[i], got[i]) for i in want if got[i] != want[i]]
    print("texts", len(texts), "missed", len(missed), missed[:5])
    assert not missed


def brute_neighbours(vectors, queries, k):
    out = []
    for q, v in queries:
        near = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), i) for i, w in vectors if i != q)[:k]
        out += [(q, r + 1, i, d) for r, (d, i) in enumerate(near)]
    return out


def test_neighbours(spark):
    from liftloom.llm.ann import hilbert_keys, nearest_neighbours

    rng = np.random.default_rng(0)
    good = [(i, rng.normal(size=8).tolist()) for i in range(60)]
    good += [(100 + i, good[0][1]) for i in range(25)] + [(300, good[1][1])]
    bad = [(200, None), (201, [0.0] * 8), (202, [1.0, None] * 4), (203, [float("nan")] + [1.0] * 7), (204, [float("inf")] * 8), (205, [1.0, 2.0]), (None, good[0][1])]
    df = spark.createDataFrame([*good, *good[:3], *bad], "vec_id long, embedding array<double>").withColumn("rank", F.lit("x")).repartition(3)
    got = sorted(map(tuple, nearest_neighbours(df, F.col("vec_id") % 100 == 0).collect()))
    want = sorted(brute_neighbours(good, [g for g in good if g[0] % 100 == 0], 10))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)
    assert nearest_neighbours(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    grid = np.array(np.meshgrid(*[range(8)] * 3, indexing="ij")).reshape(3, -1).T
    order = np.argsort(hilbert_keys(grid, 3))
    assert (np.abs(np.diff(grid[order], axis=0)).sum(1) == 1).all()


def test_neighbours_recall_of_hard_vectors(spark):
    from liftloom.llm.ann import nearest_neighbours

    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {(r.query_id, r.vec_id) for r in nearest_neighbours(df, F.col("vec_id") % 100 == 0).collect()}
    vectors = [(r.vec_id, r.embedding) for r in df.collect()]
    want = {(q, i) for q, _, i, _ in brute_neighbours(vectors, [v for v in vectors if v[0] % 100 == 0], 10)}
    assert len(got & want) >= 0.9 * len(want)


@pytest.mark.parametrize("jitter", [1e-2, 1e-6, 1e-13])
def test_neighbours_recall_in_a_tight_cluster(spark, monkeypatch, jitter):
    from liftloom.llm import ann

    monkeypatch.setattr(ann, "CELL_ROWS", 128)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[::3] = x[0] + jitter * rng.normal(size=(2000, 64))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    queries = range(0, 6000, 75)
    got = {(r.query_id, r.vec_id) for r in ann.nearest_neighbours(df, F.col("vec_id") % 75 == 0).collect()}
    want = set()
    for q in queries:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want |= {(q, i) for i in np.argsort(d)[:10].tolist()}
    assert len(got & want) >= 0.9 * len(want)
    print("recall", jitter, len(got & want) / len(want))


def test_components_with_many_edges(spark, monkeypatch):
    from liftloom.llm import common

    rng = random.Random(1)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1100)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = dict(map(tuple, common.components(df).collect()))
    monkeypatch.setattr(common, "LOCAL_EDGES", 40)
    assert dict(map(tuple, common.components(df).collect())) == want
    assert want[1100] == 1000
