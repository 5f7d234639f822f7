"""Collocations, the Pitman-Yor model and vector codes against brute force, and on odd tables."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm import collocations as col
from corvane.llm import pitman_yor as py
from corvane.llm import vector_codes as vc

DOCS = "doc_id long, text string, lang string"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def random_docs(n, seed=3, words=40):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["É", "Straße", "x\x00y"]
    odds = 1 / np.arange(1, len(vocabulary) + 1)
    out = []
    for i in range(n):
        picked = rng.choice(len(vocabulary), size=int(rng.integers(0, 60)), p=odds / odds.sum())
        marks = rng.choice([" ", "  ", "\t", ". ", ",", "\n", " ;"], size=len(picked), p=[0.8, 0.05, 0.02, 0.05, 0.03, 0.03, 0.02])
        out.append((i, "".join(vocabulary[w].upper() * (k % 7 == 0) or vocabulary[w] for w, k in zip(picked, range(99))) if i % 50 == 7 else "".join(vocabulary[w] + m for w, m in zip(picked, marks)), ["en", "de", None][i % 3]))
    return out


# --- 11 collocations


def brute_phrases(docs, least, top):
    f = defaultdict(Counter)
    for _, text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang or "und"][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        rows = []
        phrases = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        for p, a in phrases.items():
            score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
            if not any(len(q) > len(p) and 100 * b >= 80 * a and inside(q) for q, b in phrases.items()):
                rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, i, p.decode(), -a, left, right, n, -s))
    return sorted(out)


@pytest.mark.parametrize("least,top", [(5, 10_000), (5, 7), (30, 3), (1, 12)])
def test_collocations_by_brute_force(spark, least, top):
    docs = random_docs(300)
    got = col.collocations(spark.createDataFrame(docs, DOCS), least, top)
    assert sorted(map(tuple, got.collect())) == brute_phrases(docs, least, top)


def test_every_occurrence_lies_in_one_fragment():
    order = type("Order", (), {"key": lambda self, h: (h % 5) << 50})()
    keys = col._Keys("en", order)
    rng = np.random.default_rng(1)
    for _ in range(200):
        words = [b"abcdefgh"[i : i + 1] for i in rng.integers(0, 8, size=int(rng.integers(1, 12)))]
        want = Counter(b" ".join(words[i : i + k]) for k in (2, 3, 4) for i in range(len(words) - k + 1))
        got = Counter()
        for at, found in col._fragments(b" ".join(words), keys):
            for fragment in found:
                w = fragment.split(b" ")
                for i, j in itertools.combinations(range(len(w) + 1), 2):
                    if i <= at < j and 2 <= j - i <= 4:
                        got[b" ".join(w[i:j])] += 1
        assert got == want


def test_split_pivots_and_small_tables_of_counts(spark, monkeypatch):
    docs = random_docs(200, seed=8)
    routed = col._routed
    monkeypatch.setattr(col, "_routed", lambda order, unit: routed(order, 3, held=50))
    mined = col._mined
    monkeypatch.setattr(col, "_mined", lambda least: mined(least, held=5))
    got = col.collocations(spark.createDataFrame(docs, DOCS), 4, 50, cells=8)
    assert sorted(map(tuple, got.collect())) == brute_phrases(docs, 4, 50)


def test_a_common_pair_doesnt_land_in_one_row():
    order = type("Order", (), {"key": lambda self, h: 1 << 54 | (h >> 10), "most": lambda self, k: np.full(len(k), 1000.0)})()
    import pyarrow as pa

    texts = [b"hot pair a%d" % i for i in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 400), pa.array(texts)], ["lang", "text"])
    rows = [r for b in col._routed(order, 100.0)(iter([batch])) for r in b.to_pylist()]
    most = max(r["fragments"].count(b"\n") for r in rows)
    assert most < 400


def test_phrases_of_odd_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert col.collocations(empty).collect() == []
    rows = [(1, None, None), (None, "", "en"), (2, "a b " * 40_000, "en"), (2, "a b", "en"), (3, ". , \n", None)]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("score", "a", "l", "r", "rank", "phrase", "limit", "f", "word", "h", "part", "need"):
        df = df.withColumn(c, F.lit(7))
    got = sorted(map(tuple, col.collocations(df, 30, 10).collect()))
    assert got == brute_phrases(rows, 30, 10) and got


# --- 12 language model


def by_hand(docs):
    learn = [t for i, t in docs if i is not None and zlib.crc32(str(i).encode()) % 10]
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + [""]
    c = Counter(w for t in learn for w in words(t))
    n, v = sum(c.values()), len(c)
    base = lambda t: sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t))
    return words, c, n, v, base


def test_counts_and_base_scores(spark):
    docs = [(i, t) for i, t, _ in random_docs(200)] + [(None, "w1 w2"), (5, "w1 new word"), (5, None)]
    words, c, n, _, base = by_hand(docs)
    got = py.language_scores(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    show = lambda i, t, b: (str(i), i is not None and zlib.crc32(str(i).encode()) % 10 == 0, len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(b, 6))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(show(i, t, base(t)) for i, t in docs)


def plain_model(restaurants, used, totals, table):
    """Probabilities again, word by word from the totals and the tables of dishes."""
    seen = {}
    for word, ctx, n in table:
        c, v = np.frombuffer(n, "<i4").astype(np.int64), np.frombuffer(ctx, "<i4").astype(np.int64)
        t, rc, rt = py.sample(py._hashes([word]), np.zeros(len(c), np.int64), v, c, used, 5, 2)
        p = (rc[0] - totals.root_discount * rt[0]) / (1 + totals.root_customers) + totals.new_word()
        seen[word] = (p, {int(a): (int(b), float(x)) for a, b, x in zip(v, c, t)})

    def probability(before, word):
        p, dishes = seen.get(word, (totals.new_word(), {}))
        v = restaurants.ids.get(before, 0)
        if not v:
            return p
        c, t = dishes.get(v, (0, 0.0))
        whole = restaurants.customers[v]
        return max(c - totals.discount * t, 0) / (1 + whole) + (1 + totals.discount * totals.tables[v]) / (1 + whole) * p

    return probability, seen


def test_scores_by_the_formula_and_probabilities_that_sum_to_one(spark):
    docs = [(i, t) for i, t, _ in random_docs(150, seed=5)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    words, *_ = by_hand(docs)
    texts = df.where(py._learned("doc_id")).select(F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    restaurants = py.restaurants_of(texts)
    dishes = py.dishes(texts, restaurants)
    used, totals = py.train(dishes, restaurants)
    table = [(bytes(r.word), bytes(r.ctx), bytes(r.n)) for r in dishes.collect()]
    score = {r.doc_id: r.score for r in py.language_scores(df).collect()}
    probability, seen = plain_model(restaurants, used, totals, table)
    for i, t in docs:
        w = [x.encode() for x in words(t)]
        assert score[i] == pytest.approx(sum(math.log10(probability(a, b)) for a, b in zip([b"", *w[:-1]], w)), rel=1e-9)
    for before in [b"", *restaurants.words[:5], b"never"]:
        assert sum(probability(before, w) for w in seen) + probability(before, b"nowhere") == pytest.approx(1, abs=1e-9)


def test_dishes_hold_all_pairs(spark, monkeypatch):
    docs = [(i, t) for i, t, _ in random_docs(150, seed=6)]
    monkeypatch.setattr(py, "_CHUNK_TOKENS", 200)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    words, *_ = by_hand(docs)
    texts = df.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    restaurants = py.restaurants_of(texts)
    got = {}
    for r in py.dishes(texts, restaurants).collect():
        for v, n in zip(np.frombuffer(r.ctx, "<i4"), np.frombuffer(r.n, "<i4")):
            got[bytes(r.word), int(v)] = int(n)
    want = Counter()
    for _, t in docs:
        w = [x.encode() for x in words(t)]
        for a, b in zip([b"", *w[:-1]], w):
            want[b, restaurants.ids.get(a, 0)] += 1
    assert got == dict(want)


def test_rare_contexts_have_restaurants_of_their_own(spark):
    """With few words broadcast, all other contexts are small restaurants: by the formula, summing to one, however rows are dealt."""
    docs = [(i, t) for i, t, _ in random_docs(150, seed=5)] + [(1000, "once seen"), (1001, "once seen"), (1002, "once w1"), (10_000, "never known"), (None, "once seen w2")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    words, *_ = by_hand(docs)
    learned = [t for i, t in docs if i is not None and zlib.crc32(str(i).encode()) % 10 != 0]
    texts = df.where(py._learned("doc_id")).select(F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    restaurants = py.restaurants_of(texts, share=25)
    pairs = py._pairs(df.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"), py._learned("doc_id").alias("learned")), restaurants)
    restaurants.served = py._served(pairs, len(restaurants.served))
    dishes = py._dishes(pairs)
    used, totals = py.train(dishes, restaurants)
    n = Counter()
    for t in learned:
        w = [x.encode() for x in words(t)]
        n.update(zip([b"", *w[:-1]], w))
    whole, kinds, serving = Counter(), Counter(), Counter()
    for (a, b), k in n.items():
        whole[a] += k
        kinds[a] += 1
        serving[b] += a not in restaurants.ids
    assert 0 < len(restaurants.ids) < len(whole) / 2
    seen = {}
    for r in dishes.collect():
        word, c, v = bytes(r.word), np.frombuffer(r.n, "<i4").astype(np.int64), np.frombuffer(r.ctx, "<i4").astype(np.int64)
        direct = r.served + restaurants.served[restaurants.ids.get(word, 0)]
        assert direct == serving[word]
        t, rc, rt = py.sample(py._hashes([word]), np.zeros(len(c), np.int64), v, c, used, 5, 2, np.array([float(direct)]))
        seen[word] = ((rc[0] - totals.root_discount * rt[0]) / (1 + totals.root_customers) + totals.new_word(), dict(zip(v.tolist(), t.tolist())))

    def probability(a, b):
        p, tables = seen.get(b, (totals.new_word(), {}))
        v, k = restaurants.ids.get(a, 0), n[a, b]
        t, all_tables = (tables.get(v, 0), totals.tables[v]) if v else (float(k > 0), kinds[a])
        return (k - totals.discount * t) / (1 + whole[a]) + (1 + totals.discount * all_tables) / (1 + whole[a]) * p

    for a in [*whole, b"never"]:
        assert sum(probability(a, b) for b in seen) + probability(a, b"nowhere") == pytest.approx(1, abs=1e-9)
    want = sorted((str(i), round(sum(math.log10(probability(a, b)) for a, b in zip([b"", *[x.encode() for x in words(t)][:-1]], [x.encode() for x in words(t)])), 6)) for i, t in docs)
    for dealt in (df, df.repartition(7)):
        assert sorted((str(r.doc_id), round(r.score, 6)) for r in py.language_scores(dealt, share=25).collect()) == want
    # a word seen once tells what follows it
    assert probability(b"once", b"seen") > 10 * probability(b"never", b"seen")


def test_seatings_follow_their_distribution():
    """The number of tables against all partitions of few customers, and against the recursion for many."""
    d, a = 0.6, 1.7

    def partitions(items):
        if not items:
            yield []
            return
        for rest in partitions(items[1:]):
            yield [[items[0]], *rest]
            for i in range(len(rest)):
                yield [*rest[:i], [items[0], *rest[i]], *rest[i + 1 :]]

    weight = Counter()
    for p in partitions(list(range(6))):
        weight[len(p)] += a ** len(p) * math.prod(math.prod(k - d for k in range(1, len(g))) for g in p)
    n = 40_000
    u = (np.arange(n) + 0.5) / n
    t = py.draw_tables(np.full(n, 6), np.full(n, a), u, d, py.stirling(d))
    for k, w in weight.items():
        assert (t == k).mean() == pytest.approx(w / sum(weight.values()), abs=2 / n)
    for c, d in ((300, 0.6), (2000, 0.8)):
        s, at = np.full(c + 2, -np.inf), np.arange(c + 2)
        s[1] = 0
        for m in range(1, c):
            with np.errstate(all="ignore"):
                s = np.logaddexp(np.append(-np.inf, s[:-1]), s + np.log(np.maximum(m - at * d, 0)))
        for a in (0.01, 1.7, 20, 300, 5000):
            p = np.exp(s + at * math.log(a) - (s + at * math.log(a)).max())
            p /= p.sum()
            mean = (p * at).sum()
            got = py.draw_tables(np.full(4000, c), np.full(4000, float(a)), (np.arange(4000) + 0.5) / 4000, d, py.stirling(d))
            assert got.mean() == pytest.approx(mean, rel=0.03)
            assert got.std() == pytest.approx(math.sqrt((p * (at - mean) ** 2).sum()), rel=0.2, abs=0.3)


def test_draws_dont_depend_on_how_rows_are_dealt(spark):
    docs = [(i, t) for i, t, _ in random_docs(120, seed=9)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    first, second = ({r.doc_id: r.score for r in py.language_scores(df.repartition(k)).collect()} for k in (1, 5))
    assert first == pytest.approx(second, rel=1e-9)


def test_the_model_beats_the_counts_on_held_out_texts(spark):
    import os

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("needs the driver's tables")
    rows = py.language_scores(spark.read.parquet(f"{sf}/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) and all(r.score < 0 for r in rows)


def test_language_scores_of_odd_tables(spark):
    schema = "doc_id int, text string"
    assert py.language_scores(spark.createDataFrame([], schema)).collect() == []
    got = py.language_scores(spark.createDataFrame([(None, "a b"), (None, None)], schema)).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score, r.held_out) for r in got) == [(1, 0, 0, 0.0, 0.0, False), (3, 0, 0, 0.0, 0.0, False)]
    rows = [(1, "x" * 100_000), (2, "w " * 50_000), (2, "w " * 50_000), (3, None), (4, ""), (None, "w \x00 é")]
    df = spark.createDataFrame(rows, schema)
    for c in ("score", "text_", "id", "learned", "word", "c", "chunk", "doc", "bucket", "kind", "ctx", "n", "held", "ids"):
        df = df.withColumn(c, F.lit(7))
    got = py.language_scores(df).collect()
    assert len(got) == 6 and all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert sorted(r.n_tokens for r in got) == [1, 1, 2, 4, 50_001, 50_001]


def test_rare_words_of_a_bucket_share_rows(spark, monkeypatch):
    """Rows that are counted, swept and scored follow the buckets, not the vocabulary."""
    docs = [(i, t) for i, t, _ in random_docs(200, seed=11, words=3000)]
    texts = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).select(F.col("text").cast("binary").alias("text"))
    counts = Counter(w.encode() for _, t in docs for w in re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + [""])
    buckets = py._buckets(spark)
    restaurants = py.restaurants_of(texts, share=100)
    rare = counts.keys() - restaurants.ids.keys()
    assert len(rare) > 4 * buckets and (restaurants.tokens, restaurants.vocabulary) == (counts.total(), len(counts))
    assert restaurants.words == sorted(w for w, c in counts.items() if c >= -(-counts.total() // 100))
    found = py._pairs(texts.withColumn("learned", F.lit(True)), restaurants).where("kind = 0").collect()
    assert len(found) <= buckets
    assert sorted(w for r in found for w in bytes(r.word).split(b"\n")) == sorted(rare)
    show = lambda: sorted(map(tuple, py.dishes(texts, restaurants).collect()))
    want = show()
    monkeypatch.setattr(py, "_BLOCK", 7)
    assert show() == want


def test_words_are_split_by_the_rule_however_many_at_a_time():
    rng = np.random.default_rng(4)
    pieces = [*map(chr, range(128)), "É", "\u2003", "\x85", "漢", *" \n  A" * 8]
    texts = ["", " ", *("".join(rng.choice(pieces, rng.integers(40))) for _ in range(500))]
    want = [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for t in texts]
    for most in (1, 100, 1 << 20):
        got = []
        for at, counts, found in py._lowered(pa.array([b"x", *(t.encode() for t in texts)]).slice(1), most):
            assert len(counts) == len(texts[at])
            words = iter(found.to_pylist())
            got += [[next(words).decode() for _ in range(n)] for n in counts]
            assert next(words, None) is None
        assert got == want


def test_draws_by_powers_are_those_by_logarithms(monkeypatch):
    rng = np.random.default_rng(8)
    c, alpha, u = rng.integers(1, 40, 20_000), np.exp(rng.uniform(-12, 18, 20_000)), rng.random(20_000)
    got = py.draw_tables(c, alpha, u, 0.7, py.stirling(0.7))
    monkeypatch.setattr(py, "_POWERS", 1)
    assert (got == py.draw_tables(c, alpha, u, 0.7, py.stirling(0.7))).all()


# --- 13 vector codes


def brute_codes(rows, parts, entries, rounds):
    """The whole job in Python's integers; rows of (id, vector, label)."""
    ok = [(i, v, lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    floor = lambda x: (lambda a, b: 256 * a // b)(*x.as_integer_ratio())
    q = [(i, [floor(x) for x in v], lab) for i, v, lab in ok]
    q.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    step = len(q[0][1]) // parts
    cut = lambda v, p: v[p * step : (p + 1) * step]
    books = [[cut(v, p) for _, v, _ in q[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, v, _ in q:
                groups[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k])] if groups[k] else e for k, e in enumerate(books[p])]
    out, by = [], Counter()
    for i, v, lab in q:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), lab))
        by[lab] += out[-1][2]
    fits = lambda x: x if x < 1 << 63 else None
    lost = {lab for _, _, e, lab in out if fits(e) is None}
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, fits(e), None if lab in lost else fits(by[lab])) for i, c, e, lab in out), key=repr), digest


@pytest.mark.parametrize("seed,length,scale", [(1, 8, 1), (2, 12, 1), (3, 28, 5), (4, 8, 1e7), (5, 4, 1e-3), (6, 8, 3e12)])
def test_codes_by_brute_force(spark, seed, length, scale):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in np.float32(rng.normal(size=length) * scale)], int(rng.integers(0, 4)) if i % 9 else None) for i in rng.permutation(160)]
    rows += [(500, rows[0][1], 1), (501, None, 1), (502, [None, *rows[1][1][1:]], 2), (503, [float("nan"), *rows[1][1][1:]], 2), (504, [float("-inf"), *rows[1][1][1:]], 2), (505, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got, books = vc.encode(df, parts=4, entries=12)
    want, digest = brute_codes([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows], 4, 12, 2)
    assert sorted(map(tuple, got.collect()), key=repr) == want and vc.fingerprint(books) == digest


def test_bounds_never_lose_the_nearest():
    rng = np.random.default_rng(7)
    for step in (1, 2, 3, 4, 7, 16):
        for scale in (2, 300, (1 << 30) // step - 1):
            x = rng.integers(-scale, scale, size=(300, step))
            book = rng.integers(-scale, scale, size=(40, step))
            book[5], x[:40] = book[9], book
            code, error = vc.Codebook(book).nearest(x)
            d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
            assert (code == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all()


def test_bounds_drop_most_entries(monkeypatch):
    rng = np.random.default_rng(3)
    x, book = rng.integers(-100, 100, size=(2000, 16)), rng.integers(-100, 100, size=(64, 16))
    x = x // 32 + book[rng.integers(0, 64, size=2000)]
    seen = []
    bound = vc._bound
    monkeypatch.setattr(vc, "_bound", lambda a, b, size: seen.append((bound(a, b, size)).size) or bound(a, b, size))
    vc.Codebook(book).nearest(x)
    assert seen[0] == 2000 * 64 and seen[-1] < seen[0] / 4


def test_codes_of_odd_tables(spark):
    schema = "vec_id int, embedding array<double>, label string"
    got, books = vc.encode(spark.createDataFrame([], schema))
    assert got.collect() == [] and len(books) == 16
    one = [0.5] * 16
    rows = [(1, one, None), (1, one, None), (None, [1.0] * 16, "a"), (2, [1.0] * 15, "a"), (3, [1.0] * 32, "a"), (4, None, "b")]
    df = spark.createDataFrame(rows, schema)
    for c in ("id", "v", "n", "of", "s", "lost", "code", "error", "label_error", "codes"):
        df = df.withColumn(c, F.lit(7))
    got, _ = vc.encode(df)
    assert sorted((str(r.vec_id), r.error, r.label_error) for r in got.collect()) == [("1", 0, 0), ("1", 0, 0), ("None", 0, 0)]
    got, _ = vc.encode(spark.createDataFrame([(1, [0.0] * 16, "a"), (2, [1e300] * 16, "a")], schema), entries=1)
    assert {r.vec_id: (r.error, r.label_error) for r in got.collect()} == {1: (None, None), 2: (None, None)}
