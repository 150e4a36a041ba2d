"""Language mixtures, hard negatives and periodic runs."""

import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from payscope.llm import hard_negatives, language_mix, period_runs
from payscope.llm.oracle import ORACLE
from payscope.llm.queries import QUERIES
from tests.llm.conftest import LONG, ODD
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


# --- periodic runs ------------------------------------------------------------------------------


def runs_by_hand(words, least=6, exponent=4):
    """Every maximal stretch of every period, by comparing words; of equal stretches the first period."""
    found = {}
    for period in range(1, len(words) // exponent + 1):
        start = 0
        while start + period < len(words):
            stop = start
            while stop + period < len(words) and words[stop] == words[stop + period]:
                stop += 1
            length = stop - start + period
            if stop > start and length >= max(least, exponent * period):
                found.setdefault((start, length), period)
            start = max(stop, start + 1)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def digest_by_hand(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = runs_by_hand(words)
    kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + length for s, length, p in runs)]
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    start, length, period = best or (None, None, None)
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    return (
        doc_id, len(runs), start, length, period, best and 1000 * length // period,
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(kept).encode()).hexdigest(),
    )


def made_of(r, n, kinds):
    words = [b"%d" % r.randrange(kinds) for _ in range(n)]
    if n > 5 and r.random() < 0.6:
        a, p = r.randrange(n), r.randrange(1, 10)
        words = words[:a] + (words[a : a + p] * n)[: n - a]
    return words


@pytest.mark.parametrize("exponent, least", [(4, 6), (2, 1), (3, 8)])
def test_runs_against_comparing_words(exponent, least):
    r = random.Random(exponent)
    for _ in range(60):
        documents = [made_of(r, r.randrange(90), r.choice([1, 2, 2, 3, 40])) for _ in range(r.randrange(1, 7))]
        got = [[tuple(row) for row in runs.tolist()] for runs in period_runs.runs_of(documents, least, exponent)]
        assert got == [runs_by_hand(w, least, exponent) for w in documents]


def test_extensions_are_longest_common_ones():
    r = random.Random(3)
    words = np.array([-1, *(r.randrange(2) for _ in range(700)), -2])
    words[300:400] = 1
    words[500:600] = np.tile(words[200:220], 5)
    grammar = period_runs.Grammar(words)
    a, b = np.array([sorted(r.sample(range(1, 701), 2)) for _ in range(4000)]).T
    after, before = grammar.extend(a, b, forward=True), grammar.extend(a, b, forward=False)
    for x, y, n, m in zip(a, b, after, before, strict=True):
        assert n == next(k for k in range(800) if words[x + k] != words[y + k])
        assert m == next(k for k in range(800) if words[x - k] != words[y - k])


def test_long_documents_stay_quick():
    r = random.Random(4)
    n = 300_000
    once, twice = [b"a"], [b"a", b"b"]
    while len(twice) < n:  # many short repetitions, none of four periods
        once, twice = twice, twice + once
    start = time.time()
    same, periodic, fibonacci, plain = period_runs.runs_of(
        [[b"a"] * n, [b"%d" % (k % 977) for k in range(n)], twice[:n], [b"%d" % r.randrange(99) for _ in range(n)]]
    )
    assert time.time() - start < 60
    assert same.tolist() == [[0, n, 1]] and periodic.tolist() == [[0, n, 977]]
    assert not len(fibonacci) and not len(plain)


def by_repr(rows):
    return sorted(map(tuple, rows), key=repr)


def test_runs_of_odd_rows(spark, odd, empty):
    got = period_runs.digest(period_runs.find(odd, change=period_runs.planted))
    assert by_repr(got.collect()) == by_repr(digest_by_hand(row[0], row[1]) for row in ODD)
    assert period_runs.digest(period_runs.find(empty)).collect() == []


def test_runs_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    short = docs.filter("doc_id is not null").collect()
    want = [digest_by_hand(r.doc_id, r.text) for r in short if len(r.text or "") < 4000]
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_period_runs"](spark, SF).collect()}
    assert len(got) == docs.count() and [got[w[0]] for w in want] == want
    assert any(w[1] for w in want)


def test_collapsed_text(spark):
    text = "x " + "a b " * 9 + "a y\n\nz z z  z z z"
    row = period_runs.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row.runs] == [(1, 19, 2), (21, 6, 1)] and row.collapsed == "x a b y z"


# --- hard negatives -----------------------------------------------------------------------------


def mined_by_hand(rows, is_anchor, positives=5, negatives=10):
    """rows: (vec_id, label, vector) of those that take part."""
    found = []
    for n, (anchor, label, query) in enumerate(rows):
        if not is_anchor(anchor):
            continue
        scored = [
            (-sum(int(x) * int(y) for x, y in zip(query, vector, strict=True)), other, m, kind)
            for m, (other, kind, vector) in enumerate(rows)
            if m != n and len(vector) == len(query)
        ]
        scored.sort()
        near = [s for s in scored if s[3] == label][:positives]
        for score, positive, *_ in near:
            fitting = [s for s in scored if s[3] != label and 30 * -score <= 100 * -s[0] <= 90 * -score]
            for rank, s in enumerate(fitting[:negatives], 1):
                found.append((anchor, positive, rank, s[1], -score, -s[0]))
    return sorted(found)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>, dim string, shard int")


@pytest.mark.parametrize("shard_rows", [40, 8192])
def test_negatives_of_clusters(spark, shard_rows):
    r = np.random.default_rng(2)
    heads = r.normal(size=(12, 9)) * 3
    made = [
        (int(n), int(r.integers(4)), [float(x) for x in heads[n % 12] + r.normal(size=9) * 0.2], "x", 1)
        for n in range(400)
    ]
    made += [(n, 2, made[7][2], "y", 2) for n in range(400, 520)]  # copies of one vector
    quantised = hard_negatives.quantised(vectors(spark, made), 32)
    rows = [(m[0], m[1], [math.floor(32 * float(np.float32(x))) for x in m[2]]) for m in made]
    got = hard_negatives.mine(quantised, F.col("vec_id") % 20 == 0, shard_rows=shard_rows)
    assert sorted(map(tuple, got.collect())) == mined_by_hand(rows, lambda i: i % 20 == 0)


def test_negatives_of_odd_rows(spark):
    none, bad = None, float("nan")
    made = [
        (1, 0, [1.0, 2.0], "x", 1), (100, 0, [1.0, 2.0], "x", 1), (100, 0, [1.0, 1.5], None, 1),
        (200, 1, [1.0, 0.5], "x", 1), (2, 1, [1.0, 0.5], "x", 1), (3, 1, [1.0, 0.5], "x", 1),
        (4, none, [1.0, 2.0], "x", 1), (none, 0, [1.0, 2.0], "x", 1), (5, 0, none, "x", none),
        (6, 0, [1.0, none], "x", 1), (7, 0, [bad, 1.0], "x", 1), (8, 0, [float("inf"), 1.0], "x", 1),
        (9, 0, [1.0, 2.0, 3.0], "x", 1), (300, 2, [1.0, 2.0, 3.0], "x", 1), (10, 2, [2.0, 1.0, 3.0], "x", 1),
        (11, 3, [1.0, 1.0, 1.0], "x", 1), (400, 0, [], "x", 1), (12, 0, [], "x", 1), (13, 1, [], "x", 1),
        (500, 4, [0.0, 0.0], "x", 1), (14, 4, [0.0, 0.0], "x", 1), (600, 0, [-3.0, -3.0], "x", 1),
    ]
    rows = [
        (m[0], m[1], [math.floor(256 * x) for x in m[2]])
        for m in made
        if m[0] is not None and m[1] is not None and m[2] is not None
        and all(x is not None and math.isfinite(x) for x in m[2])
    ]
    quantised = hard_negatives.quantised(vectors(spark, made))
    got = hard_negatives.mine(quantised, F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == mined_by_hand(rows, lambda i: i % 100 == 0)
    nothing = hard_negatives.quantised(vectors(spark, []))
    assert hard_negatives.mine(nothing, F.col("vec_id") % 100 == 0).collect() == []


def test_negatives_against_sql(spark):
    name = "op12_hard_negatives"
    problem, *_ = compare(spark, connect(SF), SF, name, QUERIES[name], ORACLE[name])
    assert problem is None


def clustered_tree(n=4000, heads=40, dims=8):
    r = np.random.default_rng(5)
    centre = r.normal(size=(heads, dims)) * 300
    made = np.floor(centre[np.arange(n) % heads] + r.normal(size=(n, dims)) * 4).astype(np.int64)
    norm = float(np.sqrt((made**2).sum(axis=1).max()))
    ids = np.arange(n)
    return hard_negatives.build(made, ids, ids, ids % 3, norm), made


def test_covering_angles_hold_all_below_and_halve():
    tree, _ = clustered_tree()
    points = hard_negatives.augmented(tree.vectors, tree.norm)
    seen = np.zeros(len(points), int)
    for n in range(len(tree.nodes)):
        own = slice(tree.begin[n], tree.stop[n])
        away = hard_negatives.angles(points[own] @ points[tree.centre[n]])
        assert away.max() <= tree.angle[n] + hard_negatives.SLACK
        kids = slice(tree.child[n], tree.child[n] + tree.children[n])
        if tree.children[n]:
            assert tree.begin[kids][0] == tree.begin[n] and tree.stop[kids][-1] == tree.stop[n]
            assert (tree.angle[kids] <= tree.angle[n] / 2 + 3 * hard_negatives.SLACK).all()
        else:
            seen[own] += 1
    assert (seen == 1).all()


def test_descent_verifies_only_what_windows_meet():
    tree, made = clustered_tree()
    low, high = np.array([hard_negatives.LOWEST]), np.array([hard_negatives.HIGHEST])
    for row in range(0, 400, 40):
        exact = made @ made[row]
        right = np.flatnonzero((np.arange(len(made)) % 3 == row % 3) & (np.arange(len(made)) != row))
        best = right[np.lexsort((right, -exact[right]))][:5]
        _, places, scores, verified = hard_negatives.descend(
            tree, row, made[row], row % 3, True, low, high, low, 5
        )
        assert tree.vec_id[places].tolist() == best.tolist() and scores.tolist() == exact[best].tolist()
        assert verified < len(made) / 20  # others are skipped with their nodes
        window = int(scores[-1]) * 30 // 100, int(scores[-1]) * 60 // 100
        _, places, scores, verified = hard_negatives.descend(
            tree, row, made[row], row % 3, False, np.array([window[0]]), np.array([window[1]]), low, 10
        )
        other = np.flatnonzero((np.arange(len(made)) % 3 != row % 3) & (exact >= window[0]) & (exact <= window[1]))
        best = other[np.lexsort((other, -exact[other]))][:10]
        assert tree.vec_id[places].tolist() == best.tolist()
        assert verified < len(made) / 10


# --- language mixtures --------------------------------------------------------------------------


def test_languages_of_the_table(spark):
    rows = QUERIES["op11_language_id"](spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and 0.2 < len(held) / len(rows) < 0.3
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) > 0.99 * len(held)
    assert all(0 < r.score <= 1 and r.score == r.languages[0].share for r in rows if r.lang_pred != "und")


def mixture_by_hand(scores, penalty):
    """Plain loops: proportions by expectation-maximisation and the set of the best penalised likelihood."""
    n = len(scores[0])

    def proportions(chosen):
        share = [1 / len(chosen) if x in chosen else 0.0 for x in range(n)]
        for _ in range(language_mix.ROUNDS):
            new = [0.0] * n
            for word in scores:
                top = max(word)
                part = [share[x] * math.exp(word[x] - top) for x in range(n)]
                for x in range(n):
                    new[x] += part[x] / sum(part) / len(scores)
            moved = max(abs(a - b) for a, b in zip(share, new, strict=True))
            share = new
            if moved <= language_mix.TOLERANCE:
                break
        return share

    def likelihood(share):
        return sum(
            max(word) + math.log(max(1e-300, sum(s * math.exp(w - max(word)) for s, w in zip(share, word, strict=True))))
            for word in scores
        )

    order = sorted(range(n), key=lambda x, s=proportions(range(n)): -s[x])
    best, value = [1.0 if x == order[0] else 0.0 for x in range(n)], None
    value = likelihood(best)
    for k in range(2, n + 1):
        share = proportions(order[:k])
        now = likelihood(share) - penalty * (k - 1) * math.log(max(2, len(scores)))
        if now <= value:
            break
        best, value = share, now
    return best


def test_mixture_against_plain_loops():
    r = np.random.default_rng(6)
    lengths = [1, 2, 30, 60, 5, 120]
    parts = []
    for n in lengths:
        own = r.integers(0, 4, 2)  # words of one or two languages
        part = r.normal(size=(n, 4)) * 2 - 9
        part[np.arange(n), own[r.integers(0, 2, n)]] += 7
        parts.append(part)
    begin = np.cumsum([0, *lengths[:-1]])
    for penalty in (0.5, 3.0):
        got = language_mix.fit(np.concatenate(parts), begin, penalty)
        for share, part in zip(got, parts, strict=True):
            assert share == pytest.approx(mixture_by_hand(part.tolist(), penalty), abs=1e-6)


def test_triples_and_likelihoods_by_hand(spark):
    number, begin, of = language_mix.triples(["Ab, c3d", "", "É"])
    one = {w: language_mix.triples([w])[0].tolist() for w in ("ab", "c", "d", "é")}
    assert number.tolist() == one["ab"] + one["c"] + one["d"] + one["é"]
    assert begin.tolist() == [0, 2, 3, 4] and of.tolist() == [0, 0, 0, 2]
    rows = [(1, "aa bb aa", "x"), (4, "bb cc", "y"), (5, None, "x"), (6, "aa", None), (2, "zz", "x")]
    assert [zlib.crc32(b"%d" % n) % 4 for n in (1, 4, 6)].count(2) == 0
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_mix.learn(docs)
    held = zlib.crc32(b"2") % 4 == 2
    said = {"x": ["aa", "bb", "aa"] + ([] if held else ["zz"]), "y": ["bb", "cc"]}
    assert model.languages == ["x", "y"]
    counts = {
        lang: np.bincount(np.concatenate([language_mix.triples([w])[0] for w in words]), minlength=language_mix.TRIPLES)
        for lang, words in said.items()
    }
    own = {lang: c / c.sum() for lang, c in counts.items()}
    shared = 0.99 * (own["x"] + own["y"]) / 2 + 0.01 / language_mix.TRIPLES
    for n, lang in enumerate(model.languages):
        want = np.log((1 - language_mix.SHARED) * own[lang] + language_mix.SHARED * shared)
        assert np.allclose(model.log_probability[:, n], want, atol=1e-4)


def test_mixed_documents_get_their_proportions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_mix.learn(docs)
    alone = language_mix.identify(docs, model).filter("size(languages) = 1").select("doc_id")
    plain = docs.join(alone, "doc_id").orderBy("doc_id")  # some documents of the table are mixtures themselves
    whole = {
        lang: re.findall("[^\\W\\d_]{2,}", " ".join(r.text for r in plain.filter(F.col("lang") == lang).limit(4).collect()))
        for lang in ("de", "es", "fr")
    }
    mixed = [
        (1, " ".join(whole["de"][:300] + whole["es"][:100])),
        (2, " ".join(whole["fr"][:200] + whole["de"][:200] + whole["es"][:100])),
        (3, " ".join(whole["es"][:400])),
    ]
    frame = spark.createDataFrame(mixed, "doc_id long, text string")
    rows = {r.doc_id: {x.lang: x.share for x in r.languages} for r in language_mix.identify(frame, model).collect()}
    assert rows[1].keys() == {"de", "es"} and rows[1]["de"] == pytest.approx(0.75, abs=0.06)
    assert rows[2].keys() == {"fr", "de", "es"} and rows[2]["es"] == pytest.approx(0.2, abs=0.06)
    assert rows[3].keys() == {"es"}


def test_languages_of_odd_rows(spark, odd, empty):
    rows = language_mix.classify(odd).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        if r.doc_id == 3 or r.doc_id == 4:  # null and empty
            assert (r.lang_pred, r.score, r.languages) == ("und", 0.0, [])
        else:
            assert r.lang_pred in {"en", "de", "fr"} and 0 < r.score <= 1
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert language_mix.classify(empty).collect() == []
    signs = spark.createDataFrame([(1, "12 -- ½ ²", "en"), (4, LONG, "en")], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language_mix.classify(signs).orderBy("doc_id").collect()] == ["und", "en"]
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_mix.classify(unlabelled).collect()} == {"und"}
