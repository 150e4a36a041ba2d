"""Packing, mixing, line dedup, SimHash, the classifiers and the pipeline."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from payscope.llm import line_dedup, mixing, packing, quality, simhash, toxicity
from payscope.llm.components import components
from payscope.llm.oracle import OP5, OP8
from payscope.llm.queries import QUERIES
from tests.llm.conftest import ODD
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("name", ["op2_topk_search", "op5_mix_sources", "op8_line_dedup"])
def test_against_sql(spark, name):
    from payscope.llm.oracle import ORACLE

    problem, *_ = compare(spark, connect(SF), SF, name, QUERIES[name], ORACLE[name])
    assert problem is None


def in_duckdb(frame, sql):
    con = duckdb.connect()
    con.register("documents", frame.toPandas())
    return con.execute(sql).fetchdf()


# --- packing ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(VOCABULARY)
    made.encode_special_tokens = True
    return made


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(VOCABULARY)


def ids_of(encoder, text):
    return np.frombuffer(encoder(text), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.sampled_from(" \n\t.a'sé1Ⅷ½\x1c  _|"), st.characters(codec="utf-8"))))
def test_ids_of_any_text(tokenizer, encoder, text):
    assert ids_of(encoder, text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_of_documents(tokenizer, encoder):
    con = connect(SF)
    for (text,) in con.execute("SELECT text FROM documents").fetchall():
        for t in (text, " " + text, text.replace(". ", ".  "), text + "\n", "<|endoftext|>" + text):
            assert ids_of(encoder, t) == tokenizer.encode(t, add_special_tokens=False).ids


def test_pieces_and_places(spark, odd, empty, tokenizer):
    capacity = 64
    got = packing.packed_documents(odd, VOCABULARY, capacity).collect()
    want = Counter()
    for doc_id, text, *_ in ODD:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        at, k = 0, 0
        while at < len(ids):
            n = (len(ids) - at) % capacity or capacity
            crc = zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())
            want[doc_id, k, at, n, crc] += 1
            at, k = at + n, k + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert packing.packed_documents(empty, VOCABULARY).count() == 0


def test_ids_of_added_tokens(spark):
    from tokenizers import Tokenizer

    made, end = Tokenizer.from_file(VOCABULARY), "<|endoftext|>"
    texts = [f"x{end}y", end, end * 3, f"a  {end}\n b", f" {end} ", end[:-1], f"<|{end}|>", f"é😀 {end}" + " word" * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in packing.pieces(docs, VOCABULARY).orderBy("doc_id", "piece").collect():
        got[r.doc_id] = got.get(r.doc_id, []) + np.frombuffer(r.ids, "<u4").tolist()
    assert got == {n: [*made.encode(t, add_special_tokens=False).ids, 0] for n, t in enumerate(texts)}
    assert got[0] == [87, 50256, 88, 0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_best_fit_against_brute_force(lengths):
    lengths = sorted(lengths, reverse=True)
    rooms, used = [], []
    for n in lengths:
        fits = [(room, s) for s, room in enumerate(rooms) if room >= n]
        used.append(40 - min(fits)[0] if fits else 0)
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(40 - n)
    sequences, offsets = packing.best_fit(lengths, 40)
    assert offsets == used and len(set(sequences)) == len(rooms)


# --- mixing -------------------------------------------------------------------------------------


def test_mixing_odd_against_sql(odd, empty):
    got = mixing.mix(odd).toPandas()
    want = in_duckdb(odd.select("doc_id", "text", "source"), OP5)
    order = list(got.columns)
    left, right = (f[order].sort_values(order).reset_index(drop=True) for f in (got, want))
    pd.testing.assert_frame_equal(left.astype(float), right.astype(float))
    assert (got.taken <= 3 * got["size"]).all()
    assert mixing.mix(empty).count() == 0


def test_targets_fill_up(spark):
    sizes = {"a": 100, "b": 5000, "c": 10, "d": 900, "e": 0, None: 3000}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    weights = dict(zip(sorted(k for k in sizes if k), [5, 2, 1, 5, 2], strict=True)) | {None: 1}
    want, left, free = {}, float(sum(sizes.values())), set(sizes)
    while True:  # reshare the excess by weight until none is above
        unit = left / sum(weights[s] for s in free)
        above = {s for s in free if unit * weights[s] > 3 * sizes[s]}
        if not above:
            break
        want |= {s: 3.0 * sizes[s] for s in above}
        left -= sum(3 * sizes[s] for s in above)
        free -= above
    want |= {s: unit * weights[s] for s in free}
    assert got == pytest.approx(want)


def test_words_taken_come_near_the_targets(spark):
    frame = mixing.mix(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).toPandas()
    assert (frame.taken <= 3 * frame["size"]).all()
    frame["of"] = list(zip(frame.source_size, frame.target, strict=True))
    by = frame.groupby("of").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((by.taken / by.target - 1).abs() < 0.05).all()  # about 500 documents each


def test_mixed_rows_are_repeated(odd):
    taken = mixing.copies(odd).groupBy().sum("copies").first()[0]
    rows = mixing.mixed(odd)
    assert rows.count() == taken and rows.columns == odd.columns


# --- line dedup ---------------------------------------------------------------------------------


def test_lines_odd_against_sql(spark, odd, empty):
    # Identical rows are one document, and SQL's row identity is the id: leave repeats out there.
    once = odd.dropDuplicates(["doc_id"]).filter("doc_id IS NOT NULL")
    rows = line_dedup.digest(once).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = in_duckdb(once.select("doc_id", "text"), OP8).sort_values("doc_id").reset_index(drop=True)
    assert rows.n_deleted.tolist() == want.n_deleted.tolist()
    assert [t or "" for t in rows.text] == [t or "" for t in want.text]
    every = line_dedup.deduplicated(odd)
    assert every.count() == len(ODD) and every.columns == odd.columns
    assert every.filter("doc_id = 3").first().text is None
    assert line_dedup.digest(empty).count() == 0


def test_runs_of_lines(spark):
    passage = [f"line {n} of a passage that many documents share in full" for n in range(8)]
    rows = []
    for n in range(30):
        own = [f"own line {n} {k} with other words" for k in range(6)]
        rows.append((n, "\n".join(own[: n % 6] + passage + own[n % 6 :] + ["short line", "common"])))
    rows += [(50, "\n".join(passage[:3])), (51, "\n".join(["common"] * 120)), (52, "\n".join(passage + passage))]
    rows += [(60 + n, rows[5][1]) for n in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.text for r in line_dedup.digest(docs).collect()}
    want = in_duckdb(docs, OP8).set_index("doc_id").text.to_dict()
    assert got == want
    assert got[0] == rows[0][1] and all(p not in got[7] for p in passage) and got[50] == rows[30][1]
    assert "own line 7 0" in got[7] and "short line" in got[7] and got[60].strip() == ""


def test_line_dedup_is_native(spark, odd):
    plan = line_dedup.digest(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- SimHash ------------------------------------------------------------------------------------


def fingerprint_by_rule(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_rule(values, radius=4):
    """For each value the place of the first value reachable."""
    label = list(range(len(values)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    v = np.array(values, np.uint64)
    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v ^ v[i]) <= radius):
            a, b = root(i), root(int(j))
            label[max(a, b)] = min(a, b)
    return [root(x) for x in range(len(v))]


def test_simhash_odd_against_brute_force(odd, empty):
    got = simhash.digest(simhash.near_duplicates(odd)).collect()
    rows = sorted(((r[0], r[1] or "") for r in ODD), key=lambda r: (r[0] is None, r[0] or 0))
    prints = [fingerprint_by_rule(t) for _, t in rows]
    first = components_by_rule(prints)
    want = [(i, f"{p:016x}", rows[first[n]][0]) for n, ((i, _), p) in enumerate(zip(rows, prints, strict=True))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert simhash.near_duplicates(empty).count() == 0


def test_links_of_crowded_buckets(spark):
    r = np.random.default_rng(1)
    values = list(r.integers(0, 2**64, 30, dtype=np.uint64))
    for _ in range(1500):
        x = int(values[r.integers(0, len(values))])
        for b in r.integers(0, 64, r.integers(0, 6)):
            x ^= 1 << int(b)
        values.append(np.uint64(x))
    values = np.unique(np.array(values, np.uint64))
    frame = spark.createDataFrame([(int(x),) for x in values.view(np.int64)], "fp long")
    # Small chunks, so that buckets are compared in pairs of chunks.
    roots = components(simhash.links(frame, 4, chunk=100))
    got = {r.node: r.root for r in roots.collect()}
    by = {}
    for x in values.view(np.int64).tolist():
        by.setdefault(got.get(x, x), set()).add(x)
    want = {}
    for place, x in zip(components_by_rule(values), values.view(np.int64).tolist(), strict=True):
        want.setdefault(place, set()).add(x)
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("radius", [1, 3, 4])
def test_counters_stop_at_the_radius(radius):
    r = np.random.default_rng(2)
    v = r.integers(0, 2**64, 200, dtype=np.uint64)
    v[1::2] = v[::2] ^ np.uint64(0b10110)
    edges = simhash.forest(v, np.arange(len(v)), list(range(64)), radius)
    assert (len(edges) == 100) == (radius >= 3) and (radius >= 3 or not edges)


def test_components_of_chains_and_stars(spark):
    pairs = [(n, n + 1) for n in range(100, 140)] + [(0, n) for n in range(1, 30)] + [(29, 50), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: 100 for n in range(100, 141)} | {n: 0 for n in [*range(30), 50]}


def test_one_of_each_group_stays(odd):
    rows = simhash.one_of_each(odd).collect()
    assert Counter(fingerprint_by_rule(r.text or "") for r in rows).most_common(1)[0][1] == 1
    assert {fingerprint_by_rule(r.text or "") for r in rows} == {fingerprint_by_rule(r[1] or "") for r in ODD}


# --- classifiers --------------------------------------------------------------------------------


def rank_quality(scores, labels):
    ranks = pd.Series(scores).rank().to_numpy()
    one = np.array(labels) == 1
    return (ranks[one].sum() - one.sum() * (one.sum() + 1) / 2) / (one.sum() * (~one).sum())


@pytest.mark.parametrize(
    ("module", "label", "least"), [(quality, "quality", 0.98), (toxicity, "toxic", 0.9)]
)
def test_held_out_accuracy(spark, module, label, least):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    found = module.classify(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert rank_quality(found.score, found[label]) > least
    clean = found[found[label] == (1 if label == "quality" else 0)]
    assert (clean.predicted == (1 if label == "quality" else 0)).mean() > 0.98
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in found.doc_id)


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_odd_and_empty(spark, odd, empty, module, label):
    rows = [(n, n % 2, n % 2) for n in range(8)] + [(1, 0, 0), (None, 1, 1), (5, None, None), (77, 1, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    found = module.classify(odd, labels).collect()
    assert len(found) == len(ODD) and all(0 <= r.score <= 1 for r in found)
    assert module.classify(empty, labels).count() == 0
    assert module.classify(odd, labels.limit(0)).count() == len(ODD)


def test_ordinal_regression_orders_grades():
    r = np.random.default_rng(0)
    grades = np.arange(600) % toxicity.GRADES
    rows = [[int(r.integers(0, 5))] + [5 + k for k in range(g)] for g in grades]
    weights, thresholds = toxicity.ordinal_fit(rows, grades, 8, ridge=0.1)
    z = np.array([weights[x].sum() for x in rows])
    severity = (1 / (1 + np.exp(thresholds[None, :] - z[:, None]))).sum(axis=1)
    assert (np.diff(thresholds) > 0).all()
    assert all(abs(severity[grades == g].mean() - g) < 0.4 for g in range(toxicity.GRADES))


# --- pipeline -----------------------------------------------------------------------------------


def test_pipeline_stages_against_brute_force(spark, tokenizer):
    from payscope.llm.common import staged

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, staged(stage(spark, docs, SF), "test")
        seen[name] = (before.toPandas(), docs.toPandas())
        assert name == "pack" or docs.columns == columns

    before, after = seen["quality_filter"]
    scores = quality.classify(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).toPandas()
    assert sorted(after.doc_id) == sorted(scores[scores.predicted == 1].doc_id)

    before, after = seen["line_dedup"]
    want = duckdb.connect()
    want.register("documents", before)
    assert dict(zip(after.doc_id, after.text, strict=True)) == want.execute(OP8).fetchdf().set_index("doc_id").text.to_dict()

    before, after = seen["simhash"]
    before = before.sort_values("doc_id").reset_index(drop=True)
    first = components_by_rule([fingerprint_by_rule(t) for t in before.text])
    assert sorted(after.doc_id) == sorted(set(before.doc_id[first]))

    before, after = seen["mix_sources"]
    want = duckdb.connect()
    want.register("documents", before)
    mix = want.execute(OP5).fetchdf()
    mix = mix[mix["size"] > 0]
    n = Counter(after[after.text.str.strip() != ""].doc_id)
    assert n == Counter({i: t // s for i, t, s in zip(mix.doc_id, mix.taken, mix["size"], strict=True) if t})

    before, after = seen["pack"]
    sizes = sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in before.text)
    assert after.length.sum() == sizes and after.sequence_id.nunique() <= sizes / 2048 * 1.05 + 1


def test_pipeline_stages_odd_and_empty(spark, odd, empty):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SF).count() > 0
        assert stage(spark, empty, SF).count() == 0
