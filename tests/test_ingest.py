import gzip
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from payscope import schemas as S
from payscope.operators import gating, manifest, matching, rollups, typing, upsert
from payscope.plans import queries, testbed
from payscope.session import scratch_dir
from payscope.sources import filings as files
from payscope.sources import keyed, landing
from payscope.sources.dictionary import GLP1, load_dictionary
from payscope.sources.keyed import Conflict, KeyedTable
from payscope.sources.records import OPENS, STAYS
from payscope.sources.storage import stored_sizes
from payscope.streaming import ingest

ROW = {
    "program_year": "2023", "payment_date": "2023-04-15", "quarter": "2023Q2", "manufacturer": "m",
    "product": "p", "amount_usd": "100.50", "matched_field": "f", "source_year_dataset": "s",
}

def landed(spark, *rows):
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.LANDED.fields) + ", ingest_seq long"
    full = [{**dict.fromkeys(S.LANDED.names), **ROW, **r} for r in rows]
    return spark.createDataFrame([tuple(r.get(c) for c in [*S.LANDED.names, "ingest_seq"]) for r in full], schema)


def amounts(frame):
    return {r.record_id: float(r.amount_usd) for r in frame.collect()}


def test_upsert_twice_changes_nothing(spark):
    first = typing.good_rows(landed(spark, {"record_id": "a", "ingest_seq": 1}, {"record_id": "b", "ingest_seq": 2}))
    once = upsert.merge(upsert.latest(first).drop("ingest_seq").limit(0), first)
    twice = upsert.merge(once, first)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_reload_replaces_all_columns(spark):
    old = typing.good_rows(landed(spark, {"record_id": "a", "ingest_seq": 1, "physician_state": "CA"}))
    new = typing.good_rows(
        landed(spark, {"record_id": "a", "ingest_seq": 2, "amount_usd": "150.00", "program_year": "2024"})
    )
    row = upsert.merge(old.drop("ingest_seq"), new).first()
    assert (float(row.amount_usd), row.program_year, row.physician_state) == (150.0, 2024, None)


def test_hot_key_is_cut_before_the_shuffle(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("record_id"),
        F.col("id").alias("ingest_seq"),
    )
    newest = upsert.latest(rows)
    assert newest.filter("record_id = 'hot'").first().ingest_seq == 29_997 and newest.count() == 20_001
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_rows_are_typed_before_they_are_shuffled(spark):
    rows = [{"record_id": "r", "ingest_seq": n, "amount_usd": a} for n, a in enumerate(["1", " 2.5 ", "bad"])]
    made = upsert.latest_payments(landed(spark, *rows))
    above, below = made._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning")
    assert "cast(" not in above and "decimal(" in below
    assert amounts(made) == {"r": 2.5}


def test_gates(spark):
    manifests = spark.createDataFrame([(2021, True), (2022, False), (2023, None)], "year int, complete boolean")
    rows = spark.createDataFrame([("2021",), ("2022",), ("2023",), ("2024",), ("notes",)], "directory_year string")
    assert [r[0] for r in gating.complete_only(rows, manifests).collect()] == ["2021"]
    assert gating.complete_only(rows, manifests, years=[2022]).count() == 0
    wanted = gating.year_frame(spark, [2021, 2022, 2025])
    assert sorted(r.year for r in gating.years_to_do(wanted, manifests).collect()) == [2022, 2025]
    assert gating.years_to_do(wanted, manifests, force=True).count() == 3


def test_catalog_gate_from_file(spark, tmp_path):
    items = [
        {"title": "2023 General Payment Data", "identifier": "x", "modified": "m", "distribution": [{"downloadURL": "u"}]},
        {"title": "2024 General Payment Data", "identifier": "y", "distribution": []},
        {"title": "2025 general payment data", "identifier": "z", "distribution": [{"downloadURL": "u"}]},
    ]
    path = tmp_path / "items.json"
    path.write_text(json.dumps(items))
    out = gating.catalog_gate(gating.year_frame(spark, [2023, 2024, 2025]), files.read_catalog(spark, str(path)))
    assert {r.year: (r.status, r.download_url) for r in out.collect()} == {
        2023: ("ok", "u"), 2024: ("no download url", None), 2025: ("missing", None)}


def test_sizes(spark, tmp_path):
    for year, size in (("2021", 10), ("2022", 11)):
        os.makedirs(tmp_path / "raw", exist_ok=True)
        (tmp_path / "raw" / f"{year}.csv").write_bytes(b"x" * size)
    stored = stored_sizes(spark, str(tmp_path), key_depth=2)
    manifests = spark.createDataFrame(
        [(2021, "raw/2021.csv", 10), (2022, "raw/2022.csv", 10), (2023, "raw/2023.csv", 10), (2024, None, 10)],
        "year int, s3_key string, bytes long",
    )
    assert {r.year: r.status for r in gating.reconcile_sizes(manifests, stored).collect()} == {
        2021: "PASS", 2022: "WARN", 2023: "WARN"}


def write_csv(path, header, rows):
    quote = lambda v: '"' + str(v).replace('"', '""') + '"'
    path.write_text("\n".join(",".join(map(quote, r)) for r in [header, *rows]) + "\n", encoding="utf-8")


def test_wide_csv_by_name_over_years(spark, tmp_path):
    columns = [*S.FILING_COLUMNS, "Other_1", "Other_2"]
    one = {**dict.fromkeys(columns, ""), S.RECORD_ID: "1", S.PROGRAM_YEAR: "2023", S.PAYMENT_DATE: "2023-04-15",
           S.PAYER: 'Novo "N" Nordisk, é', S.AMOUNT: "5", S.NAME_FIELDS[0]: "Ozempic"}
    two = {**one, S.RECORD_ID: "2", S.PROGRAM_YEAR: "2024"}
    write_csv(tmp_path / "2023.csv", columns, [[one[c] for c in columns]])
    turned = columns[::-1]
    write_csv(tmp_path / "2024.csv", turned, [[two[c] for c in turned]])
    rows = files.read_filings(spark, [str(tmp_path / "2023.csv"), str(tmp_path / "2024.csv")])
    out = matching.land(rows, GLP1, F.lit("s"))
    good = {r.record_id: (r.program_year, r.manufacturer) for r in typing.good_rows(out).collect()}
    assert good == {"1": (2023, 'Novo "N" Nordisk, é'), "2": (2024, 'Novo "N" Nordisk, é')}
    assert "Other_1" not in rows._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def read_ids(spark, path):
    rows = files.read_filings(spark, [str(path)])
    return {r[S.RECORD_ID]: (r[S.RECIPIENT_STATE], r[S.NATURE]) for r in rows.collect()}


def test_files_of_a_folder_have_their_own_headers(spark, tmp_path):
    names = [S.RECORD_ID, S.RECIPIENT_STATE, S.NATURE]
    write_csv(tmp_path / "a.csv", names, [["1", "CA", "Food"]])
    write_csv(tmp_path / "b.csv", [names[2], names[0], "Other"], [["Travel", "2", "x"]])
    assert read_ids(spark, tmp_path) == {"1": ("CA", "Food"), "2": (None, "Travel")}


def test_line_breaks_within_quotes(spark, tmp_path):
    names = [S.RECORD_ID, S.RECIPIENT_STATE, S.NATURE]
    write_csv(tmp_path / "a.csv", names, [["1", "CA", 'Food\nand "more", drinks'], ["2", "NY", "x"]])
    write_csv(tmp_path / "b.csv", names, [["3", "TX", "y"]])
    assert read_ids(spark, tmp_path) == {
        "1": ("CA", 'Food\nand "more", drinks'), "2": ("NY", "x"), "3": ("TX", "y")}


def one_task_per_file(spark, path, names):
    """What Spark's own reader gives for whole files."""
    schema = ", ".join(f"`{n}` string" for n in names)
    rows = spark.read.csv(str(path), schema=schema, header=True, escape='"', multiLine=True, mode="DROPMALFORMED")
    return sorted(map(tuple, rows.collect()), key=str)


def test_files_with_line_breaks_are_read_by_many_tasks(spark, tmp_path):
    names = [S.RECORD_ID, S.RECIPIENT_STATE, S.NATURE]
    rng = random.Random(7)
    pieces = ["a", "\n", '"', ",", " ", '""', "\n\n", '",\n"', "é", '\n"', "x" * 50, "\r\n", ""]
    texts = {}
    for name, end in (("a.csv", "\n"), ("b.csv", "\r\n"), ("c.csv", "\n")):
        rows = []
        for n in range(600):
            cells = [f"{name}{n}", *("".join(rng.choices(pieces, k=rng.randrange(6))) for _ in range(2))]
            if name != "c.csv" or n not in (100, 500):  # long stretches without a break in c.csv
                cells[1:] = [c.replace("\n", "").replace("\r", "") for c in cells[1:]] if name == "c.csv" else cells[1:]
            else:
                cells[2] = "first\n" + '"second", third\n' * 400
            rows.append(cells)
            texts[cells[0]] = tuple(c or None for c in cells[1:])
        quoted = lambda c: '"' + c.replace('"', '""') + '"' if set(c) & set('",\r\n') or rng.random() < 0.3 else c
        (tmp_path / name).write_bytes(end.join(",".join(map(quoted, r)) for r in [names, *rows]).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = files.read_filings(spark, [str(tmp_path)])
        got = [(r[S.RECORD_ID], r[S.RECIPIENT_STATE], r[S.NATURE]) for r in rows.collect()]
        blocks = rows.groupBy("ingest_seq.file").agg(F.countDistinct("ingest_seq.block").alias("n")).collect()
        assert files.broken_filings(spark, [str(tmp_path)]).count() == 0
        kept = rows.orderBy("ingest_seq").select(S.RECORD_ID).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {g[0]: g[1:] for g in got} == texts and len(got) == 1800
    # Spark's reader takes "\\r\\n" in a cell for "\\n" where lines end so; here cells stay as they are.
    plain = lambda rows: sorted([tuple(c and c.replace("\r\n", "\n") for c in r) for r in rows], key=str)
    assert plain(got) == plain(one_task_per_file(spark, tmp_path, names))
    assert len(blocks) == 3 and all(b.n > 4 for b in blocks)
    assert [r[0] for r in kept] == [f"{f}{n}" for f in ("a.csv", "b.csv", "c.csv") for n in range(600)]


def ends_within_quotes(line, within):
    """Character by character: at a cell's start, in quotes, or in the rest of a cell."""
    state, n = "quoted" if within else "start", 0
    while n < len(line):
        c = line[n]
        if state == "quoted" and c == '"':
            if line[n + 1 : n + 2] == '"':
                n += 1
            else:
                state = "rest"
        elif state != "quoted":
            state = "start" if c == "," else "quoted" if c == '"' and state == "start" else "rest"
        n += 1
    return state == "quoted"


def test_a_line_is_a_step_between_two_states(spark):
    rng = random.Random(3)
    lines = ["".join(rng.choices('"",a \r', k=rng.randrange(14))) for _ in range(3000)]
    lines += ['"' + 'a""' * 100_000, "," * 200_000 + '"', 'x,"y",' * 50_000, '"","' * 50_000 + "a"]
    frame = spark.createDataFrame(list(enumerate(lines)), "n int, value string")
    got = frame.select("n", F.col("value").rlike(OPENS), F.col("value").rlike(STAYS)).collect()
    for n, opens, stays in got:
        assert (opens, stays) == (ends_within_quotes(lines[n], False), ends_within_quotes(lines[n], True)), lines[n][:40]


def test_a_quotation_that_is_never_closed(spark, tmp_path):
    head = ",".join([S.RECORD_ID, S.RECIPIENT_STATE, S.NATURE])
    (tmp_path / "a.csv").write_text(f'{head}\n1,CA,"x\ny"\n2,NY,"z\n3,TX,z\n\n4,TX,z\n')
    (tmp_path / "b.csv").write_text(f'{head}\n5,CA,"x\ny",more\n6,5" pipe,"x\n\ny"\n')
    assert read_ids(spark, tmp_path) == {"1": ("CA", "x\ny"), "6": ('5" pipe', "x\n\ny")}
    broken = [r.record for r in files.broken_filings(spark, [str(tmp_path)]).collect()]
    assert sorted(broken) == ['2,NY,"z', "3,TX,z", "4,TX,z", '5,CA,"x\ny",more']


def test_broken_records_are_kept_apart(spark, tmp_path):
    (tmp_path / "a.csv").write_text(f"{S.RECORD_ID},{S.RECIPIENT_STATE},{S.NATURE}\n1,CA,x\n2,NY\n3,TX,y,z\n")
    assert read_ids(spark, tmp_path) == {"1": ("CA", "x")}
    assert sorted(r.record for r in files.broken_filings(spark, [str(tmp_path)]).collect()) == ["2,NY", "3,TX,y,z"]


def test_later_paths_and_rows_are_written_later(spark, tmp_path):
    names = [S.RECORD_ID, S.RECIPIENT_STATE, S.NATURE]
    write_csv(tmp_path / "z.csv", names, [["1", "old", ""], ["2", "old", ""], ["2", "newer", ""]])
    write_csv(tmp_path / "a.csv", names, [["1", "newest", ""]])
    rows = files.read_filings(spark, [str(tmp_path / "z.csv"), str(tmp_path / "a.csv")])
    assert rows.select("ingest_seq").distinct().count() == rows.count() == 4
    kept = upsert.latest(rows, S.RECORD_ID)
    assert {r[S.RECORD_ID]: r[S.RECIPIENT_STATE] for r in kept.collect()} == {"1": "newest", "2": "newer"}


def test_order_of_paths_of_which_one_begins_the_other(spark, tmp_path):
    names = [S.RECORD_ID, S.RECIPIENT_STATE, S.NATURE]
    folders = ["2023b", "2023", "2023 and + more%41", "deep/2023"]
    for n, name in enumerate(folders):
        os.makedirs(tmp_path / name)
        write_csv(tmp_path / name / "x.csv", names, [["1", f"state {n}", ""], [f"only {n}", "x", ""]])
    for order in (folders, folders[::-1], folders[2:] + folders[:2]):
        rows = files.read_filings(spark, [str(tmp_path / f) for f in order])
        assert rows.count() == 8
        kept = {r[S.RECORD_ID]: r[S.RECIPIENT_STATE] for r in upsert.latest(rows, S.RECORD_ID).collect()}
        assert kept["1"] == f"state {folders.index(order[-1])}"
        places = {r[0]: r[1] for r in rows.select(S.RECORD_ID, "ingest_seq.path").collect() if r[0] != "1"}
        assert places == {f"only {folders.index(f)}": n for n, f in enumerate(order)}
    got = files.read_filings(spark, [f"file://{tmp_path}/2023/x.csv", f"file:{tmp_path}/deep"])
    assert {r[0]: r[1] for r in got.select(S.RECORD_ID, "ingest_seq.path").collect()}["only 1"] == 0


def test_a_few_paths_and_many_give_the_same_places(spark, tmp_path, monkeypatch):
    names = ["a", "a b", "a+b", "a%20b", "a/inner", "é"]
    for name in names:
        spark.createDataFrame([(name,)], "value string").coalesce(1).write.mode("append").text(str(tmp_path / name))
    paths = [str(tmp_path / "a"), *(str(tmp_path / n) + "/" for n in names[1:4]), f"file:{tmp_path}/a//inner", str(tmp_path)]
    for order in (paths[:-1], paths[::-1], paths[3:5]):
        got = []
        for few in (files.FEW_PATHS, 0):
            monkeypatch.setattr(files, "FEW_PATHS", few)
            rows = spark.read.text([str(tmp_path / n) for n in names if n != "a/inner"], recursiveFileLookup=True).select(
                "value", files.write_order(order).path.alias("path"))
            # A few are plain comparisons: nothing is taken apart or decoded row by row.
            assert ("transform" in rows._jdf.queryExecution().executedPlan().toString()) == (few == 0)
            got.append({r.value: r.path for r in rows.collect()})
            monkeypatch.undo()
        assert got[0] == got[1] and len(got[0]) == len(names) and len(set(got[0].values())) > 1


def test_landing_and_gzip_json(spark, tmp_path):
    year = tmp_path / "in" / "directory_year=2023"
    os.makedirs(year)
    with gzip.open(year / "matched.jsonl.gz", "wt") as out:
        out.write(json.dumps({"record_id": "a", **ROW, "matched_slot_count": 2}) + "\n\n")
        out.write(json.dumps({"record_id": "b", **ROW}) + "\n")
    rows = files.read_landed_json(spark, str(tmp_path / "in"))
    assert sorted(r.record_id for r in typing.good_rows(rows).collect()) == ["a", "b"]
    target = str(tmp_path / "out")
    rows = rows.drop("ingest_seq")
    files.write_landed(rows.drop("directory_year"), target)
    files.write_landed(landed(spark, {"record_id": "c", "program_year": "2024"}).drop("ingest_seq"), target)
    files.write_landed(rows.drop("directory_year").filter("record_id = 'a'"), target)
    stored = spark.read.parquet(target)
    assert sorted((r.record_id, r.directory_year) for r in stored.collect()) == [("a", 2023), ("c", 2024)]
    manifests = spark.createDataFrame([(2024, True)], "year int, complete boolean").filter("complete")
    plan = gating.complete_only(stored, manifests)
    assert [r.record_id for r in plan.collect()] == ["c"]


def test_manifest_files(spark, tmp_path):
    doc = {"year": 2023, "complete": True, "rows_matched": 3, "matched_by_product": {"Ozempic": 2, "Wegovy": 1},
           "matched_by_manufacturer": {"(unknown)": 3}, "error": None}
    (tmp_path / "manifest.json").write_text(json.dumps(doc, indent=2))
    read = files.read_manifests(spark, str(tmp_path / "manifest.json"))
    counts = {(r.kind, r.name): r.rows_matched for r in manifest.counts_from_manifests(read).collect()}
    assert counts == {("product", "Ozempic"): 2, ("product", "Wegovy"): 1, ("manufacturer", "(unknown)"): 3}
    assert [r.year for r in gating.complete_years(read).collect()] == [2023]


def test_dictionary_file(spark, tmp_path):
    doc = {"generic_names": ["A"], "brand_names": ["B"], "brand_to_generic": {"B": "A"},
           "manufacturers_of_record": ["M"], "manufacturer_sanity_check": {"threshold_pct": 7}}
    (tmp_path / "products.json").write_text(json.dumps(doc))
    words = load_dictionary(spark, str(tmp_path / "products.json"))
    assert words.terms == ["a", "b"] and words.generic_of() == {"a": "a", "b": "A"}
    assert words.other_share_threshold_pct == 7.0


def test_one_payment_end_to_end(spark):
    rows = typing.good_rows(
        landed(spark, {"record_id": "a", "amount_usd": "250.00", "nature_of_payment": "Food and Beverage"})
    )
    assert rollups.total_dollars(rows, 2021, 2025).first().total_usd == 250.0
    share = rollups.share_of(rows, F.col("nature_of_payment") == "Food and Beverage", "pct")
    assert share.first().pct == 100.0
    assert rollups.total_dollars(rows, 1990, 1991).first().total_usd is None
    assert rollups.share_of(rows, F.col("nature_of_payment") == "Travel", "pct").first().pct is None


def stream_in(spark, base, batches, per_trigger=1):
    schema = batches[0].schema
    for i, batch in enumerate(batches):
        batch.coalesce(1).write.mode("append").parquet(f"{base}/landing")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{base}/landing")
    ingest.start_ingest(stream, f"{base}/table", f"{base}/checkpoint").awaitTermination()


def totals(frame):
    return {r.quarter: (r.total_usd, r.payment_count) for r in frame.collect()}


def test_stream_equals_batch_and_restarts(spark):
    rng = random.Random(2)
    rows = [
        {"record_id": f"r{rng.randrange(25)}", "quarter": rng.choice(["2023Q1", "2023Q2", None]),
         "amount_usd": rng.choice(["1.10", "2.25", "bad", "30"]), "ingest_seq": i}
        for i in range(120)
    ]
    base = scratch_dir(spark, "test-stream")
    parts = [landed(spark, *rows[i : i + 20]) for i in range(0, 80, 20)]
    stream_in(spark, base, parts)
    late = [landed(spark, *rows[80:]), landed(spark, *rows[:10])]  # new rows, and old ones again
    stream_in(spark, base, late)
    want = upsert.latest(typing.good_rows(landed(spark, *rows)))
    table = f"{base}/table"
    assert amounts(ingest.current(spark, table)) == amounts(want)
    by_quarter = rollups.dollars_per_quarter(want).collect()
    got = totals(ingest.quarter_totals(spark, table))
    assert {r.quarter: pytest.approx(r.total_usd) for r in by_quarter} == {q: v[0] for q, v in got.items() if q}
    assert sum(v[1] for v in got.values()) == want.count()

    # The last batch once more, as after a lost commit: nothing changes.
    (source, newest), = ingest.payments_table(spark, table).commit().applied.items()
    ingest.apply_batch(landed(spark, {"record_id": "r1", "ingest_seq": 999}), newest, table, source)
    assert totals(ingest.quarter_totals(spark, table)) == got

    ingest.compact(spark, table, f"{base}/compacted", n_buckets=3)
    assert amounts(ingest.current(spark, f"{base}/compacted")) == amounts(want)
    assert totals(ingest.quarter_totals(spark, f"{base}/compacted")) == got


def test_streams_go_on_after_compaction_and_side_by_side(spark):
    base = scratch_dir(spark, "test-compaction")
    stream_in(spark, base, [landed(spark, *({"record_id": f"a{i}", "ingest_seq": i} for i in range(9)))])
    ingest.compact(spark, f"{base}/table", f"{base}/second/table", n_buckets=4)
    # Streams with checkpoints of their own: their first batches are number 0 as well.
    for name in "bc":
        parts = [landed(spark, *({"record_id": f"{name}{i}", "ingest_seq": i} for i in range(n, n + 5))) for n in (0, 5)]
        for part in parts:
            part.coalesce(1).write.mode("append").parquet(f"{base}/landing-{name}")
        stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/landing-{name}")
        ingest.start_ingest(stream, f"{base}/second/table", f"{base}/checkpoint-{name}").awaitTermination()
    rows = amounts(ingest.current(spark, f"{base}/second/table"))
    assert sorted(rows) == sorted([f"a{i}" for i in range(9)] + [f"{n}{i}" for n in "bc" for i in range(10)])


def test_a_correction_leaves_its_old_quarter(spark):
    base = scratch_dir(spark, "test-corrections")
    first = [{"record_id": "a", "quarter": "2023Q1", "ingest_seq": 1, "amount_usd": "5"},
             {"record_id": "b", "quarter": "2023Q2", "ingest_seq": 2, "amount_usd": "7"},
             {"record_id": "c", "quarter": None, "ingest_seq": 3, "physician_state": "CA"}]
    ingest.apply_batch(landed(spark, *first), 0, base, "s", ingest.VIEWS)
    later = [{"record_id": "a", "quarter": "2023Q2", "ingest_seq": 5, "amount_usd": "6"},
             {"record_id": "b", "quarter": "2023Q4", "ingest_seq": 1},  # older than what is there
             {"record_id": "c", "quarter": None, "ingest_seq": 4, "physician_state": "NY", "amount_usd": "bad"}]
    ingest.apply_batch(landed(spark, *later), 1, base, "s")
    assert totals(ingest.quarter_totals(spark, base)) == {"2023Q2": (13.0, 2), None: (100.5, 1)}
    current = ingest.current(spark, base)
    for name, made in [("q_totals", rollups.quarterly_totals), ("q_by_state", rollups.quarterly_by_state),
                       ("q_by_specialty", rollups.quarterly_by_specialty)]:
        kept, whole = ingest.kept_view(spark, base, name), made(current)
        assert kept.columns == whole.columns
        assert sorted(map(str, kept.collect())) == sorted(map(str, whole.collect()))
    ingest.register_kept_views(spark, base)
    assert spark.sql("SELECT sum(total_usd) FROM q_totals").first()[0] == 113.5


def test_a_batch_reads_and_writes_its_buckets_only(spark):
    base = scratch_dir(spark, "test-buckets")
    table = ingest.payments_table(spark, base, n_buckets=32)
    rows = [{"record_id": f"r{n}", "ingest_seq": n} for n in range(200)]
    table.merge(upsert.latest_payments(landed(spark, *rows)).select(*S.PAYMENT.names, "ingest_seq"), "s", 0)
    before = table.commit()
    assert len(before.buckets) == 32
    one = {"record_id": "r7", "ingest_seq": 900, "amount_usd": "1"}
    (bucket,) = typing.good_rows(landed(spark, one)).select(table._bucket(32)).first()
    # All other buckets can be out of reach: the batch goes in all the same.
    folder = f"{base}/data/batch={before.buckets[str(bucket)]}"
    os.makedirs(f"{base}/away")
    for name in os.listdir(folder):
        if name.startswith("bucket=") and name != f"bucket={bucket}":
            os.rename(f"{folder}/{name}", f"{base}/away/{name}")
    ingest.apply_batch(landed(spark, one), 1, base, "s")
    for name in os.listdir(f"{base}/away"):
        os.rename(f"{base}/away/{name}", f"{folder}/{name}")
    after = table.commit()
    assert {b for b in after.buckets if after.buckets[b] != before.buckets[b]} == {str(bucket)}
    plan = ingest.current(spark, base)
    assert len(plan.inputFiles()) == 32 and "Window" not in plan._jdf.queryExecution().executedPlan().toString()
    assert amounts(plan) == {f"r{n}": 1.0 if n == 7 else 100.5 for n in range(200)}


def test_buckets_grow_in_number_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(keyed, "BUCKET_ROWS", 10)
    base = scratch_dir(spark, "test-growth")
    table = ingest.payments_table(spark, base, n_buckets=2)

    def batch(number, ids, amount):
        rows = [{"record_id": f"r{n}", "ingest_seq": number, "amount_usd": amount, "quarter": f"2023Q{number + 1}"} for n in ids]
        ingest.apply_batch(landed(spark, *rows), number, base, "s")
        return table.commit()

    assert batch(0, range(20), "1").n_buckets == 2
    before = batch(1, range(15, 60), "2")  # at most 65 rows: room for twice as many
    assert before.n_buckets == 13 and before.n_rows == 60 and len(before.buckets) > 2
    after = batch(2, [59, 60], "3")  # one bucket or two, as before
    assert after.n_buckets == 13 and after.n_rows == 61
    assert len([b for b in after.buckets if after.buckets[b] != before.buckets.get(b)]) <= 2
    assert amounts(ingest.current(spark, base)) == {f"r{n}": 1.0 if n < 15 else 2.0 if n < 59 else 3.0 for n in range(61)}
    assert totals(ingest.quarter_totals(spark, base)) == {"2023Q1": (15.0, 15), "2023Q2": (88.0, 44), "2023Q3": (6.0, 2)}
    largest = max(spark.read.parquet(f"{base}/data/batch={f}/bucket={b}").count() for b, f in after.buckets.items())
    assert largest < 20


@pytest.mark.parametrize("cells", [1, 1_024])  # rows are dealt as they come; rows are reduced before
def test_a_merge_in_rounds_equals_one_write(spark, monkeypatch, cells):
    for name, value in [("BUCKET_ROWS", 8), ("ROUND_BUCKETS", 1), ("CELLS", cells)]:
        monkeypatch.setattr(keyed, name, value)  # 32 rows in a round on 4 cores
    base = scratch_dir(spark, "test-rounds")
    table = ingest.payments_table(spark, base, n_buckets=5)
    rng, newest, rounds = random.Random(5), KeyedTable._newest, []
    rows = [
        {"record_id": f"r{rng.randrange(150)}", "quarter": rng.choice(["2023Q1", "2023Q2", None]),
         "amount_usd": rng.choice(["1.10", "2.25", "bad", "30"]), "ingest_seq": rng.randrange(10**9)}
        for _ in range(180)
    ]

    def watched(self, commit, incoming, buckets, n_buckets, spread):
        rounds.append((commit.version, n_buckets, spread))
        return newest(self, commit, incoming, buckets, n_buckets, spread)

    monkeypatch.setattr(KeyedTable, "_newest", watched)
    for number, part in enumerate((rows[:70], rows[70:])):
        good = typing.good_rows(landed(spark, *part)).select(*S.PAYMENT.names, "ingest_seq")
        table.merge(good, "s", number)
        done = upsert.latest(typing.good_rows(landed(spark, *rows[: rows.index(part[-1]) + 1])))
        assert amounts(ingest.current(spark, base)) == amounts(done) and table.commit().n_rows == done.count()
        want = done.groupBy("quarter").agg(F.sum("amount_usd"), F.count("*")).collect()
        assert totals(ingest.quarter_totals(spark, base)) == {q: (float(usd), n) for q, usd, n in want}
    assert min(sum(r[0] == version for r in rounds) for version in (0, 1)) >= 2
    grown = [{r[1] for r in rounds if r[0] == version} for version in (0, 1)]
    assert all(len(n) == 1 for n in grown) and 5 < min(grown[0]) < min(grown[1])
    assert {r[2] for r in rounds} == {cells == 1}


def test_a_record_with_many_rows_is_noticed(spark, monkeypatch):
    monkeypatch.setattr(keyed, "BUCKET_ROWS", 10)
    table = ingest.payments_table(spark, scratch_dir(spark, "test-spread"))
    rows = spark.range(60_000).select(F.col("id").cast("string").alias("record_id"))
    hot = rows.select(F.when(F.col("record_id") % 50 == 0, "hot").otherwise(F.col("record_id")).alias("record_id"))
    assert table._spread(rows, 60_000) and not table._spread(hot, 60_000)


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for folder in folders for _, _, files in os.walk(folder) for f in files if f.startswith("shuffle_")}


def write_lines(spark, folder):
    lines = spark.range(400).select(
        (F.col("id") % 60).alias("l_orderkey"), (F.col("id") % 37).alias("l_partkey"),
        (F.col("id") % 7).alias("l_suppkey"), (F.col("id") % 4).cast("int").alias("l_linenumber"),
        (F.col("id") / 4).alias("l_extendedprice"), F.lit("R").alias("l_returnflag"), F.lit("F").alias("l_linestatus"),
        F.timestamp_seconds(F.col("id") * 2_000_000).alias("l_shipdate"))
    lines.write.parquet(f"{folder}/lineitem.parquet")


def test_a_stream_leaves_one_version_and_no_shuffle_files(spark, tmp_path):
    write_lines(spark, tmp_path)
    before = shuffle_files(spark)
    table = queries._ingested(spark, str(tmp_path))
    for _ in range(100):  # they are deleted in the background
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    commit = ingest.payments_table(spark, table).commit()
    assert commit.version == 3 and sum(commit.n_rows == n for n in (60, 60 * 4)) == 1
    held = {n.removeprefix("batch=") for n in os.listdir(f"{table}/data")}
    assert held == {*commit.buckets.values()} and os.listdir(f"{table}/views") == [commit.sums]
    rows = upsert.latest_payments(testbed.line_payments(spark, str(tmp_path)))
    assert amounts(ingest.current(spark, table)) == amounts(rows)


def test_lines_are_dealt_before_they_are_wide(spark, tmp_path):
    write_lines(spark, tmp_path)
    dealt, plain = (testbed.line_payments(spark, str(tmp_path), n) for n in (5, 0))
    (exchange,) = [x for x in dealt._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x]
    assert "l_partkey" in exchange and dealt.rdd.getNumPartitions() == 5
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("record_id") < plan.index("RepartitionByExpression")
    assert sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect()))


def test_a_retired_version_takes_no_file_of_the_next(spark):
    base = scratch_dir(spark, "test-retire")
    table = ingest.payments_table(spark, base, n_buckets=8)
    rows = [{"record_id": f"r{n}", "ingest_seq": n} for n in range(60)]
    ingest.apply_batch(landed(spark, *rows), 0, base, "s", keep=1)
    first = table.commit()
    ingest.apply_batch(landed(spark, {"record_id": "r7", "ingest_seq": 99, "amount_usd": "1"}), 1, base, "s", keep=1)
    (folder,), second = {*first.buckets.values()}, table.commit()
    (moved,) = [b for b in second.buckets if second.buckets[b] != folder]
    kept = {n for n in os.listdir(f"{base}/data/batch={folder}") if n.startswith("bucket=")}
    assert kept == {f"bucket={b}" for b in first.buckets if b != moved} and os.listdir(f"{base}/views") == [second.sums]
    assert amounts(ingest.current(spark, base)) == {f"r{n}": 1.0 if n == 7 else 100.5 for n in range(60)}
    # Without `keep` every version can still be read.
    ingest.apply_batch(landed(spark, {"record_id": "r8", "ingest_seq": 99, "amount_usd": "2"}), 2, base, "s")
    assert amounts(table.rows(table.commit(2)))["r8"] == 100.5 and amounts(table.current())["r8"] == 2.0
    ingest.apply_batch(landed(spark, {"record_id": "r8", "ingest_seq": 99, "amount_usd": "3"}), 2, base, "s", keep=2)
    assert table.commit().version == 3 and amounts(table.rows(table.commit(2)))["r8"] == 100.5


@pytest.mark.parametrize("name, n_files", [("_ingested", 6), ("_ingested_filings", 4)])
def test_landing_files_grow_in_number_and_batches_do_not(spark, monkeypatch, name, n_files):
    monkeypatch.setattr(queries, "LANDING_FILE_ROWS", 100)
    table = getattr(queries, name)(spark, "/root/testdata/sf0.001")
    files = spark.read.parquet(f"{table}/../landing").groupBy("_metadata.file_path").count().collect()
    total = sum(r["count"] for r in files)
    assert len(files) >= 0.9 * total // 100 and max(r["count"] for r in files) < 400
    (last,) = ingest.payments_table(spark, table).commit().applied.values()
    assert last + 1 <= n_files // 2


def test_a_writer_that_breaks_off_leaves_no_trace(spark, monkeypatch):
    base = scratch_dir(spark, "test-broken")
    table = ingest.payments_table(spark, base)
    rows = typing.good_rows(landed(spark, {"record_id": "a", "ingest_seq": 1}, {"record_id": "b", "ingest_seq": 2}))
    rows = rows.select(*S.PAYMENT.names, "ingest_seq")
    assert table.current() is None and table.merge(rows, "s", 0) == 1
    opened = table.current()

    def broken(self, commit):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "publish", broken)
        with pytest.raises(OSError):
            table.merge(rows.withColumn("amount_usd", F.lit("1").cast(S.AMOUNT_TYPE)).withColumn(
                "ingest_seq", F.lit(9).cast("long")), "s", 1)
    assert table.commit().version == 1 and amounts(table.current()) == amounts(opened) == {"a": 100.5, "b": 100.5}
    newer = rows.filter("record_id = 'a'").withColumns(
        {"amount_usd": F.lit("3").cast(S.AMOUNT_TYPE), "ingest_seq": F.lit(9).cast("long")})
    assert table.merge(newer, "s", 1) == 2 and table.merge(newer, "s", 1) == 2
    assert amounts(table.current()) == {"a": 3.0, "b": 100.5}
    assert amounts(opened) == {"a": 100.5, "b": 100.5}  # a reader keeps the version it opened
    gone = table.vacuum()
    assert len([g for g in gone if g.startswith("data/")]) == 1 and not os.listdir(f"{base}/work")
    assert amounts(table.current()) == {"a": 3.0, "b": 100.5}


def test_two_writers_both_get_in(spark, monkeypatch):
    base = scratch_dir(spark, "test-writers")
    table = ingest.payments_table(spark, base)
    one, two = (
        typing.good_rows(landed(spark, {"record_id": r, "ingest_seq": 1})).select(*S.PAYMENT.names, "ingest_seq")
        for r in "ab"
    )
    publish, waiting = KeyedTable.publish, [two]

    def slow(self, commit):
        if waiting:  # the other writer is first
            table.merge(waiting.pop(), "second")
        publish(self, commit)

    monkeypatch.setattr(KeyedTable, "publish", slow)
    assert table.merge(one, "first") == 2
    assert sorted(amounts(table.current())) == ["a", "b"]
    with pytest.raises(Conflict):
        publish(table, table.commit())


def test_filings_as_a_stream(spark):
    base = scratch_dir(spark, "test-filings")
    text = {c: "" for c in S.FILING_COLUMNS}
    rows = [{**text, S.RECORD_ID: str(i), S.PROGRAM_YEAR: "2023", S.PAYMENT_DATE: "2023-04-15", S.PAYER: "m",
             S.AMOUNT: "2", S.NAME_FIELDS[0]: "Ozempic" if i % 2 else "Humira"} for i in range(10)]
    spark.createDataFrame([tuple(r[c] for c in S.FILING_COLUMNS) for r in rows], S.FILING).write.csv(
        f"{base}/landing", header=True)
    stream = spark.readStream.schema(S.FILING).option("header", True).csv(f"{base}/landing")

    def to_landed(batch):
        return matching.land(batch, GLP1, F.lit("s")).withColumn("ingest_seq", F.col("record_id").cast("long"))

    ingest.start_ingest(stream, f"{base}/table", f"{base}/cp", to_landed).awaitTermination()
    assert amounts(ingest.current(spark, f"{base}/table")) == {str(i): 2.0 for i in range(1, 10, 2)}


def write_year(folder, year, ids, product="Ozempic", amount="5"):
    os.makedirs(folder, exist_ok=True)
    rows = [{**dict.fromkeys(S.FILING_COLUMNS, ""), S.RECORD_ID: i, S.PROGRAM_YEAR: str(year), S.PAYER: "m",
             S.PAYMENT_DATE: f"{year}-04-15", S.AMOUNT: amount, S.NAME_FIELDS[0]: product} for i in ids]
    write_csv(folder / "a.csv", S.FILING_COLUMNS, [[r[c] for c in S.FILING_COLUMNS] for r in rows])


def markers(spark, root):
    return {r.year: r for r in landing.manifests(spark, root).collect()}


def test_years_are_landed_by_themselves_where_one_breaks(spark, tmp_path):
    root = str(tmp_path / "lake")
    sources = {y: [str(tmp_path / f"in {y}")] for y in (2021, 2022, 2023, 2024)}
    for year in (2021, 2022):
        write_year(tmp_path / f"in {year}", year, ["same", f"r{year}", f"bad{year}"], amount=str(year))
    with open(tmp_path / "in 2021" / "b.csv", "w") as out:  # a record too short, and one without a match
        out.write(f"{S.RECORD_ID},{S.NATURE}\nshort\nplain,x\n")
    os.makedirs(tmp_path / "in 2023")
    (tmp_path / "in 2023" / "a.csv.gz").write_text("no gzip")  # fails while it is read
    got = {r.year: r for r in landing.land_years(spark, sources, GLP1, root).collect()}
    assert {y: (m.complete, m.run) for y, m in got.items()} == {
        2021: (True, 1), 2022: (True, 1), 2023: (False, 1), 2024: (False, 1)}
    first = got[2021]
    assert (first.rows_scanned, first.rows_broken, first.rows_matched, first.rows_loadable) == (4, 1, 3, 3)
    assert "in 2024" in got[2024].error and got[2023].error and not first.error
    read = landing.read_years(spark, root)
    assert sorted((r.record_id, r.directory_year) for r in read.collect()) == sorted(
        (i, y) for y in (2021, 2022) for i in ("same", f"r{y}", f"bad{y}"))
    assert sorted(r.year for r in gating.complete_years(landing.manifests(spark, root)).collect()) == [2021, 2022]

    table = ingest.payments_table(spark, str(tmp_path / "table"))
    assert landing.load_years(spark, root, table) == 1 == landing.load_years(spark, root, table)
    assert amounts(table.current()) == {"same": 2022.0, "r2021": 2021.0, "r2022": 2022.0, "bad2021": 2021.0,
                                        "bad2022": 2022.0}  # of one record the later year wins

    # The missing years alone are done again; what is complete is not even looked at.
    os.remove(tmp_path / "in 2023" / "a.csv.gz")
    write_year(tmp_path / "in 2023", 2023, ["r2023", "bad2023"], amount="abc")
    write_year(tmp_path / "in 2024", 2024, ["other"], product="Humira")
    (tmp_path / "in 2021" / "a.csv").unlink()
    again = {r.year: r for r in landing.land_years(spark, sources, GLP1, root).collect()}
    assert again[2021] == first and [again[y].run for y in (2021, 2022, 2023, 2024)] == [1, 1, 2, 2]
    assert (again[2023].rows_matched, again[2023].rows_loadable, again[2023].rows_rejected) == (2, 0, 2)
    assert (again[2024].complete, again[2024].rows_scanned, again[2024].rows_matched) == (True, 1, 0)
    landing.load_years(spark, root, table)
    assert table.commit().counts == {"landing": {"rows_seen": 8, "rows_upserted": 6, "rows_rejected": 2}}

    # A forced landing of an earlier year is the later one; one that fails takes nothing away.
    write_year(tmp_path / "in 2021", 2021, ["same"], amount="7")
    landing.land_years(spark, {2021: sources[2021], 2022: [str(tmp_path / "gone")]}, GLP1, root, force=True)
    forced = markers(spark, root)
    assert (forced[2021].run, forced[2021].rows_matched, forced[2022].run, forced[2022].complete) == (3, 1, 1, True)
    assert "gone" in forced[2022].error
    landing.load_years(spark, root, table)
    assert amounts(table.current())["same"] == 7.0
    assert sorted(r.record_id for r in landing.read_years(spark, root, [2021]).collect()) == ["same"]


def test_a_landing_that_breaks_off_leaves_no_trace(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "lake")
    write_year(tmp_path / "in", 2021, ["a"])
    with monkeypatch.context() as m:
        m.setattr(landing, "put_text", lambda *_, **__: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            landing.land_years(spark, {2021: [str(tmp_path / "in")]}, GLP1, root)
    assert os.listdir(f"{root}/data") and not markers(spark, root) and landing.read_years(spark, root).count() == 0
    landing.land_years(spark, {2021: [str(tmp_path / "in")]}, GLP1, root)
    assert landing.read_years(spark, root).count() == 1
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "a.csv").write_text("")
    done = landing.land_years(spark, {2021: [str(tmp_path / "in")], 2025: [str(tmp_path / "empty")]}, GLP1, root)
    assert {r.year: (r.complete, r.rows_scanned) for r in done.collect()} == {2021: (True, 1), 2025: (True, 0)}


def test_statistics_come_with_the_load(spark):
    base = scratch_dir(spark, "test-statistics")
    rows = [{"record_id": f"r{n % 7}", "ingest_seq": n, "amount_usd": "bad" if n % 3 == 0 else "1"} for n in range(20)]
    for n, part in enumerate((rows[:8], rows[8:])):
        ingest.apply_batch(landed(spark, *part), n, base, "a")
        ingest.apply_batch(landed(spark, *part), n, base, "a")  # repeated: counted once
    ingest.apply_batch(landed(spark, *rows[:3]), 0, base, "b")
    ingest.apply_batch(landed(spark).limit(0), 1, base, "b")
    got = {r[0]: tuple(r[1:]) for r in ingest.load_statistics(spark, base).collect()}
    assert got == {"a": (20, 13, 7), "b": (3, 2, 1)}
    whole = typing.load_stats(landed(spark, *rows)).agg(
        F.sum("rows_seen"), F.sum("rows_upserted"), F.sum("rows_rejected")).first()
    assert tuple(whole) == got["a"]
