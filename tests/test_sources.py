import csv
import glob
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from auditspark.operators import enrich, facets, hunts
from auditspark.plans import activity, trace
from auditspark.functions.predicates import any_field_contains, field_contains
from auditspark.sources import readers, search_index, writers


def lines(path):
    """Rows of a written CSV folder, header once."""
    found = []
    for part in sorted(glob.glob(f"{path}/part-*.csv")):
        with open(part, newline="", encoding="utf-8") as handle:
            found += list(csv.DictReader(handle))
    return found


def test_delimited_files(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('A,B\n1,"two\nlines, ""quoted"""\n3,\n')
    got = readers.read_delimited(spark, str(path), row_id="_Row").orderBy("_Row").collect()
    assert [(r["_Row"], r["A"], r["B"]) for r in got] == [(1, "1", 'two\nlines, "quoted"'), (2, "3", "")]
    (tmp_path / "b.txt").write_text("A;B\n1;2\n")
    assert tuple(readers.read_delimited(spark, str(tmp_path / "b.txt"), ";").first()) == ("1", "2")
    with pytest.raises(ValueError):
        readers.read_delimited(spark, str(path), "x")


def test_utf16_trace(spark, tmp_path):
    text = "Received,Sender Address,Recipient Address,Status\r\n2026-07-25T12:00:00Z,sender@example.com,r@example.com,Delivered\r\n"
    (tmp_path / "t.csv").write_bytes(text.encode("utf-16"))
    df = readers.read_trace(readers.read_delimited(spark, str(tmp_path / "t.csv"), encoding="UTF-16"))
    row = df.first().asDict()
    assert row["SenderAddress"] == "sender@example.com" and "\x00" not in "".join(row.values())


@pytest.mark.parametrize("document,count", [
    ([{"a": 1}, 7, "s", {"a": None, "b": {"c": [1, 2]}}], 4), ({"value": [{"a": 1}]}, 1), ({"records": [{"a": 1}, {"a": 2}]}, 2),
    ({"a": 1, "other": []}, 1)])
def test_json_documents(spark, tmp_path, document, count):
    (tmp_path / "d.json").write_text(json.dumps(document, indent=1))
    got = readers.read_json_document(spark, str(tmp_path / "d.json"), row_id="_Row").orderBy("_Row").collect()
    assert len(got) == count and got[0]["fields"]["a"] == "1"
    if count == 4:
        assert [r["fields"] for r in got[1:]] == [{"value": "7"}, {"value": "s"}, {"a": "", "b": '{"c":[1,2]}'}]


def test_json_lines(spark, tmp_path):
    path = str(tmp_path / "l.jsonl")
    open(path, "w").write('{"a":1}\n\n3\n{"a":2}\n')
    got = readers.read_json_lines(spark, path, row_id="_Row").orderBy("_Row").collect()
    assert [(r["_Row"], r["fields"]) for r in got] == [(1, {"a": "1"}), (2, {"value": "3"}), (3, {"a": "2"})]
    open(path, "a").write("{bad\n")
    assert [(r["line"], r["text"]) for r in readers.bad_json_lines(spark, path).collect()] == [(5, "{bad")]
    assert readers.read_json_lines(spark, path, strict=False).count() == 3
    with pytest.raises(Exception, match="Invalid JSON on line 5 of"):
        readers.read_json_lines(spark, path).collect()


def test_documents_of_lines_and_broken_ones(spark, tmp_path):
    def read(text, **options):
        path = tmp_path / f"{abs(hash(text))}.json"
        path.write_text(text)
        return readers.read_json_document(spark, str(path), **options)

    three = read('{"n":1}\r\n\n{"n":"x"}\n7\n', row_id="_Row").orderBy("_Row").collect()
    assert [r["fields"] for r in three] == [{"n": "1"}, {"n": "x"}, {"value": "7"}]
    assert [r["fields"] for r in read('{"records":[{"a":1},2]}').collect()] == [{"a": "1"}, {"value": "2"}]
    assert [r["fields"] for r in read('{"a":{"b":1}}').collect()] == [{"a": '{"b":1}'}] and read("  ").count() == 0
    for text in ('{"value": 5}', "12", '{"value":null}'):
        with pytest.raises(Exception, match="must be an array or contain"):
            read(text).collect()
    with pytest.raises(Exception, match="Invalid JSON on line 3"):
        read('{"n":1}\n\nnot json').collect()


def test_line_numbers_across_blocks(spark, tmp_path):
    path = str(tmp_path / "big.jsonl")
    open(path, "w").write("".join('{"n":%d}\n' % i for i in range(1, 4001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = readers.read_json_lines(spark, path, row_id="_Row")
        assert df.filter(F.col("fields")["n"].cast("long") != F.col("_Row")).count() == 0 and df.count() == 4000
        assert df.agg(F.max("_Row")).first()[0] == 4000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


AUDIT = [
    {"CreationTime": "2026-01-01T10:00:00", "Operation": "UserLoggedIn", "UserId": "u@x.org", "ClientIP": "8.8.8.8"},
    {"CreationTime": "2026-01-01T11:00:00", "Operation": "UserLoggedIn", "UserId": "u@x.org", "ClientIP": "9.9.9.9:1",
     "DeviceProperties": [{"Name": "IsCompliant", "Value": "False"}]},
    {"CreationTime": "2026-01-01T12:00:00", "Operation": "MailItemsAccessed", "Workload": "Exchange", "UserId": "u@x.org", "ClientIP": "10.0.0.1",
     "Folders": [{"FolderItems": [{"InternetMessageId": "<m@x.org>", "Subject": "Hello", "SizeInBytes": 5}]}], "Odd": {"Path": "p"}},
]


def test_from_file_to_review(spark, rows, tmp_path):
    source = tmp_path / "audit.csv"
    with open(source, "w", newline="") as handle:
        out = csv.writer(handle)
        out.writerow(["RecordId", "AuditData"])
        for i, record in enumerate(AUDIT):
            out.writerow([f"r{i}", json.dumps(record)])
        out.writerow(["r9", "{bad"])
    parsed = readers.read_activity(readers.read_delimited(spark, str(source), row_id="_Row"))
    assert facets.parse_errors(parsed).first()[0] == 1
    store = str(tmp_path / "store")
    writers.write_dataset(parsed, store, "case1", "set1")
    writers.write_dataset(parsed.limit(0), store, "case1", "set2")
    stored = readers.load_dataset(spark, store, "case1", "set1")
    assert stored.count() == 4 and "set1" in stored._jdf.queryExecution().executedPlan().toString()
    (tmp_path / "other").mkdir()
    twin = tmp_path / "other" / "audit.csv"
    twin.write_text("RecordId,AuditData\n")
    listed = parsed.withColumn("sourcePath", F.lit(f"file://{source}"))
    manifest = {r["sourcePath"].replace("file:", "").lstrip("/"): r for r in readers.dataset_manifest(spark, [str(source), str(twin)], listed).collect()}
    made = manifest[str(source).lstrip("/")]
    assert made["sourceSha256"] == hashlib.sha256(source.read_bytes()).hexdigest() and made["sizeBytes"] == source.stat().st_size
    assert (made["rowCount"], made["parseErrors"]) == (4, 1) and made["columnCount"] > 5
    assert len(manifest) == 2 and manifest[str(twin).lstrip("/")]["rowCount"] is None

    base = activity.derive(stored)
    plan = activity.plan_lookups(base, rows({"ip": "8.8.8.8", "Lookup_Status": "Failed", "Provider": "p"}), ["ClientIP"])
    assert sorted(r["ip"] for r in plan.pending.collect()) == ["8.8.8.8", "9.9.9.9"]
    assert [tuple(r) for r in plan.local.collect()] == [("10.0.0.1", "Private", "Skipped (non-public)", "Local")]

    first = rows({"ip": "8.8.8.8", "Country": "A", "Lookup_Status": "Success"}, {"ip": "9.9.9.9", "Country": "X", "Lookup_Status": "Failed"})
    writers.write_reference(None, first, str(tmp_path / "ref1"), "ip")
    fresh = rows({"ip": "9.9.9.9", "Country": "B", "Lookup_Status": "Success"})
    writers.write_reference(readers.load_reference(spark, str(tmp_path / "ref1")), fresh, str(tmp_path / "ref2"), "ip")
    reference = readers.load_reference(spark, str(tmp_path / "ref2"))
    assert sorted((r["ip"], r["Country"]) for r in reference.collect()) == [("8.8.8.8", "A"), ("9.9.9.9", "B")]

    travel = activity.hunt_travel(base, reference, ["ClientIP"])
    writers.write_findings(travel, str(tmp_path / "travel"), "travel heuristic", {"countryHours": 12}, "ref2")
    saved = spark.read.parquet(str(tmp_path / "travel"))
    assert writers.current_findings(saved, "ref1").count() == 0
    logins = activity.hunt_logins(base, reference, ["ClientIP"], hunts.LoginOptions(trusted_countries=["A"]))
    data = activity.ReviewData(ip_reference=reference, enriched_columns=["ClientIP"], travel=writers.current_findings(saved, "ref2"),
                               logins=logins, subjects=None, tags=rows({"_Row": 3}), narrative_rows="all")
    view = activity.review(base, data)
    got = {r["_Row"]: r.asDict() for r in view.collect()}
    assert got[2]["Travel.Score"] == 6 and got[2]["Travel.Risk"] == "High" and got[2]["SuspiciousLogin.Score"] == 4
    assert got[1]["Travel.Flag"] is None and got[3]["Review.Tag"] == "Of interest" and got[3]["ClientIP_IPAPI_Country"] == ""
    assert got[2]["Event"] == "UserLoggedIn: u@x.org; from IP 9.9.9.9; geo-location B."
    assert got[3]["fields"]["Odd.Path"] == "p" and got[3]["InternetMessageIDs"] == "<m@x.org>"

    names = writers.export_filtered(activity.filtered(view, F.col("_Row") >= 2), str(tmp_path / "csv"))
    assert names[:4] == ["_Row", "CreationTime", "Operation", "Event"] and "Odd.Path" in names and "Subject" not in names
    exported = lines(tmp_path / "csv")
    assert len(exported) == 3 and {r["Odd.Path"] for r in exported} == {"", "p"}
    writers.export_message_subjects(base, str(tmp_path / "subjects"), include_size=True)
    assert lines(tmp_path / "subjects") == [{"InternetMessageId": "<m@x.org>", "Subject": "Hello", "SizeInBytes": "5"}]


def test_trace_review(spark, rows):
    df = rows({"_Row": 1, "SenderAddress": "a@new.org", "RecipientAddress": "b@old.org", "FromIP": "1.1.1.1", "Subject": "Hi"},
              {"_Row": 2, "SenderAddress": "nobody", "Subject": "Other"})
    domains = rows({"Domain": "new.org", "Registrar": "R", "RegistrationDate": "2026-01-01", "Lookup_Status": "Success"})
    assert [r["Domain"] for r in trace.pending_domains(df, domains).collect()] == ["old.org"]
    data = trace.TraceData(domain_reference=domains, domain_columns=["SenderAddress"], tags=rows({"_Row": 2}), narrative_rows="all")
    got = {r["_Row"]: r.asDict() for r in trace.review(df, data).collect()}
    assert got[1]["SenderAddress_WHOIS_Registrar"] == "R" and got[2]["SenderAddress_WHOIS_Registrar"] == ""
    assert got[2]["Review.Tag"] == "Of interest" and got[1]["Event"] == "Subject: Hi; Sender: a@new.org; Recipient: b@old.org"
    metrics = {r["metric"]: r["value"] for r in facets.trace_metrics(df).collect()}
    assert metrics == {"rows": 2, "senders": 2, "recipients": 1, "ips": 1, "tagged": 0, "columns": 5}


def test_app_reference(spark, rows, tmp_path):
    (tmp_path / "apps.json").write_text(json.dumps({"source": "s", "apps": {"AAAAAAAA-0000-0000-0000-000000000001": "One"}}, indent=2))
    apps = readers.load_app_reference(spark, str(tmp_path / "apps.json"))
    assert [tuple(r) for r in apps.collect()] == [("aaaaaaaa-0000-0000-0000-000000000001", "One", "s")]
    df = enrich.map_app_names(rows({"_Row": 1, "AppId": "aaaaaaaa-0000-0000-0000-000000000001"}), apps, row_id="_Row")
    assert tuple(facets.app_totals(df).first()) == (1, 1, 0)


def test_dataset_list(spark):
    current = spark.createDataFrame([("a", "2026-01-02", 3, "c1"), ("b", "2026-01-03", 4, "c1")], "id string, uploadedAt string, rowCount long, caseId string")
    legacy = spark.createDataFrame([("z", "2026-01-01", "c1", 1)], "id string, uploadedAt string, caseId string, rowCount long")
    every = readers.list_datasets(current, legacy)
    assert [(r["id"], r["legacy"]) for r in every.collect()] == [("b", False), ("a", False), ("z", True)]
    assert tuple(facets.case_rollup(every).first()) == ("c1", 8, 3)


def test_client_table(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("Name,Empty,Country\nAlice,,Canada\n,,\n=2+2,,US\n")
    writers.write_client_table(readers.read_delimited(spark, str(path)), str(tmp_path / "out"))
    assert lines(tmp_path / "out") == [{"Name": "Alice", "Country": "Canada"}, {"Name": "=2+2", "Country": "US"}]
    assert writers.remember_columns(["a", "b"], ["c", "a"]) == ["a", "b", "c"]


def awkward(rnd, n):
    return rnd.choice([{"a": n, "b": {"c": [1, {"d": "}"}]}, "t": 'x"}],[{"\\'}, {"a": "\\\"value\": [ }"}, 7, "s,}", [1, [2, {"q": 3}]], None, True,
                       {"z": "é\n ", "value": [1]}, {}])


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    spark.conf.set("spark.sql.files.openCostInBytes", "64")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_large_documents_equal_whole_files(spark, tmp_path, small_blocks):
    rnd = random.Random(6)
    items = [awkward(rnd, n) for n in range(80)]
    documents = [items, {"m": {"value": [{"x": 1}]}, "value": items, "next": {"records": [1], "k": {"l": 2}}}, {"records": items},
                 {"records": [{"a": 1}], "value": items[:9]}, {"m": items, "n": {"value": items}}, [], [1, 2], {"value": []}, {}]
    styles = [{"indent": 1}, {}, {"separators": (",", ":"), "ensure_ascii": False}]
    for k, document in enumerate(documents):
        for i, style in enumerate(styles):
            mark, end = ("\ufeff", "") if i == 1 else ("", "\n" * (i == 0))
            (tmp_path / f"{k}_{i}.json").write_text(mark + json.dumps(document, **style) + end)
    path = str(tmp_path)
    whole = sorted((r["_Row"], sorted(r["fields"].items())) for r in readers.read_json_document(spark, path, row_id="_Row").collect())
    split = sorted((r["_Row"], sorted(r["fields"].items())) for r in readers.read_large_json(spark, path, row_id="_Row", ranges=7).collect())
    assert split == whole and len(whole) > 700
    assert spark.read.option("lineSep", "}").text(f"{path}/0_0.json").rdd.getNumPartitions() >= 4  # one file, several tasks


@pytest.mark.parametrize("text", ['[{"a":1},', "7", '[{"a":1}{"b":2}]', '{"value":3}', '{"a":1}\n{"b":2}', "[1] x"])
def test_broken_large_documents_fail(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(Exception, match="JSON.*bad.json"):
        readers.read_large_json(spark, str(tmp_path / "bad.json")).collect()


def test_large_quoted_files_equal_whole_files(spark, tmp_path, small_blocks):
    rnd = random.Random(2)
    rows = [[rnd.choice(["a", "x\ny", 'q"u"o', "", ", ,", "line\n\nend", "é"]) for _ in range(4)] for _ in range(300)]
    for name, eol in (("a", "\n"), ("b", "\r\n")):
        with open(tmp_path / f"{name}.csv", "w", newline="") as out:
            writer = csv.writer(out, lineterminator=eol)
            writer.writerow(["A", "B", "c.d", "E"])
            writer.writerows(rows)
    path = str(tmp_path)
    whole, split = readers.read_delimited(spark, path), readers.read_delimited(spark, path, large=True)
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, whole.collect())) and split.columns == whole.columns
    assert spark.read.text(path).rdd.getNumPartitions() > 8
    numbered = readers.read_delimited(spark, f"{path}/a.csv", large=True, row_id="n").orderBy("n").collect()
    assert [list(r)[:4] for r in numbered] == rows and [r["n"] for r in numbered] == list(range(1, 301))


def test_bad_line_in_the_last_block(spark, tmp_path, small_blocks):
    lines = [json.dumps({"a": n}) if n % 7 else "" for n in range(900)]
    (tmp_path / "l.jsonl").write_text("\n".join([*lines, "{bad", "{}"]))
    (tmp_path / "ok.jsonl").write_text("\n".join(lines))
    assert [r["line"] for r in readers.bad_json_lines(spark, str(tmp_path)).collect()] == [901]
    for action in ("count", "collect"):
        with pytest.raises(Exception, match="Invalid JSON on line 901 of .*l.jsonl"):
            getattr(readers.read_json_lines(spark, str(tmp_path)), action)()
    assert readers.read_json_lines(spark, str(tmp_path / "ok.jsonl")).count() == sum(bool(x) for x in lines)


def test_search_opens_possible_files_only(spark, tmp_path):
    data, words = str(tmp_path / "data"), ["Alpha", "bravo", "CHARLIE", "delta é", "echo"]
    df = spark.range(500).select("id", F.element_at(F.array(*map(F.lit, words)), (F.col("id") / 100).cast("int") + 1).alias("word"),
                                 F.create_map(F.lit("k"), F.concat(F.lit("tail"), (F.col("id") / 100).cast("int").cast("string"))).alias("fields"))
    df.repartitionByRange(5, "id").write.parquet(data)
    index = search_index.SearchIndex(spark, data, str(tmp_path / "filters"))
    assert len(index.files("word", "alpha")) == 5  # nothing is known yet
    index.add()
    index.add()
    assert index.unknown() == [] and index.filters().select("file").distinct().count() == 5
    whole = spark.read.parquet(data)
    for column, text, most in (("word", "aLPHA", 1), ("word", "harli", 1), ("word", "a é", 1), ("word", "zulu", 0), ("word", "lp", 5), ("WORD", "*arl*", 1),
                               (None, "tail3", 1), (None, "bravo", 1), (None, "499", 1), ("user", "echo", 1)):
        got = index.search(column, text)
        want = whole.where(any_field_contains(whole, text) if column is None else field_contains(whole, column, text))
        assert len(index.files(column, text)) <= most and sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in want.collect())
        assert len(got.inputFiles()) <= most
    df.where("id < 3").select(F.col("id") + 900, F.lit("zulu").alias("word"), "fields").toDF("id", "word", "fields").coalesce(1).write.mode("append").parquet(data)
    assert index.search("word", "zulu").count() == 3 and len(index.files("word", "zulu")) == 1  # not indexed yet, still found
    index.add()
    assert len(index.files("word", "zulu")) == 1 and len(index.files("word", "echo")) == 1


def test_columns_of_a_case_come_from_notes(spark, tmp_path):
    store = str(tmp_path / "store")
    one = spark.createDataFrame([(1, "x")], "_Row bigint, a string")
    two = spark.createDataFrame([(2, 5, {"k": "v"})], "_Row bigint, b int, fields map<string,string>")
    writers.write_dataset(one, store, "case 1", "set/1")
    writers.write_dataset(two, store, "case 1", "set2")
    writers.write_dataset(spark.createDataFrame([(3, 1.5)], "_Row bigint, c double"), store, "case2", "set1")
    assert readers._noted_schema(spark, store, "/case_id=case 1").names == ["_Row", "a", "b", "fields", "case_id", "dataset_id"]
    rows = {r["_Row"]: r.asDict() for r in readers.load_dataset(spark, store, "case 1").collect()}
    assert rows[1] == {"_Row": 1, "a": "x", "b": None, "fields": None, "case_id": "case 1", "dataset_id": "set/1"}
    assert rows[2]["fields"] == {"k": "v"} and rows[2]["b"] == 5 and len(rows) == 2
    assert [r["_Row"] for r in readers.load_dataset(spark, store, "case 1", "set/1").collect()] == [1]
    assert readers.load_dataset(spark, store).count() == 3 and "c" in readers.load_dataset(spark, store).columns
    # A dataset that somebody else wrote, without a note: the files tell.
    two.withColumnRenamed("b", "z").write.parquet(f"{store}/case_id=case 1/dataset_id=other")
    assert readers._noted_schema(spark, store, "/case_id=case 1") is None
    assert "z" in readers.load_dataset(spark, store, "case 1").columns and readers.load_dataset(spark, store, "case 1").count() == 3
