import ipaddress
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import Window, functions as F

from auditspark.functions.predicates import field_contains, negate
from auditspark.operators import collection, enrich, facets, ordering, review


def values(df, column="_Row"):
    return sorted(r[column] for r in df.collect())


def test_tags_change(rows):
    df = rows({"_Row": 1}, {"_Row": 2}, {"_Row": 3})
    none = df.filter("_Row < 0").select("_Row")
    asked = rows({"_Row": 1}, {"_Row": 2}, {"_Row": 2}, {"_Row": 99})

    def change(tags, on):
        return tuple(review.tag_change(df, tags, asked, on).first())

    assert change(none, True) == (2, 2, 2)
    tags = review.change_tags(df, none, asked, True)
    assert values(tags) == [1, 2] and change(tags, True) == (2, 0, 2) and change(tags, False) == (2, 2, 0)
    assert values(review.change_tags(df, tags, asked, False)) == []
    marked = review.mark_tagged(df, tags)
    assert {r["_Row"]: r["Review.Tag"] for r in marked.collect()} == {1: "Of interest", 2: "Of interest", 3: None}
    assert values(review.tagged_only(marked)) == [1, 2]


def test_users_are_counted_once(rows):
    df = rows({"_Row": 1, "UserId": "Alice@x.org", "InternetMessageIDs": "<a>; <b>"}, {"_Row": 2, "UserId": "alice@X.org"},
              {"_Row": 3, "UserKey": "bob", "ClientIP": "1.2.3.4:5"}, {"_Row": 4, "MailboxOwnerUPN": "carol", "ClientIP": "1.2.3.4",
                                                                       "Review.Tag": "Of interest", "InternetMessageIDs": "<a>"})
    got = {r["metric"]: r["value"] for r in facets.review_metrics(df).collect()}
    assert got == {"rows": 4, "users": 3, "ips": 1, "messageIds": 2, "tagged": 1, "columns": 7}
    assert {r["metric"]: r["value"] for r in facets.review_metrics(df.filter("_Row < 0")).collect()} == {
        "rows": 0, "users": 0, "ips": 0, "messageIds": 0, "tagged": 0, "columns": 0}


def test_value_facets(rows):
    df = rows({"_Row": 1, "Login.OS": "Windows"}, {"_Row": 2, "Login.OS": "Windows"}, {"_Row": 3, "Login.OS": "macOS"}, {"_Row": 4},
              {"_Row": 5, "Login.OS": ""})
    got = [tuple(r) for r in facets.value_facets(df, "Login.OS").collect()]
    assert got == [("", "(empty)", 2), ("Windows", "Windows", 2), ("macOS", "macOS", 1)]
    totals = facets.value_facet_totals(df, "Login.OS", "win", 0, 1).first().asDict()
    assert totals == {"totalUnique": 3, "matchingUnique": 1, "matchingRows": 5, "hasMore": False}
    assert [r["value"] for r in facets.value_facets(df, "Login.OS", "win").collect()] == ["Windows"]


def test_selected_operation_joins_the_facet(rows):
    df = rows(*[{"_Row": i * 10 + j, "Operation": f"op{i:02d}"} for i in range(15) for j in range(15 - i)])
    got = facets.faceted_counts(df, "", "op14").filter("facet = 'operation'").collect()
    assert {r["name"] for r in got} == {f"op{i:02d}" for i in range(12)} | {"op14"}




@pytest.mark.parametrize("column,samples,ascending,descending", [
    ("Travel.Risk", ["High", "Low", "Medium", ""], ["Low", "Medium", "High", ""], ["High", "Medium", "Low", ""]),
    ("Travel.Score", ["10", "2", "6", ""], ["2", "6", "10", ""], ["10", "6", "2", ""]),
    ("A_WHOIS_RegistrationDate", ["2026-01-01T06:00:00-05:00", "2026-01-01T10:00:00Z", "2025-12-31T23:00:00Z", "unknown", ""],
     ["2025-12-31T23:00:00Z", "2026-01-01T10:00:00Z", "2026-01-01T06:00:00-05:00", "unknown", ""],
     ["2026-01-01T06:00:00-05:00", "2026-01-01T10:00:00Z", "2025-12-31T23:00:00Z", "unknown", ""]),
    ("Unsorted", ["b", "a", "c"], ["b", "a", "c"], ["b", "a", "c"]),
])
def test_review_order(rows, column, samples, ascending, descending):
    df = rows(*[{"_Row": i, column: s} for i, s in enumerate(samples)])
    for direction, want in (("asc", ascending), ("desc", descending)):
        assert [r[column] for r in ordering.sort_rows(df, column, direction).collect()] == want
        placed = ordering.sorted_positions(df, column, direction).orderBy("position").collect()
        assert [r[column] for r in placed] == want and [r["position"] for r in placed] == list(range(1, len(want) + 1))


@pytest.mark.parametrize("kind,pool", [
    ("time", ["", " ", "zz", "Alpha", "alpha", "2026-01-01", "2026-01-01T05:00:00Z", "1/2/2026", "20251231"]),
    ("number", ["", "x", "y", "1", "-2.5", "1e3", "1", "1.5", "1.25", "-2", "2"]), ("risk", ["", "low", "HIGH", "Critical", "odd", "else"])])
@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_positions_agree_with_a_plain_sort(rows, kind, pool, direction):
    rnd = random.Random(7)
    df = rows(*[{"_Row": i, "v": rnd.choice(pool)} for i in range(300)])
    plain = [r["_Row"] for r in ordering.sort_rows(df, "v", direction, kind=kind).collect()]
    placed = ordering.sorted_positions(df, "v", direction, "p", kind=kind).orderBy("p").collect()
    assert ordering.sort_rows(df, "v", direction, kind=kind).columns == df.columns
    assert [r["_Row"] for r in placed] == plain and [r["p"] for r in placed] == list(range(1, 301))


def range_sizes(df, keys, partition=(), ranges=16):
    dealt = ordering.deal_ranges(df, [F.col(p) for p in partition], keys, ranges)
    return [r["count"] for r in dealt.rows.groupBy("__range").count().collect()]


@pytest.mark.parametrize("value", ["id", "xxhash64(id)", "0", "if(id % 3 = 0, 7, id)", "concat('?', hex(xxhash64(id)))", "if(id % 3 = 0, null, -id)"])
@pytest.mark.parametrize("descending", [False, True])
def test_ranges_are_even_whatever_the_keys(spark, value, descending):
    df = spark.range(20000).select("id", F.expr(value).alias("v"))
    keys = [ordering.Key(F.col("v"), descending), ordering.Key(F.col("id"))]
    sizes = range_sizes(df, keys)
    assert len(sizes) == 16 and max(sizes) <= 3 * 20000 / 16 and sum(sizes) == 20000
    placed = ordering.with_position(df, keys, "p", ranges=16)
    plain = df.withColumn("p", F.row_number().over(Window.orderBy(*[k.order for k in keys])))
    assert placed.exceptAll(plain).count() == 0 and placed.count() == 20000


def test_row_id_positions(spark):
    df = spark.range(5000).select((F.col("id") * 3).alias("_Row"))
    placed = ordering.sorted_positions(df, "_Row", "desc", ranges=9)
    assert placed.filter(F.col("position") != 5000 - F.col("_Row") / 3).count() == 0


def test_running_sums_go_over_borders(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 != 0, F.lit("hot")).otherwise(F.when(F.col("id") % 2 == 0, (F.col("id") % 40).cast("string"))).alias("u"),
                                  (F.col("id") % 7).alias("v"))
    got = ordering.with_running(df, [ordering.Key(F.col("id"), True)], {"s": F.col("v"), "n": F.lit(1)}, ["u"], ranges=20)
    over = Window.partitionBy("u").orderBy(F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    plain = df.withColumns({"s": F.sum("v").over(over), "n": F.count(F.lit(1)).over(over)})
    assert got.exceptAll(plain).count() == 0 and got.count() == 3000


def test_no_window_over_all_rows(spark):
    plan = ordering.with_position(spark.range(20000), [ordering.Key(F.col("id"))], "p", ranges=8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 2  # one over the rows of ranges, one over what ranges hand on
    single = [line for line in plan.split("\n") if "SinglePartition" in line]
    assert len(single) <= 1


@pytest.mark.parametrize("kind,direction", [("time", "asc"), ("number", "desc"), ("risk", "desc")])
def test_pages_by_key_follow_the_plain_sort(rows, kind, direction):
    pool = {"time": ["", "zz", "2026-01-01", "2026-01-02"], "number": ["", "x", "1", "-2.5", "7"], "risk": ["", "low", "HIGH", "odd"]}[kind]
    rnd = random.Random(3)
    df = rows(*[{"_Row": i, "v": rnd.choice(pool)} for i in range(34)])
    plain = [r["_Row"] for r in ordering.sort_rows(df, "v", direction, kind=kind).collect()]
    seen, last = [], None
    while page := ordering.sorted_page_after(df, "v", direction, last, 10, kind=kind).collect():
        seen += [r["_Row"] for r in page]
        last = page[-1]
    assert seen == plain


def test_positions_keep_rows_without_ids_or_partitions(spark):
    df = spark.createDataFrame([(1, "a"), (None, "a"), (2, None), (3, None), (None, None)], "id bigint, part string")
    numbered = ordering.with_row_ids(df, "id", "at", ["part"]).collect()
    assert sorted(((r["part"], r["at"]) for r in numbered), key=repr) == sorted([("a", 1), ("a", 2), (None, 1), (None, 2), (None, 3)], key=repr)
    scored = spark.createDataFrame([(1, "5"), (None, "5"), (None, ""), (4, None)], "_Row bigint, s string")
    placed = ordering.sorted_positions(scored, "s", "asc", kind="number").collect()
    assert sorted(r["position"] for r in placed) == [1, 2, 3, 4]


def test_one_value_of_a_third_of_all_rows_is_cut(spark):
    df = spark.range(3000).select(F.col("id").alias("_Row"), F.when(F.col("id") % 3 == 0, "0.7").otherwise(F.col("id").cast("string")).alias("v"))
    spec = ordering.review_order(df, "v", kind="number")
    assert max(range_sizes(spec.attach(df), spec.keys, ranges=30)) <= 300
    placed = ordering.sorted_positions(df, "v", kind="number", ranges=30)
    assert placed.filter("v = '0.7'").agg(F.min("position"), F.max("position")).first()[:] == (1, 1000)


def test_references_count_once(rows):
    reference = rows({"ip": "1.1.1.1", "Country": "A", "t": "1"}, {"ip": "1.1.1.1", "Country": "B", "t": "2"}, {"ip": "1.1.1.1", "Country": "C", "t": "0"})
    assert [r["Country"] for r in enrich.one_per_key(reference, "ip", "t").collect()] == ["B"]
    got = enrich.enrich_ip(rows({"_Row": 1, "ClientIP": "1.1.1.1"}), "ClientIP", reference, row_id="_Row").collect()
    assert len(got) == 1 and enrich.upsert(reference.limit(0), reference, "ip").count() == 1
    assert enrich.upsert(reference, reference.limit(0), "ip").count() == 1  # repeated current keys end as one too


def test_pages_cover_the_order_once(rows):
    df = rows(*[{"_Row": i, "v": str(i % 7)} for i in range(45)])
    seen = [r["_Row"] for p in range(1, 6) for r in ordering.sorted_page(df, "v", page=p, size=1, kind="number").collect()]
    assert len(seen) == 45 and len(set(seen)) == 45  # a size of 1 is raised to 10
    follow = ordering.page_after(df, [F.col("_Row")], F.col("_Row") > 39, 10)
    assert [r["_Row"] for r in follow.collect()] == [40, 41, 42, 43, 44]


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["hot", "hot", "hot", "a", "b"]), st.integers(0, 400)), min_size=1, max_size=120),
       st.sampled_from([1, 4, 30]))
def test_previous_row_agrees_with_one_window(spark, events, ranges):
    df = spark.createDataFrame([(i, u, t) for i, (u, t) in enumerate(events)], "id bigint, u string, t bigint")
    plain = df.withColumn("p", F.lag("id").over(Window.partitionBy("u").orderBy("t", "id")))
    got = ordering.with_previous(df, ["u"], [F.col("t"), F.col("id")], F.col("id"), "p", ranges=ranges)
    assert {r["id"]: r["p"] for r in got.collect()} == {r["id"]: r["p"] for r in plain.collect()}
    wanted = {r["id"]: r["p"] for r in plain.collect() if r["p"] is not None and r["p"] % 2 == 0}
    kept = ordering.with_previous(df, ["u"], [F.col("t"), F.col("id")], F.col("id"), "p",
                                  keep=lambda p: p % 2 == 0, ranges=ranges)
    assert {r["id"]: r["p"] for r in kept.collect()} == wanted


def test_one_minute_of_one_user_is_cut(spark):
    df = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("u"), F.lit(5).alias("t"))
    keys = [ordering.Key(F.col("t")), ordering.Key(F.col("id"))]
    assert max(range_sizes(df, keys, ["u"], 24)) <= 3 * 6000 / 24
    got = ordering.with_previous(df, ["u"], [F.col("t"), F.col("id")], F.col("id"), "p", ranges=24)
    assert got.filter("u = 'hot' and id > 0 and not p <=> id - 3 or u <> 'hot' and p is not null").count() == 0 and got.count() == 6000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lag(__payload") == 1  # rows go through one window


def test_upsert_keeps_one_row_per_key(rows):
    old = rows({"ip": "1", "Country": "A"}, {"ip": "2", "Country": "B"})
    new = rows({"ip": "2", "Country": "C"}, {"ip": "3", "Country": "D"})
    assert sorted(tuple(r) for r in enrich.upsert(old, new, "ip").collect()) == [("1", "A"), ("2", "C"), ("3", "D")]


def test_pending_lookups(rows):
    ref = rows({"ip": "1", "Lookup_Status": "Success", "Provider": "p"}, {"ip": "2", "Lookup_Status": "Failed", "Provider": "p"},
               {"ip": "3", "Lookup_Status": "Success", "Provider": "q"})
    wanted = rows(*[{"ip": str(i)} for i in range(1, 5)])
    assert values(enrich.pending_lookups(wanted, ref, "ip", providers=["p"]), "ip") == ["2", "3", "4"]
    assert values(enrich.pending_lookups(wanted, ref, "ip"), "ip") == ["2", "4"]


def test_address_columns():
    assert enrich.trace_ip_columns(["Original Client IP", "FromIP", "RecipientAddress", "FromIP_IPAPI_Country"]) == [
        "FromIP", "Original Client IP"]
    assert enrich.ip_columns(["ClientIP", "SomeIpAddress", "Operation", "OriginatingServer"]) == [
        "ClientIP", "SomeIpAddress", "OriginatingServer"]


def test_join_enrichment(rows):
    ref = rows({"ip": "1.2.3.4", "Country": "A", "Lookup_Status": "Success"})
    df = rows({"_Row": 1, "ClientIP": "1.2.3.4:99"}, {"_Row": 2, "ClientIP": "4.3.2.1"}, {"_Row": 3, "ClientIP": "none"}, {"_Row": 4})
    for salt in (1, 3):
        got = enrich.enrich_ip(df, "ClientIP", ref, row_id="_Row", salt=salt).orderBy("_Row").collect()
        assert [r["ClientIP_IPAPI_Country"] for r in got] == ["A", "", None, None]
        assert [r["ClientIP_IPAPI_City"] for r in got] == ["", "", None, None]


def test_domains_of_a_cell_keep_their_order(rows):
    ref = rows({"Domain": "a.org", "Registrar": "R1", "Status": "x"}, {"Domain": "b.org", "Registrar": "R1", "Status": "y"})
    df = rows({"_Row": 1, "S": "x@b.org; y@a.org; z@none.org"}, {"_Row": 2, "S": "none"}, {"_Row": 3})
    got = enrich.enrich_domains(df, "S", ref, row_id="_Row").orderBy("_Row").collect()
    assert [(r["S_WHOIS_Domain"], r["S_WHOIS_Registrar"], r["S_WHOIS_Status"]) for r in got] == [
        ("b.org; a.org", "R1", "y; x"), ("", "", ""), ("", "", "")]


def test_networks_and_services(spark, rows):
    nets = spark.createDataFrame([("10.0.0.0/8", "wide", 2), ("10.1.0.0/16", "narrow", 1), ("2001:db8::/32", "six", 3)],
                                 "cidr string, label string, position int")
    df = rows(*[{"_Row": i, "ip": ip} for i, ip in enumerate(("10.1.2.3", "10.2.0.1", "11.0.0.1", "2001:db8::9", None))])
    got = enrich.match_networks(df, "ip", nets, row_id="_Row").orderBy("_Row").collect()
    assert [r["network"] for r in got] == ["narrow", "wide", None, "six", None]
    services = spark.createDataFrame([("x.org", 2), ("a.x.org", 1)], "service string, position int")
    hosts = rows(*[{"_Row": i, "h": h} for i, h in enumerate(("b.a.x.org", "x.org", "yx.org", None))])
    got = enrich.match_services(hosts, "h", services, row_id="_Row").orderBy("_Row").collect()
    assert [r["service"] for r in got] == ["a.x.org", "x.org", None, None]


def test_targets(rows):
    manual = collection.split_targets(rows({"box": "a@x.org", "ids": "one@y.org, <two@y.org>;\none@Y.org"}), "ids", "box").drop("ids")
    tidy = collection.normalize_targets(manual).withColumn("n", F.monotonically_increasing_id())
    assert [tuple(r) for r in collection.unique_targets(tidy, "n").orderBy("InternetMessageId").collect()] == [
        ("a@x.org", "<one@y.org>"), ("a@x.org", "<two@y.org>")]
    bad = collection.normalize_targets(collection.read_targets(rows(
        {"Mailbox Owner UPN": "nobody", "Internet Message IDs": "x@y"}, {"Mailbox Owner UPN": "a@b"}, {"Mailbox Owner UPN": " "},
        {"Mailbox Owner UPN": "a@b", "Internet Message IDs": "x" * 1000}))).collect()
    assert [r["problem"] for r in bad] == ["Invalid MailboxOwnerUPN: nobody", "InternetMessageId is required for a@b",
                                           "InternetMessageId is invalid or too long"]
    with pytest.raises(ValueError, match="must contain"):
        collection.read_targets(rows({"Mailbox": "x"}))


def test_collection_report(rows):
    targets = rows({"MailboxOwnerUPN": "a@x", "InternetMessageId": "<1>"}, {"MailboxOwnerUPN": "a@x", "InternetMessageId": "<2>"},
                   {"MailboxOwnerUPN": "a@x", "InternetMessageId": "<3>"})
    results = rows({"MailboxOwnerUPN": "A@x", "InternetMessageId": "<1>", "Subject": "s", "AttachmentCount": "2"},
                   {"MailboxOwnerUPN": "a@x", "InternetMessageId": "<1>", "Subject": "t"},
                   {"MailboxOwnerUPN": "a@x", "InternetMessageId": "<3>", "Error": "HTTP 500"})
    report = collection.collection_report(targets, results)
    assert sorted((r["InternetMessageId"], r["Status"]) for r in report.collect()) == [
        ("<1>", "Collected"), ("<1>", "Collected"), ("<2>", "Not found"), ("<3>", "Error")]
    assert tuple(collection.collection_rollup(report).first()) == (3, 2, 1, 1)


def test_negation_is_the_complement(rows):
    df = rows(*[{"_Row": i, "s": v} for i, v in enumerate(("abc", "", None, "B"))])
    test = field_contains(df, "s", "b")
    assert sorted(values(df.filter(test)) + values(df.filter(negate(test)))) == [0, 1, 2, 3]


def test_ranges_that_overlap(spark):
    rnd = random.Random(3)
    start = int(ipaddress.ip_address("198.51.100.0"))
    text = lambda n: str(ipaddress.ip_address(n))
    listed = []
    for i in range(120):
        low = start + rnd.randint(0, 600)
        listed.append((text(low), text(low + rnd.choice([0, 0, 1, 5, 40, 300, -3])), f"r{i}", rnd.randint(0, 99) * 1000 + i))
    listed += [("2001:db8::1", "2001:db8::ff", "v6", 5), ("1.1.1.1", "2001:db8::", "mixed", 0), ("bad", "1.1.1.1", "bad", 0), ("0.0.0.0", "255.255.255.255", "all", 10**6)]
    addresses = [text(start + rnd.randint(-5, 950)) for _ in range(300)] + ["2001:db8::7", "2001:db8::1:0", None, "10.0.0.1", "10.0.0.1"]

    def first(address):
        a = ipaddress.ip_address(address)
        held = [(p, label) for low, high, label, p in listed[:-3] + listed[-1:]
                if ipaddress.ip_address(low).version == a.version and ipaddress.ip_address(low) <= a <= ipaddress.ip_address(high)]
        return min(held)[1] if held else None

    df = spark.createDataFrame(list(enumerate(addresses)), "id bigint, ip string")
    got = enrich.match_ranges(df, "ip", spark.createDataFrame(listed, "low string, high string, label string, position bigint")).collect()
    assert {r["id"]: r["range"] for r in got} == {i: first(a) if a else None for i, a in enumerate(addresses)} and len(got) == len(addresses)
    none = enrich.match_ranges(df, "ip", spark.createDataFrame([], "low string, high string, label string, position bigint"))
    assert none.where("range is null").count() == len(addresses)


def test_borders_of_range_matches_count_ends_too(spark, monkeypatch):
    """Many ranges and few addresses, or one address in many rows, meet in ranges of the order like any others."""
    monkeypatch.setattr(ordering, "LEAST_ROWS", 100)
    cuts, sampled = [], ordering.sample_borders
    monkeypatch.setattr(enrich, "sample_borders", lambda *a, **k: cuts.append(sampled(*a, **k)) or cuts[-1])
    listed = [(f"10.0.{i // 250}.{i % 250}", f"10.0.{i // 250}.{i % 250 + i % 4}", f"r{i}", 2000 - i) for i in range(1000)]
    ranges = spark.createDataFrame(listed, "low string, high string, label string, position bigint")
    df = spark.createDataFrame([(i, f"10.0.{i}.{i + 7}") for i in range(4)] + [(4, "10.0.9.9")], "id bigint, ip string")
    got = enrich.match_ranges(df, "ip", ranges).collect()
    assert {r["id"]: r["range"] for r in got} == {0: "r7", 1: "r258", 2: "r509", 3: "r760", 4: None}
    assert all(len(c.rows) > 4 for c in cuts)


def test_networks_of_every_length(spark):
    rnd = random.Random(5)
    nets = [str(ipaddress.ip_network((rnd.getrandbits(32) & 0x0F00FFFF | 0x0A000000, n), strict=False)) for n in range(33) for _ in range(3)]
    nets += [str(ipaddress.ip_network(((0x20010DB8 << 96) | rnd.getrandbits(12), n), strict=False)) for n in (0, 1, 30, 33, 64, 113, 121, 126, 127, 128)]
    held = [ipaddress.ip_network(n) for n in nets]
    listed = spark.createDataFrame([(n, n, -i) for i, n in enumerate(nets)], "cidr string, label string, position int")
    addresses = [str(n[rnd.choice([0, -1])]) for n in held] + [str(n[-1] + 1) for n in held if n.prefixlen > 8] + ["2001:db8::77", "4000::1"]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(addresses)], "id bigint, ip string")
    got = {r["id"]: r["network"] for r in enrich.match_networks(df, "ip", listed).collect()}
    # Later networks stand first in the list.
    assert got == {i: next((n for n, h in reversed(list(zip(nets, held))) if ipaddress.ip_address(a) in h), None) for i, a in enumerate(addresses)}
