import ipaddress
import json
from datetime import datetime, timezone

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from auditspark.functions import mail, network, payload, text, times
from auditspark.operators import enrich

ADDRESSES = [
    "1.2.3.4", " '1.2.3.4' ", "1.2.3.4:80", "[::1]:443", "2001:DB8::0001", "::", "::ffff:1.2.3.4", "01.2.3.4", "1.2.3",
    "fe80::1%eth0", "2001:db8:0:0:1:0:0:1", "1:0:0:2:0:0:0:3", "2001:db8::1:0:0:1", "::1.2.3.4", "1::2::3",
    "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "0:0:0:0:0:0:0:1", "1:0:0:0:0:0:0:0", "g::1", "1:0:2:0:3:0:4:0",
    "64:ff9b:1::5", "192.0.0.9", "100.64.0.1", "224.0.0.1", "2002::1", "2001:20::1", "240.0.0.1", "ff02::1", "4000::1",
    "2600::1", "10:20", ":::", "::1:", "x", "", "0:0:3:0:0:0:0:0", "::ffff:10.0.0.1", "256.1.1.1", "127.0.0.1", "169.254.1.1"]


def reference_ip(value):
    bare = value.strip().strip("'")
    if bare.startswith("[") and "]" in bare:
        bare = bare[1:bare.index("]")]
    elif bare.count(":") == 1 and bare.split(":")[1].isdigit():
        bare = bare.split(":")[0]
    try:
        return ipaddress.ip_address(bare)
    except ValueError:
        return None


def expected_class(ip):
    for name, flag in (("Loopback", ip.is_loopback), ("Link-local", ip.is_link_local), ("Private", ip.is_private),
                       ("Multicast", ip.is_multicast), ("Reserved", ip.is_reserved)):
        if flag:
            return name
    return "Public"


def check_addresses(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string").withColumn("ip", network.normalize_ip(F.col("v")))
    for r in df.select("v", "ip", network.classify_ip(F.col("ip")).alias("c"), network.is_global(F.col("ip")).alias("g")).collect():
        want = reference_ip(r["v"])
        assert (r["ip"], r["c"], r["g"]) == (
            (None, None, None) if want is None else (str(want), expected_class(want), want.is_global)), r["v"]


def test_addresses_match_the_standard_library(spark):
    check_addresses(spark, ADDRESSES)


@settings(max_examples=3, deadline=None)
@given(st.lists(st.one_of(st.ip_addresses(v=4).map(str), st.ip_addresses(v=6).map(str),
                          st.lists(st.sampled_from(["0", "0000", "1", "ab", "00c", "::", ":"]), max_size=9).map(":".join)),
                min_size=30, max_size=60))
def test_random_addresses(spark, values):
    check_addresses(spark, [v for v in values if "." not in v.split(":")[-1] or ":" not in v])


def test_times_match_the_standard_library(spark):
    samples = ["2026-07-21T12:00:00Z", "2026-07-21T08:00:00-04:00", "2026-07-21", "20260721", "2026-07", "12:30", "2026",
               "2026-07-21 10:00", "2026-07-21T10", "2026-07-21T10:00:00.123456789", "2026-07-21T10:00:00+0530", "2026-02-30",
               "unknown", "", "2026-07-21T10:00:00", "20260721T101112Z", "2026-07-21T25:00:00"]

    def want(value):
        try:
            t = datetime.fromisoformat(value.replace("Z", "+00:00"))
        except ValueError:
            return None
        return (t if t.tzinfo else t.replace(tzinfo=timezone.utc)).timestamp()

    df = spark.createDataFrame([(v,) for v in samples], "v string")
    got = df.select("v", (F.unix_micros(times.parse_time(F.col("v"))) / 1e6).alias("t")).collect()
    assert {r["v"]: r["t"] for r in got} == {v: want(v) for v in samples}


def test_sortable_times(spark):
    df = spark.createDataFrame([("7/4/2026 1:02:03",), ("2026/07/04 01:02:03",), ("07/04/2026",), ("13/45/2026",)], "v string")
    got = [r["t"] for r in df.select(text.iso_text(times.parse_sortable_time(F.col("v"))).alias("t")).collect()]
    assert got == ["2026-07-04T01:02:03+00:00", "2026-07-04T01:02:03+00:00", "2026-07-04T00:00:00+00:00", None]


def test_mail_texts(spark):
    df = spark.createDataFrame([("Alice <alice@Example.COM>; bob@sub.example.net x@y a@b..c q@-a.com alice@example.com a@b-x!c@d.org",)], "v string")
    assert df.select(mail.email_domains(F.col("v")).alias("d")).first()["d"] == ["example.com", "sub.example.net", "d.org"]
    ids = spark.createDataFrame([(" a@b ",), ("<a@b>",), ("",), (None,)], "v string")
    assert [r["m"] for r in ids.select(mail.format_message_id(F.col("v")).alias("m")).collect()] == ["<a@b>", "<a@b>", "", ""]
    long = spark.createDataFrame([("a" * 200000 + " x@y.org",)], "v string")
    assert long.select(mail.email_domains(F.col("v")).alias("d")).first()["d"] == ["y.org"]


def test_ids_in_texts(spark):
    cases = {"<a@b> c@d": ["<a@b>", "<c@d>"], "x<<a@b>y@z>": ["<a@b>", "<y@z>"], "@a a@ @ a@@": ["<a@@>"], "@a@b": ["<@a@b>"], "a@b@c\tq@r\n": ["<a@b@c>", "<q@r>"],
             "<no at>": [], "": [], None: [], "to:<first.last+tag@mail.example.com>;next": ["<first.last+tag@mail.example.com>"]}
    df = spark.createDataFrame(list(enumerate(cases)), "i int, v string")
    got = {r["i"]: r["ids"] for r in df.select("i", mail.ids_in_text(F.col("v")).alias("ids")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_columns_of_application_ids(spark):
    names = ["AppId", "ApplicationId", "Actor.ClientAppID", "ResourceAPPLICATIONID", "AppIdName", "ApplicationName", "AppMapping.AppId", "appid2"]
    assert enrich.app_columns(names) == names[:4]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r["n"] for r in df.where(enrich._holds_app_id(F.col("n"))).collect()] == names[:4]


def test_flatten_keeps_every_leaf(spark):
    doc = {"A": {"B": 1, "C": [{"x": 1}], "E": {}, "F": {"G": {"H": "deep"}}}, "D": None, "T": True, "U": "é"}
    df = spark.createDataFrame([(json.dumps(doc),), ("[1]",), ("bad",)], "v string")
    got = [r["m"] for r in df.select(payload.flatten_map(F.col("v")).alias("m")).collect()]
    assert got == [{"A.B": "1", "A.C": '[{"x":1}]', "A.F.G.H": "deep", "D": "", "T": "true", "U": "é"}, None, None]


def test_long_and_bracketed_strings(spark):
    doc = {"a": "x\\n\"[{" * 2000, "b": {"c": {"d": "]]"}}}
    df = spark.createDataFrame([(json.dumps(doc),)], "v string")
    assert df.select(payload.flatten_map(F.col("v")).alias("m")).first()["m"] == {"a": doc["a"], "b.c.d": "]]"}


def test_members_keep_order_and_numbers(spark):
    doc = ('{"z": 1.0, "a": {"y": 2.50, "b": [1.0, {"q": 1, "c": 2}], "x": "{\\"k\\":1}"}, "s": "[1]", "n": null, "z2": {"n": {"m": 10.0}}, '
           '"r": {"x": 1}, "r": {"w": 2}, "big": 12345678901234567890}')
    df = spark.createDataFrame([(doc,), ("{'b': True, 'a': {'d': None, 'c': 'x'}}",), ('{"a":1} x',)], "v string")
    got = [[tuple(e) for e in r["m"]] if r["m"] is not None else None for r in df.select(payload.flatten_texts(F.col("v")).alias("m")).collect()]
    assert got == [[("z", "1.0"), ("a.y", "2.5"), ("a.b", '[1.0,{"q":1,"c":2}]'), ("a.x", '{"k":1}'), ("s", "[1]"), ("n", ""), ("z2.n.m", "10.0"),
                    ("r.w", "2"), ("big", "12345678901234567890")], [("b", "true"), ("a.d", ""), ("a.c", "x")], None]


def test_kinds_are_looked_up_where_a_string_begins_like_an_object(spark):
    """Other payloads are read once a level; brackets are counted without going through the text letter by letter."""
    doc = ('{"a": {"b": {"c": 1}, "d:": "x"}, "l": "[{\\"Name\\":\\"{\\"}]", "e": {}}', '{"a": "{\\"x\\":1}", "b": {"c": "{", "d": {"x": 2}}}',
           '{"a": {"x": 1}, "a": {"y": "{}"}, ":": {"{": 3}}', '{"a": "\\u007b", "b": {"\\":": {"c": "\\":{"}}}')
    df = spark.createDataFrame([(d,) for d in doc], "v string").select(payload.flatten_texts(F.col("v")).alias("m"))
    assert [[tuple(e) for e in r["m"]] for r in df.collect()] == [
        [("a.b.c", "1"), ("a.d:", "x"), ("l", '[{"Name":"{"}]')], [("a", '{"x":1}'), ("b.c", "{"), ("b.d.x", "2")],
        [("a.y", "{}"), (":.{", "3")], [("a", "{"), ('b.":.c', '":{')]]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(" not in plan and "Contains(" in plan


def test_first_subject_and_size_in_document_order(spark):
    doc = ('{"Z":{"SizeInBytes":7,"InternetMessageId":"a@b","Subject":"first"},"A":[{"Subject":"second","InternetMessageId":"a@b"},'
           '{"internetmessageid":"<c@d>","subject":"old","Subject":"new","B":{"InternetMessageId":"e@f"},"A":{"InternetMessageId":"g@h"}}]}')
    df = spark.createDataFrame([(doc,)], "v string").select(payload.messages_of_text(F.col("v")).alias("m"))
    assert [tuple(m) for m in df.first()["m"]] == [("<a@b>", "first", "7"), ("<a@b>", "second", ""), ("<c@d>", "new", ""), ("<e@f>", "", ""), ("<g@h>", "", "")]


def test_named_properties(spark):
    data = [('[{"Name":"A","Value":"1"},{"Name":"b","Value":null},{"Name":"A","Value":{"z":1}},{"Value":"x"},3]',), ("bad",), (None,),
            ('{"Name":"A"}',)]
    df = spark.createDataFrame(data, "v string")
    got = [r["m"] for r in df.select(payload.named_properties(F.col("v")).alias("m")).collect()]
    assert got == [{"A": '{"z":1}', "b": ""}, {}, {}, {}]


def test_registration_record(spark):
    record = {"ldhName": "EXAMPLE.COM", "status": ["client transfer prohibited"],
              "events": [{"eventAction": "registration", "eventDate": "1995-08-14T04:00:00Z"},
                         {"eventAction": "expiration", "eventDate": "2027-08-13T04:00:00Z"}],
              "entities": [{"roles": ["registrar"], "vcardArray": ["vcard", [["fn", {}, "text", "Example Registrar"]]]}],
              "nameservers": [{"ldhName": "A.IANA-SERVERS.NET"}], "secureDNS": {"delegationSigned": True}}
    df = spark.createDataFrame([(json.dumps(record),), ("{}",)], "v string")
    full, empty = [r["p"] for r in df.select(payload.parse_domain_registration(F.col("v"), F.lit("example.com")).alias("p")).collect()]
    assert (full["Registrar"], full["RegistrationDate"], full["NameServers"], full["DNSSEC"], full["RegisteredDomain"]) == (
        "Example Registrar", "1995-08-14T04:00:00Z", "a.iana-servers.net", "Signed", "example.com")
    assert (empty["Registrar"], empty["NameServers"], empty["DNSSEC"], empty["RegisteredDomain"]) == ("", "", "", "example.com")


def test_shortening(spark):
    df = spark.createDataFrame([("a " * 400,), ("x" * 320,), ("y" * 321,), (" a\n\tb ",)], "v string")
    got = [r["s"] for r in df.select(text.shorten(F.col("v")).alias("s")).collect()]
    assert [len(g) for g in got] == [320, 320, 320, 3] and got[0].endswith("…") and got[2].endswith("y…") and got[3] == "a b"
