"""The operators bound to the driver's tables.

Every query reads whole tables.  ``bindings_sql`` states the same results in plain SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import payload, predicates as P
from ..functions.categories import in_category
from ..functions.mail import format_message_id
from ..functions.network import classify_ip, is_global, normalize_ip
from ..functions.text import (compact, country_key, falsey, first_text, iso_text, ref, shorten, to_text, truthy)
from ..functions.times import parse_sortable_time, parse_time
from ..operators import collection, enrich, facets, hunts, ordering, review, shape
from ..session import configure
from . import activity as activity_plan, trace as trace_plan

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

HUNT_MOMENT = datetime(2024, 6, 1, tzinfo=timezone.utc)
KEYWORDS = ["license", "the one", "Password"]
SERVICES = ["mail3.example.com", "https://mail5.example.com/unsubscribe", "*.example.org"]


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(configure(spark), sf_dir)
    run.__name__, run.__doc__ = function.__name__, function.__doc__
    QUERIES[function.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- the tables in the shape of audit records ------------------------------------------------

def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def _graded(limit_false: float, limit_blank: float) -> Column:
    return F.when(F.col("value") < limit_false, "False").when(F.col("value") < limit_blank, "").otherwise("True")


def logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as login records: clicks, views and purchases succeed, sign-ups fail."""
    kind = (F.when(F.col("event_type").isin("click", "view", "purchase"), "UserLoggedIn")
            .when(F.col("event_type") == "signup", "UserLoginFailed").otherwise("FileAccessed"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("_Row"), F.col("ts").alias("CreationTime"),
        F.col("user_id").cast("string").alias("UserId"), kind.alias("Operation"),
        F.concat(F.lit("198.51.100."), (_k() % 25).cast("string")).alias("ClientIP"),
        _graded(3, 6).alias("Login.IsCompliant"), _graded(4.5, 9).alias("Login.IsCompliantAndManaged"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records of several kinds of activity."""
    kind = (F.when(F.col("event_type") == "click", "FileAccessed").when(F.col("event_type") == "view", "MailItemsAccessed")
            .when(F.col("event_type") == "purchase", "New-InboxRule")
            .when(F.col("event_type") == "signup", "UserLoggedIn").otherwise(""))
    load = (F.when(F.col("event_type") == "click", "SharePoint").when(F.col("event_type") == "view", "Exchange")
            .otherwise(""))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("_Row"), F.col("ts").alias("CreationTime"),
        F.when(F.col("value") >= 5, F.concat(F.lit("User"), F.col("user_id").cast("string"))).alias("UserId"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("UserKey"),
        kind.alias("Operation"), load.alias("Workload"), F.col("event_type").alias("RecordType"),
        F.concat(F.lit("198.51.100."), _k().cast("string"), F.lit(":443")).alias("ClientIP"),
        F.when(F.col("value") < 4, F.concat(F.lit("[2001:DB8::"), F.hex(_k()), F.lit("]:25"))).alias("ActorIpAddress"),
        F.concat(F.lit("m"), _k().cast("string"), F.lit("@x.org; <m"), F.col("user_id").cast("string"),
                 F.lit("@x.org>")).alias("InternetMessageIDs"),
        F.when(F.col("value") > 20, "Of interest").alias("Review.Tag"))


def ip_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as results of an address lookup; one lookup failed."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    key = F.col("n_nationkey")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.concat(F.lit("198.51.100."), key.cast("string")).alias("ip"), F.col("n_name").alias("Country"),
        F.col("r_name").alias("Region"), F.concat(F.lit("City "), key.cast("string")).alias("City"),
        F.concat(F.lit("ISP "), key.cast("string")).alias("ISP"),
        F.when(key % 11 == 0, "True").otherwise("False").alias("Proxy_VPN_TOR"),
        F.when(key % 7 == 0, "True").otherwise("False").alias("Hosting"),
        F.when(key == 13, "Failed").otherwise("Success").alias("Lookup_Status"),
        F.when(key % 5 == 0, "other").otherwise("service").alias("Provider"))


def domain_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as results of a domain lookup."""
    key = F.col("n_nationkey")
    born = F.date_format(F.date_sub(F.lit("2024-01-01").cast("date"), key * 60), "yyyy-MM-dd'T'00:00:00'Z'")
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("mail"), key.cast("string"), F.lit(".example.com")).alias("Domain"),
        F.concat(F.lit("Registrar "), F.col("n_regionkey").cast("string")).alias("Registrar"),
        born.alias("RegistrationDate"), F.when(key % 4 == 0, "Failed").otherwise("Success").alias("Lookup_Status"))


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as mails: the addresses and the subject are found in the whole text."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("_Row"), F.col("text").alias("SenderAddress"), F.col("text").alias("Subject"))


# --- hunts -----------------------------------------------------------------------------------

@query
def impossible_travel(spark, sf_dir):
    """H1, W2, J1, F17."""
    return hunts.impossible_travel(logins(spark, sf_dir), ip_reference(spark, sf_dir))


@query
def impossible_travel_custom(spark, sf_dir):
    """H1 with other windows and without device risk."""
    options = hunts.TravelOptions(country_hours=2, region_hours=6, elevated_hours=48, use_device_risk=False)
    return hunts.impossible_travel(logins(spark, sf_dir), ip_reference(spark, sf_dir), options, salt=4)


@query
def suspicious_logins(spark, sf_dir):
    """H2, R29."""
    options = hunts.LoginOptions(trusted_countries="United States\nnation_3, NATION_5,nation_7,nation_11,nation_14")
    return hunts.suspicious_logins(logins(spark, sf_dir), ip_reference(spark, sf_dir), options)


@query
def suspicious_logins_infrastructure(spark, sf_dir):
    """H2 without the country rule."""
    options = hunts.LoginOptions(use_country=False, require_device_risk=False)
    return hunts.suspicious_logins(logins(spark, sf_dir), ip_reference(spark, sf_dir), options)


@query
def suspicious_mail(spark, sf_dir):
    """H3, R17, J8."""
    options = hunts.MailOptions(keywords=KEYWORDS, service_domains=SERVICES, now=HUNT_MOMENT)
    return hunts.suspicious_mail(mails(spark, sf_dir), domain_reference(spark, sf_dir), options,
                                 domain_columns=["SenderAddress"])


@query
def suspicious_mail_range(spark, sf_dir):
    """H3 with a registration range."""
    options = hunts.MailOptions(registered_after="2022-09-01", registered_before="2023-06-01", now=HUNT_MOMENT)
    return hunts.suspicious_mail(mails(spark, sf_dir), domain_reference(spark, sf_dir), options,
                                 domain_columns=["SenderAddress"])


@query
def mail_hunt_totals(spark, sf_dir):
    """A14."""
    return facets.hunt_totals(QUERIES["suspicious_mail"](spark, sf_dir))


# --- predicates ------------------------------------------------------------------------------

def _keep(df: DataFrame, test: Column, *columns: str) -> DataFrame:
    return df.filter(test).select(*[ref(c) for c in columns])


@query
def filter_equals(spark, sf_dir):
    """F2."""
    df = table(spark, sf_dir, "part")
    return _keep(df, P.field_equals(df, "P_TYPE", "economy"), "p_partkey", "p_name", "p_type")


@query
def filter_contains(spark, sf_dir):
    """F3 over whole texts."""
    df = table(spark, sf_dir, "documents")
    return _keep(df, P.field_contains(df, "text", "ÉTION"), "doc_id", "lang")


@query
def filter_like(spark, sf_dir):
    """F4."""
    df = table(spark, sf_dir, "part")
    return _keep(df, P.field_like(df, "p_name", "*E*W*"), "p_partkey", "p_name")


@query
def filter_compare(spark, sf_dir):
    """F5 on typed columns."""
    df = table(spark, sf_dir, "orders")
    test = P.all_of(P.field_compare(df, "o_orderdate", ">=", "1997-01-01"), P.field_compare(df, "o_totalprice", ">", "250000"),
                    P.field_compare(df, "o_totalprice", "<=", "400000"))
    return _keep(df, test, "o_orderkey", "o_totalprice")


@query
def filter_compare_text(spark, sf_dir):
    """F5, F14 on texts: times, numbers and a mixed pair."""
    df = table(spark, sf_dir, "events").select("event_id", iso_text(F.col("ts").cast("timestamp")).alias("seen_time"),
                                               F.get_json_object("props", "$.k").alias("k"), "event_type")
    test = P.all_of(P.after(df, "seen_time", "2024-01-05T14:00:00+02:00"), P.before(df, "seen_time", "2024-01-20"),
                    P.field_compare(df, "k", "<", "9"), P.field_compare(df, "event_type", ">=", "5"),
                    P.field_compare(df, "event_type", "<", "Purge"))
    return _keep(df, test, "event_id", "seen_time", "k")


@query
def filter_negate(spark, sf_dir):
    """F6."""
    df = table(spark, sf_dir, "customer")
    return _keep(df, P.negate(P.field_contains(df, "c_mktsegment", "machin")), "c_custkey", "c_mktsegment")


def _with_gaps(spark, sf_dir) -> DataFrame:
    kind = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").withColumn("clerk", F.when(kind == "1-URGENT", "").when(
        kind != "5-LOW", kind))


@query
def filter_blank(spark, sf_dir):
    """absent and blank alike."""
    df = _with_gaps(spark, sf_dir)
    return _keep(df, P.field_is_blank(df, "clerk"), "o_orderkey", "o_orderpriority")


@query
def filter_populated(spark, sf_dir):
    """F7 negated."""
    df = _with_gaps(spark, sf_dir)
    return _keep(df, P.field_is_populated(df, "clerk"), "o_orderkey", "clerk")


@query
def filter_any_field(spark, sf_dir):
    """F8."""
    df = table(spark, sf_dir, "customer")
    return _keep(df, P.any_field_contains(df, "91"), "c_custkey", "c_name")


@query
def filter_grouped(spark, sf_dir):
    """F9."""
    df = table(spark, sf_dir, "events")
    test = P.any_of(P.all_of(P.field_equals(df, "event_type", "CLICK"), P.field_compare(df, "value", ">", "40")),
                    P.all_of(P.field_equals(df, "event_type", "error"), P.negate(P.field_equals(df, "user_id", "7"))))
    return _keep(df, test, "event_id", "event_type", "user_id")


@query
def filter_alias(spark, sf_dir):
    """a logical field over several columns."""
    df = records(spark, sf_dir)
    test = P.any_of(P.field_equals(df, "ip", "198.51.100.7:443"), P.field_contains(df, "ip", "db8::2a]"),
                    P.field_equals(df, "user", "user12"))
    return _keep(df, test, "_Row", "ClientIP", "UserKey")


@query
def filter_partial_name(spark, sf_dir):
    """An exact name hides partial names only where the record has it."""
    df = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("value") > 10, F.col("event_type")).alias("kind"),
        F.concat(F.col("event_type"), F.lit("-"), F.col("user_id").cast("string")).alias("kind_detail"))
    return _keep(df, P.field_contains(df, "KIND", "click"), "event_id", "kind", "kind_detail")


@query
def filter_tail(spark, sf_dir):
    """F1, F5 on the open tail of a record."""
    df = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,string>").alias("fields"))
    df = df.filter(P.field_compare(df, "k", ">=", "90"))
    return df.select("event_id", F.col("fields")["k"].alias("k"))


@query
def operation_is(spark, sf_dir):
    """reaches the scan."""
    return _keep(table(spark, sf_dir, "events"), P.operation_is("purchase", "event_type"), "event_id", "value")


@query
def value_selection(spark, sf_dir):
    """F13."""
    df = table(spark, sf_dir, "part")
    test = P.all_of(P.value_selection(df, "p_type", ["ECONOMY", "promo"], []),
                    P.value_selection(df, "p_brand", [], ["Brand#2", "brand#17"]))
    return _keep(df, test, "p_partkey", "p_type", "p_brand")


@query
def drop_blank_rows(spark, sf_dir):
    """F16."""
    df = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("_Row"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("name"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "  ").when(F.col("c_mktsegment") == "BUILDING", "x").alias("note"))
    return shape.drop_blank_rows(df).select("_Row")


@query
def broad_categories(spark, sf_dir):
    """flags of the overlapping categories."""
    df = records(spark, sf_dir)
    return df.select("_Row", *[in_category(df, c).alias(c) for c in ("logins", "teams", "files", "mail", "inbox_rules",
                                                                     "other")])


# --- facets and metrics ----------------------------------------------------------------------

@query
def category_counts(spark, sf_dir):
    """A2, F10."""
    return facets.category_counts(records(spark, sf_dir))


@query
def operation_counts(spark, sf_dir):
    """A1."""
    return facets.operation_counts(records(spark, sf_dir))


@query
def operation_facets(spark, sf_dir):
    """A5."""
    df = records(spark, sf_dir)
    return facets.faceted_counts(df.filter(P.field_compare(df, "CreationTime", ">=", "2024-01-03")), "mail", "UserLoggedIn")


@query
def value_facets(spark, sf_dir):
    """One page of values."""
    return facets.value_facets(table(spark, sf_dir, "part"), "p_name", "b", 5, 40)


@query
def value_facet_totals(spark, sf_dir):
    """A6."""
    return facets.value_facet_totals(table(spark, sf_dir, "part"), "p_name", "b", 5, 10)


@query
def review_metrics(spark, sf_dir):
    """A3, A4, R18."""
    return facets.review_metrics(records(spark, sf_dir))


@query
def trace_metrics(spark, sf_dir):
    """A10."""
    df = records(spark, sf_dir).select("_Row", ref("UserKey").alias("SenderAddress"), ref("UserId").alias("RecipientAddress"),
                                       ref("ClientIP").alias("FromIP"), ref("ActorIpAddress").alias("Peer IP"), "`Review.Tag`")
    return facets.trace_metrics(df)


@query
def populated_profile(spark, sf_dir):
    """R18."""
    df = table(spark, sf_dir, "events").withColumn("fields", F.from_json("props", "map<string,string>")).withColumn(
        "empty", F.lit("  "))
    return facets.populated_profile(df)


@query
def distinct_ips(spark, sf_dir):
    """A7, R15."""
    df = records(spark, sf_dir)
    return enrich.distinct_ips(df, enrich.ip_columns(df.columns))


@query
def email_domain_list(spark, sf_dir):
    """A8, R17."""
    return enrich.distinct_domains(table(spark, sf_dir, "documents"), ["text"])


@query
def message_id_list(spark, sf_dir):
    """A8."""
    return facets.distinct_message_ids(shape.normalize_message_ids(records(spark, sf_dir)))


@query
def case_rollup(spark, sf_dir):
    """Datasets (customers) of a case (nation) and their rows."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    datasets = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("rowCount")).join(
        customer, F.col("o_custkey") == F.col("c_custkey"))
    return facets.case_rollup(datasets.withColumnRenamed("c_nationkey", "caseId"))


# --- reference data --------------------------------------------------------------------------

@query
def enrich_left(spark, sf_dir):
    """J1."""
    df = records(spark, sf_dir).select("_Row", F.when(ref("Operation") != "", ref("ClientIP")).alias("ClientIP"))
    return enrich.enrich_ip(df, "ClientIP", ip_reference(spark, sf_dir), row_id="_Row")


@query
def pending_lookups(spark, sf_dir):
    """J7."""
    wanted = enrich.distinct_ips(records(spark, sf_dir), ["ClientIP"])
    return enrich.pending_lookups(wanted, ip_reference(spark, sf_dir), "ip", providers=["service"])


@query
def local_lookups(spark, sf_dir):
    """Addresses that no lookup service knows."""
    df = records(spark, sf_dir).join(table(spark, sf_dir, "events").select(
        F.col("event_id").alias("_Row"), F.concat((_k() + 100).cast("string"), F.lit(".64.0.1")).alias("FromIP"),
        F.concat((_k() + 100).cast("string"), F.lit(".254.0.1:80")).alias("ToIP")), "_Row")
    return enrich.local_references(enrich.distinct_ips(df, ["FromIP", "ToIP", "ActorIpAddress"]))


@query
def lookup_plan(spark, sf_dir):
    """What an enrichment has to fetch."""
    df = table(spark, sf_dir, "events").select(F.concat_ws(".", (_k() + 1).cast("string"), F.lit("8"), F.lit("4"),
                                                           F.lit("4")).alias("ClientIP"))
    return activity_plan.plan_lookups(df, ip_reference(spark, sf_dir)).pending


@query
def reference_upsert(spark, sf_dir):
    """U2."""
    fresh = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")).select(
        F.concat(F.lit("198.51.100."), (F.col("c_nationkey") + 10).cast("string")).alias("ip"),
        F.concat(F.lit("Fresh "), F.col("n").cast("string")).alias("Country"))
    current = ip_reference(spark, sf_dir).select("ip", "Country", "ISP")
    return enrich.upsert(current, fresh, "ip")


@query
def app_names(spark, sf_dir):
    """J3, R22."""
    return _apps(spark, sf_dir).select("c_custkey", ref("AppMapping.ClientAppId").alias("app"))


def _apps(spark, sf_dir) -> DataFrame:
    def uuid(key: Column) -> Column:
        return F.concat(F.lit("00000000-0000-00AA-0000-"), F.lpad(key.cast("string"), 12, "0"))
    apps = table(spark, sf_dir, "nation").select(
        F.lower(uuid(F.col("n_nationkey"))).alias("app_id"), F.col("n_name").alias("name"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(
        F.col("c_mktsegment") == "BUILDING", "no-uuid").otherwise(uuid(F.col("c_nationkey") + 5)).alias("ClientAppId"))
    return enrich.map_app_names(rows, apps, row_id="c_custkey")


@query
def app_totals(spark, sf_dir):
    """A12."""
    return facets.app_totals(_apps(spark, sf_dir))


@query
def domain_attributes(spark, sf_dir):
    """J2, R17."""
    df = enrich.enrich_domains(mails(spark, sf_dir).select("_Row", "SenderAddress"), "SenderAddress",
                               domain_reference(spark, sf_dir), row_id="_Row")
    return df.select("_Row", *[ref(f"SenderAddress_WHOIS_{a}") for a in (
        "Domain", "Registrar", "RegistrationDate", "Lookup_Status", "DNSSEC")])


@query
def pending_domains(spark, sf_dir):
    """A8, J7 for domains."""
    return trace_plan.pending_domains(mails(spark, sf_dir), domain_reference(spark, sf_dir))


def _hosts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.lower(F.try_parse_url("url", F.lit("HOST"))).alias("host"))


@query
def service_domains(spark, sf_dir):
    """Hosts under a listed domain; the list comes from the hosts' own parent domains."""
    hosts = _hosts(spark, sf_dir)
    parents = hosts.select(F.substring_index("host", ".", -2).alias("service"))
    listed = parents.groupBy("service").agg(F.count(F.lit(1)).alias("position"))
    return enrich.match_services(hosts, "host", listed, row_id="page_id")


def _document_ips(spark, sf_dir) -> DataFrame:
    """Every dotted quadruple of the texts, valid or not."""
    found = F.regexp_extract_all("text", F.lit(r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(found).alias("pos", "raw")).withColumn("pos", F.col("pos").cast("bigint")).withColumn(
        "ip", normalize_ip(F.col("raw")))


@query
def ip_classes(spark, sf_dir):
    """R15, R16, J9."""
    return _document_ips(spark, sf_dir).select("doc_id", "pos", "raw", "ip", classify_ip(F.col("ip")).alias("ip_class"),
                                               is_global(F.col("ip")).alias("is_global"))


@query
def network_match(spark, sf_dir):
    """J9 against a table of ranges: one /8 per nation, one /4 per region."""
    nation = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    wide = nation.select(F.concat((key * 9 + 10).cast("string"), F.lit(".0.0.0/8")).alias("cidr"),
                         F.col("n_name").alias("label"), key.cast("bigint").alias("position"))
    broad = nation.groupBy("n_regionkey").agg(F.min("n_name").alias("label")).select(
        F.concat((F.col("n_regionkey") * 32).cast("string"), F.lit(".0.0.0/4")).alias("cidr"), "label",
        (F.col("n_regionkey") + 100).cast("bigint").alias("position"))
    found = _document_ips(spark, sf_dir)
    return enrich.match_networks(found, "ip", wide.unionByName(broad)).select("doc_id", "pos", "ip", "network")


# --- findings, tags, narratives ----------------------------------------------------------------

@query
def findings_join(spark, sf_dir):
    """J4."""
    rows = logins(spark, sf_dir).select("_Row", "UserId")
    found = QUERIES["impossible_travel"](spark, sf_dir).select("_Row", "Risk", "Score")
    joined = review.join_findings(rows, found, "Travel")
    return joined.select("_Row", "UserId", ref("Travel.Risk").alias("risk"), ref("Travel.Score").alias("score"))


def _ids(spark, sf_dir, test: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter(test).select(F.col("event_id").alias("_Row"))


def _tag_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows, tags, requested ids; some requested ids exist nowhere."""
    rows = logins(spark, sf_dir)
    asked = _ids(spark, sf_dir, "event_type = 'error'").union(
        table(spark, sf_dir, "customer").select((-F.col("c_custkey") - 1).alias("_Row")))
    return rows, _ids(spark, sf_dir, "value > 10"), asked


@query
def tag_rows(spark, sf_dir):
    """J5, J10, U1, U4."""
    return review.change_tags(*_tag_tables(spark, sf_dir), True)


@query
def untag_rows(spark, sf_dir):
    """U3."""
    return review.change_tags(*_tag_tables(spark, sf_dir), False)


@query
def tag_change(spark, sf_dir):
    """A15."""
    return review.tag_change(*_tag_tables(spark, sf_dir), True)


@query
def tagged_review(spark, sf_dir):
    """J5, F15."""
    rows, tags, _ = _tag_tables(spark, sf_dir)
    tagged = review.tagged_only(review.mark_tagged(rows.select("_Row", "UserId"), tags))
    return tagged.withColumnRenamed("Review.Tag", "tag")


@query
def narrative_activity(spark, sf_dir):
    """R23-R25, J6."""
    df = records(spark, sf_dir).withColumns({
        "Subject": F.concat(F.lit("Order  "), F.col("RecordType")), "SourceFileName": F.concat(F.col("UserKey"), F.lit(".txt")),
        "InboxRule.Name": F.concat(F.lit("Rule "), F.col("UserKey")), "ObjectId": F.lit("object-1"),
        "ResultStatus": F.lit("Succeeded")}).drop("ActorIpAddress")
    df = enrich.enrich_ip(df, "ClientIP", ip_reference(spark, sf_dir), row_id="_Row")
    chosen = _ids(spark, sf_dir, "value > 2")
    return review.add_narrative(df, review.activity_narrative(df), chosen).select("_Row", "Event")


@query
def narrative_trace(spark, sf_dir):
    """R26."""
    df = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("Subject"), F.col("source").alias("Sender"),
                                                  F.col("lang").alias("RecipientAddress"))
    return df.select("doc_id", review.trace_narrative(df).alias("Event"))


@query
def reviewed_page(spark, sf_dir):
    """Lifecycle B: joined rows, a predicate over a derived column, one sorted page."""
    rows = logins(spark, sf_dir)
    data = activity_plan.ReviewData(
        ip_reference=ip_reference(spark, sf_dir), enriched_columns=["ClientIP"],
        travel=QUERIES["impossible_travel"](spark, sf_dir), tags=_ids(spark, sf_dir, "value > 10"))
    view = activity_plan.review(rows, data)
    kept = activity_plan.filtered(view, P.field_equals(view, "Travel.Risk", "high"))
    page = ordering.sorted_page(kept, "Travel.Score", "desc", 2, 40)
    shown = shape.select_columns(page, ["_Row", "UserId", "Travel.Score", "ClientIP_IPAPI_Country"])
    return shown.withColumnRenamed("Travel.Score", "score")


# --- shaping -----------------------------------------------------------------------------------

@query
def flatten_props(spark, sf_dir):
    """Nested payload to leaves; a leaf named like a field keeps a prefix."""
    df = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("_Row"), F.col("event_type").alias("Operation"),
        F.concat(F.lit('{"Operation":"inner","Actor":{"Id":'), F.col("user_id").cast("string"), F.lit(',"Props":'),
                 F.col("props"), F.lit(',"None":{}},"Tags":["a",{"b":1}],"Gone":null'),
                 F.when(F.col("value") < 2, "").otherwise("}")).alias("AuditData"))
    wide = shape.expand_payload(df, promote=["Actor.Id"])
    return wide.select("_Row", "Operation", ref("Actor.Id").alias("actor"), "_ParseError",
                       *[F.try_element_at("fields", F.lit(k)).alias(k.replace(".", "_")) for k in (
                           "AuditData.Operation", "Actor.Props.k", "Tags", "Gone")],
                       F.size("fields").cast("bigint").alias("leaves"))


def _rules(spark, sf_dir) -> DataFrame:
    def pair(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("Name"), value.alias("Value"))
    pairs = F.array(pair("NAME", F.col("o_orderpriority")), pair("Force", F.lit("True")), pair("MoveToFolder", F.lit("")),
                    pair("From", F.col("o_custkey").cast("string")), pair("NAME", F.col("o_orderstatus")))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("_Row"), F.when(F.col("o_totalprice") > 100000, "New-InboxRule").otherwise("Send").alias(
            "Operation"), F.to_json(pairs).alias("Parameters"), F.col("o_orderpriority").alias("MoveToFolder"))


@query
def named_properties(spark, sf_dir):
    """Last value of a name wins."""
    p = payload.named_properties(F.col("Parameters"))
    made = _rules(spark, sf_dir).withColumn("p", p).withColumn("folded", payload.folded(F.col("p")))
    return made.select("_Row", payload.property_value(F.col("folded"), "name").alias("name"),
                       payload.property_value(F.col("folded"), "from").alias("sender"),
                       F.size("p").cast("bigint").alias("names"))


@query
def rule_details(spark, sf_dir):
    """R11, R12."""
    df = shape.with_inbox_rules(_rules(spark, sf_dir))
    return df.select("_Row", *[ref(f"InboxRule.{n}").alias(n.lower()) for n in ("Name", "From", "MoveToFolder", "Details")])


@query
def login_details(spark, sf_dir):
    """R13."""
    def pair(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("Name"), value.alias("Value"))
    df = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("_Row"), F.when(F.col("event_type") == "view", "FileAccessed").otherwise("UserLoggedIn").alias(
            "Operation"),
        F.to_json(F.array(pair("OS", F.col("event_type")), pair("IsCompliant", _graded(3, 6)))).alias("DeviceProperties"),
        F.to_json(F.array(pair("RequestType", F.col("props")))).alias("ExtendedProperties"))
    made = shape.with_login_details(df)
    return made.select("_Row", *[ref(f"Login.{n}").alias(n.lower()) for n in ("OS", "IsCompliant", "RequestType")])


@query
def mail_details(spark, sf_dir):
    """R14."""
    df = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("_Row"), F.when(F.col("event_type") == "view", "MailItemsAccessed").otherwise("FileAccessed")
        .alias("Operation"),
        F.when(F.col("value") > 8, F.concat(F.lit("Client=REST;UserAgent=Agent/"), F.col("user_id").cast("string"), F.lit(" x")))
        .when(F.col("value") > 4, F.lit("Client=OWA")).otherwise("").alias("ActorInfoString"),
        F.lit("Reported").alias("UserAgent"))
    made = shape.with_mail_details(df)
    return made.select("_Row", *[ref(f"Mail.{n}").alias(n.lower()) for n in ("ActorInfoString", "UserAgent",
                                                                             "ClientInfoString")])


@query
def message_ids(spark, sf_dir):
    """Ids in whole texts."""
    df = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("InternetMessageId"))
    return shape.with_message_ids(df).select("doc_id", "InternetMessageIDs")


@query
def normalized_message_ids(spark, sf_dir):
    """R6."""
    return shape.normalize_message_ids(records(spark, sf_dir)).select("_Row", "InternetMessageIDs")


def _turns(spark, sf_dir) -> DataFrame:
    """Conversation turns as audit records with messages nested in JSON text."""
    name = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string"),
                    F.lit("@mail.example.com"))
    first = F.struct(F.concat(F.lit("<"), name, F.lit(">")).alias("InternetMessageId"), F.col("text").alias("Subject"))
    second = F.struct(F.upper(name).alias("internetMessageID"), F.length("text").alias("SizeInBytes"))
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("_Row"),
        F.concat(F.lit('[{"FolderItems":['), F.to_json(first), F.lit(","), F.to_json(second), F.lit("]}]")).alias("Folders"),
        F.when(F.col("role") == "user", F.concat(name, F.lit("; lost@mail.example.com"))).otherwise("").alias(
            "InternetMessageIDs"))


@query
def message_pairs(spark, sf_dir):
    """R8, J11."""
    return shape.message_pairs(_turns(spark, sf_dir)).select(
        "_Row", F.col("position").cast("bigint").alias("position"), "message_id", "subject", "size")


@query
def message_subjects(spark, sf_dir):
    """R9."""
    return shape.message_subjects(_turns(spark, sf_dir))


@query
def pairs_dedup(spark, sf_dir):
    """A9."""
    return shape.unique_messages(shape.message_pairs(_turns(spark, sf_dir)), include_size=True)


@query
def pair_totals(spark, sf_dir):
    """A13."""
    return shape.pair_totals(shape.message_pairs(_turns(spark, sf_dir)))


@query
def unpaired_ids(spark, sf_dir):
    """J11 on tables."""
    turns = _turns(spark, sf_dir)
    listed = turns.select("_Row", F.explode(F.split("InternetMessageIDs", ";")).alias("i")).select(
        "_Row", format_message_id(F.col("i")).alias("message_id")).filter("message_id <> ''")
    pairs = shape.message_pairs(turns.drop("InternetMessageIDs"))
    return shape.unpaired_ids(listed, pairs)


@query
def trace_headers(spark, sf_dir):
    """R4."""
    df = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("_Row"), F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderpriority")).alias(
            "sender_address"), F.col("o_orderstatus").alias("From Address"), F.col("o_orderdate").cast("date").cast("string").alias(
            "Received Time"))
    made = shape.canonical_headers(df)
    return made.select("_Row", "SenderAddress", "Received", ref("From Address").alias("original"))


@query
def clean_table(spark, sf_dir):
    """R18, R20, F16."""
    df = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("\x01"), F.col("text"), F.lit("\x0b")).alias("body"),
        F.lit(" ").alias("blank"), F.col("lang").alias("tag"), F.when(F.col("lang") == "en", F.col("source")).alias("origin"))
    return shape.clean_table(df, ["id", "body", "blank", "Tag", "tag"]).withColumnRenamed("tag (2)", "tag_2")


@query
def populated_view(spark, sf_dir):
    """Populated columns of a filtered frame, in display order."""
    df = records(spark, sf_dir).filter("RecordType = 'view'").withColumn("Zone", F.lit(""))
    names = facets.populated_columns(df)
    return shape.select_columns(df, available=names, default=9).withColumnRenamed("Review.Tag", "tag")


def _customer_nations(spark, sf_dir) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))


@query
def domain_registration(spark, sf_dir):
    """Registrations that customers hold."""
    nation = _customer_nations(spark, sf_dir)
    key = F.col("c_custkey").cast("string")
    text = F.concat(
        F.lit('{"ldhName":"'), F.upper("n_name"), F.lit('.COM","status":["active","'), key, F.lit('"],"events":['),
        F.lit('{"eventAction":"Registration","eventDate":"19'), F.lpad(key, 2, "0"), F.lit('-01-01T00:00:00Z"},'),
        F.lit('{"eventAction":"last changed","eventDate":""}],"entities":[{"roles":["abuse"],"handle":"no"},'),
        F.lit('{"roles":["registrar"],"handle":"H'), key, F.lit('","vcardArray":["vcard",[["version",{},"text","4.0"],'),
        F.when(F.col("n_regionkey") == 1, F.concat(F.lit('["fn",{},"text","Reg '), key, F.lit('"],'))).otherwise(""),
        F.when(F.col("n_regionkey") < 3, F.lit('["org",{},"text",["Org","Unit"]],')).otherwise(""),
        F.lit('["x",{},"text","y"]]]}],"nameservers":[{"ldhName":"NS2.X"},{"ldhName":"ns1.x"},{"ldhName":"ns2.x"}],'),
        F.lit('"secureDNS":{"delegationSigned":'), F.when(F.col("n_regionkey") == 0, "true").otherwise("false"), F.lit("}}"))
    parsed = payload.parse_domain_registration(text, F.lower("n_name"))
    return nation.select(parsed.alias("p")).select("p.*")


@query
def text_renderings(spark, sf_dir):
    """R1, R23, R27, R29 over whole tables."""
    df = table(spark, sf_dir, "documents")
    named = df.select("doc_id", F.when(F.col("lang") == "en", "  ").otherwise(F.col("source")).alias("first"), "text")
    return named.select("doc_id", F.coalesce(first_text(named, ["first", "text"]), F.lit("")).alias("shown"),
                        shorten(F.col("text"), 40).alias("short"), to_text(named, "first").alias("as_text"))


@query
def word_readings(spark, sf_dir):
    """R27, R29."""
    word = F.element_at(F.array(F.lit(" Yes"), F.lit("0"), F.lit("TRUE "), F.lit("maybe"), F.lit("no")),
                        (F.col("n_regionkey") + 1))
    return _customer_nations(spark, sf_dir).select(
        "c_custkey", truthy(word).alias("is_true"), falsey(word).alias("is_false"),
        country_key(F.when(F.col("n_regionkey") == 0, "U.S.A.").otherwise(F.col("n_name"))).alias("country"),
        compact(F.col("n_name")).alias("compact"))


def _time_texts(spark, sf_dir) -> DataFrame:
    """Order dates in several written shapes."""
    day = F.col("o_orderdate").cast("timestamp")
    kind = F.col("o_orderpriority")
    shown = (F.when(kind == "1-URGENT", F.date_format(day, "yyyy-MM-dd'T'10:00:00'Z'"))
             .when(kind == "2-HIGH", F.date_format(day, "yyyy-MM-dd'T'08:30:15.25'+05:30'"))
             .when(kind == "3-MEDIUM", F.date_format(day, "yyyyMMdd"))
             .when(kind == "4-NOT SPECIFIED", F.date_format(day, "M/d/yyyy 7:5:9"))
             .when(F.col("o_orderstatus") == "F", " ").when(F.col("o_orderstatus") == "P", F.lit("unknown"))
             .otherwise(F.date_format(day, "yyyy-MM-dd")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_Row"), shown.alias("Registered date"))


@query
def parsed_times(spark, sf_dir):
    """R28."""
    c = ref("Registered date")
    return _time_texts(spark, sf_dir).select("_Row", F.unix_micros(parse_time(c)).alias("micros"),
                                             F.unix_micros(parse_sortable_time(c)).alias("sort_micros"))


# --- order -------------------------------------------------------------------------------------

@query
def sort_time(spark, sf_dir):
    """O1: position of every row."""
    return ordering.sorted_positions(_time_texts(spark, sf_dir), "Registered date", "desc").select("_Row", "position")


@query
def sort_number(spark, sf_dir):
    """O2."""
    df = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("_Row"), F.when(F.col("o_orderstatus") == "P", F.concat(F.col("o_orderpriority"), F.lit("?")))
        .when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.col("o_totalprice").cast("decimal(12,2)").cast("string"))
        .alias("Travel.Score"))
    return ordering.sorted_positions(df, "Travel.Score", "asc").select("_Row", "position")


@query
def sort_risk(spark, sf_dir):
    """O3."""
    df = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("_Row"), F.when(F.col("o_orderstatus") == "P", "").otherwise(
            F.initcap(F.element_at(F.split("o_orderpriority", "-"), 2))).alias("Travel.Risk"))
    return ordering.sorted_positions(df, "Travel.Risk", "desc").select("_Row", "position")


@query
def page_rows(spark, sf_dir):
    """O4."""
    df = _time_texts(spark, sf_dir)
    page = ordering.sorted_page(df, "Registered date", "asc", 3, 25)
    return page.withColumnRenamed("Registered date", "registered")


@query
def top_orders(spark, sf_dir):
    """O5."""
    return ordering.top_k(table(spark, sf_dir, "orders"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 20).select(
        "o_orderkey", "o_totalprice")


@query
def row_ordinals(spark, sf_dir):
    """Ordinal of each event within its type."""
    return ordering.with_row_ids(table(spark, sf_dir, "events"), "event_id", "ordinal", ["event_type"]).select(
        "event_id", "event_type", "ordinal")


@query
def previous_event(spark, sf_dir):
    """W2."""
    df = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return ordering.with_previous(df, ["user_id"], [F.col("at"), F.col("event_id")], F.col("event_id"),
                                  "previous").select("event_id", "previous")


@query
def first_event(spark, sf_dir):
    """W3."""
    df = table(spark, sf_dir, "events")
    return ordering.first_by(df, [F.col("user_id"), F.lower("event_type")], F.struct("ts", "event_id"),
                             ["user_id", "event_type", "event_id"])


# --- collection ----------------------------------------------------------------------------------

def _targets(spark, sf_dir) -> DataFrame:
    raw = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("box"), (F.col("o_custkey") % 50).cast("string"))).otherwise(F.concat(
            F.when(F.col("o_orderstatus") == "F", "Box").otherwise("box"), (F.col("o_custkey") % 50).cast("string"),
            F.lit("@x.org "))).alias("Mailbox Owner UPN"),
        F.concat(F.lit("m"), F.col("o_orderpriority"), F.lit("@y.org")).alias("internet-message-id"))
    return collection.normalize_targets(collection.read_targets(raw))


@query
def target_check(spark, sf_dir):
    """S6, R30."""
    return _targets(spark, sf_dir)


@query
def target_split(spark, sf_dir):
    """Hand-written lists, here the words of an order's texts."""
    df = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", F.lit("@x.org")).alias("box"),
                                             F.concat_ws(",\n", "p_name", F.lit(" "), "p_type").alias("ids"))
    return collection.split_targets(df, "ids", "box").drop("ids")


@query
def target_dedup(spark, sf_dir):
    """A11."""
    return collection.unique_targets(_targets(spark, sf_dir).filter("problem IS NULL"), "o_orderkey")


def _report(spark, sf_dir) -> DataFrame:
    targets = QUERIES["target_dedup"](spark, sf_dir)
    results = table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 40).alias("box"), "c_mktsegment").agg(
        F.count(F.lit(1)).alias("n")).select(
        F.concat(F.lit("BOX"), F.col("box").cast("string"), F.lit("@X.ORG")).alias("MailboxOwnerUPN"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "<M1-URGENT@y.org>").otherwise("<m5-LOW@y.org>").alias("InternetMessageId"),
        F.col("c_mktsegment").alias("Subject"), F.col("n").alias("AttachmentCount"),
        F.when(F.col("c_mktsegment") == "BUILDING", "HTTP 500").otherwise("").alias("Error"))
    return collection.collection_report(targets, results)


@query
def collection_report(spark, sf_dir):
    """J12, K7."""
    return _report(spark, sf_dir)


@query
def collection_rollup(spark, sf_dir):
    """A17."""
    return collection.collection_rollup(_report(spark, sf_dir))


