"""More operators bound to the driver's tables, each beside its SQL: records, repeated and missing keys, tails, long lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import payload, predicates as P
from ..functions.categories import in_category
from ..functions.mail import split_list
from ..functions.text import compact, country_key, falsey, ref, truthy
from ..operators import enrich, facet_tables, facets, hunts, ordering, rehunt, shape
from ..sources import readers, search_index, writers
from ..sources.reference_store import reference_changes
from . import activity as activity_plan
from .bindings import HUNT_MOMENT, ip_reference, logins, query, records, table
from .bindings_sql import IPREF, LOGINS, RECORDS, SQL, K


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def _dotted(number) -> Column:
    return F.concat_ws(".", *[(F.shiftright(number, bits) % 256).cast("string") for bits in (24, 16, 8, 0)])


@query
def range_match(spark, sf_dir):
    """Ranges that begin and end anywhere and overlap, as many as parts; the first listed one wins."""
    start, part = F.lit(3325231104), F.col("p_partkey")  # 198.51.0.0
    low = start + part * 37 % 65536
    ranges = table(spark, sf_dir, "part").select(
        _dotted(low).alias("low"), _dotted(low + part % 50 * (part % 3) - part % 7).alias("high"),
        F.concat(F.lit("r"), part.cast("string")).alias("label"), (part * 17 % 1000 * 100000000 + part).alias("position"))
    address = start + (F.col("user_id") * 131 + F.col("k") * 7) % 65536
    df = _events(spark, sf_dir).select("event_id", _dotted(address.cast("bigint")).alias("ip"))
    return enrich.match_ranges(df, "ip", ranges, row_id="event_id")


SQL["range_match"] = f"""WITH r AS (SELECT 3325231104 + p_partkey * 37 % 65536 AS low, 3325231104 + p_partkey * 37 % 65536 + p_partkey % 50 * (p_partkey % 3)
      - p_partkey % 7 AS high, 'r' || p_partkey AS label, p_partkey * 17 % 1000 * 100000000 + p_partkey AS position FROM part),
    e AS (SELECT event_id, 3325231104 + (user_id * 131 + {K} * 7) % 65536 AS a FROM events),
    best AS (SELECT a, arg_min(label, position) AS label FROM (SELECT DISTINCT a FROM e) JOIN r ON a BETWEEN low AND high GROUP BY a)
    SELECT event_id, (a >> 24) || '.' || ((a >> 16) % 256) || '.' || ((a >> 8) % 256) || '.' || (a % 256) AS ip, label AS range
    FROM e LEFT JOIN best USING (a)"""


def _older_reference(spark, sf_dir) -> DataFrame:
    """The address reference before some rows came, went and changed."""
    newer = ip_reference(spark, sf_dir)
    number = F.substring_index("ip", ".", -1).cast("int")
    older = newer.where(number % 6 != 1).withColumns({
        "Country": F.when(number % 5 == 0, F.lit("Elsewhere")).otherwise(F.col("Country")),
        "Hosting": F.when(number == 2, "True").otherwise(F.col("Hosting"))})
    return older.unionByName(newer.where(number == 3).withColumn("ip", F.lit("203.0.113.9")))


@query
def travel_rehunt(spark, sf_dir):
    """H1, K4: findings of an older reference, brought up to date for the users of changed addresses."""
    events, before, now = logins(spark, sf_dir), _older_reference(spark, sf_dir), ip_reference(spark, sf_dir)
    changed = reference_changes(before, now, "ip")
    return rehunt.rehunt_travel(events, hunts.impossible_travel(events, before), changed, now).select("_Row", "Risk", "Score", "Reasons")


SQL["travel_rehunt"] = """SELECT _Row, "Risk", "Score", "Reasons" FROM (""" + SQL["impossible_travel"] + ")"


@query
def login_rehunt(spark, sf_dir):
    """H2, K4: the same for logins from changed addresses."""
    options = hunts.LoginOptions(trusted_countries="United States\nnation_3, NATION_5,nation_7,nation_11,nation_14")
    events, before, now = logins(spark, sf_dir), _older_reference(spark, sf_dir), ip_reference(spark, sf_dir)
    changed = reference_changes(before, now, "ip")
    found = rehunt.rehunt_logins(events, hunts.suspicious_logins(events, before, options), changed, now, options)
    return found.select("_Row", "Risk", "Score", "Reasons")


SQL["login_rehunt"] = """SELECT _Row, "Risk", "Score", "Reasons" FROM (""" + SQL["suspicious_logins"] + ")"


def _facet_parts(spark, sf_dir) -> DataFrame:
    """Parts of nine files: most at once, some added, one replaced, one dropped."""
    df = records(spark, sf_dir)
    source = F.concat(F.lit("f"), (F.col("_Row") % 9).cast("string"))

    def parts(chosen: DataFrame) -> DataFrame:
        members = {"users": F.array(facets.identity(chosen)), "ips": enrich.addresses_of(chosen), "messageIds": split_list(F.col("InternetMessageIDs"))}
        return facet_tables.facet_parts(chosen, source, members, values=["RecordType"])

    first, later = parts(df.where("_Row % 9 < 6")), parts(df.where("_Row % 9 >= 5"))
    dropped = spark.createDataFrame([("f2",), ("f5",)], "source string")
    return facet_tables.without_sources(first, dropped).unionByName(later)


@query
def merged_metrics(spark, sf_dir):
    """A3, A4: metrics of the files that are left, from their parts."""
    return facet_tables.metrics_of(_facet_parts(spark, sf_dir), ["users", "ips", "messageIds"])


_LEFT = "records WHERE _Row % 9 <> 2"
SQL["merged_metrics"] = f"""WITH {RECORDS}, q AS (SELECT * FROM {_LEFT}) SELECT 'rows' AS metric, count(*) AS value FROM q UNION ALL
    SELECT 'users', count(DISTINCT lower(coalesce(uid, ukey))) FROM q UNION ALL
    SELECT 'ips', count(DISTINCT ip) FROM (SELECT ip4 AS ip FROM q UNION ALL SELECT ip6 FROM q) UNION ALL
    SELECT 'messageIds', count(DISTINCT i) FROM (SELECT 'm' || k || '@x.org' AS i FROM q UNION ALL SELECT '<m' || user_id || '@x.org>' FROM q) UNION ALL
    SELECT 'tagged', count(tag) FROM q UNION ALL
    SELECT 'columns', 9 + (count(uid) > 0)::INT + (count(ip6) > 0)::INT + (count(tag) > 0)::INT - 1 FROM q"""


@query
def merged_facets(spark, sf_dir):
    """A2, A5: facets of the files that are left, with a category and an operation chosen."""
    return facet_tables.facets_of(_facet_parts(spark, sf_dir), "mail", "UserLoggedIn")


SQL["merged_facets"] = f"""WITH {RECORDS}, q AS (SELECT * FROM {_LEFT})
    SELECT 'all' AS facet, '' AS name, count(*) AS count FROM q UNION ALL
    SELECT 'operationTotal', '', count(*) FROM q WHERE event_type = 'view' UNION ALL
    SELECT 'category', c, count(_Row) FROM (SELECT unnest(['logon','inbox_rules','transport_rules','mailbox_permissions',
      'email_access','file_access','other']) AS c) LEFT JOIN q ON kind = c GROUP BY c UNION ALL
    SELECT 'operation', op, count(*) FROM q WHERE event_type = 'view' GROUP BY op"""


@query
def merged_values(spark, sf_dir):
    """Operations and the values of a column."""
    parts = _facet_parts(spark, sf_dir)
    values = facet_tables.values_of(parts, "RecordType").select(F.lit("value").alias("list"), F.col("value").alias("name"), "count")
    return values.unionByName(facet_tables.operations_of(parts).select(F.lit("operation").alias("list"), "name", "count"))


SQL["merged_values"] = f"""WITH {RECORDS}, q AS (SELECT * FROM {_LEFT}) SELECT 'value' AS list, event_type AS name, count(*) AS count FROM q GROUP BY event_type
    UNION ALL SELECT 'operation', CASE WHEN op = '' THEN 'Unknown' ELSE op END, count(*) FROM q GROUP BY op"""


@query
def value_facets_deep(spark, sf_dir):
    """The page of values behind a line that was seen, without skipping the lines before."""
    df = table(spark, sf_dir, "customer").select(F.concat(F.lit("N"), (F.col("c_custkey") % 700).cast("string")).alias("name"))
    return facets.value_facets_after(df, "name", (3, "n350"), limit=60)


SQL["value_facets_deep"] = """WITH c AS (SELECT 'N' || (c_custkey % 700) AS value, count(*) AS count FROM customer GROUP BY 1)
    SELECT value, value AS label, count FROM c WHERE count < 3 OR (count = 3 AND (lower(value) > 'n350' OR (lower(value) = 'n350' AND value > 'n350')))
    ORDER BY count DESC, lower(value), value LIMIT 60"""


@query
def searched_documents(spark, sf_dir):
    """only files whose trigram filter can hold the text take part, then every row is tested."""
    path, text = f"{sf_dir}/documents.parquet", "License"
    files = search_index.possible_files(search_index.build_filters(spark, path, ["text"]), "text", text)
    docs = spark.read.parquet(path).select("doc_id", "text", F.col("_metadata.file_path").alias("opened"))
    return docs.join(files, F.col("opened") == F.col("file"), "left_semi").where(P.field_contains(docs, "text", text)).select("doc_id")


SQL["searched_documents"] = "SELECT doc_id FROM documents WHERE contains(lower(text), 'license')"


# --- payloads ------------------------------------------------------------------------------------

@query
def payload_collisions(spark, sf_dir):
    """Leaves that share a path, and a leaf with the name that one before it is moved to."""
    text = F.concat(F.lit('{"a":{"b":'), F.col("k").cast("string"), F.lit('},"a.b":"last","Operation":"inner","AuditData.Operation":'),
                    F.col("user_id").cast("string"), F.lit("}"))
    df = _events(spark, sf_dir).select(F.col("event_id").alias("_Row"), F.col("event_type").alias("Operation"), text.alias("AuditData"))
    wide = shape.expand_payload(df, promote=[])
    return wide.select("_Row", "Operation", F.col("fields")["a.b"].alias("a_b"), F.size("fields").cast("bigint").alias("leaves"),
                       F.col("fields")["AuditData.Operation"].isin("inner", "last").alias("moved"))


SQL["payload_collisions"] = """SELECT event_id AS _Row, event_type AS "Operation", 'last' AS a_b, 3::BIGINT AS leaves, true AS moved FROM events"""


@query
def payload_order(spark, sf_dir):
    """Leaves in the order of the document, numbers with their fractions; of repeated members the last."""
    number = F.concat((F.col("k") % 9).cast("string"), F.lit(".0"))
    text = F.concat(F.lit('{"Zone":'), number, F.lit(',"Actor": {"Type":"t'), F.col("user_id").cast("string"), F.lit('", "Id":'), number,
                    F.lit(',"Inner":{"B":1,"A":"{\\"x\\":2}"}}, "Gone":{"x":1}, "Beta":['), number, F.lit(', {"y":1,"x":2}],"Alpha":null, "Gone":"'),
                    F.col("event_type"), F.lit('"}'))
    leaves = payload.flatten_texts(text)
    return _events(spark, sf_dir).select("event_id", F.array_join(F.transform(leaves, lambda e: e["path"]), "|").alias("paths"),
                                         F.array_join(F.transform(leaves, lambda e: e["text"]), "|").alias("texts"))


SQL["payload_order"] = f"""WITH e AS (SELECT event_id, user_id, event_type, ({K} % 9)::VARCHAR || '.0' AS n FROM events)
    SELECT event_id, 'Zone|Actor.Type|Actor.Id|Actor.Inner.B|Actor.Inner.A|Gone|Beta|Alpha' AS paths,
      n || '|t' || user_id || '|' || n || '|1|{{"x":2}}|' || event_type || '|[' || n || ',{{"y":1,"x":2}}]|' AS texts FROM e"""


@query
def message_order(spark, sf_dir):
    """The first subject and size in the order of the document, whatever its members are called."""
    key = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("@mail.example.com"))
    text = F.concat(F.lit('{"Zulu":{"Subject":"'), F.col("role"), F.lit('","InternetMessageId":"'), key, F.lit('"},"Mike":[{"SizeInBytes":'),
                    F.length("text").cast("string"), F.lit('.5,"internetMessageID":"'), key, F.lit('","Alpha":{"Subject":"inner","InternetMessageId":"'),
                    key, F.lit('"}}],"Bravo":{"SizeInBytes":1.0,"Subject":"late","InternetMessageId":"'), key, F.lit('"}}'))
    df = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("_Row"), text.alias("Folders"))
    return shape.unique_messages(shape.message_pairs(df), include_size=True)


SQL["message_order"] = """WITH t AS (SELECT 'c' || conv_id || '@mail.example.com' AS id, arg_min(role, turn) AS role, arg_min(length(text), turn) AS n
    FROM conversations GROUP BY conv_id) SELECT '<' || id || '>' AS "InternetMessageId", role AS "Subject", n || '.5' AS "SizeInBytes" FROM t"""


def _audit_records(spark, sf_dir) -> DataFrame:
    """Events as exported audit rows: nested payload, some of it broken, property lists in other spellings in the tail."""
    def pair(name, value):
        return F.struct(F.lit(name).alias("Name"), value.alias("Value"))

    lists = F.to_json(F.array(pair("os", F.col("event_type")), pair("IsManaged", F.lit("False"))))
    inner = F.to_json(F.struct(
        F.when(F.col("k") % 2 == 0, "UserLoggedIn").otherwise("MailItemsAccessed").alias("Operation"),
        lists.alias("deviceProperties"), F.concat(F.lit("203.0.113."), F.col("k").cast("string")).alias("SourceIpAddress"),
        F.struct(F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad((F.col("k") % 40).cast("string"), 12, "0")).alias("ClientAppId"))
        .alias("AppAccessContext"),
        F.struct(F.concat(F.lit("<m"), F.col("k").cast("string"), F.lit("@x.org>")).alias("InternetMessageId")).alias("Item")))
    return _events(spark, sf_dir).select(
        F.col("event_id").alias("_Row"), F.col("user_id").cast("string").alias("User"),
        F.when(F.col("value") < 2, F.lit("{broken")).when(F.col("value") < 3, F.lit("[1]")).otherwise(inner).alias("AuditData"))


@query
def activity_records(spark, sf_dir):
    """Payload, errors and message ids of exported rows."""
    made = readers.read_activity(_audit_records(spark, sf_dir), promote=["Operation"])
    return made.select("_Row", "Operation", "InternetMessageIDs", "_ParseError",
                       F.try_element_at("fields", F.lit("SourceIpAddress")).alias("source"))


SQL["activity_records"] = f"""SELECT event_id AS _Row, CASE WHEN value >= 3 THEN CASE WHEN {K} % 2 = 0 THEN 'UserLoggedIn'
    ELSE 'MailItemsAccessed' END END AS "Operation", CASE WHEN value >= 3 THEN '<m' || {K} || '@x.org>' ELSE '' END AS "InternetMessageIDs",
    CASE WHEN value < 2 THEN 'AuditData is not valid JSON' WHEN value < 3 THEN 'AuditData JSON is not an object' END AS "_ParseError",
    CASE WHEN value >= 3 THEN '203.0.113.' || {K} END AS source FROM events"""


@query
def parse_errors(spark, sf_dir):
    """A18."""
    return facets.parse_errors(readers.read_activity(_audit_records(spark, sf_dir)))


SQL["parse_errors"] = """SELECT count(*) FILTER (value < 3) AS "parseErrors" FROM events"""


@query
def derived_records(spark, sf_dir):
    """The derivation chain finds lists, application ids and addresses in the tail, in any spelling."""
    apps = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(F.col("n_nationkey").cast("string"), 12, "0")).alias("app_id"),
        F.col("n_name").alias("name"))
    rows = readers.read_activity(_audit_records(spark, sf_dir), promote=["Operation"])
    made = activity_plan.derive(rows, apps)
    return made.select("_Row", ref("Login.OS").alias("os"), ref("Login.IsManaged").alias("managed"),
                       F.try_element_at("fields", F.lit("AppMapping.AppAccessContext.ClientAppId")).alias("app"))


SQL["derived_records"] = f"""SELECT event_id AS _Row, CASE WHEN value >= 3 AND {K} % 2 = 0 THEN event_type END AS os,
    CASE WHEN value >= 3 AND {K} % 2 = 0 THEN 'False' END AS managed,
    CASE WHEN value >= 3 THEN coalesce(n_name, 'Not listed in Microsoft first-party reference') END AS app
    FROM events LEFT JOIN nation ON {K} % 40 = n_nationkey"""


@query
def tail_addresses(spark, sf_dir):
    """Addresses in the tail are listed and counted."""
    rows = readers.read_activity(_audit_records(spark, sf_dir), promote=["Operation"])
    listed = enrich.distinct_ips(rows).select("ip", F.lit(0).cast("bigint").alias("metric"))
    counted = facets.review_metrics(rows, user_fields=["User"]).filter("metric = 'ips'").select(
        F.lit("all").alias("ip"), F.col("value").alias("metric"))
    return listed.unionByName(counted)


SQL["tail_addresses"] = f"""WITH a AS (SELECT DISTINCT '203.0.113.' || {K} AS ip FROM events WHERE value >= 3)
    SELECT ip, 0::BIGINT AS metric FROM a UNION ALL SELECT 'all', count(*) FROM a"""


@query
def trace_rows(spark, sf_dir):
    """Canonical headers, blank rows go."""
    blank = F.col("o_orderstatus") == "P"
    df = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("_Row"), F.when(~blank, F.col("o_orderpriority")).otherwise(" ").alias(" Sender Address "),
        F.when(~blank, F.col("o_custkey").cast("string")).alias("Message-ID"))
    return readers.read_trace(df).select("_Row", "SenderAddress", "MessageId")


SQL["trace_rows"] = """SELECT o_orderkey AS _Row, o_orderpriority AS "SenderAddress", o_custkey::VARCHAR AS "MessageId" FROM orders
    WHERE o_orderstatus <> 'P'"""


@query
def dataset_list(spark, sf_dir):
    """Datasets of both manifest shapes; those without a time come last."""
    orders = table(spark, sf_dir, "orders")
    current = orders.groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderdate").alias("uploadedAt"), F.count(F.lit(1)).alias("rowCount"))
    legacy = table(spark, sf_dir, "supplier").select((-F.col("s_suppkey") - 1).alias("id"), F.lit(1).cast("bigint").alias("rowCount"))
    return readers.list_datasets(current, legacy).select("id", "rowCount", "legacy", F.col("uploadedAt").isNull().alias("undated"))


SQL["dataset_list"] = """SELECT o_custkey AS id, count(*) AS "rowCount", false AS legacy, false AS undated FROM orders GROUP BY o_custkey
    UNION ALL SELECT -s_suppkey - 1, 1, true, true FROM supplier"""


@query
def stored_findings(spark, sf_dir):
    """K4: findings with their bookkeeping; those of another version of the reference are not current."""
    found = hunts.impossible_travel(logins(spark, sf_dir), ip_reference(spark, sf_dir)).select("_Row", "Score")
    kept = writers.with_bookkeeping(found, "travel", {"hours": 12}, "v1").unionByName(
        writers.with_bookkeeping(found.withColumn("Score", F.lit(-1).cast("bigint")), "travel", {}, "v0"))
    return writers.current_findings(kept, "v1")


SQL["stored_findings"] = """SELECT _Row, "Score" FROM (""" + SQL["impossible_travel"] + ")"


@query
def export_lines(spark, sf_dir):
    """K2: the cells of an export, one line for each populated field of a row, however many fields there are."""
    rows = readers.read_activity(_audit_records(spark, sf_dir), promote=["Operation"])
    return writers.export_cells(rows.select("_Row", "Operation", "fields"), "_Row")


SQL["export_lines"] = f"""WITH r AS (SELECT event_id AS _Row, event_type, user_id, {K} AS k FROM events WHERE value >= 3)
    SELECT _Row, 'Operation' AS "column", CASE WHEN k % 2 = 0 THEN 'UserLoggedIn' ELSE 'MailItemsAccessed' END AS value FROM r UNION ALL
    SELECT _Row, 'SourceIpAddress', '203.0.113.' || k FROM r UNION ALL
    SELECT _Row, 'AppAccessContext.ClientAppId', '00000000-0000-0000-0000-' || lpad((k % 40)::VARCHAR, 12, '0') FROM r UNION ALL
    SELECT _Row, 'Item.InternetMessageId', '<m' || k || '@x.org>' FROM r UNION ALL
    SELECT _Row, 'deviceProperties', '[{{"Name":"os","Value":"' || event_type || '"}},{{"Name":"IsManaged","Value":"False"}}]' FROM r"""


# --- repeated and missing keys ---------------------------------------------------------------------

@query
def enrich_repeated_keys(spark, sf_dir):
    """A reference with several rows for an address gives each record one, the newest."""
    reference = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("198.51.100."), (F.col("o_custkey") % 60).cast("string")).alias("ip"), F.col("o_orderkey").alias("at"),
        F.col("o_orderpriority").alias("Country"))
    newest = enrich.one_per_key(reference, "ip", "at")
    df = logins(spark, sf_dir).select("_Row", "ClientIP")
    return enrich.enrich_ip(df, "ClientIP", newest, attributes=["Country"], row_id="_Row").withColumnRenamed("ClientIP_IPAPI_Country", "country")


SQL["enrich_repeated_keys"] = f"""WITH {LOGINS}, r AS (SELECT '198.51.100.' || (o_custkey % 60) AS ip, arg_max(o_orderpriority, o_orderkey) AS c
    FROM orders GROUP BY 1) SELECT _Row, logins.ip AS "ClientIP", coalesce(c, '') AS country FROM logins LEFT JOIN r ON logins.ip = r.ip"""


@query
def travel_repeated_keys(spark, sf_dir):
    """H1: a reference that lists every address twice finds what it finds with single rows."""
    reference = ip_reference(spark, sf_dir)
    return hunts.impossible_travel(logins(spark, sf_dir), reference.unionByName(reference)).select("_Row", "Risk", "Score")


SQL["travel_repeated_keys"] = """SELECT _Row, "Risk", "Score" FROM (""" + SQL["impossible_travel"] + ")"


@query
def sort_missing_ids(spark, sf_dir):
    """Rows without an id or value keep a place; one value holds a third of all rows."""
    df = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderkey")).alias("_Row"),
        F.when(F.col("o_orderkey") % 3 == 0, "7.25").otherwise((F.col("o_orderkey") % 1000 / 8).cast("string")).alias("Travel.Score"))
    placed = ordering.sorted_positions(df, "Travel.Score", "desc")
    return placed.groupBy(ref("Travel.Score").alias("score")).agg(
        F.min("position").alias("first"), F.max("position").alias("last"), F.count(F.lit(1)).alias("n"))


SQL["sort_missing_ids"] = """WITH t AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN '7.25' ELSE ((o_orderkey % 1000) / 8)::DOUBLE::VARCHAR END AS score
    FROM orders), p AS (SELECT score, row_number() OVER (ORDER BY score::DOUBLE DESC) AS place FROM t)
    SELECT score, min(place) AS first, max(place) AS last, count(*) AS n FROM p GROUP BY score"""


@query
def ordinals_missing_parts(spark, sf_dir):
    """A missing partition is a partition."""
    df = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("part"))
    return ordering.with_row_ids(df, "event_id", "ordinal", ["part"])


SQL["ordinals_missing_parts"] = """SELECT event_id, nullif(event_type, 'view') AS part,
    row_number() OVER (PARTITION BY nullif(event_type, 'view') ORDER BY event_id) AS ordinal FROM events"""


@query
def deep_page(spark, sf_dir):
    """The third page, reached from the last row of the second without skipping rows."""
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_Row"), F.when(F.col("o_orderkey") % 4 == 0, " ").otherwise(
        (F.col("o_orderkey") % 50).cast("string")).alias("Travel.Score"))
    last = None
    for _ in range(2):  # a page is a few rows
        last = ordering.sorted_page_after(df, "Travel.Score", "desc", last, 40).collect()[-1]
    return ordering.sorted_page_after(df, "Travel.Score", "desc", last, 40).select("_Row", ref("Travel.Score").alias("score"))


SQL["deep_page"] = """SELECT o_orderkey AS _Row, (o_orderkey % 50)::VARCHAR AS score FROM orders WHERE o_orderkey % 4 <> 0
    ORDER BY o_orderkey % 50 DESC, o_orderkey LIMIT 40 OFFSET 80"""


@query
def selected_by_table(spark, sf_dir):
    """a selection as long as a table."""
    customers = table(spark, sf_dir, "customer")
    chosen = customers.filter("c_acctbal > 0").select(F.upper("c_name").alias("value"))
    barred = customers.filter("c_nationkey = 3").select(F.col("c_name").alias("value"))
    df = customers.select("c_custkey", "c_name")
    return P.selected_rows(df, "C_NAME", chosen, barred)


SQL["selected_by_table"] = "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0 AND c_nationkey <> 3"


# --- long lists of operations, categories, countries -----------------------------------------------

def _many(spark, sf_dir) -> DataFrame:
    """Forty operations of different frequency, in several workloads."""
    number = F.floor(F.col("k") * F.col("k") / 250).cast("int")
    return _events(spark, sf_dir).select(
        F.col("event_id").alias("_Row"), F.concat(F.lit("TeamOp"), number.cast("string")).alias("Operation"),
        F.when(F.col("k") < 20, "MicrosoftTeams").when(F.col("k") < 40, "Exchange").when(F.col("k") < 60, "").otherwise("OneDrive").alias("Workload"),
        F.col("event_type").alias("RecordType"), F.when(F.col("k") % 9 == 0, "").otherwise(F.col("event_type")).alias("Note"))


_MANY = f"""many AS (SELECT event_id AS _Row, 'TeamOp' || floor({K} * {K} / 250)::INT AS op, {K} AS k, event_type,
    CASE WHEN {K} < 20 THEN 'MicrosoftTeams' WHEN {K} < 40 THEN 'Exchange' WHEN {K} < 60 THEN '' ELSE 'OneDrive' END AS load FROM events)"""


@query
def leading_operations(spark, sf_dir):
    """A1: the most frequent twelve of forty operations."""
    return facets.operation_counts(_many(spark, sf_dir))


SQL["leading_operations"] = f"""WITH {_MANY} SELECT op AS name, count(*) AS count FROM many GROUP BY op ORDER BY count DESC, min(_Row) LIMIT 12"""


@query
def selected_operation(spark, sf_dir):
    """A5: an operation beyond the leading ones stays when it is selected."""
    return facets.faceted_counts(_many(spark, sf_dir), "files", "TeamOp37")


SQL["selected_operation"] = f"""WITH {_MANY}, c AS (SELECT op, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(_Row)) AS place
      FROM many WHERE load = 'OneDrive' GROUP BY op)
    SELECT 'all' AS facet, '' AS name, count(*) AS count FROM many UNION ALL
    SELECT 'operationTotal', '', count(*) FROM many WHERE load = 'OneDrive' UNION ALL
    SELECT 'category', c, CASE WHEN c = 'other' THEN (SELECT count(*) FROM many) ELSE 0 END FROM (SELECT unnest(['logon','inbox_rules',
      'transport_rules','mailbox_permissions','email_access','file_access','other']) AS c) UNION ALL
    SELECT 'operation', op, n FROM c WHERE place <= 12 OR op = 'TeamOp37'"""


@query
def team_rows(spark, sf_dir):
    """rows of teams by workload, or by operation outside mail."""
    df = _many(spark, sf_dir)
    return df.filter(in_category(df, "teams")).select("_Row", "Workload")


SQL["team_rows"] = f"""WITH {_MANY} SELECT _Row, load AS "Workload" FROM many WHERE load IN ('MicrosoftTeams', 'OneDrive')"""


@query
def blank_facet(spark, sf_dir):
    """Blank values have a label of their own."""
    return facets.value_facets(_many(spark, sf_dir), "Note")


SQL["blank_facet"] = f"""SELECT CASE WHEN {K} % 9 = 0 THEN '' ELSE event_type END AS value,
    CASE WHEN {K} % 9 = 0 THEN '(empty)' ELSE event_type END AS label, count(*) AS count FROM events GROUP BY 1, 2"""


@query
def logins_outside(spark, sf_dir):
    """H2: countries that differ in letters, so that the country rule speaks alone and with others."""
    letter = F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.substring_index("ip", ".", -1).cast("int") + 1, F.lit(1))
    reference = ip_reference(spark, sf_dir).withColumn("Country", F.concat(F.lit("Land "), letter))
    options = hunts.LoginOptions(trusted_countries="United States\nland d, LAND F,land h,Land L")
    return hunts.suspicious_logins(logins(spark, sf_dir), reference, options).select("_Row", "Risk", "Score", "Reasons")


_TRUSTED = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', split_part(l.ip, '.', 4)::INT + 1, 1)"
SQL["logins_outside"] = f"""WITH {LOGINS}, {IPREF},
    j AS (SELECT l.*, {_TRUSTED} AS letter, proxy, hosting, {_TRUSTED} NOT IN ('D', 'F', 'H', 'L') AS outside,
        comp IN ('False', '') AND managed IN ('False', '') AS ok FROM logins l JOIN ipref r ON l.ip = r.ip AND status = 'Success' WHERE op LIKE 'UserLog%'),
    s AS (SELECT *, 4 * outside::INT + 3 * proxy::INT + 3 * hosting::INT + CASE WHEN proxy OR hosting THEN
        CASE comp WHEN '' THEN 1 WHEN 'False' THEN 2 ELSE 0 END + CASE managed WHEN '' THEN 1 WHEN 'False' THEN 2 ELSE 0 END ELSE 0 END AS score
        FROM j WHERE outside OR ((proxy OR hosting) AND ok))
    SELECT _Row, CASE WHEN score >= 7 THEN 'High' ELSE 'Medium' END AS "Risk", score::BIGINT AS "Score",
      concat_ws('; ', CASE WHEN outside THEN 'Login country outside trusted countries (Land ' || letter || ')' END,
        CASE WHEN proxy THEN 'Proxy/VPN/TOR indicator' END, CASE WHEN hosting THEN 'Hosting provider IP' END,
        CASE WHEN proxy OR hosting THEN CASE comp WHEN '' THEN 'IsCompliant missing' WHEN 'False' THEN 'IsCompliant=False' END END,
        CASE WHEN proxy OR hosting THEN CASE managed WHEN '' THEN 'IsCompliantAndManaged missing' WHEN 'False'
          THEN 'IsCompliantAndManaged=False' END END) AS "Reasons" FROM s"""


@query
def mail_hunt_many(spark, sf_dir):
    """H3 over many mails: sender domains of all customers, a third of them from one domain, and a table of new domains."""
    key = F.col("c_custkey")
    domain = F.when(key % 3 == 0, "hot.example.com").otherwise(F.concat(F.lit("d"), (key % 500).cast("string"), F.lit(".example.org")))
    mails = table(spark, sf_dir, "customer").select(
        key.alias("_Row"), F.concat(F.lit("Someone <a@"), domain, F.lit(">")).alias("SenderAddress"), F.col("c_mktsegment").alias("Subject"))
    born = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("d"), F.col("s_suppkey").cast("string"), F.lit(".example.org")).alias("Domain"),
        F.date_format(F.date_sub(F.lit("2024-05-01").cast("date"), F.col("s_suppkey").cast("int") * 20), "yyyy-MM-dd'T'00:00:00'Z'").alias("RegistrationDate"))
    options = hunts.MailOptions(keywords=["machin"], service_domains=["https://www.hot.example.com/x", "*.example.com"], now=HUNT_MOMENT)
    found = hunts.suspicious_mail(mails, born, options, domain_columns=["SenderAddress"])
    return found.select("_Row", "Risk", "Score", "NewDomains", "DomainAgeDays", "ServiceDomains")


SQL["mail_hunt_many"] = """WITH m AS (SELECT c_custkey AS _Row, c_mktsegment, c_custkey % 3 = 0 AS hot, c_custkey % 500 AS d FROM customer),
    j AS (SELECT m.*, s_suppkey IS NOT NULL AS fresh, 31 + s_suppkey * 20 AS age FROM m LEFT JOIN supplier ON NOT hot AND d = s_suppkey
        AND 31 + s_suppkey * 20 <= 365),
    s AS (SELECT *, contains(lower(c_mktsegment), 'machin') AS term FROM j)
    SELECT _Row, CASE WHEN fresh::INT + term::INT + hot::INT >= 2 THEN 'High' ELSE 'Medium' END AS "Risk",
      (5 * fresh::INT + 3 * term::INT + 3 * hot::INT)::BIGINT AS "Score", CASE WHEN fresh THEN 'd' || d || '.example.org' ELSE '' END AS "NewDomains",
      CASE WHEN fresh THEN age END AS "DomainAgeDays", CASE WHEN hot THEN 'hot.example.com' ELSE '' END AS "ServiceDomains"
    FROM s WHERE fresh OR term OR hot"""


# --- values over a table that grows ----------------------------------------------------------------

@query
def word_readings_documents(spark, sf_dir):
    """R27, R29 over all documents: the id chooses the word and the country's spelling."""
    shape_of = F.col("doc_id") % 5
    key = F.col("doc_id").cast("string")
    word = F.element_at(F.array(F.lit(" Yes"), F.lit("0"), F.lit("TRUE "), F.concat(F.lit("maybe "), key), F.lit("no")),
                        (shape_of + 1).cast("int"))
    country = F.when(shape_of == 0, "U.S.A.").otherwise(F.concat(F.col("source"), F.lit(" - "), key))
    return table(spark, sf_dir, "documents").select(
        "doc_id", truthy(word).alias("is_true"), falsey(word).alias("is_false"), country_key(country).alias("country"),
        compact(F.concat(F.col("source"), F.lit("#"), key)).alias("compact"))


SQL["word_readings_documents"] = """SELECT doc_id, doc_id % 5 IN (0, 2) AS is_true, doc_id % 5 IN (1, 4) AS is_false,
    CASE WHEN doc_id % 5 = 0 THEN 'unitedstates' ELSE regexp_replace(lower(source), '[^a-z]', '', 'g') END AS country,
    regexp_replace(lower(source || doc_id), '[^a-z0-9]', '', 'g') AS compact FROM documents"""


@query
def domain_registration_documents(spark, sf_dir):
    """R21 over all documents: the id chooses which parts a registration has."""
    shape_of = F.col("doc_id") % 5
    key = F.col("doc_id").cast("string")
    name = F.concat(F.lit("Site-"), key)
    born = F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), (F.col("doc_id") % 10000).cast("int")), "yyyy-MM-dd")
    text = F.concat(
        F.lit('{"ldhName":"'), F.upper(name), F.lit('.COM","status":["active","'), F.col("lang"), F.lit('"],"events":['),
        F.lit('{"eventAction":"Registration","eventDate":"'), born, F.lit('T00:00:00Z"},'),
        F.lit('{"eventAction":"last changed","eventDate":""}],"entities":[{"roles":["abuse"],"handle":"no"},'),
        F.lit('{"roles":["registrar"],"handle":"H'), key, F.lit('","vcardArray":["vcard",[["version",{},"text","4.0"],'),
        F.when(shape_of == 1, F.concat(F.lit('["fn",{},"text","Reg '), key, F.lit('"],'))).otherwise(""),
        F.when(shape_of < 3, F.concat(F.lit('["org",{},"text",["Org","Unit '), key, F.lit('"]],'))).otherwise(""),
        F.lit('["x",{},"text","y"]]]}],"nameservers":[{"ldhName":"NS2.X'), key, F.lit('"},{"ldhName":"ns1.x'), key,
        F.lit('"},{"ldhName":"ns2.x'), key, F.lit('"}],"secureDNS":{"delegationSigned":'),
        F.when(shape_of == 0, "true").otherwise("false"), F.lit("}}"))
    parsed = payload.parse_domain_registration(text, F.lower(name))
    return table(spark, sf_dir, "documents").select(parsed.alias("p")).select("p.*")


SQL["domain_registration_documents"] = """WITH c AS (SELECT doc_id AS k, doc_id % 5 AS shape, lang,
      'site-' || doc_id AS name FROM documents)
    SELECT name AS "Domain", name || '.com' AS "RegisteredDomain",
      CASE WHEN shape = 1 THEN 'Reg ' || k WHEN shape < 3 THEN 'Org, Unit ' || k ELSE 'H' || k END AS "Registrar",
      strftime(DATE '1990-01-01' + (k % 10000)::INT, '%Y-%m-%dT00:00:00Z') AS "RegistrationDate", '' AS "ExpirationDate",
      '' AS "LastChangedDate", 'active; ' || lang AS "Status", 'ns1.x' || k || '; ns2.x' || k AS "NameServers",
      CASE WHEN shape = 0 THEN 'Signed' ELSE 'Unsigned' END AS "DNSSEC", 'Success' AS "Lookup_Status", 'RDAP' AS "Provider",
      '' AS "Error" FROM c"""
