"""Every registered query against plain SQL, and the shape of the plans."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from auditspark.operators import hunts, ordering
from auditspark.plans.bindings import QUERIES, _time_texts, ip_reference, logins, table
from auditspark.sources import search_index

DATA = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return repr(value)
    return repr(round(float(value), 6)) if isinstance(value, (int, float)) or hasattr(value, "as_tuple") else repr(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sql, name):
    df = queries()[name](spark, DATA)
    assert "Python" not in df._jdf.queryExecution().optimizedPlan().toString()
    names = sorted(df.columns)
    assert all("." not in n for n in names)
    got = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
    cursor = sql.execute(oracle_sql()[name])
    held = [d[0] for d in cursor.description]
    assert sorted(held) == names
    places = [held.index(n) for n in names]
    assert got == sorted(tuple(plain(r[i]) for i in places) for r in cursor.fetchall())


def test_entry(spark):
    assert entry(spark).count() > 0


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["impossible_travel", "suspicious_logins", "suspicious_mail", "domain_attributes", "service_domains",
                                  "network_match", "sort_time", "review_metrics", "operation_facets", "enrich_left", "tag_change"])
def test_no_cross_joins_without_broadcast(spark, name):
    """With broadcasting off, every join must still be a keyed join."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(queries()[name](spark, DATA))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,purchase)]" in plan_of(queries()["operation_is"](spark, DATA))
    compare = plan_of(queries()["filter_compare"](spark, DATA))
    for pushed in ("GreaterThanOrEqual(o_orderdate", "GreaterThan(o_totalprice,250000.0)", "LessThanOrEqual(o_totalprice,400000.0)"):
        assert pushed in compare
    travel = plan_of(queries()["impossible_travel"](spark, DATA))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double,props:string>" in travel
    assert table(spark, DATA, "events").columns == ["event_id", "ts", "user_id", "event_type", "value", "props"]


def test_no_shuffle_where_a_row_is_enough(spark):
    for name in ("payload_order", "message_subjects", "flatten_props", "rule_details", "login_details", "mail_details", "message_ids",
                 "narrative_trace", "filter_alias"):
        assert "Exchange" not in plan_of(queries()[name](spark, DATA)), name


def test_busy_users_and_operations_are_split(spark):
    df = hunts.impossible_travel(logins(spark, DATA), ip_reference(spark, DATA), ranges=6)
    travel = plan_of(df).split("== Initial Plan ==")[0]
    windows = [line for line in travel.split("\n") if "Window [" in line]
    # All rows go through one window, by range and user; no window holds a whole user.
    assert sum("lag(__payload" in line for line in windows) == 1 and all("__range" in line for line in windows)
    facets = plan_of(queries()["operation_facets"](spark, DATA)).split("== Initial Plan ==")[0]
    assert facets.count("FileScan") == 1 and "share" in facets


@pytest.mark.parametrize("name", ["word_readings_documents", "domain_registration_documents"])
def test_values_of_a_growing_table(spark, sql, name):
    got = queries()[name](spark, DATA)
    assert got.count() == got.distinct().count() == sql.execute("SELECT count(*) FROM documents").fetchone()[0] > 25


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_deep_page_is_the_third_page(spark, size):
    """Whatever the size of the table: the rows behind the first eighty, not those behind a fixed key."""
    folder = f"/root/testdata/{size}"
    got = [tuple(r) for r in queries()["deep_page"](spark, folder).collect()]
    scored = sorted((-(r[0] % 50), r[0]) for r in table(spark, folder, "orders").select("o_orderkey").collect() if r[0] % 4)
    assert got == [(key, str(-score)) for score, key in scored[80:120]]
    assert "OFFSET 80" in oracle_sql()["deep_page"]


def test_ranges_are_found_once_a_row(spark):
    """What the ranges hand on is added up without a filter that would compute keys and ranges again beneath them."""
    travel = hunts.impossible_travel(logins(spark, DATA), ip_reference(spark, DATA), ranges=6)
    times = ordering.sorted_positions(_time_texts(spark, DATA), "Registered date", "desc", ranges=6)
    for df in (travel, times):
        optimized = df._jdf.queryExecution().optimizedPlan().toString()
        assert "aggregate(" in optimized
        assert not any("Filter" in line and "aggregate(" in line for line in optimized.split("\n"))


def test_tails_are_taken_apart_twice_at_most(spark):
    """Application names join lists of ids; neither looks into the payload again to see whether there are any."""
    optimized = queries()["derived_records"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in line and "map_entries(" in line for line in optimized.split("\n"))


def test_one_metric_works_out_no_other(spark):
    """The metric is chosen before the lines are made."""
    optimized = queries()["merged_values"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("__metric") and "(x#" not in "".join(line for line in optimized.split("\n") if "Filter" in line)


def test_bits_of_a_file_are_sent_once(spark):
    """Different bits are found first, by hashing; only they become bitmaps."""
    made = search_index.build_filters(spark, f"{DATA}/documents.parquet", ["text"])
    plan = plan_of(made).split("== Initial Plan ==")[0]
    first = plan.index("Generate")  # the scan's side comes last in a plan
    assert "HashAggregate(keys=[file" in plan[:first] and plan[:first].rindex("HashAggregate") > plan[:first].rindex("bitmap_construct_agg")
