"""The bucketed reference store, and hunts that follow its changes."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from auditspark.operators import hunts, rehunt
from auditspark.sources.reference_store import ReferenceStore, reference_changes


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture
def store(spark, tmp_path):
    made = ReferenceStore(spark, f"reference_{random.getrandbits(40):x}", str(tmp_path / "store"), "ip", buckets=8)
    yield made
    spark.sql(f"DROP TABLE IF EXISTS {made.name}")


def reference(spark, numbers, country):
    return spark.createDataFrame([(f"198.51.100.{n}" if n is not None else None, country, f"R{(n or 0) % 3}", n or 0) for n in numbers], "ip string, Country string, Region string, t int")


def test_generations_replace_and_remove(spark, store):
    assert store.generations() == []
    assert store.upsert(reference(spark, range(200), "A").unionAll(reference(spark, range(5), "A"))) == 1
    assert store.upsert(reference(spark, [3, 250, None], "B").withColumn("t", F.col("t") + 1), newest="t") == 2
    assert store.remove(spark.createDataFrame([("198.51.100.7",), ("198.51.100.7",), ("unknown",)], "ip string")) == 3
    now = {r["ip"]: r["Country"] for r in store.current().collect()}
    assert len(now) == 200 and now["198.51.100.3"] == now["198.51.100.250"] == "B" and "198.51.100.7" not in now
    assert store.current(1).count() == 200 and store.current().count() == store.current().select("ip").distinct().count()
    assert sorted(r["ip"][11:] for r in store.changed(1).collect()) == ["250", "3", "7"]
    assert [r["ip"] for r in store.changed(2).collect()] == ["198.51.100.7"] and store.changed(3).count() == 0
    store.upsert(reference(spark, [250], "B").withColumn("t", F.col("t") + 1))
    assert store.changed(3).count() == 0  # written again, but the same


def test_an_upsert_writes_its_own_buckets_only(spark, store):
    store.upsert(reference(spark, range(256), "A"))
    before = set(glob.glob(f"{store.path}/*/*.parquet"))
    store.upsert(reference(spark, [1, 2], "B"))
    files = set(glob.glob(f"{store.path}/*/*.parquet"))
    assert before < files and len(files - before) <= 2 and len(before) == 8


def test_the_reference_does_not_move(spark, store):
    store.upsert(reference(spark, range(256), "A"))
    store.upsert(reference(spark, [1, 2], "B"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "Exchange" not in plan_of(store.current())
        events = spark.range(2000).select("id", F.concat(F.lit("198.51.100."), (F.col("id") % 300).cast("string")).alias("address"))
        joined = store.lookup(events, F.when(F.col("id") % 3 != 0, F.col("address")), "hit", row_id="id")
        plan = plan_of(joined)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Exchange hashpartitioning") == 1 and "__key" in next(x for x in plan.split("\n") if "Exchange hash" in x)
    rows = joined.collect()
    assert len(rows) == 2000 and all((r["hit"] is not None) == (r["id"] % 3 != 0 and r["id"] % 300 < 256) for r in rows)
    assert {r["hit"]["Country"] for r in rows if r["address"] == "198.51.100.1" and r["hit"]} == {"B"}
    keys = spark.createDataFrame([("198.51.100.1",), ("198.51.100.300",)], "ip string")
    assert [r["ip"] for r in store.pending(keys, F.col("Country") == "B").collect()] == ["198.51.100.300"]


def test_another_session_finds_the_store(spark, store):
    store.upsert(reference(spark, range(20), "A"))
    store.upsert(reference(spark, [4], "B"))
    again = ReferenceStore(spark, f"{store.name}_again", store.path, "ip", buckets=8)
    again.attach("ip string, Country string, Region string, t int")
    assert again.generations() == [1, 2] and again.current().exceptAll(store.current()).count() == 0 and again.current().count() == 20
    spark.sql(f"DROP TABLE {again.name}")


@pytest.mark.parametrize("seed", [1, 2])
def test_hunts_follow_the_changes(spark, rows, seed):
    rnd = random.Random(seed)
    events = rows(*[{"_Row": i, "Operation": "UserLoggedIn", "UserId": rnd.choice(["hot", "HOT", "a", "b", "c", "d"]), "Login.IsCompliant": rnd.choice(["False", ""]),
                     "CreationTime": f"2026-01-0{rnd.randint(1, 4)}T{rnd.randint(10, 23)}:00:00Z", "ClientIP": f"1.1.1.{rnd.randint(1, 9)}"} for i in range(120)])

    def places(missing):
        return rows(*[{"ip": f"1.1.1.{n}", "Country": rnd.choice("XY"), "Region": rnd.choice("PQ"), "Hosting": rnd.choice(["True", "False"]),
                       "Lookup_Status": rnd.choice(["Success"] * 5 + ["Failed"])} for n in range(1, 10) if n not in missing])

    before = places([4])
    after = places([5]).where("ip not in ('1.1.1.1', '1.1.1.2')").unionByName(before.where("ip in ('1.1.1.1', '1.1.1.2')"))
    changed = reference_changes(before, after, "ip")
    assert not {r["ip"] for r in changed.collect()} & {"1.1.1.1", "1.1.1.2"} and {"1.1.1.4", "1.1.1.5"} <= {r["ip"] for r in changed.collect()}
    options = hunts.LoginOptions(trusted_countries="X", require_device_risk=False)
    for full, again in ((hunts.impossible_travel, rehunt.rehunt_travel), (hunts.suspicious_logins, rehunt.rehunt_logins)):
        extra = [options] if full is hunts.suspicious_logins else []
        found = again(events, full(events, before, *extra), changed, after, *extra)
        assert sorted(map(repr, found.collect())) == sorted(map(repr, full(events, after, *extra).collect()))
