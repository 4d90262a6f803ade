"""Facet tables: parts that come and go give what the rows give."""

import random

import pytest
from pyspark.sql import functions as F

from auditspark.operators import facet_tables, facets


def records(rows, seed):
    rnd = random.Random(seed)
    return rows(*[{"_Row": i, "Operation": rnd.choice(["UserLoggedIn", "MailItemsAccessed", "FileAccessed", "New-InboxRule", "", "TeamCreated"]),
                   "Workload": rnd.choice(["Exchange", "SharePoint", "", None]), "UserId": rnd.choice(["A@x", "a@x", "b@x", "", None]),
                   "Review.Tag": rnd.choice(["x", "", None]), "source": rnd.choice(["one", "two", "three"])} for i in range(150)])


def listing(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("category", ["", "logins", "files", "mail", "teams", "email_access", "unknown"])
def test_merged_parts_equal_the_rows(spark, rows, category):
    df = records(rows, 5)
    members = {"users": F.array(facets.identity(df, ["UserId"]))}

    def parts(chosen):
        return facet_tables.facet_parts(chosen, F.col("source"), members, values=["Workload"])

    gone = spark.createDataFrame([("two",)], "source string")
    kept = facet_tables.without_sources(parts(df.where("source <> 'three'")), gone).unionByName(parts(df.where("source = 'three'")))
    left = df.where("source <> 'two'")
    assert listing(facet_tables.facets_of(kept, category, "FileAccessed")) == listing(facets.faceted_counts(left, category, "FileAccessed"))
    if not category:
        assert listing(facet_tables.operations_of(kept)) == listing(facets.operation_counts(left))
        assert listing(facet_tables.categories_of(kept)) == listing(facets.category_counts(left))
        values = {r["value"]: r["count"] for r in facet_tables.values_of(kept, "Workload").collect()}
        assert values == {r["value"]: r["count"] for r in facets.value_facets(left, "Workload").collect()}
        metrics = {r["metric"]: r["value"] for r in facet_tables.metrics_of(kept, ["users"]).collect()}
        plain = {r["metric"]: r["value"] for r in facets.review_metrics(left, user_fields=["UserId"]).collect()}
        assert all(metrics[m] == plain[m] for m in ("rows", "users", "tagged", "columns"))
        assert {r["source"]: r["rowCount"] for r in facet_tables.sources_of(kept).collect()} == {r["source"]: r["count"] for r in left.groupBy("source").count().collect()}
        assert {r["value"] for r in facet_tables.metrics_of(kept.limit(0), ["users"]).collect()} == {0}


def test_pages_of_values_by_key(rows):
    df = rows(*[{"_Row": i, "v": f"{'vV'[i % 2]}{i % 37}"} for i in range(400)])
    whole = [tuple(r) for r in facets.value_facets(df, "v", limit=500).collect()]
    seen, last = [], None
    while page := [tuple(r) for r in facets.value_facets_after(df, "v", last, limit=9).collect()]:
        seen += page
        last = (page[-1][2], page[-1][0])
    assert seen == whole
