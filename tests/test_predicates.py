import pytest
from pyspark.sql import functions as F

from auditspark.functions import predicates as P
from auditspark.functions.categories import CATEGORIES, category_of, in_category


def verdicts(df, test):
    return [r["v"] for r in df.select("_Row", test.alias("v")).orderBy("_Row").collect()]


def test_blank_matches_missing_and_blank(rows):
    df = rows({"_Row": 1, "Operation": "UserLoggedIn"}, {"_Row": 2, "Login.DeviceName": ""},
              {"_Row": 3, "Login.DeviceName": "Managed-Laptop"})
    assert verdicts(df, P.field_equals(df, "Login.DeviceName", "")) == [True, True, False]
    assert verdicts(df, P.field_is_populated(df, "Login.DeviceName")) == [False, False, True]
    assert verdicts(df, P.field_contains(df, "Login.DeviceName", "*")) == [False, True, True]
    assert verdicts(df, P.field_contains(df, "Login.Unknown", "*")) == [False, False, False]


def test_time_range(rows):
    df = rows(*[{"_Row": i, "CreationTime": t} for i, t in enumerate((
        "2026-07-21T12:00:00Z", "2026-07-21T23:59:59Z", "2026-07-21T11:59:59Z", "2026-07-22T00:00:00Z",
        "2026-07-21T08:00:00-04:00", "2026-07-21T07:59:59-04:00", ""))])
    test = P.all_of(P.field_compare(df, "time", ">=", "2026-07-21T12:00:00Z"),
                    P.field_compare(df, "time", "<", "2026-07-22T00:00:00Z"))
    assert verdicts(df, test) == [True, True, False, False, True, False, False]


def test_typed_times_and_numbers_compare_natively(spark):
    df = spark.sql("SELECT id AS _Row, timestamp_ntz'2026-07-21 12:00:00' + make_interval(0,0,0,0,id) AS CreationTime "
                   "FROM range(4)")
    assert verdicts(df, P.field_compare(df, "CreationTime", ">", "2026-07-21T15:00:00+02:00")) == [False, False, True, True]
    assert verdicts(df, P.field_compare(df, "_Row", "<=", "1")) == [True, True, False, False]


def test_numbers_and_mixed_kinds(rows):
    df = rows(*[{"_Row": i, "n": n} for i, n in enumerate(("11", "20", "10", "21", "text", " ", "1e1"))])
    assert verdicts(df, P.all_of(P.field_compare(df, "n", ">", "10"), P.field_compare(df, "n", "<=", "20"))) == [
        True, True, False, False, False, False, False]
    assert verdicts(df, P.field_compare(df, "n", ">", "3 apples")) == [False, False, False, False, True, False, False]
    with pytest.raises(ValueError, match="missing a value"):
        P.field_compare(df, "n", ">", "")


def test_alias_covers_several_columns(rows):
    df = rows({"_Row": 1, "ClientIP": "1.2.3.4", "UserId": "alice@example.com"},
              {"_Row": 2, "ActorIpAddress": "5.6.7.8", "UserId": "bob@example.com"},
              {"_Row": 3, "ClientIP": "5.6.7.8", "UserId": "ALICE@example.com"})
    one, five = P.field_equals(df, "ip", "1.2.3.4"), P.field_equals(df, "ip", "5.6.7.8")
    alice, bob = P.field_equals(df, "user", "alice@example.com"), P.field_equals(df, "user", "bob@example.com")
    assert verdicts(df, P.any_of(one, five)) == [True, True, True]
    assert verdicts(df, P.any_of(P.all_of(alice, one), P.all_of(bob, five))) == [True, True, False]
    assert verdicts(df, P.all_of(P.any_of(alice, bob), P.negate(one))) == [False, True, True]
    # An alias column that is missing reads as blank, so a blank test on an alias passes.
    assert verdicts(df, P.field_equals(df, "ip", "")) == [True, True, True]


def test_names_resolve_per_record_in_the_tail(spark):
    df = spark.createDataFrame([(1, {"Device": "x"}), (2, {"DeviceName": "x"}), (3, {"Device": "y", "DeviceName": "x"}),
                                (4, {})], "_Row bigint, fields map<string,string>")
    assert verdicts(df, P.field_equals(df, "device", "X")) == [True, True, False, False]
    assert verdicts(df, P.field_is_blank(df, "devicename")) == [True, False, False, True]
    assert verdicts(df, P.any_field_contains(df, "Y")) == [False, False, True, False]


def test_wildcards_stay_within_a_line(rows):
    df = rows({"_Row": 1, "s": "Review (urgent)"}, {"_Row": 2, "s": "review\nurgent"}, {"_Row": 3, "s": "a.b"},
              {"_Row": 4, "s": "axb"}, {"_Row": 5, "s": "SENDER@EXAMPLE.COM"})
    assert verdicts(df, P.field_like(df, "s", "review*urgent*")) == [True, False, False, False, False]
    assert verdicts(df, P.field_like(df, "s", "a.*")) == [False, False, True, False, False]
    assert verdicts(df, P.field_contains(df, "s", "*@example.com")) == [False, False, False, False, True]
    assert verdicts(df, P.field_equals(df, "s", "review (URGENT)")) == [True, False, False, False, False]


def test_value_selection_and_blank_rows(rows):
    df = rows({"_Row": 1, "a": "x", "b": " "}, {"_Row": 2, "a": "Y"}, {"_Row": 3, "a": "z", "b": "q"}, {"_Row": 4})
    assert verdicts(df, P.value_selection(df, "a", ["X", "z"], [])) == [True, False, True, False]
    assert verdicts(df, P.value_selection(df, "a", [], ["x", "y"])) == [False, False, True, True]
    assert verdicts(df, P.value_selection(df, "a", ["", "Z"], [])) == [False, False, True, True]
    assert verdicts(df, P.value_selection(df, "b", [], ["", "Q"])) == [True, False, False, False]
    assert verdicts(df, P.value_selection(df, "a", ["x", "y"], ["Y"])) == [True, False, False, False]
    assert verdicts(df, P.has_any_value(df, ["a", "b"])) == [True, True, True, False]


GROUPS = {
    "logon": ["UserLoggedIn", "UserLoginFailed"],
    "inbox_rules": ["New-InboxRule", "Set-InboxRule", "UpdateInboxRule", "UpdateInboxRules"],
    "transport_rules": ["New-TransportRule", "Remove-TransportRule"],
    "mailbox_permissions": ["Add-MailboxPermission", "Remove-MailboxPermission"],
    "email_access": ["MailItemsAccessed", "SoftDelete", "Create", "Update", "Move", "HardDelete", "Send", "SendAs"],
    "file_access": ["FileAccessed", "SearchQueryPerformed", "FolderRename", "FolderDeletedSecondStageRecycleBin"],
    "other": ["MemberAdded", "Enable-InboxRule", "FileUploaded", ""],
}


def test_categories_are_exclusive_and_complete(spark):
    data = [(g, o) for g, ops in GROUPS.items() for o in ops]
    df = spark.createDataFrame(data, "want string, Operation string")
    flags = F.array(*[in_category(df, c).cast("int") for c in CATEGORIES])
    got = df.select("want", category_of(F.col("Operation")).alias("got"),
                    F.aggregate(flags, F.lit(0), lambda a, x: a + x).alias("n")).collect()
    assert all(r["want"] == r["got"] and r["n"] == 1 for r in got)


def test_broad_categories(rows):
    df = rows({"_Row": 1, "Operation": "UserLoggedOut"}, {"_Row": 2, "Operation": "TeamCreated", "Workload": "MicrosoftTeams"},
              {"_Row": 3, "Operation": "AddTeam", "Workload": "Exchange"}, {"_Row": 4, "Operation": "x", "Workload": "OneDrive"},
              {"_Row": 5, "Operation": "SendAs", "Workload": "Exchange"})
    want = {"logins": [1], "teams": [2], "files": [4], "mail": [5], "": [1, 2, 3, 4, 5], "nonsense": [1, 2, 3, 4, 5]}
    for name, ids in want.items():
        assert [i + 1 for i, v in enumerate(verdicts(df, in_category(df, name))) if v] == ids, name
