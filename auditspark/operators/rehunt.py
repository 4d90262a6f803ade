"""H1, H2, K4: findings after a change of the reference, without hunting through everything again.

A login's finding depends on its own address, and in a travel hunt also on the user's login before it.  Where a few
reference rows changed, only logins from these addresses (H2), or of users who used them (H1), can have other findings; the
findings of all others stay.  The result equals a full hunt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.network import normalize_ip
from ..functions.text import ref, text_of
from .hunts import LoginOptions, TravelOptions, impossible_travel, suspicious_logins, travel_user


def _touched(events: DataFrame, changed: DataFrame, key: str, address: str) -> DataFrame:
    """The events from changed addresses."""
    keys = changed.select(ref(key).alias("__changed")).distinct()
    return events.withColumn("__address", normalize_ip(text_of(events, address))).join(
        keys, F.col("__address") == F.col("__changed"), "left_semi").drop("__address")


def _replaced(findings: DataFrame, again: DataFrame, fresh: DataFrame, row_id: str) -> DataFrame:
    """Findings of the events that were hunted again come from the fresh ones."""
    kept = findings.join(again.select(ref(row_id)), row_id, "left_anti")
    return kept.select(*[ref(c) for c in fresh.columns]).unionAll(fresh)


def rehunt_logins(events: DataFrame, findings: DataFrame, changed: DataFrame, ip_reference: DataFrame, options: LoginOptions = LoginOptions(), *,
                  row_id: str = "_Row", address: str = "ClientIP", reference_key: str = "ip", **names) -> DataFrame:
    """H2: ``findings`` of an older reference brought up to date; ``changed`` lists the addresses whose reference row changed.

    Rows of ``events`` have an id.
    """
    again = _touched(events, changed, reference_key, address)
    fresh = suspicious_logins(again, ip_reference, options, row_id=row_id, address=address, reference_key=reference_key, **names)
    return _replaced(findings, again, fresh, row_id)


def rehunt_travel(events: DataFrame, findings: DataFrame, changed: DataFrame, ip_reference: DataFrame, options: TravelOptions = TravelOptions(), *,
                  row_id: str = "_Row", address: str = "ClientIP", reference_key: str = "ip", users=("UserId", "UserKey"), **names) -> DataFrame:
    """H1: the same for users of changed addresses, whose neighbouring logins may pair anew."""
    touched = _touched(events, changed, reference_key, address)
    who = touched.select(travel_user(touched, users).alias("__who")).distinct()
    again = events.withColumn("__user", travel_user(events, users)).join(who, F.col("__user") == F.col("__who"), "left_semi").drop("__user")
    fresh = impossible_travel(again, ip_reference, options, row_id=row_id, address=address, reference_key=reference_key, users=users, **names)
    return _replaced(findings, again, fresh, row_id)
