"""Reference data on records.

Joins are plain equi joins.  No side is broadcast by hint: Spark broadcasts the reference when
its measured size is below the threshold and otherwise sorts and merges, where adaptive
execution splits a hot address or domain.  Records without a usable key are spread over all
partitions instead of meeting in one.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import presets
from ..functions.mail import email_domains, parent_domains
from ..functions.network import classify_ip, ip_key, is_global, normalize_ip
from ..functions.predicates import header_key
from ..functions.text import TAIL, ref, strip, text_of
from .ordering import Key, sample_borders, with_runs


def spread_missing(df: DataFrame, key: Column, row_id: str | None) -> Column:
    """The key, or for a missing one a text that matches nothing and differs between rows."""
    seed = F.xxhash64(ref(row_id)) if row_id else F.xxhash64(*[ref(c) for c in df.columns])
    return F.coalesce(key, F.concat(F.lit("\x00"), F.hex(seed)))


def one_per_key(reference: DataFrame, key: str, newest: str | None = None) -> DataFrame:
    """A reference with one row for each key: the newest by column ``newest``, else the greatest by its columns."""
    row = F.struct(*[ref(c) for c in reference.columns])
    ranked = F.struct(ref(newest).alias("newest"), row.alias("row")) if newest else F.struct(row.alias("row"))
    return (reference.groupBy(ref(key).alias("__one")).agg(F.max(ranked).alias("__best"))
            .select(*[F.col("__best.row")[c].alias(c) for c in reference.columns]))


def lookup(df: DataFrame, reference: DataFrame, key: Column, reference_key: str, name: str, *,
           row_id: str | None = None, salt: int = 1, how: str = "left", newest: str | None = None) -> DataFrame:
    """Attach the reference row of a key as struct ``name`` (NULL without a match), one row for each key.

    ``salt`` > 1 copies the reference that often and deals the rows of each key out over the
    copies, for clusters where adaptive skew handling is off.
    """
    keyed = df.withColumn("__key", spread_missing(df, key, row_id) if how == "left" else key)
    reference = one_per_key(reference, reference_key, newest)
    side = reference.select(ref(reference_key).alias("__key"), F.struct(*[ref(c) for c in reference.columns]).alias(name))
    on = ["__key"]
    if salt > 1:
        seed = F.xxhash64(ref(row_id)) if row_id else F.xxhash64(*[ref(c) for c in df.columns])
        keyed = keyed.withColumn("__salt", F.pmod(seed, F.lit(salt)))
        side = side.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1)).cast("array<bigint>")))
        on = ["__key", "__salt"]
    return keyed.join(side, on, how).drop(*on)


def successful(reference: DataFrame) -> DataFrame:
    """lookups that succeeded."""
    return reference.filter(ref("Lookup_Status") == presets.LOOKUP_OK)


def enrich_ip(df: DataFrame, column: str, reference: DataFrame, *, reference_key: str = "ip",
              attributes: Sequence[str] = tuple(presets.IP_ATTRIBUTES), row_id: str | None = None,
              salt: int = 1) -> DataFrame:
    """``{column}_IPAPI_{attribute}``; a valid address without a result gets blanks, an invalid one nothing."""
    keyed = df.withColumn("__ip", normalize_ip(text_of(df, column)))
    held = [a for a in attributes if a in reference.columns]
    joined = lookup(keyed, reference.select(ref(reference_key), *[ref(a) for a in held if a != reference_key]),
                    F.col("__ip"), reference_key, "__hit", row_id=row_id, salt=salt)
    return joined.withColumns({
        f"{column}_IPAPI_{a}": F.when(F.col("__ip").isNotNull(), F.coalesce(
            F.col("__hit")[a].cast("string") if a in held else F.lit(None), F.lit("")))
        for a in attributes}).drop("__ip", "__hit")


def enrich_domains(df: DataFrame, column: str, reference: DataFrame, *, reference_key: str = "Domain",
                   attributes: Sequence[str] = tuple(presets.DOMAIN_ATTRIBUTES),
                   row_id: str | None = None) -> DataFrame:
    """``{column}_WHOIS_{attribute}``, distinct values of all domains of a cell joined in order."""
    found = domain_references(df, email_domains(text_of(df, column)), reference, "__rows",
                              reference_key=reference_key, row_id=row_id)

    def values(attribute: str) -> Column:
        texts = F.transform(F.col("__rows"), lambda r: r["hit"][attribute].cast("string"))
        kept = F.array_distinct(F.filter(texts, lambda t: F.coalesce(strip(t), F.lit("")) != ""))
        return F.coalesce(F.array_join(kept, "; "), F.lit(""))

    return found.withColumns({
        f"{column}_WHOIS_{a}": values(a) if a in reference.columns else F.lit("") for a in attributes}).drop("__rows")


def domain_references(df: DataFrame, domains: Column, reference: DataFrame, name: str, *,
                      reference_key: str = "Domain", row_id: str | None = None) -> DataFrame:
    """Array ``name`` of (pos, domain, hit) for the domains of a row that have a reference, in order.

    Only distinct domain lists are taken apart and put together again; records are joined to the
    finished lists, so wide records are never regrouped.
    """
    keyed = df.withColumn("__list", F.nullif(F.array_join(domains, " "), F.lit("")))
    lists = keyed.filter(F.col("__list").isNotNull()).select("__list").distinct()
    parts = lists.select("__list", F.posexplode(F.split("__list", " ")).alias("pos", "domain"))
    hits = lookup(parts, reference, F.col("domain"), reference_key, "hit", how="inner")
    complete = hits.groupBy("__list").agg(F.array_sort(F.collect_list(F.struct("pos", "domain", "hit"))).alias(name))
    return (keyed.withColumn("__list", spread_missing(df, F.col("__list"), row_id))
            .join(complete, "__list", "left").drop("__list"))


def _holds_app_id(name: Column) -> Column:
    low = F.lower(name)
    return ~name.startswith("AppMapping.") & reduce(lambda a, b: a | b, [low.endswith(e) for e in presets.APP_ID_ENDINGS])


def app_columns(columns: Sequence[str]) -> list[str]:
    """Columns that hold application ids."""
    return [c for c in columns if not c.startswith("AppMapping.") and c.lower().endswith(presets.APP_ID_ENDINGS)]


def map_app_names(df: DataFrame, apps: DataFrame, *, app_id: str = "app_id", app_name: str = "name",
                  columns: Sequence[str] | None = None, row_id: str | None = None, tail: str = TAIL) -> DataFrame:
    """Name of every application id column that holds a UUID; unknown ids get a fixed text.

    Ids in the tail map are named there, if no columns are given.
    """
    result = df
    for column in columns or app_columns(df.columns):
        key = F.lower(strip(text_of(result, column)))
        keyed = result.withColumn("__app", F.when(key.rlike(presets.UUID), key))
        result = lookup(keyed, apps.select(ref(app_id), ref(app_name)), F.col("__app"), app_id, "__hit",
                        row_id=row_id)
        result = result.withColumn(f"AppMapping.{column}", F.when(
            F.col("__app").isNotNull(), F.coalesce(F.col("__hit")[app_name], F.lit(presets.UNLISTED_APP))
        )).drop("__app", "__hit")
    return result if columns or tail not in df.columns else _map_tail_apps(result, apps, app_id, app_name, row_id, tail)


_NO_IDS = "[]"


def _map_tail_apps(df: DataFrame, apps: DataFrame, app_id: str, app_name: str, row_id: str | None, tail: str) -> DataFrame:
    """Names of the application ids in the tail.  Only distinct lists of (field, id) are taken apart and joined."""
    held = F.filter(F.transform(F.map_entries(ref(tail)), lambda e: F.struct(
        e["key"].alias("field"), F.lower(strip(e["value"])).alias("id"))),
        lambda e: _holds_app_id(e["field"]) & F.coalesce(e["id"].rlike(presets.UUID), F.lit(False)))
    # Never null: a test for null would move below the payload and take it apart once more, here and on the way to the join.
    keyed = df.withColumn("__ids", F.coalesce(F.to_json(held), F.lit(_NO_IDS)))
    lists = keyed.select("__ids").distinct()
    parts = (lists.select("__ids", F.explode_outer(F.from_json("__ids", "array<struct<field:string,id:string>>")).alias("e"))
             .filter(F.col("e").isNotNull()))
    named = lookup(parts, apps.select(ref(app_id), ref(app_name)), F.col("e.id"), app_id, "__hit")
    shown = F.struct(F.concat(F.lit("AppMapping."), F.col("e.field")).alias("k"),
                     F.coalesce(F.col("__hit")[app_name], F.lit(presets.UNLISTED_APP)).alias("v"))
    complete = named.groupBy("__ids").agg(F.map_from_entries(F.collect_list(shown)).alias("__names"))
    own = spread_missing(df, F.nullif(F.col("__ids"), F.lit(_NO_IDS)), row_id)
    joined = keyed.withColumn("__ids", own).join(complete, "__ids", "left")
    kept = F.map_filter(ref(tail), lambda k, _: ~F.map_contains_key("__names", k))
    return (joined.withColumn(tail, F.when(F.col("__names").isNull(), ref(tail)).otherwise(F.map_concat(kept, F.col("__names"))))
            .drop("__ids", "__names"))


def pending_lookups(wanted: DataFrame, reference: DataFrame, key: str, *,
                    providers: Sequence[str] | None = None) -> DataFrame:
    """Keys without a usable reference row: absent, failed, or from another provider."""
    usable = ~(F.coalesce(ref("Lookup_Status"), F.lit("")) == presets.LOOKUP_FAILED)
    if providers is not None:
        usable = usable & F.coalesce(ref("Provider").isin(list(providers)), F.lit(False))
    return wanted.join(reference.filter(usable).select(ref(key)), key, "left_anti")


def local_references(addresses: DataFrame, column: str = "ip") -> DataFrame:
    """reference rows of addresses that no lookup service knows."""
    return (addresses.filter(~is_global(ref(column)))
            .select(ref(column), classify_ip(ref(column)).alias("IP_Class"),
                    F.lit(presets.LOOKUP_SKIPPED).alias("Lookup_Status"),
                    F.lit(presets.LOCAL_PROVIDER).alias("Provider")))


def public_addresses(addresses: DataFrame, column: str = "ip") -> DataFrame:
    """addresses worth a lookup."""
    return addresses.filter(is_global(ref(column)))


def upsert(current: DataFrame, fresh: DataFrame, key: str, newest: str | None = None) -> DataFrame:
    """Fresh rows, one for each key, replace current ones of the same key; one row for each key is left."""
    fresh, current = one_per_key(fresh, key, newest), one_per_key(current, key, newest)
    return fresh.unionByName(current.join(fresh.select(ref(key)), key, "left_anti"), allowMissingColumns=True)


_SERVICE = re.compile(r"(?:[a-z][a-z0-9+.-]*://(?:[^/@]*@)?|\*\.)?([^/:?#\s]*)", re.IGNORECASE)


def parse_service_domains(values: Sequence[str]) -> list[str]:
    """Configured service domains as bare lower-case hosts, each once, in order.

    An address of a page counts for its host, ``*.`` and outer dots are left out.
    """
    hosts = [_SERVICE.match(str(value).strip())[1].strip(".").lower() for value in values]
    return [h for h in dict.fromkeys(hosts) if h]


def service_of(domain: Column, services: Sequence[str]) -> Column:
    """J8 for a short list of arguments: first configured service that owns the domain, else NULL.

    The domain's own few parents are looked up in one literal array, however many services there are.
    """
    if not services:
        return F.lit(None).cast("string")
    listed = F.lit(list(services))
    places = F.filter(F.transform(parent_domains(domain), lambda p: F.array_position(listed, p)), lambda at: at > 0)
    return F.get(listed, (F.array_min(places) - 1).cast("int"))


def match_services(df: DataFrame, domain: str, services: DataFrame, *, service: str = "service",
                   position: str = "position", name: str = "service", row_id: str | None = None) -> DataFrame:
    """J8 for a table of services: every parent of a domain is an equi-join candidate.

    Distinct domains are matched once; the first configured service wins.
    """
    domains = df.select(ref(domain).alias("__d")).filter(F.col("__d").isNotNull()).distinct()
    candidates = domains.select("__d", F.explode(parent_domains(F.col("__d"))).alias("__key"))
    listed = services.select(ref(service).alias("__key"), ref(position).alias("__at"))
    best = (candidates.join(listed, "__key").groupBy("__d")
            .agg(F.min_by("__key", "__at").alias("__service")))
    return (df.withColumn("__d", spread_missing(df, ref(domain), row_id)).join(best, "__d", "left")
            .withColumn(name, F.col("__service")).drop("__d", "__service"))


def match_networks(df: DataFrame, ip: str, networks: DataFrame, *, cidr: str = "cidr", label: str = "label",
                   position: str = "position", name: str = "network", row_id: str | None = None) -> DataFrame:
    """J9 for a table of networks; the first listed one that holds the address wins."""
    key, length = ip_key(F.substring_index(ref(cidr), "/", 1)), F.substring_index(ref(cidr), "/", -1).cast("int")
    listed = networks.select(key.alias("__key"), length.alias("__length"), ref(label).alias("__label"), ref(position).alias("__at"))
    whole = F.floor(F.col("__length") / 4).cast("int")  # digits that lie in the prefix; the next one may do so in part
    digit = F.conv(F.substring("__key", whole + 1, F.lit(1)), 16, 10).cast("int")
    free = F.expr("shiftright(15, cast(__length % 4 as int))")

    def filled(last: Column, fill: str) -> Column:
        start = F.concat(F.substring("__key", F.lit(1), whole), F.coalesce(F.lower(F.hex(last)), F.lit("")))
        return F.when(F.col("__length") >= 0, _place(F.rpad(start, F.length("__key"), F.lit(fill))))

    low, high = filled(digit.bitwiseAND(F.lit(15) - free), "0"), filled(digit.bitwiseOR(free), "f")
    return _in_ranges(df, ip, listed.select(low.alias("__low"), high.alias("__high"), "__label", "__at"), name, row_id)


def match_ranges(df: DataFrame, ip: str, ranges: DataFrame, *, low: str = "low", high: str = "high", label: str = "label",
                 position: str = "position", name: str = "range", row_id: str | None = None) -> DataFrame:
    """J9 for a table of ranges from one canonical address to another, ends included; the first listed one that holds
    the address wins.  Ranges that end before they begin, or in the other address family, hold nothing."""
    return _in_ranges(df, ip, ranges.select(_place(ip_key(ref(low))).alias("__low"), _place(ip_key(ref(high))).alias("__high"),
                                            ref(label).alias("__label"), ref(position).alias("__at")), name, row_id)


def _place(key: Column) -> Column:
    """A hexadecimal address key behind the mark of its family, so that texts sort like addresses."""
    return F.concat(F.when(F.length(key) == 8, "4").otherwise("6"), key)


def _in_ranges(df: DataFrame, ip: str, ranges: DataFrame, name: str, row_id: str | None) -> DataFrame:
    """First listed range (__low, __high, __label, __at) of every different address; rows meet their address.

    Addresses and ends of ranges go into one order, where addresses without an end between them make up a cell.  A range
    holds all cells from its low end up to its high end: it goes to the few nodes of a binary tree over the cells that make
    these up, and each cell asks the nodes above it for the first listed range.  Equi joins only.
    """
    # An end without an order among addresses, or in another family than the other end, has no place and holds nothing.
    usable = F.length("__low") == F.length("__high")
    sides = F.array(F.struct(F.when(usable, F.col("__low")).alias("__place"), F.lit(0).alias("__side")),
                    F.struct(F.when(usable, F.col("__high")).alias("__place"), F.when(usable, F.lit(2)).otherwise(0).alias("__side")))
    ends = ranges.select(F.explode(sides).alias("__s"), "__low", "__high", "__label", "__at").select("__s.*", "__low", "__high", "__label", "__at")
    text = F.lit(None).cast("string")
    named = df.select(ref(ip).alias("__ip")).filter(F.col("__ip").isNotNull())

    def together(addresses: DataFrame, place: Column) -> DataFrame:
        absent = [F.lit(None).cast(ends.schema[c].dataType).alias(c) for c in ("__low", "__high", "__label", "__at")]
        points = addresses.select(place.alias("__place"), F.lit(1).alias("__side"), *absent, "__ip")
        return ends.withColumn("__ip", text).unionAll(points)

    keys = [Key(F.col("__place")), Key(F.col("__side")), Key(F.col("__at"))]
    listed, rows = ranges.count(), df.count()
    # All rows stand for the different addresses here, which takes no shuffle: a range of the order has at most as many.
    place = _place(ip_key(F.col("__ip")))
    borders = sample_borders(together(named, text), keys, total=2 * listed + rows, prepare=lambda seen: seen.withColumn(
        "__place", F.when(F.col("__side") == 1, place).otherwise(F.col("__place"))))
    placed = with_runs(together(named.distinct(), place), keys, F.col("__side") == 1, "__cell", borders=borders)
    points = placed.where("__ip is not null and __place is not null").select("__ip", "__cell")
    found = _first_ranges(placed.where("__side <> 1"), points.select("__cell").distinct(), min(2 * listed + len(borders.rows) + 1, rows))
    best = points.join(found, "__cell").select("__ip", F.col("__best.__label").alias("__label"))
    return (df.withColumn("__ip", spread_missing(df, ref(ip), row_id)).join(best, "__ip", "left")
            .withColumn(name, F.col("__label")).drop("__ip", "__label"))


def _first_ranges(ends: DataFrame, cells: DataFrame, most: int) -> DataFrame:
    """(__cell, __best): the first listed range (__at, __label) of those of these cells, at most ``most``, that a range holds.

    A range that holds no cell, since no address lies in it or it ends before it begins, goes to no node.
    """
    first, last = F.min(F.when(F.col("__side") == 0, F.col("__cell") + 1)), F.max(F.when(F.col("__side") == 2, F.col("__cell")))
    held = (ends.groupBy("__low", "__high").agg(first.alias("first"), last.alias("last"), F.min(F.struct("__at", "__label")).alias("__best"))
            .where("first <= last"))
    # What is left to make up on a level begins and ends at these nodes; it takes in the first one if that is a right child,
    # and the last one if that is a left child.
    levels = held.select("first", "last", "__best", F.explode(F.sequence(F.lit(0), F.length(F.bin(F.expr("last - first + 1"))) - 1)).alias("level"))
    levels = levels.select("level", "__best", F.expr("shiftright(first + shiftleft(1L, level) - 1, level)").alias("begin"),
                           F.expr("shiftright(last + 1, level) - 1").alias("end")).where("begin <= end")
    taken = F.array(F.when(F.expr("begin % 2 = 1"), F.col("begin")), F.when(F.expr("end % 2 = 0"), F.col("end")))
    nodes = levels.select("level", "__best", F.explode(taken).alias("at")).where("at is not null").groupBy("level", "at").agg(F.min("__best").alias("__best"))
    above = cells.select("__cell", F.explode(F.sequence(F.lit(0), F.lit(most.bit_length()))).alias("level")).withColumn("at", F.expr("shiftright(__cell, level)"))
    return above.join(nodes, ["level", "at"]).groupBy("__cell").agg(F.min("__best").alias("__best"))


def ip_columns(columns: Sequence[str]) -> list[str]:
    """Columns of an activity log that hold addresses: the aliases of an address, and names that end so."""
    return [c for c in columns if _is_address_name(c)]


_ADDRESS_NAMES = frozenset(name for alias in ("ip", "clientip") for name in presets.FIELD_ALIASES[alias])
_ADDRESS_ENDING = "ipaddress"


def _is_address_name(name: str) -> bool:
    return name in _ADDRESS_NAMES or name.lower().endswith(_ADDRESS_ENDING)


def trace_ip_columns(columns: Sequence[str]) -> list[str]:
    """Columns of a mail trace that hold addresses, preferred ones first; attributes that a lookup added do not count."""
    def place(name: str) -> int | None:
        if name in presets.TRACE_IP_COLUMNS:
            return presets.TRACE_IP_COLUMNS.index(name)
        own = "_ipapi_" not in name.lower() and re.search("ip(?:address)?$", header_key(name))
        return len(presets.TRACE_IP_COLUMNS) if own else None

    return sorted((c for c in columns if place(c) is not None), key=place)


def addresses_of(df: DataFrame, columns: Sequence[str] | None = None, tail: str = TAIL) -> Column:
    """Array of the canonical addresses of a record: of these columns, or of all that hold addresses, in the tail too."""
    chosen = ip_columns([c for c in df.columns if c != tail]) if columns is None else columns
    found = F.array(*[normalize_ip(text_of(df, c)) for c in chosen]) if chosen else F.array().cast("array<string>")
    if columns is None and tail in df.columns:
        named = F.map_filter(ref(tail), lambda k, _: k.isin(sorted(_ADDRESS_NAMES)) | F.lower(k).endswith(_ADDRESS_ENDING))
        found = F.concat(found, F.coalesce(F.transform(F.map_values(named), normalize_ip), F.array().cast("array<string>")))
    return F.array_distinct(F.array_compact(found))


def distinct_ips(df: DataFrame, columns: Sequence[str] | None = None, name: str = "ip") -> DataFrame:
    """Canonical addresses of the given columns, or of all that hold addresses, each once, sorted."""
    return df.select(F.explode(addresses_of(df, columns)).alias(name)).distinct().orderBy(name)


def distinct_domains(df: DataFrame, columns: Sequence[str], name: str = "domain") -> DataFrame:
    """Mail domains of the given columns, each once, sorted."""
    found = F.flatten(F.array(*[F.coalesce(email_domains(text_of(df, c)), F.array().cast("array<string>"))
                                for c in columns]))
    return df.select(F.explode(F.array_distinct(found)).alias(name)).distinct().orderBy(name)

