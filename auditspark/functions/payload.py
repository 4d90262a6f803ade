"""Nested payloads: flattening, Name/Value lists, nested messages, registration records.

Nesting is followed level by level inside one row with array functions, so no payload is
shuffled.  The opening brackets of a text bound its levels; the walk ends at the last one.
Members are read from the text itself, so they keep the order of the document and numbers
their fractions (``1.0``); VARIANT, which sorts members, only tells the kinds of values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import presets
from .mail import format_message_id, quoted_member
from .text import let, strip

_MESSAGES = "array<struct<message_id:string,subject:string,size:string>>"


def _json_literals(c: Column) -> Column:
    for bare, proper in (("None", "null"), ("True", "true"), ("False", "false")):
        c = F.regexp_replace(c, rf"(?<=[:,\[\s]){bare}(?=\s*[,}}\]])", proper)
    return c


def parse_payload(c: Column) -> Column:
    """JSON text -> VARIANT; NULL when unreadable.

    Text quoted with single quotes and bare literals is read too.
    """
    return F.coalesce(F.try_parse_json(c), F.from_json(c, "variant"), F.from_json(_json_literals(c), "variant"))


def normal_text(c: Column) -> Column:
    """The same JSON without blanks, in double quotes and with its members in order; NULL when unreadable."""
    def read(text: Column) -> Column:
        return F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "map<string,string>")["v"]

    return F.coalesce(read(c), read(_json_literals(c)))


_MEMBERS = "array<struct<key:string,text:string,kind:string>>"


def _kind(text: Column, v: Column) -> Column:
    """Whether a text that looks like an object or a list is one; a string can look so too."""
    return (F.when(text.startswith("{"), F.when(as_object(v).isNotNull(), "object").otherwise(""))
            .when(text.startswith("["), F.when(as_list(v).isNotNull(), "list").otherwise("")).otherwise(""))


def members(text: Column) -> Column:
    """(key, text, kind) of the members of a JSON object, in order; of several with one key the last counts, in the place of the first.

    Strings are unescaped, other values are JSON text, null is NULL; the kind is ``object``, ``list`` or blank.
    """
    entries = F.map_entries(F.from_json(text, "map<string,string>"))
    kinds = F.map_values(F.from_json(text, "map<string,variant>"))

    def typed(all_: Column) -> Column:
        plain = F.transform(all_, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("text"), F.lit("").alias("kind")))
        looked = F.zip_with(all_, kinds, lambda e, v: F.struct(e["key"].alias("key"), e["value"].alias("text"), _kind(e["value"], v).alias("kind")))
        return F.when(F.exists(all_, lambda e: e["value"].startswith("{") | e["value"].startswith("[")), looked).otherwise(plain)

    def last(all_: Column) -> Column:
        return let(F.array_distinct(F.transform(all_, lambda m: m["key"])), lambda keys: F.when(
            F.size(keys) == F.size(all_), all_).otherwise(F.transform(keys, lambda k: F.element_at(F.filter(all_, lambda m: m["key"] == k), -1))))

    return let(entries, lambda all_: F.when(all_.isNotNull(), let(typed(all_).cast(_MEMBERS), last)))


def items(text: Column) -> Column:
    """The same for the elements of a JSON list; their keys are blank."""
    kinds = F.from_json(text, "array<variant>")
    return F.zip_with(F.from_json(text, "array<string>"), kinds, lambda t, v: F.struct(
        F.lit("").alias("key"), t.alias("text"), _kind(t, v).alias("kind"))).cast(_MEMBERS)


def as_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def as_list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _levels(text: Column, opening: str = "{[") -> Column:
    """At least one number for every level below the root of a JSON text that these brackets open."""
    brackets = sum(F.length(text) - F.length(F.replace(text, F.lit(b), F.lit(""))) for b in opening)
    return F.sequence(F.lit(0), F.greatest(brackets, F.lit(0)))


def flatten_texts(c: Column) -> Column:
    """R2: (dotted path, text) of every leaf of a JSON text, in document order.  NULL when it is no object.

    Lists are leaves, JSON null is blank, empty objects leave nothing.  Every object is opened once.
    """
    def shown(all_: Column, prefix: Column | None, value: str, deep: Callable[[Column], Column]) -> Column:
        return F.transform(all_, lambda m: F.struct(
            (m["key"] if prefix is None else F.concat(prefix, F.lit("."), m["key"])).alias("path"),
            F.coalesce(m[value], F.lit("")).alias("text"), F.coalesce(deep(m), F.lit(False)).alias("deep")))

    def opened(prefix: Column | None, text: Column) -> Column:
        """Kinds are looked up only where a string begins like an object.  In a normal text ``:"{`` stands nowhere else: within
        strings quotes are escaped, and behind the end of a string there is no brace."""
        looked = shown(members(text), prefix, "text", lambda m: m["kind"] == "object")
        plain = let(F.from_json(text, "map<string,string>"), lambda held: F.when(
            F.size(F.array_distinct(F.map_keys(held))) == F.size(held),
            shown(F.map_entries(held), prefix, "value", lambda m: m["value"].startswith("{"))).otherwise(looked))
        return F.when(text.contains(':"{'), looked).otherwise(plain)

    def step(entries: Column, _: Column) -> Column:
        deeper = F.flatten(F.transform(entries, lambda e: F.when(e["deep"], opened(e["path"], e["text"])).otherwise(F.array(e))))
        return F.when(F.exists(entries, lambda e: e["deep"]), deeper).otherwise(entries)

    def walked(text: Column) -> Column:
        return let(opened(None, text), lambda start: F.when(F.exists(start, lambda e: e["deep"]), F.aggregate(_levels(text, "{"), start, step)).otherwise(start))

    leaves = let(F.when(F.ltrim(c).startswith("{"), normal_text(c)), walked)
    return F.transform(leaves, lambda e: F.struct(e["path"].alias("path"), e["text"].alias("text")))


def map_of_last(entries: Column, key: str, value: str) -> Column:
    """A MAP of structs in an array; of several with one key the last counts, whatever the session does with repeated keys."""
    def last(all_: Column, keys: Column) -> Column:
        return let(F.array_distinct(keys), lambda names: F.map_from_arrays(
            names, F.transform(names, lambda n: F.element_at(F.filter(all_, lambda e: e[key] == n), -1)[value])))

    def build(all_: Column) -> Column:
        keys = F.transform(all_, lambda e: e[key])
        return F.when(F.size(F.array_distinct(keys)) == F.size(all_), F.map_from_arrays(keys, F.transform(all_, lambda e: e[value]))).otherwise(last(all_, keys))

    return let(entries, lambda all_: F.when(all_.isNotNull(), build(all_)))


def leaf(v: Column, text: Column, path: str) -> Column:
    """One leaf of R2 by its dotted path, without flattening the rest; ``v`` is the VARIANT of ``text``.

    NULL where there is no such leaf or it is an object, blank for JSON null.
    """
    def at(place: str) -> Column:
        value = F.try_variant_get(v, place, "variant")
        inside = F.try_variant_get(v, place, "map<string,variant>")
        plain = F.try_variant_get(v, place, "string")
        number = F.try_variant_get(v, place, "double").isNotNull() | plain.startswith("[")  # VARIANT writes these anew
        return F.when(value.isNotNull() & inside.isNull(), F.coalesce(F.when(number, F.get_json_object(text, place)), plain, F.lit("")))

    nested = at("$" + "".join(f"['{part}']" for part in path.split(".")))
    return F.coalesce(nested, at(f"$['{path}']")) if "." in path else nested


def flatten_map(c: Column) -> Column:
    """R2 as one MAP: path -> text; of leaves with one path the last counts.  NULL when the payload is no object."""
    return map_of_last(flatten_texts(c), "path", "text")


def named_properties(c: Column) -> Column:
    """JSON list of Name/Value -> MAP, the last value of a name wins; malformed -> empty map."""
    pair = "struct<Name:string,Value:string>"
    c = F.when(F.ltrim(c).startswith("["), c)
    # A list with a member that is no object does not read as a whole; its members are read one by one.
    one_by_one = F.transform(F.from_json(c, "array<string>"), lambda m: F.from_json(m, pair))
    read = let(F.from_json(c, f"array<{pair}>"), lambda whole: F.when(F.size(whole) > 0, whole).otherwise(one_by_one))
    named = F.filter(F.coalesce(read, F.array().cast(f"array<{pair}>")), lambda i: F.coalesce(i["Name"], F.lit("")) != "")
    return map_of_last(F.transform(named, lambda i: F.struct(
        i["Name"].alias("Name"), F.coalesce(i["Value"], F.lit("")).alias("Value"))), "Name", "Value")


def folded(properties: Column) -> Column:
    """The same MAP under lower-case names; of names that differ in case only, the first counts."""
    lowered = F.transform(F.reverse(F.map_entries(properties)), lambda e: F.struct(
        F.lower(e["key"]).alias("k"), e["value"].alias("v")))
    return map_of_last(lowered, "k", "v")


def property_value(folded_properties: Column, name: str) -> Column:
    """Value of a lower-case name; NULL when there is none."""
    return F.try_element_at(folded_properties, F.lit(name))


def property_details(properties: Column, noise: list[str]) -> Column:
    """``name=value; name=value`` without noise and blanks."""
    kept = F.filter(F.map_entries(properties),
                    lambda e: ~F.lower(e["key"]).isin(noise) & (e["value"] != ""))
    return F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")


def _message(own: Column) -> Column:
    """A message from the members of its object; names count without regard to case, the last one."""
    def text(name: str) -> Column:
        named = F.filter(own, lambda m: F.lower(m["key"]) == name)
        return F.coalesce(F.try_element_at(named, F.lit(-1))["text"], F.lit(""))
    return F.struct(format_message_id(text("internetmessageid")).alias("message_id"),
                    strip(text("subject")).alias("subject"), strip(text("sizeinbytes")).alias("size"))


def nested_messages(text: Column) -> Column:
    """Every object of a JSON text that carries a message id, at any depth, in document order.  ``text`` comes from ``normal_text``."""
    node = f"struct<place:string,key:string,members:{_MEMBERS}>"
    none = F.array().cast(_MEMBERS)

    def at(place: Column, inner: Column, kind: Column) -> Column:
        """A node: its place in the document, its kind, and its members."""
        own = F.when(kind == "object", members(inner)).when(kind == "list", items(inner)).otherwise(none)
        return F.struct(place.alias("place"), kind.alias("key"), F.coalesce(own, none).alias("members")).cast(node)

    def children(n: Column) -> Column:
        placed = F.transform(n["members"], lambda m, i: F.struct(i.alias("i"), m.alias("m")))
        deep = F.filter(placed, lambda p: p["m"]["kind"] != "")
        return F.transform(deep, lambda p: at(F.concat(n["place"], F.lpad(p["i"].cast("string"), 10, "0"), F.lit("/")), p["m"]["text"], p["m"]["kind"]))

    def step(state: Column, _: Column) -> Column:
        lower = let(F.flatten(F.transform(state["edge"], children)), lambda edge: F.struct(
            F.concat(state["seen"], edge).alias("seen"), edge.alias("edge")))
        return F.when(F.size(state["edge"]) > 0, lower).otherwise(state)

    root = F.array(at(F.lit(""), text, F.when(text.startswith("{"), "object").when(text.startswith("["), "list").otherwise("")))
    nodes = let(root, lambda first: F.aggregate(_levels(text), F.struct(first.alias("seen"), first.alias("edge")), step)["seen"])
    found = F.filter(nodes, lambda n: (n["key"] == "object") & F.exists(n["members"], lambda m: F.lower(m["key"]) == "internetmessageid"))
    messages = F.transform(found, lambda n: F.struct(n["place"].alias("place"), _message(n["members"]).alias("m")))
    return F.transform(F.array_sort(messages), lambda n: n["m"]).cast(_MESSAGES)


# An id, then the subject that follows before the next id.
_ID_THEN_SUBJECT = (rf"(?is){quoted_member('internetmessageid')}([^'\"]*+)['\"](?:(?!internetmessageid).)*?"
                    rf"{quoted_member('subject')}([^'\"]*+)['\"]")


def messages_by_pattern(c: Column) -> Column:
    """Id/subject pairs of a text that no JSON reader accepts."""
    ids = F.regexp_extract_all(c, F.lit(_ID_THEN_SUBJECT), F.lit(1))
    subjects = F.regexp_extract_all(c, F.lit(_ID_THEN_SUBJECT), F.lit(2))
    return F.zip_with(ids, subjects, lambda i, s: F.struct(
        format_message_id(i).alias("message_id"), strip(s).alias("subject"), F.lit("").alias("size"))).cast(_MESSAGES)


def messages_of_text(c: Column) -> Column:
    """Messages inside one text column: JSON where it reads as JSON, the pattern otherwise."""
    text = strip(c)
    nested = let(normal_text(text), lambda plain: F.when(plain.isNotNull(), nested_messages(plain)))
    looks_nested = text.rlike(r"^[\[{]")
    found = F.when(looks_nested, F.coalesce(nested, messages_by_pattern(text))).otherwise(messages_by_pattern(text))
    return F.when(F.lower(c).contains("internetmessageid"), found).otherwise(F.array().cast(_MESSAGES))


def tidy_messages(messages: Column) -> Column:
    """Each (id, subject) once, in order of appearance, with its first recorded size."""
    usable = F.filter(messages, lambda m: m["message_id"].contains("@"))

    def unique(all_: Column) -> Column:
        keys = F.array_distinct(F.transform(all_, lambda m: F.struct(m["message_id"], m["subject"])))
        return F.transform(keys, lambda k: F.struct(
            k["message_id"].alias("message_id"), k["subject"].alias("subject"),
            F.coalesce(F.get(F.filter(all_, lambda m: (m["message_id"] == k["message_id"])
                                      & (m["subject"] == k["subject"]) & (m["size"] != "")), 0)["size"],
                       F.lit("")).alias("size")))

    return let(usable, unique).cast(_MESSAGES)


def no_messages() -> Column:
    return F.array().cast(_MESSAGES)


_REGISTRATION = ("struct<ldhName:string,unicodeName:string,status:array<string>,"
                 "events:array<struct<eventAction:string,eventDate:string>>,"
                 "entities:array<struct<roles:array<string>,handle:string,vcardArray:array<string>>>,"
                 "nameservers:array<struct<ldhName:string>>,secureDNS:struct<delegationSigned:boolean>>")


def parse_domain_registration(c: Column, requested: Column) -> Column:
    """Registration JSON -> the attributes of a domain reference row."""
    r = F.from_json(c, _REGISTRATION)
    blank = F.lit("")

    def event(action: str) -> Column:
        hits = F.filter(r["events"], lambda e: (F.lower(e["eventAction"]) == action)
                        & (F.coalesce(e["eventDate"], blank) != ""))
        return F.coalesce(F.try_element_at(hits, F.lit(-1))["eventDate"], blank)

    def card_name(card: Column) -> Column:
        entries = F.from_json(F.get(card, 1), "array<array<string>>")

        def value(kind: str) -> Column:
            text = F.get(F.get(F.filter(entries, lambda e: (F.size(e) >= 4) & (e[0] == kind)), 0), 3)
            parts = F.from_json(text, "array<string>")
            return F.when(text.startswith("[") & parts.isNotNull(), F.array_join(parts, ", ")).otherwise(text)

        return F.coalesce(F.nullif(value("fn"), blank), F.nullif(value("org"), blank))

    registrars = F.transform(
        F.filter(r["entities"], lambda e: F.coalesce(F.array_contains(e["roles"], "registrar"), F.lit(False))),
        lambda e: F.coalesce(card_name(e["vcardArray"]), F.nullif(e["handle"], blank)))
    servers = F.array_sort(F.array_distinct(F.filter(
        F.transform(r["nameservers"], lambda n: F.lower(n["ldhName"])), lambda n: F.coalesce(n, blank) != "")))
    signed = r["secureDNS"]["delegationSigned"]
    return F.struct(
        requested.alias("Domain"),
        F.lower(F.coalesce(F.nullif(r["ldhName"], blank), F.nullif(r["unicodeName"], blank), requested))
        .alias("RegisteredDomain"),
        F.coalesce(F.get(F.array_compact(registrars), 0), blank).alias("Registrar"),
        event("registration").alias("RegistrationDate"), event("expiration").alias("ExpirationDate"),
        event("last changed").alias("LastChangedDate"),
        F.coalesce(F.array_join(r["status"], "; "), blank).alias("Status"),
        F.coalesce(F.array_join(servers, "; "), blank).alias("NameServers"),
        F.when(signed, F.lit("Signed")).when(~signed, F.lit("Unsigned")).otherwise(blank).alias("DNSSEC"),
        F.lit(presets.LOOKUP_OK).alias("Lookup_Status"), F.lit("RDAP").alias("Provider"), blank.alias("Error"))
