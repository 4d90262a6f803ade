"""Addresses as canonical text, as fixed-width hexadecimal keys, and by class.

The hexadecimal key has 8 digits for IPv4 and 32 for IPv6, so a range test is a plain
text comparison and a network is a prefix.
"""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import presets
from .text import let, strip

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
_IPV4_TAIL = rf"^(.*:)({_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET})$"


_WRAPPING = r"(?s)^\[([^\]]*)\].*$|^([^:]*):\d+$"


def bare_address(c: Column) -> Column:
    """Drop quotes, brackets and a port."""
    return F.regexp_replace(F.btrim(strip(c), F.lit("'")), _WRAPPING, "$1$2")


def _v4_hex(c: Column) -> Column:
    octets = [F.lpad(F.hex(F.substring_index(F.substring_index(c, ".", i), ".", -1).cast("int")), 2, "0")
              for i in (1, 2, 3, 4)]
    return F.lower(F.concat(*octets))


def _plain_groups(c: Column) -> Column:
    """A dotted IPv4 ending as two hexadecimal groups."""
    tail = _v4_hex(F.regexp_extract(c, _IPV4_TAIL, 2))
    return F.when(c.rlike(_IPV4_TAIL), F.concat(
        F.regexp_extract(c, _IPV4_TAIL, 1), F.substring(tail, 1, 4), F.lit(":"), F.substring(tail, 5, 4))).otherwise(c)


def _group_count(c: Column) -> Column:
    return F.when(c == "", F.lit(0)).otherwise(F.length(c) - F.length(F.replace(c, F.lit(":"), F.lit(""))) + 1)


def _eight_groups(c: Column) -> Column:
    """All eight groups written out; whatever cannot be an address fails the shape test later."""
    head, tail = F.substring_index(c, "::", 1), F.substring_index(c, "::", -1)
    missing = F.lit(8) - _group_count(head) - _group_count(tail)
    filled = F.concat_ws(":", F.nullif(head, F.lit("")),
                         F.nullif(F.rtrim(F.repeat(F.lit("0 "), F.greatest(missing, F.lit(0)))), F.lit("")),
                         F.nullif(tail, F.lit("")))
    usable = (missing >= 1) & (F.length(c) - F.length(F.replace(c, F.lit("::"), F.lit(""))) == 2)
    usable = usable & ~c.contains(":::")
    return F.when(c.contains("::"), F.when(usable, F.replace(filled, F.lit(" "), F.lit(":")))).otherwise(c)


# A run of two to eight zero groups with what precedes and follows it; longer runs are tried first
# and the lazy prefix finds the first run of that length.
_ZERO_RUN = "^(?:" + "|".join(
    rf"(|.*?[^:]:)0(?::0){{{run - 1}}}(?::(.*))?" for run in range(8, 1, -1)) + ")$"
_AROUND_ZEROS = "".join(f"${g}" for g in range(1, 15, 2)) + ":::" + "".join(f"${g}" for g in range(2, 15, 2))


def _short_form(groups: Column) -> Column:
    """The longest run of zero groups, first one on a tie, becomes ``::``."""
    return F.regexp_replace(F.regexp_replace(groups, _ZERO_RUN, _AROUND_ZEROS), ":{3,}", "::")


def _normalize_v6(c: Column) -> Column:
    scope = F.regexp_extract(c, r"(%[^%]+)$", 1)
    address = F.lower(F.when(scope != "", F.substring_index(c, "%", 1)).otherwise(c))

    def canonical(full: Column) -> Column:
        lean = F.regexp_replace(full, r"(^|:)0+(?=[0-9a-f])", "$1")
        return F.when(full.rlike(r"^(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}$"), let(lean, lambda g: F.when(
            g.rlike(r"^0:0:0:0:0:ffff:"), F.concat(F.lit("::ffff:"), _dotted(g))).otherwise(_short_form(g))))

    return F.concat(let(let(let(address, _plain_groups), _eight_groups), canonical), scope)


def _dotted(groups: Column) -> Column:
    """The last two of eight groups as dotted IPv4."""
    pair = F.concat(*[F.lpad(F.substring_index(F.substring_index(groups, ":", n), ":", 1), 4, "0")
                      for n in (-2, -1)])
    return F.concat_ws(".", *[F.conv(F.substring(pair, i, 2), 16, 10) for i in (1, 3, 5, 7)])


def normalize_ip(c: Column) -> Column:
    """Canonical address or NULL."""
    return let(bare_address(c), lambda bare: F.when(bare.rlike(_IPV4), bare).when(bare.contains(":"), _normalize_v6(bare)))


def ip_key(ip: Column) -> Column:
    """Hexadecimal key of a canonical address; an IPv4 address mapped into IPv6 counts as IPv4."""
    def v6(a: Column) -> Column:
        return F.array_join(F.transform(F.split(_eight_groups(a), ":"), lambda g: F.lpad(g, 4, "0")), "")
    return (F.when(ip.rlike(_IPV4), _v4_hex(ip))
            .when(ip.startswith("::ffff:") & ip.contains("."), _v4_hex(F.substring_index(ip, ":", -1)))
            .when(ip.contains(":"), let(F.substring_index(ip, "%", 1), v6)))


def _bounds(cidr: str) -> tuple[str, str]:
    network = ipaddress.ip_network(cidr)
    return network.network_address.packed.hex(), network.broadcast_address.packed.hex()


def key_in(key: Column, cidrs: list[str]) -> Column:
    tests = []
    for cidr in cidrs:
        low, high = _bounds(cidr)
        tests.append((F.length(key) == len(low)) & key.between(low, high))
    return reduce(lambda a, b: a | b, tests)


def classify_key(key: Column) -> Column:
    private = key_in(key, presets.PRIVATE) & ~key_in(key, presets.PRIVATE_EXCEPTIONS)
    return (F.when(key.isNull(), F.lit(None).cast("string"))
            .when(key_in(key, presets.LOOPBACK), F.lit("Loopback"))
            .when(key_in(key, presets.LINK_LOCAL), F.lit("Link-local"))
            .when(private, F.lit("Private"))
            .when(key_in(key, presets.MULTICAST), F.lit("Multicast"))
            .when(key_in(key, presets.RESERVED), F.lit("Reserved"))
            .otherwise(F.lit("Public")))


def classify_ip(ip: Column) -> Column:
    """Class of a canonical address, first match in the given order."""
    mapped = ip.startswith("::ffff:") & ip.contains(".")
    return let(let(ip_key(ip), classify_key),
               lambda name: F.when(mapped & (name == "Public"), F.lit("Reserved")).otherwise(name))


def is_global(ip: Column) -> Column:
    """only these are worth a lookup; shared carrier space is not, although its class is Public."""
    return let(ip_key(ip), lambda key: ~(
        (key_in(key, presets.PRIVATE) & ~key_in(key, presets.PRIVATE_EXCEPTIONS)) | key_in(key, presets.SHARED)))
