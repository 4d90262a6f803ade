"""H1-H3: scored hunts over logins and mail traces.

Each hunt returns one row per finding: the row id and its fields.  Options are checked on the
driver before a job is built.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field as dataclass_field
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import presets
from ..functions.categories import is_login
from ..functions.mail import email_domains
from ..functions.network import normalize_ip
from ..functions.predicates import header_key
from ..functions.text import (country_key, falsey, field, hundredths_of_hours, iso_text, ref, strip, text_of, truthy,
                              two_places, typed_column)
from ..functions.times import literal_micros, literal_time, parse_time, time_of
from .enrich import domain_references, lookup, parse_service_domains, service_of, successful
from .ordering import HOUR_MICROS, Key, sample_borders, with_previous

DAY_MICROS = 24 * HOUR_MICROS


def _hours(value) -> float:
    return max(0.01, min(float(value), 720))


@dataclass(frozen=True)
class TravelOptions:
    """Rules of the travel hunt; hours are kept within 0.01..720, only a literal True switches a rule on."""
    use_country_change: bool = True
    use_region_change: bool = True
    use_elevated_window: bool = True
    country_hours: float = 12
    region_hours: float = 3
    elevated_hours: float = 24
    use_hosting: bool = True
    use_proxy: bool = True
    use_device_risk: bool = True

    def __post_init__(self):
        rules = (self.use_country_change, self.use_region_change, self.use_elevated_window)
        signals = (self.use_hosting, self.use_proxy, self.use_device_risk)
        if not any(r is True for r in rules):
            raise ValueError("Select at least one Impossible Travel rule")
        if self.use_elevated_window is True and not any(s is True for s in signals):
            raise ValueError("Select at least one elevated-risk signal")


@dataclass(frozen=True)
class LoginOptions:
    """Rules of the login hunt."""
    use_country: bool = True
    trusted_countries: Sequence[str] | str = ("United States",)
    use_proxy: bool = True
    use_hosting: bool = True
    require_device_risk: bool = True
    missing_device_risky: bool = True

    def trusted_keys(self) -> list[str]:
        given = self.trusted_countries
        names = re.split(r"[\n,]+", given) if isinstance(given, str) else given
        keys = [re.sub("[^a-z]", "", str(n).lower()) for n in names if str(n).strip()]
        return [presets.COUNTRY_SYNONYMS.get(k, k) for k in keys]

    def __post_init__(self):
        if self.use_country is True and not self.trusted_keys():
            raise ValueError("Enter at least one trusted country or disable the country rule")
        if not any(r is True for r in (self.use_country, self.use_proxy, self.use_hosting)):
            raise ValueError("Select at least one Suspicious Login rule")


def login_address_column(enriched: Sequence[str]) -> str:
    """One address column drives a login hunt: ClientIP if it is enriched, else the first."""
    if not enriched:
        raise ValueError("IP enrichment is required before running a login hunt")
    return "ClientIP" if "ClientIP" in enriched else enriched[0]


def travel_user(events: DataFrame, users: Sequence[str] = ("UserId", "UserKey")) -> Column:
    """The user whose logins follow each other: the first given of these columns, without regard to case."""
    blank = F.lit("")
    return F.lower(strip(F.coalesce(*[F.nullif(field(events, u), blank) for u in users], blank)))


def impossible_travel(events: DataFrame, ip_reference: DataFrame, options: TravelOptions = TravelOptions(), *,
                      row_id: str = "_Row", time: str = "CreationTime", operation: str = "Operation",
                      users: Sequence[str] = ("UserId", "UserKey"), address: str = "ClientIP",
                      reference_key: str = "ip", ranges: int | None = None, salt: int = 1) -> DataFrame:
    """H1: successful logins whose place changed too fast since the user's previous one."""
    blank = F.lit("")
    posture = [field(events, n) for n in ("Login.IsCompliantAndManaged", "Login.IsCompliant", "Login.IsManaged")]
    bad_device = falsey(posture[0]) | falsey(posture[1]) | falsey(posture[2])
    logins = (events.filter(F.lower(field(events, operation)).contains("userloggedin"))
              .select(ref(row_id).alias("__row"), time_of(events, time).alias("__time"),
                      travel_user(events, users).alias("__user"),
                      normalize_ip(text_of(events, address)).alias("__ip"), bad_device.alias("__device"))
              .filter(F.col("__time").isNotNull() & (F.col("__user") != "") & F.col("__ip").isNotNull()))

    def known(name: str) -> Column:
        return (F.coalesce(text_of(ip_reference, name), blank) if name in ip_reference.columns else blank).alias(name)

    intel = (successful(ip_reference)
             .select(ref(reference_key).alias("ip"), *[known(n) for n in (
                 "Country", "Region", "ISP", "Hosting", "Proxy_VPN_TOR")])
             .filter((F.col("Country") != "") | (F.col("Region") != ""))
             .select("ip", "Country", "Region", "ISP", truthy(F.col("Hosting")).alias("Hosting"),
                     truthy(F.col("Proxy_VPN_TOR")).alias("Proxy")))
    placed = lookup(logins, intel, F.col("__ip"), "ip", "__intel", row_id="__row", salt=salt, how="inner")
    seen = placed.select("__row", "__user", F.struct(
        F.unix_micros("__time").alias("micros"), F.col("__time").alias("time"), F.col("__ip").alias("ip"),
        F.col("__intel.Country").alias("country"), F.col("__intel.Region").alias("region"),
        F.col("__intel.ISP").alias("isp"), F.col("__intel.Hosting").alias("hosting"),
        F.col("__intel.Proxy").alias("proxy"), F.col("__device").alias("device")).alias("now"))
    now = F.col("now")

    def on(flag: bool) -> Column:
        return F.lit(flag is True)

    def rules(was: Column) -> dict[str, Column]:
        elapsed = now["micros"] - was["micros"]

        def changed(part: str) -> Column:
            return (was[part] != "") & (now[part] != "") & (F.lower(was[part]) != F.lower(now[part]))

        def within(hours: float) -> Column:
            return elapsed <= F.lit(int(_hours(hours) * HOUR_MICROS))

        hosting = on(options.use_hosting) & (was["hosting"] | now["hosting"])
        proxy = on(options.use_proxy) & (was["proxy"] | now["proxy"])
        device = on(options.use_device_risk) & (was["device"] | now["device"])
        country = on(options.use_country_change) & changed("country") & within(options.country_hours)
        region = on(options.use_region_change) & changed("region") & within(options.region_hours)
        elevated = (on(options.use_elevated_window) & changed("country") & within(options.elevated_hours)
                    & (hosting | proxy | device))
        return {"elapsed": elapsed, "hosting": hosting, "proxy": proxy, "device": device, "region": region,
                "by_country": country | elevated, "within_country": within(options.country_hours),
                "candidate": country | region | elevated}

    # The borders come from the logins before any lookup.
    borders = sample_borders(logins, [Key(F.col("__user")), Key(F.unix_micros("__time")), Key(F.col("__row"))], ranges)
    pairs = with_previous(seen, ["__user"], [F.col("now.micros"), F.col("__row")], now, "was",
                          keep=lambda was: rules(was)["candidate"], borders=borders)
    was = F.col("was")
    r = rules(was)
    facts = pairs.select("__row", "now", "was", *[r[k].alias(k) for k in r if k != "candidate"])
    two = F.lit(2)
    zero = F.lit(0)
    place_score = (F.when(F.col("by_country"), F.when(F.col("elapsed") <= 4 * HOUR_MICROS, F.lit(4))
                          .when(F.col("within_country"), F.lit(3)).otherwise(F.lit(1))).otherwise(two))
    score = place_score
    for signal in ("hosting", "proxy", "device"):
        score = score + F.when(F.col(signal), two).otherwise(zero)
    hundredths = hundredths_of_hours(F.col("elapsed"))
    span = F.concat(F.lit(" changed within "), two_places(F.col("hundredths")), F.lit("h"))
    reasons = F.array_compact(F.array(
        F.concat(F.when(F.col("by_country"), F.lit("Country")).otherwise(F.lit("Region")), span),
        F.when(F.col("hosting"), F.lit("Hosting provider IP")),
        F.when(F.col("proxy"), F.lit("Proxy/VPN/TOR indicator")),
        F.when(F.col("device"), F.lit("Device not compliant and managed"))))

    def location(side: Column) -> Column:
        return F.array_join(F.filter(F.array(side["region"], side["country"]), lambda x: x != ""), ", ")

    scored = facts.withColumn("score", score.cast("bigint")).withColumn("hundredths", hundredths)
    return scored.select(
        F.col("__row").alias(row_id), F.lit(True).alias("Flag"),
        F.when(F.col("score") >= 6, F.lit("High")).when(F.col("score") >= 3, F.lit("Medium"))
        .otherwise(F.lit("Low")).alias("Risk"),
        F.col("score").alias("Score"), (F.col("hundredths") / F.lit(100.0)).alias("ElapsedHours"),
        iso_text(was["time"]).alias("PreviousTime"), was["ip"].alias("PreviousIP"), was["isp"].alias("PreviousISP"),
        location(was).alias("PreviousLocation"), now["isp"].alias("CurrentISP"),
        location(now).alias("CurrentLocation"), (F.col("hosting") | F.col("proxy")).alias("HostingOrVPN"),
        F.col("device").alias("DeviceRisk"), F.array_join(reasons, "; ").alias("Reasons"))


def suspicious_logins(events: DataFrame, ip_reference: DataFrame, options: LoginOptions = LoginOptions(), *,
                      row_id: str = "_Row", operation: str = "Operation", address: str = "ClientIP",
                      reference_key: str = "ip", salt: int = 1) -> DataFrame:
    """H2: logins from outside the trusted countries, or from infrastructure on a risky device."""
    blank = F.lit("")
    logins = (events.filter(is_login(field(events, operation)))
              .select(ref(row_id).alias("__row"), normalize_ip(text_of(events, address)).alias("__ip"),
                      F.coalesce(field(events, "Login.IsCompliant"), blank).alias("IsCompliant"),
                      F.coalesce(field(events, "Login.IsCompliantAndManaged"), blank).alias("IsCompliantAndManaged"))
              .filter(F.col("__ip").isNotNull()))

    def known(name: str) -> Column:
        return (F.coalesce(text_of(ip_reference, name), blank) if name in ip_reference.columns else blank).alias(name)

    intel = successful(ip_reference).select(ref(reference_key).alias("ip"), *[known(n) for n in (
        "Country", "Region", "City", "ISP", "Proxy_VPN_TOR", "Hosting")])
    intel = intel.select(
        "ip", F.array_join(F.filter(F.array("City", "Region", "Country"), lambda x: x != ""), ", ").alias("Location"),
        "ISP", strip(F.col("Country")).alias("country"), truthy(F.col("Proxy_VPN_TOR")).alias("proxy"),
        truthy(F.col("Hosting")).alias("hosting"))
    outside = (F.lit(options.use_country is True) & (F.col("country") != "")
               & ~country_key(F.col("country")).isin(options.trusted_keys() or [""]))
    proxy_hit = F.lit(options.use_proxy is True) & F.col("proxy")
    hosting_hit = F.lit(options.use_hosting is True) & F.col("hosting")
    # Everything that depends on the address alone is settled on the small side, and addresses that
    # can never lead to a finding do not take part in the join.
    intel = (intel.withColumns({"outside": outside, "proxyHit": proxy_hit, "hostingHit": hosting_hit})
             .filter(F.col("outside") | F.col("proxyHit") | F.col("hostingHit")))
    placed = lookup(logins, intel, F.col("__ip"), "ip", "i", row_id="__row", salt=salt, how="inner")
    i = F.col("i")

    def missing(name: str) -> Column:
        return strip(F.col(name)) == ""

    def risky(name: str) -> Column:
        bad = falsey(F.col(name))
        return bad | missing(name) if options.missing_device_risky is True else bad

    infrastructure = i["proxyHit"] | i["hostingHit"]
    device_ok = F.lit(options.require_device_risk is not True) | (risky("IsCompliant") & risky("IsCompliantAndManaged"))
    found = placed.filter(i["outside"] | (infrastructure & device_ok))
    by_device = F.lit(options.require_device_risk is True) & infrastructure

    def posture(name: str) -> tuple[Column, Column]:
        points = F.when(by_device, F.when(missing(name), F.lit(1)).when(falsey(F.col(name)), F.lit(2)))
        reason = F.when(by_device, F.when(missing(name), F.lit(f"{name} missing"))
                        .when(falsey(F.col(name)), F.lit(f"{name}=False")))
        return F.coalesce(points, F.lit(0)), reason

    first, second = posture("IsCompliant"), posture("IsCompliantAndManaged")
    score = (F.when(i["outside"], 4).otherwise(0) + F.when(i["proxyHit"], 3).otherwise(0)
             + F.when(i["hostingHit"], 3).otherwise(0) + first[0] + second[0]).cast("bigint")
    reasons = F.array_compact(F.array(
        F.when(i["outside"], F.concat(F.lit("Login country outside trusted countries ("), i["country"], F.lit(")"))),
        F.when(i["proxyHit"], F.lit("Proxy/VPN/TOR indicator")),
        F.when(i["hostingHit"], F.lit("Hosting provider IP")), first[1], second[1]))
    return found.withColumn("Score", score).select(
        F.col("__row").alias(row_id), F.lit(True).alias("Flag"),
        F.when(F.col("Score") >= 7, F.lit("High")).otherwise(F.lit("Medium")).alias("Risk"), "Score",
        F.col("__ip").alias("IP"), i["Location"].alias("Location"), i["ISP"].alias("ISP"),
        i["proxy"].alias("Proxy_VPN_TOR"), i["hosting"].alias("Hosting"), "IsCompliant", "IsCompliantAndManaged",
        F.array_join(reasons, "; ").alias("Reasons"))


@dataclass(frozen=True)
class MailOptions:
    """Signals of the mail hunt; the age is kept within 1..3650 days."""
    use_domain_age: bool = True
    max_age_days: int = 365
    registered_after: str = ""
    registered_before: str = ""
    keywords: Sequence[str] | str = ()
    use_service_domains: bool = True
    service_domains: Sequence[str] | str = ()
    now: datetime = dataclass_field(default_factory=lambda: datetime.now(timezone.utc))

    def __post_init__(self):
        for label, value in (("start", self.registered_after), ("end", self.registered_before)):
            if value and literal_time(value) is None:
                raise ValueError(f"Invalid registration {label} date")
        if self.registered_after and self.registered_before and self.registered_after > self.registered_before:
            raise ValueError("Registration start must be before registration end")
        if not self.use_domain_age and not self.terms() and not self.services():
            raise ValueError("Enable domain age, provide a subject keyword, or provide a service sender domain")

    @staticmethod
    def _listed(given: Sequence[str] | str) -> list[str]:
        parts = re.split(r"[,\n]", given) if isinstance(given, str) else given
        return [str(p).strip() for p in parts if str(p).strip()]

    def terms(self) -> list[str]:
        kept: dict[str, str] = {}
        for term in self._listed(self.keywords):
            kept.setdefault(term.casefold(), term)
        return list(kept.values())

    def services(self) -> list[str]:
        return parse_service_domains(self._listed(self.service_domains)) if self.use_service_domains else []

    def moment(self) -> int:
        return literal_micros(self.now if self.now.tzinfo else self.now.replace(tzinfo=timezone.utc))

    def bounds(self) -> tuple[int | None, int | None]:
        """Half-open registration range in micros; a date-only end includes that day."""
        after, before = literal_time(self.registered_after), literal_time(self.registered_before)
        if before and len(self.registered_before.strip()) == 10:
            before += timedelta(days=1)
        return (literal_micros(after) if after else None), (literal_micros(before) if before else None)


def suspicious_mail(trace: DataFrame, domain_reference: DataFrame | None, options: MailOptions, *,
                    row_id: str = "_Row", domain_columns: Sequence[str] = ("SenderAddress", "RecipientAddress"),
                    sender_columns: Sequence[str] | None = None,
                    subject_columns: Sequence[str] = ("Subject", "message_subject"),
                    reference_key: str = "Domain") -> DataFrame:
    """H3: mail with a newly registered domain, a suspicious subject or a messaging service as sender."""
    blank = F.lit("")
    none = F.array().cast("array<string>")
    senders = list(sender_columns if sender_columns is not None
                   else [c for c in trace.columns if header_key(c) in presets.SENDER_HEADERS])
    aged = [c for c in domain_columns if typed_column(trace, c)] if options.use_domain_age else []
    if options.use_domain_age and domain_reference is None:
        raise ValueError("Domain enrichment is required for the domain age rule")

    def domains_in(columns: Sequence[str]) -> Column:
        lists = [F.coalesce(email_domains(field(trace, c)), none) for c in columns]
        return F.array_distinct(F.flatten(F.array(*lists))) if lists else none

    subject = F.coalesce(*[F.nullif(field(trace, c), blank) for c in subject_columns], blank)
    terms, services = options.terms(), options.services()
    matched_terms = (F.array_compact(F.array(*[
        F.when(F.lower(subject).contains(t.lower()), F.lit(t)) for t in terms])) if terms else none)
    owned = F.transform(domains_in(senders), lambda d: F.struct(d.alias("domain"), service_of(d, services).alias("by")))
    rows = trace.select(
        ref(row_id).alias("__row"), matched_terms.alias("terms"),
        (F.filter(owned, lambda s: s["by"].isNotNull()) if services
         else F.array().cast("array<struct<domain:string,by:string>>")).alias("services"),
        domains_in(aged).alias("domains"))
    if aged:
        registrations = domain_reference.select(
            ref(reference_key).alias("Domain"), strip(text_of(domain_reference, "RegistrationDate")).alias("text"))
        registrations = registrations.select("Domain", "text", F.unix_micros(parse_time(F.col("text"))).alias("at"))
        after, before = options.bounds()
        age = F.lit(options.moment()) - F.col("at")
        if after is not None or before is not None:
            hit = ((F.lit(True) if after is None else F.col("at") >= after)
                   & (F.lit(True) if before is None else F.col("at") < before))
        else:
            limit = min(3650, max(1, int(options.max_age_days)))
            hit = age.between(-DAY_MICROS, limit * DAY_MICROS)
        # Only domains that count as new take part in the join.
        fresh = registrations.filter(F.col("at").isNotNull() & hit).select(
            "Domain", "text", F.greatest(F.lit(0), F.floor(age / F.lit(DAY_MICROS))).cast("bigint").alias("age"))
        rows = domain_references(rows, F.col("domains"), fresh, "looked_up", row_id="__row")
        new = F.transform(F.filter(F.coalesce(F.col("looked_up"), F.array().cast(
            "array<struct<pos:int,domain:string,hit:struct<Domain:string,text:string,age:bigint>>>")),
            lambda x: x["hit"].isNotNull()), lambda x: x["hit"])
        ranged = after is not None or before is not None
    else:
        new = F.array().cast("array<struct<Domain:string,text:string,age:bigint>>")
        ranged = False
    found = (rows.withColumn("new", new)
             .filter((F.size("new") > 0) | (F.size("terms") > 0) | (F.size("services") > 0)))

    def describe(x: Column) -> Column:
        if ranged:
            return F.concat(x["Domain"], F.lit(" registered "), x["text"])
        return F.concat(x["Domain"], F.lit(" is "), x["age"].cast("string"), F.lit(" days old (registered "),
                        x["text"], F.lit(")"))

    def has(name: str) -> Column:
        return F.size(name) > 0

    plural = F.when(F.size("terms") != 1, F.lit("s")).otherwise(blank)
    reasons = F.array_compact(F.array(
        F.when(has("new"), F.concat(F.lit("Newly registered domain: "),
                                    F.array_join(F.transform("new", describe), ", "))),
        F.when(has("terms"), F.concat(
            F.lit("Subject contains suspicious keyword"), plural, F.lit(": "),
            F.array_join(F.transform("terms", lambda t: F.concat(F.lit('"'), t, F.lit('"'))), ", "))),
        F.when(has("services"), F.concat(
            F.lit("Third-party survey/messaging service sender domain: "),
            F.array_join(F.transform("services", lambda s: F.when(s["domain"] == s["by"], s["domain"]).otherwise(
                F.concat(s["domain"], F.lit(" (matches "), s["by"], F.lit(")")))), ", ")))))
    points = [F.when(has(n), F.lit(p)).otherwise(F.lit(0)) for n, p in (("new", 5), ("terms", 3), ("services", 3))]
    kinds = sum((has(n).cast("int") for n in ("terms", "services")), has("new").cast("int"))
    return found.select(
        F.col("__row").alias(row_id), F.lit(True).alias("Flag"),
        F.when(kinds >= 2, F.lit("High")).otherwise(F.lit("Medium")).alias("Risk"),
        (points[0] + points[1] + points[2]).cast("bigint").alias("Score"),
        F.array_join(F.transform("new", lambda x: x["Domain"]), "; ").alias("NewDomains"),
        F.array_min(F.transform("new", lambda x: x["age"])).alias("DomainAgeDays"),
        F.array_join(F.transform("new", lambda x: x["text"]), "; ").alias("DomainRegistrationDates"),
        F.array_join("terms", "; ").alias("SubjectKeywords"),
        F.array_join(F.transform("services", lambda s: s["domain"]), "; ").alias("ServiceDomains"),
        F.array_join(reasons, "; ").alias("SuspiciousReason"))
