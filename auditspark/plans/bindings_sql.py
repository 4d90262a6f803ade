"""The results of ``bindings`` in plain SQL over the same tables."""

from __future__ import annotations

# The code points that count as white space at the edge of a value.
_CHARS = "||".join(f"chr({n})" for n in (
    9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288))


def strip(c: str) -> str:
    return f"trim({c}, {_CHARS})"


def micros(c: str) -> str:
    return f"epoch_us({c})"


def iso(c: str) -> str:
    return (f"strftime({c}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({c}) % 1000000 = 0 THEN '' ELSE "
            f"'.' || lpad((epoch_us({c}) % 1000000)::VARCHAR, 6, '0') END || '+00:00'")


K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


def graded(a: float, b: float) -> str:
    return f"CASE WHEN value < {a} THEN 'False' WHEN value < {b} THEN '' ELSE 'True' END"


LOGINS = f"""logins AS (
  SELECT event_id AS _Row, ts, user_id::VARCHAR AS user_id,
         CASE WHEN event_type IN ('click','view','purchase') THEN 'UserLoggedIn'
              WHEN event_type = 'signup' THEN 'UserLoginFailed' ELSE 'FileAccessed' END AS op,
         '198.51.100.' || ({K} % 25) AS ip, {graded(3, 6)} AS comp, {graded(4.5, 9)} AS managed
  FROM events)"""
RECORDS = f"""records AS (
  SELECT event_id AS _Row, ts, value, event_type, user_id, {K} AS k,
         CASE WHEN value >= 5 THEN 'User' || user_id END AS uid, 'user' || user_id AS ukey,
         CASE event_type WHEN 'click' THEN 'FileAccessed' WHEN 'view' THEN 'MailItemsAccessed'
              WHEN 'purchase' THEN 'New-InboxRule' WHEN 'signup' THEN 'UserLoggedIn' ELSE '' END AS op,
         CASE event_type WHEN 'click' THEN 'SharePoint' WHEN 'view' THEN 'Exchange' ELSE '' END AS load,
         CASE event_type WHEN 'click' THEN 'file_access' WHEN 'view' THEN 'email_access'
              WHEN 'purchase' THEN 'inbox_rules' WHEN 'signup' THEN 'logon' ELSE 'other' END AS kind,
         '198.51.100.' || {K} AS ip4,
         CASE WHEN value < 4 THEN '2001:db8::' || CASE WHEN {K} = 0 THEN '' ELSE lower(to_hex({K})) END END AS ip6,
         CASE WHEN value > 20 THEN 'Of interest' END AS tag
  FROM events)"""
IPREF = """ipref AS (
  SELECT '198.51.100.' || n_nationkey AS ip, n_name AS country, r_name AS region, 'City ' || n_nationkey AS city,
         'ISP ' || n_nationkey AS isp, n_nationkey % 11 = 0 AS proxy, n_nationkey % 7 = 0 AS hosting,
         CASE WHEN n_nationkey = 13 THEN 'Failed' ELSE 'Success' END AS status,
         CASE WHEN n_nationkey % 5 = 0 THEN 'other' ELSE 'service' END AS provider
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""
DOMREF = """domref AS (
  SELECT 'mail' || n_nationkey || '.example.com' AS domain, 'Registrar ' || n_regionkey AS registrar,
         (DATE '2024-01-01' - n_nationkey * 60)::TIMESTAMP AS born,
         strftime(DATE '2024-01-01' - n_nationkey * 60, '%Y-%m-%d') || 'T00:00:00Z' AS born_text,
         CASE WHEN n_nationkey % 4 = 0 THEN 'Failed' ELSE 'Success' END AS status
  FROM nation)"""
_LABEL = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
_CLASS = r"A-Z0-9.!#$%&''*+/=?^_`{|}~-"
# One row per document and distinct domain of its text, with the order of appearance.
DOMAINS = f"""found AS (
  SELECT doc_id, text, list_filter(list_transform(regexp_extract_all(text, '(?i)[{_CLASS}]+@([A-Z0-9.-]+)', 1),
           lambda d: trim(lower(d), '.')),
           lambda d: length(d) <= 253 AND regexp_full_match(d, '{_LABEL}(?:\\.{_LABEL})+')) AS all_domains
  FROM documents),
domains AS (
  SELECT doc_id, text, list_filter(all_domains, lambda d, i: list_position(all_domains, d) = i) AS domains FROM found)"""


def travel(country: float, region: float, elevated: float, device: bool) -> str:
    def hours(h):
        return f"{int(h * 3600 * 1000000)}"
    dev = "(comp = 'False' OR managed = 'False')" if device else "false"
    return f"""
WITH {LOGINS}, {IPREF},
seen AS (SELECT l._Row, user_id, ts, {micros('ts')} AS us, l.ip, country, region, isp, hosting, proxy, {dev} AS dev
         FROM logins l JOIN ipref r ON l.ip = r.ip AND r.status = 'Success' WHERE op = 'UserLoggedIn'),
pairs AS (SELECT *, lag(us) OVER w AS p_us, lag(ts) OVER w AS p_ts, lag(ip) OVER w AS p_ip, lag(country) OVER w AS p_country,
            lag(region) OVER w AS p_region, lag(isp) OVER w AS p_isp, lag(hosting) OVER w AS p_hosting,
            lag(proxy) OVER w AS p_proxy, lag(dev) OVER w AS p_dev
          FROM seen WINDOW w AS (PARTITION BY user_id ORDER BY us, _Row)),
facts AS (SELECT *, us - p_us AS el, hosting OR p_hosting AS h, proxy OR p_proxy AS x, dev OR p_dev AS d,
            lower(country) <> lower(p_country) AS cc, lower(region) <> lower(p_region) AS rc
          FROM pairs WHERE p_us IS NOT NULL),
rules AS (SELECT *, cc AND el <= {hours(country)} AS cand_c, rc AND el <= {hours(region)} AS cand_r,
            cc AND el <= {hours(elevated)} AND (h OR x OR d) AS cand_e FROM facts),
scored AS (SELECT *, (cand_c OR cand_e) AS by_c,
             CASE WHEN cand_c OR cand_e THEN CASE WHEN el <= {hours(4)} THEN 4 WHEN el <= {hours(country)} THEN 3 ELSE 1 END
                  ELSE 2 END + 2 * h::INT + 2 * x::INT + 2 * d::INT AS score,
             (el + 18000000) // 36000000 AS cents
           FROM rules WHERE cand_c OR cand_r OR cand_e)
SELECT _Row, true AS "Flag", CASE WHEN score >= 6 THEN 'High' WHEN score >= 3 THEN 'Medium' ELSE 'Low' END AS "Risk",
       score::BIGINT AS "Score", cents / 100.0 AS "ElapsedHours", {iso('p_ts')} AS "PreviousTime", p_ip AS "PreviousIP",
       p_isp AS "PreviousISP", p_region || ', ' || p_country AS "PreviousLocation", isp AS "CurrentISP",
       region || ', ' || country AS "CurrentLocation", h OR x AS "HostingOrVPN", d AS "DeviceRisk",
       concat_ws('; ', CASE WHEN by_c THEN 'Country' ELSE 'Region' END || ' changed within ' || (cents // 100)::VARCHAR || '.'
                 || lpad((cents % 100)::VARCHAR, 2, '0') || 'h', CASE WHEN h THEN 'Hosting provider IP' END,
                 CASE WHEN x THEN 'Proxy/VPN/TOR indicator' END, CASE WHEN d THEN 'Device not compliant and managed' END)
         AS "Reasons"
FROM scored"""


def login_hunt(country: bool, device: bool) -> str:
    trusted = "('UNITED STATES','NATION_3','NATION_5','NATION_7','NATION_11','NATION_14')"
    # Digits do not count in a country name, so every numbered nation reads alike.
    outside = f"(regexp_replace(lower(country), '[^a-z]', '', 'g') NOT IN (SELECT regexp_replace(lower(x), '[^a-z]', '', 'g') FROM unnest({trusted.replace('(', '[').replace(')', ']')}) t(x)))" if country else "false"
    ok = "((comp = 'False' OR comp = '') AND (managed = 'False' OR managed = ''))" if device else "true"
    dev = "(proxy OR hosting)" if device else "false"
    return f"""
WITH {LOGINS}, {IPREF},
j AS (SELECT l.*, r.country, r.region, r.city, r.isp, r.proxy, r.hosting, {outside} AS outside, {ok} AS ok
      FROM logins l JOIN ipref r ON l.ip = r.ip AND r.status = 'Success' WHERE op LIKE 'UserLog%'),
s AS (SELECT *, 4 * outside::INT + 3 * proxy::INT + 3 * hosting::INT + CASE WHEN {dev} THEN
        CASE comp WHEN '' THEN 1 WHEN 'False' THEN 2 ELSE 0 END + CASE managed WHEN '' THEN 1 WHEN 'False' THEN 2 ELSE 0 END
        ELSE 0 END AS score FROM j WHERE outside OR ((proxy OR hosting) AND ok))
SELECT _Row, true AS "Flag", CASE WHEN score >= 7 THEN 'High' ELSE 'Medium' END AS "Risk", score::BIGINT AS "Score",
       ip AS "IP", city || ', ' || region || ', ' || country AS "Location", isp AS "ISP", proxy AS "Proxy_VPN_TOR",
       hosting AS "Hosting", comp AS "IsCompliant", managed AS "IsCompliantAndManaged",
       concat_ws('; ', CASE WHEN outside THEN 'Login country outside trusted countries (' || country || ')' END,
         CASE WHEN proxy THEN 'Proxy/VPN/TOR indicator' END, CASE WHEN hosting THEN 'Hosting provider IP' END,
         CASE WHEN {dev} THEN CASE comp WHEN '' THEN 'IsCompliant missing' WHEN 'False' THEN 'IsCompliant=False' END END,
         CASE WHEN {dev} THEN CASE managed WHEN '' THEN 'IsCompliantAndManaged missing' WHEN 'False'
              THEN 'IsCompliantAndManaged=False' END END) AS "Reasons"
FROM s"""


def mail_hunt(ranged: bool) -> str:
    now = "TIMESTAMP '2024-06-01'"
    if ranged:
        hit = "born >= TIMESTAMP '2022-09-01' AND born < TIMESTAMP '2023-06-02'"
        detail = "domain || ' registered ' || born_text"
        terms, services = "[]::VARCHAR[]", "[]::VARCHAR[]"
    else:
        hit = f"epoch_us({now}) - epoch_us(born) BETWEEN -86400000000 AND 365 * 86400000000"
        detail = "domain || ' is ' || age || ' days old (registered ' || born_text || ')'"
        terms = "list_filter(['license','the one','Password'], lambda t: contains(lower(text), lower(t)))"
        services = "list_filter(domains, lambda d: d IN ('mail3.example.com','mail5.example.com','example.org') OR ends_with(d, '.mail3.example.com') OR ends_with(d, '.mail5.example.com') OR ends_with(d, '.example.org'))"
    shown = "CASE WHEN d IN ('mail3.example.com','mail5.example.com','example.org') THEN d ELSE d || ' (matches ' || CASE WHEN ends_with(d, '.mail3.example.com') THEN 'mail3.example.com' WHEN ends_with(d, '.mail5.example.com') THEN 'mail5.example.com' ELSE 'example.org' END || ')' END"
    return f"""
WITH {DOMAINS}, {DOMREF},
fresh AS (SELECT domain, born_text, greatest(0, (epoch_us({now}) - epoch_us(born)) // 86400000000) AS age FROM domref WHERE {hit}),
hits AS (SELECT doc_id, list(domain ORDER BY i) AS ds, list(born_text ORDER BY i) AS ts, min(age) AS youngest,
           list({detail} ORDER BY i) AS details
         FROM (SELECT doc_id, unnest(domains) AS d, generate_subscripts(domains, 1) AS i FROM domains) JOIN fresh ON d = domain
         GROUP BY doc_id),
signals AS (SELECT doc_id, {terms} AS terms, {services} AS services FROM domains),
s AS (SELECT s.*, ds, ts, youngest, details FROM signals s LEFT JOIN hits USING (doc_id)
      WHERE ds IS NOT NULL OR len(terms) > 0 OR len(services) > 0)
SELECT doc_id AS _Row, true AS "Flag",
  CASE WHEN (ds IS NOT NULL)::INT + (len(terms) > 0)::INT + (len(services) > 0)::INT >= 2 THEN 'High' ELSE 'Medium' END AS "Risk",
  (5 * (ds IS NOT NULL)::INT + 3 * (len(terms) > 0)::INT + 3 * (len(services) > 0)::INT)::BIGINT AS "Score",
  coalesce(array_to_string(ds, '; '), '') AS "NewDomains", youngest::BIGINT AS "DomainAgeDays",
  coalesce(array_to_string(ts, '; '), '') AS "DomainRegistrationDates", array_to_string(terms, '; ') AS "SubjectKeywords",
  array_to_string(services, '; ') AS "ServiceDomains",
  concat_ws('; ', CASE WHEN ds IS NOT NULL THEN 'Newly registered domain: ' || array_to_string(details, ', ') END,
    CASE WHEN len(terms) > 0 THEN 'Subject contains suspicious keyword' || CASE WHEN len(terms) <> 1 THEN 's' ELSE '' END || ': '
      || array_to_string(list_transform(terms, lambda t: '"' || t || '"'), ', ') END,
    CASE WHEN len(services) > 0 THEN 'Third-party survey/messaging service sender domain: '
      || array_to_string(list_transform(services, lambda d: {shown}), ', ') END) AS "SuspiciousReason"
FROM s"""


QUADS = r"""quads AS (
  SELECT doc_id, unnest(list_transform(m, lambda x, i: {'raw': x, 'pos': i - 1}), recursive := true)
  FROM (SELECT doc_id, regexp_extract_all(text, '\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}') AS m FROM documents)),
parts AS (SELECT *, string_split(raw, '.') AS p FROM quads),
valid AS (SELECT *, len(list_filter(p, lambda o: o::INT > 255 OR (length(o) > 1 AND o[1] = '0'))) = 0 AS ok FROM parts),
ips AS (SELECT doc_id, pos, raw, CASE WHEN ok THEN raw END AS ip,
          CASE WHEN ok THEN p[1]::BIGINT * 16777216 + p[2]::BIGINT * 65536 + p[3]::BIGINT * 256 + p[4]::BIGINT END AS n FROM valid)"""


def v4_in(*ranges: tuple[str, str]) -> str:
    """Tests of the number n against first and last addresses."""
    def number(address: str) -> int:
        a, b, c, d = map(int, address.split("."))
        return ((a * 256 + b) * 256 + c) * 256 + d

    return "(" + " OR ".join(f"n BETWEEN {number(first)} AND {number(last)}" for first, last in ranges) + ")"


_PRIVATE4 = v4_in(("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"), ("127.0.0.0", "127.255.255.255"), ("169.254.0.0", "169.254.255.255"),
                  ("172.16.0.0", "172.31.255.255"), ("192.0.0.0", "192.0.0.8"), ("192.0.0.11", "192.0.0.255"), ("192.0.2.0", "192.0.2.255"),
                  ("192.168.0.0", "192.168.255.255"), ("198.18.0.0", "198.19.255.255"), ("198.51.100.0", "198.51.100.255"),
                  ("203.0.113.0", "203.0.113.255"), ("240.0.0.0", "255.255.255.255"))
IP_CLASS = (f"CASE WHEN n IS NULL THEN NULL WHEN {v4_in(('127.0.0.0', '127.255.255.255'))} THEN 'Loopback' "
            f"WHEN {v4_in(('169.254.0.0', '169.254.255.255'))} THEN 'Link-local' WHEN {_PRIVATE4} THEN 'Private' "
            f"WHEN {v4_in(('224.0.0.0', '239.255.255.255'))} THEN 'Multicast' ELSE 'Public' END")
IS_GLOBAL = f"CASE WHEN n IS NOT NULL THEN NOT ({_PRIVATE4} OR {v4_in(('100.64.0.0', '100.127.255.255'))}) END"

TURNS = """turns AS (
  SELECT conv_id * 1000 + turn AS _Row, 'c' || conv_id || '.' || turn || '@mail.example.com' AS name, role,
         """ + strip("text") + """ AS subject, length(text)::VARCHAR AS size FROM conversations),
pairs AS (
  SELECT _Row, 0 AS position, '<' || name || '>' AS message_id, subject, '' AS size FROM turns UNION ALL
  SELECT _Row, 1, '<' || upper(name) || '>', '', size FROM turns UNION ALL
  SELECT _Row, 2, '<lost@mail.example.com>', '', '' FROM turns WHERE role = 'user')"""

RULES = """rules AS (
  SELECT o_orderkey AS _Row, o_totalprice > 100000 AS is_rule, o_orderpriority, o_orderstatus, o_custkey::VARCHAR AS cust FROM orders)"""

TIME_TEXTS = """texts AS (
  SELECT o_orderkey AS _Row, o_orderdate AS d, CASE
    WHEN o_orderpriority = '1-URGENT' THEN strftime(o_orderdate, '%Y-%m-%dT10:00:00Z')
    WHEN o_orderpriority = '2-HIGH' THEN strftime(o_orderdate, '%Y-%m-%dT08:30:15.25+05:30')
    WHEN o_orderpriority = '3-MEDIUM' THEN strftime(o_orderdate, '%Y%m%d')
    WHEN o_orderpriority = '4-NOT SPECIFIED' THEN strftime(o_orderdate, '%-m/%-d/%Y 7:5:9')
    WHEN o_orderstatus = 'F' THEN ' ' WHEN o_orderstatus = 'P' THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS t,
  CASE WHEN o_orderpriority = '1-URGENT' THEN epoch_us(o_orderdate) + 36000000000
    WHEN o_orderpriority = '2-HIGH' THEN epoch_us(o_orderdate) + 10815250000
    WHEN o_orderpriority = '3-MEDIUM' THEN epoch_us(o_orderdate)
    WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL
    WHEN o_orderstatus = 'O' THEN epoch_us(o_orderdate) END AS us,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN epoch_us(o_orderdate) + 25509000000 END AS slashed FROM orders)"""

TARGETS = """targets AS (
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'box' || (o_custkey % 50)
           ELSE CASE WHEN o_orderstatus = 'F' THEN 'Box' ELSE 'box' END || (o_custkey % 50) || '@x.org' END AS mailbox,
         '<m' || o_orderpriority || '@y.org>' AS mid,
         CASE WHEN o_orderstatus = 'P' THEN 'Invalid MailboxOwnerUPN: box' || (o_custkey % 50) END AS problem FROM orders),
uniq AS (SELECT arg_min(mailbox, o_orderkey) AS mailbox, arg_min(mid, o_orderkey) AS mid FROM targets WHERE problem IS NULL
         GROUP BY lower(mailbox), lower(mid)),
results AS (
  SELECT 'box' || (c_custkey % 40) || '@x.org' AS box,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN '<m1-urgent@y.org>' ELSE '<m5-low@y.org>' END AS mid,
         c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2, 3),
report AS (
  SELECT u.mailbox AS "MailboxOwnerUPN", u.mid AS "InternetMessageId", coalesce(c_mktsegment, '') AS "Subject",
         CASE WHEN c_mktsegment IS NULL THEN 'Not found' WHEN c_mktsegment = 'BUILDING' THEN 'Error' ELSE 'Collected' END AS "Status",
         '' AS "EmlPath", coalesce(n::VARCHAR, '') AS "AttachmentCount",
         CASE WHEN c_mktsegment = 'BUILDING' THEN 'HTTP 500' ELSE '' END AS "Error"
  FROM uniq u LEFT JOIN results r ON lower(u.mailbox) = r.box AND lower(u.mid) = r.mid)"""

TAGS = """tags AS (SELECT event_id AS _Row FROM events WHERE value > 10),
asked AS (SELECT event_id AS _Row FROM events WHERE event_type = 'error')"""

_SHORT = strip("regexp_replace({c}, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g')")


def short(c: str, limit: int = 320) -> str:
    clean = _SHORT.format(c=c)
    return f"CASE WHEN length({clean}) <= {limit} THEN {clean} ELSE substr({clean}, 1, {limit - 1}) || '…' END"


def positions(cte: str, order: str) -> str:
    return f"WITH {cte} SELECT _Row, row_number() OVER (ORDER BY {order}) AS position FROM texts"


SQL = {
    "impossible_travel": travel(12, 3, 24, True),
    "impossible_travel_custom": travel(2, 6, 48, False),
    "suspicious_logins": login_hunt(True, True),
    "suspicious_logins_infrastructure": login_hunt(False, False),
    "suspicious_mail": mail_hunt(False),
    "suspicious_mail_range": mail_hunt(True),
    "mail_hunt_totals": f"""SELECT count(*) AS "findingCount", count(*) FILTER ("NewDomains" <> '') AS "domainHitCount",
        count(*) FILTER ("SubjectKeywords" <> '') AS "subjectHitCount", count(*) FILTER ("ServiceDomains" <> '') AS "serviceHitCount"
        FROM ({mail_hunt(False)})""",
    "filter_equals": "SELECT p_partkey, p_name, p_type FROM part WHERE lower(p_type) = 'economy'",
    "filter_contains": "SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'étion')",
    "filter_like": "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%e%w%'",
    "filter_compare": """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'
        AND o_totalprice > 250000 AND o_totalprice <= 400000""",
    "filter_compare_text": f"""SELECT event_id, {iso('ts')} AS seen_time, json_extract_string(props, '$.k') AS k FROM events
        WHERE ts > TIMESTAMP '2024-01-05 12:00:00' AND ts < TIMESTAMP '2024-01-20' AND {K} < 9 AND event_type < 'purge'""",
    "filter_negate": "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT contains(lower(c_mktsegment), 'machin')",
    "filter_blank": "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')",
    "filter_populated": """SELECT o_orderkey, o_orderpriority AS clerk FROM orders
        WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW')""",
    "filter_any_field": """SELECT c_custkey, c_name FROM customer WHERE contains(c_custkey::VARCHAR, '91') OR contains(c_name, '91')
        OR contains(c_nationkey::VARCHAR, '91') OR contains(c_acctbal::VARCHAR, '91') OR contains(c_mktsegment, '91')""",
    "filter_grouped": """SELECT event_id, event_type, user_id FROM events WHERE (event_type = 'click' AND value > 40)
        OR (event_type = 'error' AND user_id <> 7)""",
    "filter_alias": f"""WITH {RECORDS} SELECT _Row, ip4 || ':443' AS "ClientIP", ukey AS "UserKey" FROM records
        WHERE k = 7 OR (value < 4 AND k = 42) OR user_id = 12""",
    "filter_partial_name": """SELECT event_id, CASE WHEN value > 10 THEN event_type END AS kind, event_type || '-' || user_id AS kind_detail
        FROM events WHERE event_type = 'click'""",
    "filter_tail": f"SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE {K} >= 90",
    "operation_is": "SELECT event_id, value FROM events WHERE event_type = 'purchase'",
    "value_selection": """SELECT p_partkey, p_type, p_brand FROM part WHERE lower(p_type) IN ('economy', 'promo')
        AND lower(p_brand) NOT IN ('brand#2', 'brand#17')""",
    "drop_blank_rows": "SELECT c_custkey AS _Row FROM customer WHERE c_acctbal > 0 OR c_mktsegment = 'BUILDING'",
    "broad_categories": f"""WITH {RECORDS} SELECT _Row, event_type = 'signup' AS logins, false AS teams, event_type = 'click' AS files,
        event_type = 'view' AS mail, event_type = 'purchase' AS inbox_rules, event_type = 'error' AS other FROM records""",
    "category_counts": f"""WITH {RECORDS} SELECT category, count(_Row) AS count FROM (SELECT unnest(['logon','inbox_rules',
        'transport_rules','mailbox_permissions','email_access','file_access','other']) AS category) c LEFT JOIN records ON kind = category
        GROUP BY category""",
    "operation_counts": f"""WITH {RECORDS} SELECT CASE WHEN op = '' THEN 'Unknown' ELSE op END AS name, count(*) AS count
        FROM records GROUP BY 1 ORDER BY count DESC, min(_Row) LIMIT 12""",
    "operation_facets": f"""WITH {RECORDS}, q AS (SELECT * FROM records WHERE ts >= TIMESTAMP '2024-01-03')
        SELECT 'all' AS facet, '' AS name, count(*) AS count FROM q UNION ALL
        SELECT 'operationTotal', '', count(*) FROM q WHERE event_type = 'view' UNION ALL
        SELECT 'category', c, count(_Row) FROM (SELECT unnest(['logon','inbox_rules','transport_rules','mailbox_permissions',
          'email_access','file_access','other']) AS c) LEFT JOIN q ON kind = c GROUP BY c UNION ALL
        SELECT 'operation', op, count(*) FROM q WHERE event_type = 'view' GROUP BY op""",
    "value_facets": """SELECT p_name AS value, p_name AS label, count(*) AS count FROM part WHERE contains(lower(p_name), 'b')
        GROUP BY p_name ORDER BY count DESC, lower(p_name), p_name LIMIT 40 OFFSET 5""",
    "value_facet_totals": """SELECT count(*) AS "totalUnique", count(*) FILTER (contains(lower(p_name), 'b')) AS "matchingUnique",
        sum(n)::BIGINT AS "matchingRows", count(*) FILTER (contains(lower(p_name), 'b')) > 15 AS "hasMore"
        FROM (SELECT p_name, count(*) AS n FROM part GROUP BY p_name)""",
    "review_metrics": f"""WITH {RECORDS} SELECT 'rows' AS metric, count(*) AS value FROM records UNION ALL
        SELECT 'users', count(DISTINCT lower(coalesce(uid, ukey))) FROM records UNION ALL
        SELECT 'ips', count(DISTINCT ip) FROM (SELECT ip4 AS ip FROM records UNION ALL SELECT ip6 FROM records) UNION ALL
        SELECT 'messageIds', count(DISTINCT i) FROM (SELECT 'm' || k || '@x.org' AS i FROM records UNION ALL
          SELECT '<m' || user_id || '@x.org>' FROM records) UNION ALL
        SELECT 'tagged', count(tag) FROM records UNION ALL
        SELECT 'columns', 9 + (count(uid) > 0)::INT + (count(ip6) > 0)::INT + (count(tag) > 0)::INT - 1 FROM records""",
    "trace_metrics": f"""WITH {RECORDS} SELECT 'rows' AS metric, count(*) AS value FROM records UNION ALL
        SELECT 'senders', count(DISTINCT lower(ukey)) FROM records UNION ALL
        SELECT 'recipients', count(DISTINCT lower(uid)) FROM records UNION ALL
        SELECT 'ips', count(DISTINCT ip) FROM (SELECT ip4 AS ip FROM records UNION ALL SELECT ip6 FROM records) UNION ALL
        SELECT 'tagged', count(tag) FROM records UNION ALL
        SELECT 'columns', 3 + (count(uid) > 0)::INT + (count(ip6) > 0)::INT + (count(tag) > 0)::INT FROM records""",
    "populated_profile": """SELECT c AS "column", CASE WHEN c = 'empty' THEN 0 ELSE n END AS populated FROM
        (SELECT unnest(['event_id','ts','user_id','event_type','value','props','k','empty']) AS c), (SELECT count(*) AS n FROM events)""",
    "distinct_ips": f"WITH {RECORDS} SELECT DISTINCT ip FROM (SELECT ip4 AS ip FROM records UNION ALL SELECT ip6 FROM records WHERE ip6 IS NOT NULL)",
    "email_domain_list": f"WITH {DOMAINS} SELECT DISTINCT unnest(domains) AS domain FROM domains",
    "message_id_list": f"""WITH {RECORDS} SELECT DISTINCT i AS message_id FROM (SELECT '<m' || k || '@x.org>' AS i FROM records UNION ALL
        SELECT '<m' || user_id || '@x.org>' FROM records)""",
    "case_rollup": """SELECT c_nationkey AS "caseId", sum(n)::BIGINT AS "rowCount", count(*) AS "datasetCount" FROM
        (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
    "enrich_left": f"""WITH {RECORDS}, {IPREF} SELECT _Row, CASE WHEN op <> '' THEN ip4 || ':443' END AS "ClientIP",
        """ + ", ".join(f"""CASE WHEN op <> '' THEN coalesce({e}, '') END AS "ClientIP_IPAPI_{a}" """ for a, e in (
            ("Country", "country"), ("Region", "region"), ("City", "city"), ("ISP", "isp"), ("AS", "NULL"), ("Mobile", "NULL"),
            ("Proxy_VPN_TOR", "CASE WHEN proxy THEN 'True' WHEN NOT proxy THEN 'False' END"),
            ("Hosting", "CASE WHEN hosting THEN 'True' WHEN NOT hosting THEN 'False' END"), ("IP_Class", "NULL"),
            ("Lookup_Status", "status"), ("Error", "NULL"))) + "FROM records LEFT JOIN ipref ON ip4 = ip",
    "pending_lookups": f"""WITH {RECORDS}, {IPREF} SELECT DISTINCT ip4 AS ip FROM records
        WHERE ip4 NOT IN (SELECT ip FROM ipref WHERE status <> 'Failed' AND provider = 'service')""",
    "local_lookups": f"""WITH {RECORDS}, ips AS (SELECT DISTINCT ip FROM (SELECT (k + 100)::VARCHAR || '.64.0.1' AS ip FROM records UNION ALL
          SELECT (k + 100)::VARCHAR || '.254.0.1' FROM records UNION ALL SELECT ip6 FROM records WHERE ip6 IS NOT NULL)),
        classed AS (SELECT ip, CASE WHEN ip LIKE '127.%' THEN 'Loopback' WHEN ip LIKE '169.254.%' THEN 'Link-local'
          WHEN ip LIKE '%:%' THEN 'Private' WHEN ip LIKE '100.64.%' THEN 'Public' END AS c FROM ips)
        SELECT ip, c AS "IP_Class", 'Skipped (non-public)' AS "Lookup_Status", 'Local' AS "Provider" FROM classed WHERE c IS NOT NULL""",
    "lookup_plan": f"""SELECT DISTINCT ({K} + 1)::VARCHAR || '.8.4.4' AS ip FROM events WHERE {K} + 1 <> 10""",
    "reference_upsert": f"""WITH {IPREF}, fresh AS (SELECT '198.51.100.' || (c_nationkey + 10) AS ip, 'Fresh ' || count(*) AS country
        FROM customer GROUP BY c_nationkey) SELECT ip, country AS "Country", NULL::VARCHAR AS "ISP" FROM fresh UNION ALL
        SELECT ip, country, isp FROM ipref WHERE ip NOT IN (SELECT ip FROM fresh)""",
    "app_names": """SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN coalesce(n_name,
        'Not listed in Microsoft first-party reference') END AS app FROM customer LEFT JOIN nation ON c_nationkey + 5 = n_nationkey""",
    "app_totals": """SELECT count(*) AS "mappedRows", count(n_name) AS known, count(*) - count(n_name) AS unlisted
        FROM customer LEFT JOIN nation ON c_nationkey + 5 = n_nationkey WHERE c_mktsegment <> 'BUILDING'""",
    "domain_attributes": f"""WITH {DOMAINS}, {DOMREF},
        x AS (SELECT doc_id, i, domref.* FROM (SELECT doc_id, unnest(domains) AS d, generate_subscripts(domains, 1) AS i FROM domains)
              JOIN domref ON d = domain),
        u AS (SELECT doc_id, list(domain ORDER BY i) AS a, list(registrar ORDER BY i) AS b, list(born_text ORDER BY i) AS c,
                list(status ORDER BY i) AS s FROM x GROUP BY doc_id)
        SELECT d.doc_id AS _Row, """ + ", ".join(
            f"""coalesce(array_to_string(list_filter({c}, lambda v, i: list_position({c}, v) = i), '; '), '') AS "SenderAddress_WHOIS_{n}" """
            for c, n in (("a", "Domain"), ("b", "Registrar"), ("c", "RegistrationDate"), ("s", "Lookup_Status"))) + """,
        '' AS "SenderAddress_WHOIS_DNSSEC" FROM documents d LEFT JOIN u ON d.doc_id = u.doc_id""",
    "pending_domains": f"""WITH {DOMAINS}, {DOMREF} SELECT DISTINCT d AS "Domain" FROM (SELECT unnest(domains) AS d FROM domains)
        WHERE d NOT IN (SELECT domain FROM domref WHERE status <> 'Failed')""",
    "service_domains": r"""WITH hosts AS (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS host FROM pages),
        listed AS (SELECT service, count(*) AS position FROM (SELECT regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS service FROM hosts)
                   GROUP BY 1)
        SELECT page_id, host, arg_min(service, position) AS service FROM hosts LEFT JOIN listed
          ON host = service OR ends_with(host, '.' || service) GROUP BY page_id, host""",
    "ip_classes": f"WITH {QUADS} SELECT doc_id, pos, raw, ip, {IP_CLASS} AS ip_class, {IS_GLOBAL} AS is_global FROM ips",
    "network_match": f"""WITH {QUADS}, nets AS (
          SELECT (n_nationkey * 9 + 10)::BIGINT * 16777216 AS lo, (n_nationkey * 9 + 10)::BIGINT * 16777216 + 16777215 AS hi,
                 n_name AS label, n_nationkey AS place FROM nation UNION ALL
          SELECT n_regionkey::BIGINT * 32 * 16777216, n_regionkey::BIGINT * 32 * 16777216 + 268435455, min(n_name), n_regionkey + 100
          FROM nation GROUP BY n_regionkey)
        SELECT doc_id, pos, ip, (SELECT arg_min(label, place) FROM nets WHERE n BETWEEN lo AND hi) AS network FROM ips""",
    "findings_join": f"""WITH l AS (SELECT event_id AS _Row, user_id::VARCHAR AS "UserId" FROM events), f AS ({travel(12, 3, 24, True)})
        SELECT l.*, f."Risk" AS risk, f."Score" AS score FROM l LEFT JOIN f USING (_Row)""",
    "tag_rows": f"WITH {TAGS} SELECT _Row FROM tags UNION SELECT _Row FROM asked",
    "untag_rows": f"WITH {TAGS} SELECT _Row FROM tags EXCEPT SELECT _Row FROM asked",
    "tag_change": f"""WITH {TAGS} SELECT (SELECT count(*) FROM asked) AS matched,
        (SELECT count(*) FROM asked WHERE _Row NOT IN (SELECT _Row FROM tags)) AS changed,
        (SELECT count(*) FROM (SELECT _Row FROM tags UNION SELECT _Row FROM asked)) AS "taggedCount" """,
    "tagged_review": """SELECT event_id AS _Row, user_id::VARCHAR AS "UserId", 'Of interest' AS tag FROM events WHERE value > 10""",
    "narrative_activity": f"""WITH {RECORDS}, {IPREF}, j AS (SELECT * FROM records LEFT JOIN ipref ON ip4 = ip)
        SELECT _Row, CASE WHEN value > 2 THEN CASE WHEN op = '' THEN 'Audit event' ELSE op END || ': ' || concat_ws('; ',
          coalesce(uid, ukey), 'from IP ' || ip4, 'geo-location ' || country || ', ' || region || ', ' || city, 'ISP ' || isp,
          CASE WHEN proxy THEN 'VPN/Proxy/TOR' END, CASE WHEN hosting THEN 'Hosting' END,
          CASE event_type WHEN 'signup' THEN NULL WHEN 'purchase' THEN 'rule Rule ' || ukey
            WHEN 'click' THEN 'item ' || ukey || '.txt'
            WHEN 'view' THEN 'subject Order view; message ID m' || k || '@x.org; <m' || user_id || '@x.org>'
            ELSE 'object object-1' END,
          CASE WHEN load <> '' AND event_type <> 'signup' THEN 'workload ' || load END,
          CASE WHEN event_type <> 'signup' THEN 'result Succeeded' END) || '.' END AS "Event" FROM j""",
    "narrative_trace": f"""SELECT doc_id, 'Subject: ' || {short('text')} || '; Sender: ' || {short('source')} || '; Recipient: ' ||
        {short('lang')} AS "Event" FROM documents""",
    "reviewed_page": f"""WITH f AS ({travel(12, 3, 24, True)}), j AS (
        SELECT event_id AS _Row, user_id::VARCHAR AS "UserId", f."Score" AS score, n_name AS "ClientIP_IPAPI_Country",
          value > 10 AS tagged FROM events JOIN f ON event_id = f._Row LEFT JOIN nation ON {K} % 25 = n_nationkey WHERE f."Risk" = 'High')
        SELECT _Row, "UserId", score, "ClientIP_IPAPI_Country", _Row AS "__RowId", tagged AS "__Tagged" FROM j
        ORDER BY score DESC, _Row LIMIT 40 OFFSET 40""",
    "flatten_props": """SELECT event_id AS _Row, event_type AS "Operation", CASE WHEN value >= 2 THEN user_id::VARCHAR END AS actor,
        CASE WHEN value < 2 THEN 'AuditData is not valid JSON' END AS "_ParseError",
        CASE WHEN value >= 2 THEN 'inner' END AS "AuditData_Operation",
        CASE WHEN value >= 2 THEN json_extract_string(props, '$.k') END AS "Actor_Props_k",
        CASE WHEN value >= 2 THEN '["a",{"b":1}]' END AS "Tags", CASE WHEN value >= 2 THEN '' END AS "Gone",
        (CASE WHEN value >= 2 THEN 4 ELSE 0 END)::BIGINT AS leaves FROM events""",
    "named_properties": f"WITH {RULES} SELECT _Row, o_orderstatus AS name, cust AS sender, 4::BIGINT AS names FROM rules",
    "rule_details": f"""WITH {RULES} SELECT _Row, CASE WHEN is_rule THEN o_orderstatus END AS name, CASE WHEN is_rule THEN cust END AS "from",
        CASE WHEN is_rule THEN o_orderpriority END AS movetofolder,
        CASE WHEN is_rule THEN 'NAME=' || o_orderstatus || '; From=' || cust END AS details FROM rules""",
    "login_details": f"""SELECT event_id AS _Row, CASE WHEN event_type <> 'view' THEN event_type END AS os,
        CASE WHEN event_type <> 'view' THEN nullif({graded(3, 6)}, '') END AS iscompliant,
        CASE WHEN event_type <> 'view' THEN props END AS requesttype FROM events""",
    "mail_details": """SELECT event_id AS _Row, CASE WHEN event_type = 'view' THEN CASE WHEN value > 8 THEN
        'Client=REST;UserAgent=Agent/' || user_id || ' x' WHEN value > 4 THEN 'Client=OWA' END END AS actorinfostring,
        CASE WHEN event_type = 'view' THEN CASE WHEN value > 8 THEN 'Agent/' || user_id || ' x' WHEN value > 4 THEN 'Client=OWA'
          ELSE 'Reported' END END AS useragent, NULL::VARCHAR AS clientinfostring FROM events""",
    "message_ids": r"""WITH m AS (SELECT doc_id, list_transform(regexp_extract_all(text, '<?([^<>\s]+@[^<>\s]+)>?', 1),
          lambda x: '<' || x || '>') AS l FROM documents)
        SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '; ') AS "InternetMessageIDs" FROM m""",
    "normalized_message_ids": f"""SELECT event_id AS _Row, '<m' || {K} || '@x.org>; <m' || user_id || '@x.org>' AS "InternetMessageIDs" FROM events""",
    "message_pairs": f"WITH {TURNS} SELECT _Row, position::BIGINT AS position, message_id, subject, size FROM pairs",
    "message_subjects": f"""WITH {TURNS} SELECT _Row, string_agg(message_id, '; ' ORDER BY position) AS "InternetMessageIDs",
        string_agg(CASE WHEN subject = '' THEN '(no subject)' ELSE subject END, '; ' ORDER BY position) AS "Subjects",
        string_agg(CASE WHEN size = '' THEN '(not recorded)' ELSE size END, '; ' ORDER BY position) AS "SizeInBytes",
        string_agg(message_id || ' → ' || CASE WHEN subject = '' THEN '(no subject)' ELSE subject END, chr(10) ORDER BY position) AS "Pairs"
        FROM pairs GROUP BY _Row""",
    "pairs_dedup": f"""WITH {TURNS} SELECT arg_min(message_id, _Row * 10 + position) AS "InternetMessageId",
        coalesce(arg_min(subject, _Row * 10 + position) FILTER (subject <> ''), '') AS "Subject",
        coalesce(arg_min(size, _Row * 10 + position) FILTER (size <> ''), '') AS "SizeInBytes" FROM pairs GROUP BY lower(message_id)""",
    "pair_totals": f"""WITH {TURNS} SELECT (SELECT count(*) FROM (SELECT DISTINCT message_id, subject FROM pairs)) AS "pairCount",
        (SELECT count(DISTINCT _Row) FROM pairs) AS "rowCount" """,
    "unpaired_ids": f"WITH {TURNS} SELECT _Row, message_id FROM pairs WHERE position = 2",
    "trace_headers": """SELECT o_orderkey AS _Row, CASE WHEN o_orderstatus = 'F' THEN o_orderstatus ELSE o_orderpriority END AS "SenderAddress",
        strftime(o_orderdate, '%Y-%m-%d') AS "Received", o_orderstatus AS original FROM orders""",
    "clean_table": r"""SELECT doc_id::VARCHAR AS id, regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') AS body, lang AS "Tag",
        CASE WHEN lang = 'en' THEN source ELSE '' END AS tag_2 FROM documents""",
    "populated_view": f"""WITH {RECORDS} SELECT _Row, ts AS "CreationTime", op AS "Operation", tag, uid AS "UserId",
        ukey AS "UserKey", ip4 || ':443' AS "ClientIP", load AS "Workload", event_type AS "RecordType", _Row AS "__RowId",
        tag IS NOT NULL AS "__Tagged" FROM records WHERE event_type = 'view'""",
    "domain_registration": """SELECT lower(n_name) AS "Domain", lower(n_name) || '.com' AS "RegisteredDomain",
        CASE WHEN n_regionkey = 1 THEN 'Reg ' || c_custkey WHEN n_regionkey < 3 THEN 'Org, Unit' ELSE 'H' || c_custkey END AS "Registrar",
        '19' || lpad(c_custkey::VARCHAR, 2, '0') || '-01-01T00:00:00Z' AS "RegistrationDate", '' AS "ExpirationDate",
        '' AS "LastChangedDate", 'active; ' || c_custkey AS "Status", 'ns1.x; ns2.x' AS "NameServers",
        CASE WHEN n_regionkey = 0 THEN 'Signed' ELSE 'Unsigned' END AS "DNSSEC", 'Success' AS "Lookup_Status", 'RDAP' AS "Provider",
        '' AS "Error" FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "text_renderings": f"""SELECT doc_id, CASE WHEN lang = 'en' OR trim(source) = '' THEN {short('text')} ELSE source END AS shown,
        {short('text', 40)} AS short, CASE WHEN lang = 'en' THEN '  ' ELSE source END AS as_text FROM documents""",
    "word_readings": """SELECT c_custkey, n_regionkey IN (0, 2) AS is_true, n_regionkey IN (1, 4) AS is_false,
        CASE WHEN n_regionkey = 0 THEN 'unitedstates' ELSE regexp_replace(lower(n_name), '[^a-z]', '', 'g') END AS country,
        regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') AS compact FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "parsed_times": f"WITH {TIME_TEXTS} SELECT _Row, us AS micros, coalesce(us, slashed) AS sort_micros FROM texts",
    "sort_time": positions(TIME_TEXTS, "CASE WHEN trim(t) = '' THEN 2 WHEN coalesce(us, slashed) IS NULL THEN 1 ELSE 0 END, coalesce(us, slashed) DESC, CASE WHEN coalesce(us, slashed) IS NULL THEN t END DESC, _Row"),
    "sort_number": positions("""texts AS (SELECT o_orderkey AS _Row, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority || '?'
        WHEN o_orderpriority = '5-LOW' THEN '' END AS t, o_totalprice::DECIMAL(12, 2) AS n FROM orders)""",
                             "CASE WHEN t IS NULL THEN 0 WHEN t = '' THEN 2 ELSE 1 END, CASE WHEN t IS NULL THEN n END, t, _Row"),
    "sort_risk": positions("""texts AS (SELECT o_orderkey AS _Row, CASE WHEN o_orderstatus = 'P' THEN '' ELSE lower(string_split(o_orderpriority, '-')[2]) END AS t
        FROM orders)""", """t = '', CASE t WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 0 END DESC,
        CASE WHEN t IN ('low', 'medium', 'high') THEN '' ELSE t END DESC, _Row"""),
    "page_rows": f"""WITH {TIME_TEXTS} SELECT _Row, t AS registered FROM texts ORDER BY CASE WHEN trim(t) = '' THEN 2
        WHEN coalesce(us, slashed) IS NULL THEN 1 ELSE 0 END, coalesce(us, slashed), CASE WHEN coalesce(us, slashed) IS NULL THEN t END, _Row LIMIT 25 OFFSET 50""",
    "top_orders": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "row_ordinals": "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS ordinal FROM events",
    "previous_event": "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events",
    "first_event": """SELECT user_id, event_type, event_id FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""",
    "target_check": f"""WITH {TARGETS} SELECT o_orderkey, mailbox AS "MailboxOwnerUPN", mid AS "InternetMessageId", problem FROM targets""",
    "target_split": """SELECT p_partkey, p_brand || '@x.org' AS "MailboxOwnerUPN", unnest([p_name, p_type]) AS "InternetMessageId" FROM part""",
    "target_dedup": f"""WITH {TARGETS} SELECT mailbox AS "MailboxOwnerUPN", mid AS "InternetMessageId" FROM uniq""",
    "collection_report": f"WITH {TARGETS} SELECT * FROM report",
    "collection_rollup": f"""WITH {TARGETS} SELECT (SELECT count(*) FROM uniq) AS requested,
        count(*) FILTER ("Status" = 'Collected') AS collected, count(*) FILTER ("Status" = 'Not found') AS "notFound",
        count(*) FILTER ("Status" = 'Error') AS errors FROM report""",
}
