"""Marks of requests over the events: an event is a request, its headers made of its columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import marks
from quillon.plans.registry import query
from quillon.sources.tables import table

KEY = "a key for tests"
_PADS = ["".join(f"\\x{b ^ pad:02X}" for b in KEY.encode().ljust(64, b"\0")) for pad in (0x36, 0x5C)]
_MARK = "substr(rtrim(translate(base64(unhex(sha256('{1}'::BLOB || unhex(sha256('{0}'::BLOB || encode({{kind}} || ':' || {{value}})))))), '+/', '-_'), '='), 1, 22)".format(*_PADS)
_GROUPS = "CASE WHEN coalesce({0}, '') = '' THEN []::VARCHAR[] ELSE string_split({0}, ':') END"
REQUESTS = """h AS (SELECT event_id, user_id AS who, ts,
  CASE WHEN event_id % 5 > 0 THEN 'browser-' || (user_id % 40) || CASE WHEN event_id % 11 = 0 THEN ' x' ELSE '' END END AS device,
  CASE event_id % 4 WHEN 0 THEN '10.' || (user_id % 200) || '.' || (event_id % 3) || '.' || (event_id % 250)
   WHEN 1 THEN ' 2001:0DB8:00' || (user_id % 90 + 10) || ':0000::' || (event_id % 9) || ' ' WHEN 2 THEN '::ffff:' || (user_id % 7) END AS real,
  CASE WHEN event_id % 8 = 3 THEN 'FE80::' || (user_id % 5) || ':1, 10.0.0.1' WHEN event_id % 8 = 7 THEN '' END AS forwarded,
  CASE event_id % 6 WHEN 0 THEN 'Mozilla/5.0 (Linux; Android 14) Chrome/120.0 Safari/537.36' WHEN 1 THEN 'Mozilla/5.0 (iPhone; CPU) Safari/604.1' WHEN 2 THEN 'Mozilla/5.0 (Windows NT 10.0) Edg/120.0 Chrome/120.0'
   WHEN 3 THEN 'curl/8.0' WHEN 4 THEN '' END AS agent FROM events)"""
SQL = f"""WITH {REQUESTS}, a AS (SELECT *, nullif(trim(coalesce(real, string_split(forwarded, ',')[1], '')), '') AS ip FROM h),
 g AS (SELECT *, {_GROUPS.format("string_split(ip, '::')[1]")} AS x, {_GROUPS.format("string_split(ip, '::')[2]")} AS y FROM a),
 f AS (SELECT *, CASE WHEN contains(ip, '::') THEN list_concat(x, list_transform(range(8 - len(x) - len(y)), lambda i: '0'), y) ELSE x END AS parts FROM g),
 n AS (SELECT *, CASE WHEN contains(ip, '.') AND NOT contains(ip, ':') THEN array_to_string(string_split(ip, '.')[1:3], '.') || '.0/24'
   ELSE array_to_string(list_transform(parts[1:3], lambda p: coalesce(nullif(ltrim(lower(p), '0'), ''), '0')), ':') || '::/48' END AS net FROM f),
 m AS (SELECT who, ts, 'device' AS kind, {_MARK.format(kind="'device'", value="device")} AS value FROM n WHERE regexp_full_match(device, '[A-Za-z0-9-]{{8,64}}')
  UNION ALL SELECT who, ts, 'ip', {_MARK.format(kind="'ip'", value="ip")} FROM n WHERE ip IS NOT NULL
  UNION ALL SELECT who, ts, 'net', {_MARK.format(kind="'net'", value="net")} FROM n WHERE ip IS NOT NULL
  UNION ALL SELECT who, ts, 'ua', CASE WHEN contains(agent, 'Edg/') THEN 'Edge Windows' WHEN contains(agent, 'Android') THEN 'Chrome Android' WHEN contains(agent, 'iPhone') THEN 'Safari iOS' ELSE 'Other Other' END FROM n WHERE agent <> '')
 SELECT who, kind, value, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS hits FROM m GROUP BY ALL"""


@query("device_marks", SQL)
def device_marks(spark, d):
    """How often, first and last each account was seen with each mark."""
    e, who = table(spark, d, "events"), F.col("user_id")
    n = F.col("event_id")
    text = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    real = (
        F.when(n % 4 == 0, text("10.", who % 200, ".", n % 3, ".", n % 250))
        .when(n % 4 == 1, text(" 2001:0DB8:00", who % 90 + 10, ":0000::", n % 9, " "))
        .when(n % 4 == 2, text("::ffff:", who % 7))
    )
    forwarded = F.when(n % 8 == 3, text("FE80::", who % 5, ":1, 10.0.0.1")).when(n % 8 == 7, "")
    device = F.when(n % 5 > 0, text("browser-", who % 40, F.when(n % 11 == 0, " x").otherwise("")))
    agents = ["Mozilla/5.0 (Linux; Android 14) Chrome/120.0 Safari/537.36", "Mozilla/5.0 (iPhone; CPU) Safari/604.1", "Mozilla/5.0 (Windows NT 10.0) Edg/120.0 Chrome/120.0", "curl/8.0", ""]
    agent = F.get(F.array(*map(F.lit, agents)), (n % 6).cast("int"))
    requests = e.select(who.alias("who"), F.col("ts").alias("at"), marks.request_marks(KEY, device, real, forwarded, agent).alias("marks"))
    return marks.sightings(requests)
