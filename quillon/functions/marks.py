"""Marks of where a request comes from: canonical forms and keyed hashes, as JVM expressions.

A mark tells several accounts on one device or network apart from several people, and
can't be turned back into an address without the key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a user agent holds, and the name it stands for; the first that is found counts.
SYSTEMS = (("Android", "Android"), ("iPhone|iPad|iPod", "iOS"), ("Windows", "Windows"), ("Mac OS X|Macintosh", "macOS"), ("CrOS", "ChromeOS"), ("Linux", "Linux"))
BROWSERS = (("Edg/", "Edge"), ("OPR/|Opera", "Opera"), ("Firefox/", "Firefox"), ("SamsungBrowser", "Samsung"), ("Chrome/", "Chrome"), ("Safari/", "Safari"))
#: A device's own identifier; marks as they are stored.
DEVICE_ID, STORED, AGENT = r"\A[A-Za-z0-9-]{8,64}\z", r"\A[A-Za-z0-9_-]{16,64}\z", r"\A[A-Za-z ]{1,40}\z"
BLOCK = 64


def _bytes(value) -> Column:
    return value if isinstance(value, Column) else F.lit(bytearray(value))


def hmac_sha256(key: str | bytes, message) -> Column:
    """HMAC-SHA-256 of a text or binary column under a key, as binary; null for a null message.

    The two padded keys are constants, so a row costs two digests in the JVM.
    """
    import hashlib

    raw = key.encode() if isinstance(key, str) else bytes(key)
    block = (hashlib.sha256(raw).digest() if len(raw) > BLOCK else raw).ljust(BLOCK, b"\0")
    inner, outer = (_bytes(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    body = F.col(message) if isinstance(message, str) else message
    return F.unhex(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, body.cast("binary")), 256))), 256))


def keyed_mark(key: str | bytes, kind: str, value, length: int = 22) -> Column:
    """The mark of a value: the first characters of the URL-safe Base64 of its keyed hash, the kind hashed with it."""
    coded = F.base64(hmac_sha256(key, F.concat(F.lit(f"{kind}:"), value)))
    return F.substring(F.rtrim(F.translate(coded, "+/", "-_"), F.lit("=")), 1, length)


def client_address(real, forwarded) -> Column:
    """The caller's address: the proxy's header if it is there (even if empty), else the first forwarded one; null if that is empty."""
    first = F.coalesce(real, F.get(F.split(forwarded, ","), F.lit(0)), F.lit(""))
    return F.nullif(F.regexp_replace(first, r"\A\s+|\s+\z", ""), F.lit(""))


def network(address) -> Column:
    """The /24 of an IPv4 address, the /48 of an IPv6 one with its zeros written out and its groups without leading ones."""
    ip = F.col(address) if isinstance(address, str) else address
    four = F.concat(F.array_join(F.slice(F.split(ip, r"\."), 1, 3), "."), F.lit(".0/24"))
    sides = F.split(ip, "::")
    groups = lambda side: F.when(F.coalesce(side, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(side, ":"))
    head, tail = groups(F.get(sides, F.lit(0))), groups(F.get(sides, F.lit(1)))
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(head) - F.size(tail)))
    full = F.when(F.contains(ip, F.lit("::")), F.concat(head, zeros, tail)).otherwise(head)
    plain = F.transform(F.slice(full, 1, 3), lambda g: F.regexp_replace(F.lower(g), "^0+(?=.)", ""))
    six = F.concat(F.array_join(plain, ":"), F.lit("::/48"))
    return F.when(F.contains(ip, F.lit(".")) & ~F.contains(ip, F.lit(":")), four).when(ip.isNotNull(), six)


def agent_family(agent) -> Column:
    """Browser and system of a user agent, as coarse as millions share: "Chrome Android"."""
    ua = F.col(agent) if isinstance(agent, str) else agent

    def first(names: Sequence[tuple[str, str]]) -> Column:
        out = F.lit("Other")
        for pattern, name in reversed(names):
            out = F.when(ua.rlike(pattern), name).otherwise(out)
        return out

    return F.when(ua.isNotNull(), F.concat_ws(" ", first(BROWSERS), first(SYSTEMS)))


def request_marks(key: str | bytes, device, real, forwarded, agent) -> Column:
    """The marks of a request, map of kind (device, ip, net, ua) to value; what can't be worked out is left out."""
    ip = client_address(real, forwarded)
    found = {
        "device": F.when(device.rlike(DEVICE_ID), keyed_mark(key, "device", device)),
        "ip": keyed_mark(key, "ip", ip),
        "net": keyed_mark(key, "net", network(ip)),
        "ua": F.when(agent != "", agent_family(agent)),
    }
    pairs = F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in found.items()))
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def well_formed(kind, value) -> Column:
    """Whether a mark that came in is one to store."""
    return F.coalesce(F.when(kind == "ua", value.rlike(AGENT)).otherwise(value.rlike(STORED)), F.lit(False))


def sightings(requests: DataFrame, who: str = "who", marks: str = "marks", at: str = "at", also: Mapping[str, Column] | None = None) -> DataFrame:
    """(who, kind, value, first_seen, last_seen, hits) of the well-formed marks of requests(who, marks map, at); without an account nothing is kept."""
    rows = requests.filter(F.col(who).isNotNull()).select(who, at, F.explode(marks).alias("kind", "value")).filter(well_formed(F.col("kind"), F.col("value")))
    more = [c.alias(n) for n, c in (also or {}).items()]
    return rows.groupBy(who, "kind", "value").agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count(F.lit(1)).alias("hits"), *more)
