"""Keyed hashes against the vectors of RFC 4231, addresses and agents by hand."""

import base64
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from quillon.functions import marks

#: (key, data, HMAC-SHA-256) of RFC 4231, test cases 1 to 4, 6 and 7.
VECTORS = [
    ("0b" * 20, b"Hi There".hex(), "b0344c61d8db38535ca8afceaf0bf12b881dc200c9833da726e9376c2e32cff7"),
    (b"Jefe".hex(), b"what do ya want for nothing?".hex(), "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"),
    ("aa" * 20, "dd" * 50, "773ea91e36800e46854db8ebd09181a72959098b3ef8c122d9635514ced565fe"),
    (bytes(range(1, 26)).hex(), "cd" * 50, "82558a389a443c0ea4cc819899f2083a85f0faa3e578f8077a2e3ff46729665b"),
    ("aa" * 131, b"Test Using Larger Than Block-Size Key - Hash Key First".hex(), "60e431591ee0b67f0d8a26aacbf5b77f8e0bc6213728c5140546040f0ee37f54"),
    ("aa" * 131, b"This is a test using a larger than block-size key and a larger than block-size data. The key needs to be hashed before being used by the HMAC algorithm.".hex(), "9b09ffa71b942fcb27635fbcd5b0e944bfdc63644f0713938a7f51535c3a35e2"),
]


@pytest.mark.parametrize("key,data,digest", VECTORS)
def test_hmac(spark, key, data, digest):
    got = spark.range(1).select(F.lower(F.hex(marks.hmac_sha256(bytes.fromhex(key), F.lit(bytearray.fromhex(data))))).alias("h")).first().h
    assert got == digest


NETWORKS = {
    "203.0.113.77": "203.0.113.0/24",
    "2001:db8:85a3::8a2e:370:7334": "2001:db8:85a3::/48",
    "2001:0DB8:0000:0042:0000:8a2e:0370:7334": "2001:db8:0::/48",
    "::1": "0:0:0::/48",
    "fe80::": "fe80:0:0::/48",
    "2001::a:b:c:d:e:f": "2001:0:a::/48",
    "::ffff:192.0.2.1": "0:0:0::/48",
    "1:2:3:4:5:6:7:8": "1:2:3::/48",
    "00ff:0:00:1::": "ff:0:0::/48",
}
AGENTS = {
    "Mozilla/5.0 (Linux; Android 14; SM-S918B) SamsungBrowser/23.0 Chrome/115.0 Mobile Safari/537.36": "Samsung Android",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) Version/17.0 Safari/605.1.15": "Safari macOS",
    "Mozilla/5.0 (iPad; CPU OS 17_0 like Mac OS X) Version/17.0 Safari/604.1": "Safari iOS",
    "Mozilla/5.0 (X11; CrOS x86_64) Chrome/120.0 Safari/537.36 OPR/106.0": "Opera ChromeOS",
    "Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Firefox/121.0": "Firefox Linux",
    "Mozilla/5.0 (Windows NT 10.0) Chrome/120.0 Safari/537.36 Edg/120.0": "Edge Windows",
    "curl/8.0": "Other Other",
}


def test_networks_and_agents(spark):
    got = spark.createDataFrame([(a,) for a in NETWORKS], "a string").select("a", marks.network("a").alias("n")).collect()
    assert {r.a: r.n for r in got} == NETWORKS
    got = spark.createDataFrame([(a,) for a in [*AGENTS, None]], "a string").select("a", marks.agent_family("a").alias("f")).collect()
    assert {r.a: r.f for r in got} == AGENTS | {None: None}


def test_marks_of_requests(spark):
    mark = lambda kind, value: base64.urlsafe_b64encode(hmac.new(b"salt", f"{kind}:{value}".encode(), hashlib.sha256).digest()).decode().rstrip("=")[:22]
    requests = [
        ("a", "1234abcd-x", " 203.0.113.77 ", "9.9.9.9", "curl/8.0", 1),
        ("a", "1234abcd-x", None, "203.0.113.78, 10.0.0.1", "", 2),
        ("b", "short", "", "9.9.9.9", None, 3),  # an empty header is one, and there is no address
        ("b", "with space x", None, None, "Safari/1 <script>", 4),
        ("b", "1234abcd-x\n", None, None, None, 5),
        (None, "1234abcd-x", "203.0.113.77", None, None, 6),
    ]
    columns = [F.col(c) for c in ("device", "real", "forwarded", "agent")]
    rows = spark.createDataFrame(requests, "who string, device string, real string, forwarded string, agent string, at int").select("who", "at", marks.request_marks("salt", *columns).alias("marks"))
    got = {(r.who, r.kind, r.value): (r.first_seen, r.last_seen, r.hits) for r in marks.sightings(rows).collect()}
    assert got == {
        ("a", "device", mark("device", "1234abcd-x")): (1, 2, 2),
        ("a", "ip", mark("ip", "203.0.113.77")): (1, 1, 1),
        ("a", "ip", mark("ip", "203.0.113.78")): (2, 2, 1),
        ("a", "net", mark("net", "203.0.113.0/24")): (1, 2, 2),
        ("a", "ua", "Other Other"): (1, 1, 1),
        ("b", "ua", "Safari Other"): (4, 4, 1),
    }
    kinds = spark.createDataFrame([("ua", "Safari <script>"), ("ua", "Chrome Android"), ("ip", "short"), ("ip", "x" * 16), ("net", None)], "k string, v string")
    assert [r[0] for r in kinds.select(marks.well_formed(F.col("k"), F.col("v"))).collect()] == [False, True, False, True, False]
