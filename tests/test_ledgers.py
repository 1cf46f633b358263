"""Scans that stop, shards, snapshots and loops: what is read, what is bounded, what a stop leaves."""

import datetime
import io
import random
import tarfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillon.sources import ledgers


def test_scan_stops_at_the_quotas(spark, tmp_path):
    rng = random.Random(1)
    schema, rows = "id long, label string, ok boolean", []
    for n in range(40):
        some = [(n * 10 + i, rng.choice(["a", "a", "b", "x"] if n < 12 else ["a", "b", "c"]), rng.random() < 0.8) for i in range(10)]
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(str(tmp_path / f"{n:02d}"))
        rows += some
    files = [str(next((tmp_path / f"{n:02d}").glob("*.parquet"))) for n in range(40)]
    kind = spark.createDataFrame([], schema).schema

    def whole(quotas):
        out = {c: [r for r in rows if r[1] == c and r[2]][:q] for c, q in quotas.items()}
        return sorted(r for some in out.values() for r in some)

    for quotas, most in (({"a": 5, "b": 3}, 3), ({"a": 5, "c": 1}, 31), ({"a": 1, "never": 2}, 40), ({}, 0)):
        got, read = ledgers.scan_quotas(spark, files, kind, F.col("label"), quotas, usable=F.col("ok"))
        assert sorted((r.id, r.label, r.ok) for r in got.collect()) == whole(quotas)
        assert read == files[: len(read)] and len(read) <= most
        assert all(r["class"] == r.label for r in got.collect())


@pytest.mark.parametrize("limit", [1, 100, 1000, 10**6])
def test_shards_are_bounded(spark, limit):
    rng = random.Random(limit)
    files = [(f"f{i:04d}", rng.choice([0, 1, 7, 40, 90, rng.randrange(2000)])) for i in range(300)]
    got = ledgers.shard_numbers(spark.createDataFrame(files, "name string, bytes long"), limit).collect()
    assert sorted((r.name, r.bytes) for r in got) == files
    shards = {}
    for r in sorted(got, key=lambda r: r.name):
        shards.setdefault(r.shard, []).append(r.bytes)
    assert sorted(shards) == list(range(len(shards)))
    assert all(sum(s) <= limit or len(s) == 1 for s in shards.values())
    small = [s for s in shards.values() if max(s) <= limit // 2]
    assert len(small) <= 1 + sum(map(sum, small)) / max(1, limit // 2)


def test_archives(spark, tmp_path):
    files = [(f"a/{i:03d}.txt", bytes([i % 256]) * (i * 3 % 50)) for i in range(60)]
    frame, folder = spark.createDataFrame(files, "name string, content binary").repartition(4), str(tmp_path / "out")

    def read():
        found = {}
        for path in sorted(Path(folder).glob("*.tar")):
            with tarfile.open(path) as tar:
                members = {m.name: tar.extractfile(m).read() for m in tar.getmembers()}
            assert sum(map(len, members.values())) <= 200 and not found.keys() & members.keys()
            found |= members
        return found

    told = ledgers.tar_shards(frame, folder, 200).collect()
    assert read() == dict(files) and sum(r.files for r in told) == 60 and all(Path(r.path).exists() for r in told)
    assert not [p for p in Path(folder).iterdir() if p.name.startswith("_")]
    # a run that was stopped: what is there stays as it is, the rest is written
    kept, gone = told[0].path, told[1].path
    before = Path(kept).stat().st_mtime_ns
    Path(gone).unlink()
    ledgers.tar_shards(frame, folder, 200).collect()
    assert Path(kept).stat().st_mtime_ns == before and read() == dict(files)
    with tarfile.open(fileobj=io.BytesIO(Path(gone).read_bytes())) as tar:
        assert len(tar.getmembers()) == told[1].files


def test_snapshots(spark, tmp_path):
    folder, noon = str(tmp_path / "snap"), datetime.datetime(2026, 1, 1, 12)
    asked = []

    def compute():
        asked.append(1)
        return spark.createDataFrame([(len(asked),)], "n int")

    at = lambda minutes: ledgers.snapshot_or_compute(spark, folder, compute, noon + datetime.timedelta(minutes=minutes)).first().n
    assert ledgers.last_snapshot(spark, folder) is None
    assert at(0) == 1 and at(119) == 1 and at(120) == 2 and at(125) == 2
    # a publication that broke off before its manifest is never seen
    spark.createDataFrame([(99,)], "n int").write.parquet(f"{folder}/v-broken")
    (tmp_path / "snap" / "_v-broken.json").write_text('{"version": "v-broken"}')
    assert at(126) == 2 and ledgers.last_snapshot(spark, folder)[1] == noon + datetime.timedelta(minutes=120)
    ledgers.publish_snapshot(spark.createDataFrame([(7,)], "n int"), folder, noon + datetime.timedelta(minutes=130))
    assert at(131) == 7


def test_loop(spark, tmp_path):
    targets = spark.createDataFrame([("a", 25), ("b", 4), ("c", 0)], "label string, target int")
    asked = []

    def acquire(short, number):
        asked.append((number, {r.label: r.missing for r in short.collect()}))
        if len(asked) == 2 and not stopped:
            stopped.append(1)
            raise RuntimeError("stopped")
        return spark.createDataFrame([(f"{x}{number * 10 + i - 2}", x) for x in "abz" for i in range(10)], "key string, label string")

    stopped, folder = [], str(tmp_path / "ledger")
    with pytest.raises(RuntimeError):
        ledgers.close_shortfall(spark, folder, targets, acquire, "key")
    got, rounds = ledgers.close_shortfall(spark, folder, targets, acquire, "key")
    # a: 10 a round, 2 of which overlap none of the round before; b is at its target after the first
    assert asked == [(0, {"a": 25, "b": 4}), (1, {"a": 15}), (1, {"a": 15}), (2, {"a": 5})] and rounds == 3
    rows = got.collect()
    assert sum(r.label == "a" for r in rows) == 25 and sum(r.label == "b" for r in rows) == 4 and len({r.key for r in rows}) == 29
    assert ledgers.close_shortfall(spark, folder, targets, acquire, "key")[1] == 3 and len(asked) == 4
    # a source that brings nothing new ends it
    dry, rounds = ledgers.close_shortfall(spark, str(tmp_path / "dry"), targets, lambda short, n: spark.createDataFrame([("k", "a")], "key string, label string"), "key")
    assert rounds == 1 and dry.count() == 1
    none, rounds = ledgers.close_shortfall(spark, str(tmp_path / "none"), targets, lambda short, n: spark.createDataFrame([], "key string, label string"), "key")
    assert none is None and rounds == 0
