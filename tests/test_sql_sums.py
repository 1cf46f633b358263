"""Queries whose sums stand at a limit or tie, against their SQL on small tables of their own."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from quillon.operators import segment
from quillon.operators import segment
from quillon.plans import catalogue  # noqa: F401
from quillon.plans.registry import ORACLES, QUERIES


def both(spark, folder, name: str, **tables: dict) -> tuple[list, list]:
    """The sorted rows of the query and of its SQL over these tables."""
    con = duckdb.connect()
    for t, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    df = QUERIES[name](spark, str(folder))
    return sorted(tuple(r) for r in df.select(*want.columns).collect()), sorted(want.fetchall())


def test_gold_pick_orders_by_the_plain_average(spark, tmp_path):
    """Three discounts of 0.1 average to a little more than one, so the late clip comes before the twelfth early one."""
    clips = [*range(1, 13), 50, 50, 50]
    got, want = both(spark, tmp_path, "gold_pick", lineitem={"l_partkey": clips, "l_returnflag": ["A"] * len(clips), "l_discount": [0.1] * len(clips)})
    assert got == want
    assert [r[0] for r in got] == [*range(1, 12), 50]


def test_concat_neighbours_adds_up_as_the_sql():
    """1.6863 + 3.2137 + 0.1 from left to right is under five, so a third clip still comes in."""
    assert segment.group_neighbours([(0, 1.6863), (1, 3.2137), (2, 2.0)]) == [[0, 1, 2]]
    assert segment.group_neighbours([(0, 1.7), (1, 3.2), (2, 2.0)]) == [[0, 1]]
