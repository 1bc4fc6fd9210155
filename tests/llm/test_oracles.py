"""The SQL twins of the text operators at a small scale."""

from pathlib import Path

import duckdb
import pytest

from pixelloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name, sf", [*((n, sf) for n in sorted(ORACLES) for sf in ("sf0.001", "sf0.01")), ("op10_quality_rules", "sf0.1")])
def test_twin(spark, name, sf):
    folder = f"/root/testdata/{sf}"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        path = Path(folder, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path / '*.parquet' if path.is_dir() else path}')")
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    got = QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(cursor.fetchall())


def test_cutoffs_bind(spark):
    """The larger twin compares more than the base rule."""
    assert QUERIES["op10_quality_rules"](spark, "/root/testdata/sf0.1").where("not kept and not base_failed").count() > 300
