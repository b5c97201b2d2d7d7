"""Every catalogue query that has SQL gives the rows that DuckDB gives."""

from pathlib import Path

import duckdb
import pytest

from loomgraph import catalog
from tests.conftest import SMALL, rows

QUERIES, SQL = catalog.load()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SMALL).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SMALL).count() >= 0


def test_rules_by_lens_counts_all_findings(spark, tmp_path):
    for f in Path(SMALL).glob("*.parquet"):
        (tmp_path / f.name).symlink_to(f)
    (tmp_path / "customer.parquet").unlink()
    con = duckdb.connect()
    con.execute(f"""copy (select c.* replace (c_custkey + 1000000 * k as c_custkey, case when k > 0 then -1 else c_acctbal end as c_acctbal)
        from '{SMALL}/customer.parquet' c, range(110000 // (select count(*) from '{SMALL}/customer.parquet') + 1) r(k)) to '{tmp_path}/customer.parquet'""")
    for f in tmp_path.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    got, want = QUERIES["rules_by_lens"](spark, str(tmp_path)).toPandas(), con.execute(SQL["rules_by_lens"]).df()
    assert want["n"].sum() > 100_000
    assert rows(got) == rows(want)
