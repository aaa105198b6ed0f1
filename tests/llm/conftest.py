import math

import duckdb
import pytest

from plumbline.llm.queries import ORACLES, QUERIES

TABLES = "documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


@pytest.fixture
def same_as_sql(spark, tmp_path):
    """Compare a registered query with its statement on the tables of a folder."""

    def run(name, sf_dir):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
        df = QUERIES[name](spark, sf_dir)
        rel = con.sql(ORACLES[name])
        assert sorted(df.columns) == sorted(rel.columns)
        cols = sorted(df.columns)
        got = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
        at = [rel.columns.index(c) for c in cols]
        want = sorted(str([plain(r[i]) for i in at]) for r in rel.fetchall())
        assert got == want
        return len(got)

    return run
