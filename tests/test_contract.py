"""Registered queries against their SQL twins, as the driver compares them."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from vecforge.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple(None if x != x else x for x in r) for r in pdf.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in ORACLES:
        assert rows(got) == rows(duck.sql(ORACLES[name]).df())
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 500


@pytest.mark.parametrize("name", ["assign_training_meso", "assign_training_weighted", "training_seeds_meso", "training_seeds_weighted"])
def test_query_of_a_share_of_many_vectors(spark, tmp_path, name):
    """Half of 9000 vectors is more than 256 a cluster: the share holds all the same."""
    x = np.random.default_rng(9).standard_normal((9000, 64)).astype(np.float32)
    columns = {"vec_id": pa.array(np.arange(9000)), "embedding": pa.array(list(x), pa.list_(pa.float32())), "label": pa.array(np.arange(9000, dtype=np.int32) % 10)}
    pq.write_table(pa.table(columns), tmp_path / "embeddings.parquet")
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    assert rows(QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(c.sql(ORACLES[name]).df())
