import importlib.util
import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def entry():
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("spark_entry", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_flagship(spark, entry):
    assert entry.entry(spark).count() > 0


#: Queries that SQL cannot express: learned, searched and sampled results. Their tests compare them with definitions.
WITHOUT_SQL = {
    "op2_license_scan", "op4_nearest_neighbours", "op5_toxicity", "op6_suffix_dedup", "op7_mixing", "op8_quality",
    "op9_vector_dedup", "op10_sampled_pieces", "op13_sharding", "pipeline",
}


def test_every_query_has_sql(entry):
    assert set(entry.queries()) - set(entry.oracle_sql()) <= WITHOUT_SQL
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def db():
    from benchset.check import TABLES

    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


#: They clean or load whole reports, which their own tests do too; ``python -m benchset.check`` compares them with SQL.
WHOLE_LOADS = {"clean_report", "clean_rejects", "load_report", "run_history", "stream_ingest",
               "cleaned_sink", "reject_sink"}


def core_queries():
    from benchset.queries import QUERIES

    return sorted(set(QUERIES) - WHOLE_LOADS)


@pytest.mark.parametrize("name", core_queries())
def test_query_equals_sql(spark, entry, db, name):
    from benchset.check import rows_of

    found = entry.queries()[name](spark, SF)
    cursor = db.execute(entry.oracle_sql()[name])
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == rows_of([d[0] for d in cursor.description], cursor.fetchall())
