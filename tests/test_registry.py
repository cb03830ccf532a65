"""Every registered query against its SQL."""

import duckdb
import pytest

from brightloom.plans import registry
from tests.compare import differences

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    assert name in registry.ORACLE_SQL
    assert differences(spark, DATA, registry.QUERIES[name], registry.ORACLE_SQL[name]) == ""


@pytest.fixture(scope="module")
def edges(tmp_path_factory):
    """Events around the instants at which lifetimes end, with and without a kind, and events without a time."""
    path = tmp_path_factory.mktemp("edges")
    duckdb.sql("SELECT row_number() OVER () AS event_id, ts, event_type, 1.0::DOUBLE AS value FROM (VALUES ('click'), ('view'), ('purchase'), (NULL)) k(event_type), "
               "(SELECT NULL::TIMESTAMP AS ts UNION ALL SELECT day + to_microseconds(us) FROM (VALUES (TIMESTAMP '2024-01-05'), (TIMESTAMP '2024-01-10')) d(day), "
               "(VALUES (-1500000), (-500000), (-499999), (-1), (0), (1), (499999), (500000), (500001), (660043), (999999), (1000000), (1500000)) o(us))"
               ).write_parquet(str(path / "events.parquet"))
    return str(path)


@pytest.mark.parametrize("name", ["ttl_after_update", "ttl_visible"])
def test_lifetimes_at_their_end(spark, edges, name):
    assert differences(spark, edges, registry.QUERIES[name], registry.ORACLE_SQL[name]) == ""
