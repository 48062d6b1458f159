"""Named queries on the smallest data against their SQL, and that the others run."""

import pytest

from maskwright.catalog import load

REGISTRY = load()
SMALL = "/root/testdata/sf0.001"
# One query per operator family here; ``python tests/oracle.py`` checks all of them.
CHECKED = [n for n in REGISTRY if n.startswith(("e", "p", "d3", "d5", "d12", "a6", "a15", "a17", "a19", "a26", "m7", "m10", "m2_", "w1", "w2", "r1_", "r3", "r17", "r18", "r20", "r21", "x3"))]


def test_names():
    assert len(REGISTRY) > 150
    assert all(q.sql is None or q.sql.strip() for q in REGISTRY.values())


@pytest.mark.parametrize("name", [n for n in CHECKED if REGISTRY[n].sql])
def test_against_sql(spark, oracle_db, name):
    from oracle import check

    result, _, _ = check(spark, oracle_db, REGISTRY[name], SMALL)
    assert result.startswith("ok") and "TYPES" not in result, result


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 2
    assert set(entry.oracle_sql()) <= set(entry.queries())
