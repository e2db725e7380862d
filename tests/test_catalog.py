"""Every query of the catalogue against its SQL."""

import pytest

from tests.compare import difference, oracle
from tidelog.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query(spark, con, name):
    assert difference(catalog.QUERIES[name](spark, SF), con, catalog.ORACLE[name]) is None


def test_checksum_is_crc32(spark):
    import zlib

    rows = catalog.package_crc(spark, SF).limit(3).collect()
    t = {r.trans_seq_no: f"{r.gtid}|{r.epoch}|{r.bytes}" for r in catalog.trx(spark, SF).collect()}
    assert all(r.checksum == zlib.crc32(t[r.trans_seq_no].encode()) for r in rows)
    assert spark.sql("select crc32('123456789')").first()[0] == 3421780262


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0 and set(e.oracle_sql()) <= set(e.queries())
