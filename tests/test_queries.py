import compare
import pytest

from loomslice.plans import catalog


@pytest.fixture(scope="module")
def duck(sf):
    return compare.duck(sf)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    if name in catalog.ORACLE:
        assert compare.same(df, duck, catalog.ORACLE[name]) == ""
    else:
        assert df.count() > 0


def test_flagship(spark, sf):
    assert catalog.flagship(spark, sf).count() == 71
