import compare
import pytest

from loomslice.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, sf, name):
    assert compare.same(queries.QUERIES[name](spark, sf), compare.duck(sf), queries.ORACLE[name]) == ""
