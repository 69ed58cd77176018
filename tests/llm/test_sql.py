import pytest

from quillspark.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_its_sql(spark, name):
    assert difference(spark, connect(SF), SF, QUERIES[name], ORACLE_SQL[name]) is None


def test_every_operator_has_its_query():
    import re

    assert sorted(int(m[1]) for n in QUERIES if (m := re.match(r"op(\d+)_", n))) == list(range(1, 14)) and "pipeline" in QUERIES
