import pytest

from fathom.llm.queries import ORACLE, QUERIES
from tests.llm.helpers import same_as_oracle


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    assert same_as_oracle(spark, QUERIES[name], ORACLE[name])
