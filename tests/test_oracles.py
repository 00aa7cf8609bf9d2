import pytest

from queries import registry
from tests.helpers import SF, same_as_oracle

ORACLE = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    same_as_oracle(spark, registry.queries()[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(ORACLE)))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() >= 0
