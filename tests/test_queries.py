"""Every registered query of the library against its DuckDB SQL."""

import pytest

from loamgrid.plans import registry
from tests.compare import oracle, rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_oracle(spark, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), oracle(registry.oracle_sql()[name], SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_session_replay_never_repeats_while_there_is_a_choice(spark):
    got = registry.queries()["session_replay"](spark, SF).toPandas()
    assert len(got) and not got[got["route"] == "fresh"].duplicated(["conv_id", "chunk_id"]).any()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
