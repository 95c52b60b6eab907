"""Parent chains of any length."""

import pytest

from recallsmith.operators import sessions


def test_long_chains_are_whole_and_circles_raise(spark):
    chain = [(f"s{i}", f"s{i - 1}" if i else None) for i in range(27)]
    got = sessions.ancestors(spark.createDataFrame(chain, "id string, parent_session_id string")).collect()
    assert {(r["id"], r["ancestor"], r["depth"]) for r in got} == {(f"s{i}", f"s{i - k}", k) for i in range(27) for k in range(1, i + 1)}
    with pytest.raises(ValueError, match="ancestors"):
        sessions.ancestors(spark.createDataFrame([("a", "b"), ("b", "a")], "id string, parent_session_id string"), 3)
