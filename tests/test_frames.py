"""Window frames that Spark would work out anew for each row."""

import pytest

from evidentia.plans import load


@pytest.mark.parametrize("name", ["nearest_label"])
def test_no_frame_to_the_last_row(spark, name):
    plan = load().QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan
