import re

import pytest

from larkfield.llm import registry


@pytest.mark.parametrize("name", ["op1_secret_scan", "op3_mix_sources", "op4_line_quality", "op7_tool_chat", "op10_url_filter"])
def test_no_python_in_native_plans(spark, sf, name):
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct", plan)
    assert "n_chars" not in plan and "props" not in plan
