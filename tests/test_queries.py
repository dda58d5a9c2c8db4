"""A cross-section of the registered queries against their SQL twins.

``tools/check_queries.py`` runs all of them.
"""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check_queries  # noqa: E402
from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from weirgauge.plans.registry import QUERIES  # noqa: E402
from weirgauge.testing.oracles import ORACLES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")

SELECTED = [
    "classify_datagrams", "decode_flows", "template_history", "flow_history", "scalar_functions", "assign_windows",
    "window_metrics", "top_talkers", "source_port_fanout", "apply_cooldown", "query_alerts_defaults", "metric_samples",
    "log_rate",
]


@pytest.mark.parametrize("name", SELECTED)
def test_same_as_sql(spark, name):
    good, note = check_queries.compare(spark, check_queries.connect(FOLDER), FOLDER, name)
    assert good, note


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
