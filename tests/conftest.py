import os
import sys

import pytest
from moments import T0, moment

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from weirgauge.schema import FLOW_SCHEMA, WINDOW_METRICS_SCHEMA  # noqa: E402
from weirgauge.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 4, **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_flows(spark):
    """Flows from dicts; ``at`` is milliseconds after T0."""
    def make(*rows):
        filled = []
        for row in rows:
            base = dict(src_ip=1, dst_ip=2, src_port=1024, dst_port=80, protocol=6, packets=1, bytes=100,
                        start_time=0, end_time=0, tcp_flags=0, exporter_ip="127.0.0.1", at=1)
            base.update(row)
            ms = T0 + base.pop("at")
            base.update(received_at=moment(ms), received_at_ms=ms)
            filled.append(tuple(base[c] for c in FLOW_SCHEMA.fieldNames()))
        return spark.createDataFrame(filled, FLOW_SCHEMA)
    return make


@pytest.fixture(scope="session")
def make_metrics(spark):
    """Metrics rows from dicts, one tick apart in the order given."""
    def make(*rows):
        filled = []
        for place, row in enumerate(rows):
            base = dict(window_secs=10, flows=0, packets=0, bytes=0, flows_per_sec=0.0, packets_per_sec=0.0,
                        bytes_per_sec=0.0, unique_src_ips=0, unique_dst_ips=1, top_src_ips=[], top_dst_ips=[],
                        protocol_dist={}, tcp_flows=0, syn_only_flows=0, avg_flow_duration_ms=0,
                        tick=moment(T0 + 10_000 * place))
            base.update(row)
            filled.append(tuple(base[c] for c in WINDOW_METRICS_SCHEMA.fieldNames()))
        return spark.createDataFrame(filled, WINDOW_METRICS_SCHEMA)
    return make
