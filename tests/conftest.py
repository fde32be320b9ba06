import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]


@pytest.fixture(scope="session")
def spark():
    from netloom.session import build_session

    session = build_session(
        "netloom-tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_packets(spark):
    """Packets from dicts; ``t`` is in seconds after 2024-01-01."""
    import datetime as dt

    from netloom.schemas import PACKET_SCHEMA

    start = dt.datetime(2024, 1, 1)

    def make(rows):
        data = []
        for i, r in enumerate(rows):
            base = dict(packet_id=i, ts=start + dt.timedelta(microseconds=round(r["t"] * 1e6)), protocol=6, ip_len=60, ttl=64,
                        fin=0, syn=0, rst=0, psh=0, ack=0, urg=0, sensor_id="s1")
            base.update({k: v for k, v in r.items() if k != "t"})
            data.append(tuple(base.get(f.name) for f in PACKET_SCHEMA))
        return spark.createDataFrame(data, PACKET_SCHEMA)

    return make
