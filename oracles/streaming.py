"""Oracles of the drained streams."""

from oracles.common import MARKET
from oracles.detection import ORACLES as DETECTION
from oracles.detection import cents

ORACLES = {
    # Minutes the watermark (newest tick less 45 seconds) has passed.
    "stream_net_flow": f"""WITH {MARKET}
      SELECT ts_ns // 60000000000 * 60000000 AS minute_us,
             {cents("sum(CASE event_type WHEN 'click' THEN value * volume WHEN 'purchase' THEN -(value * volume) ELSE 0 END)", 'net_flow')},
             count(*) AS n
      FROM clocked GROUP BY ts_ns // 60000000000
      HAVING (ts_ns // 60000000000 + 1) * 60000000000 <= (SELECT max(ts_ns) FROM clocked) - 45000000000""",
    "stream_detect": DETECTION["detect_flow"],
}
