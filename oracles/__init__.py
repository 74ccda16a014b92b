"""DuckDB statements the registered queries are checked against."""

from oracles import detection, evaluation, ingest, search, streaming

ORACLES: dict[str, str] = {**detection.ORACLES, **evaluation.ORACLES, **ingest.ORACLES, **search.ORACLES, **streaming.ORACLES}
