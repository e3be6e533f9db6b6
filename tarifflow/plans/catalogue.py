"""All registered queries."""

from . import (  # noqa: F401
    frontier_queries,
    log_queries,
    plan_queries,
    snapshot_queries,
    stream_queries,
    text_queries,
)
from .registry import ORACLES, QUERIES  # noqa: F401
