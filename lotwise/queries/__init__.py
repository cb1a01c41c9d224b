"""Queries of the library's own operators over the driver's tables."""

from lotwise.queries import closed, maps, models, policies, replays, traces  # noqa: F401
from lotwise.queries.registry import ORACLES, QUERIES  # noqa: F401
