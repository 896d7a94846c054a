"""All registered queries; importing this package fills the registry."""

from tradeloom.plans.registry import ORACLE, QUERIES  # noqa: F401
from tradeloom.plans import (  # noqa: F401, E402
    bar_queries,
    calibrate_queries,
    feature_queries,
    indicator_queries,
    rank_queries,
    resample_queries,
    signal_queries,
    source_queries,
    stat_queries,
    trade_queries,
)
