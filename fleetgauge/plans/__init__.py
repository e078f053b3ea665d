from fleetgauge.plans import (  # noqa: F401
    capacity_queries,
    catalog_queries,
    cost_queries,
    model_queries,
    resilience_queries,
    traffic_queries,
    user_queries,
)
from fleetgauge.plans.registry import all_queries, all_sql

__all__ = ["all_queries", "all_sql"]
