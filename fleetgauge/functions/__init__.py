from fleetgauge.functions.chunks import Chunks, exact_percentiles, latest_n, plan_chunks, prefix, runs
from fleetgauge.functions.common import cut, percent, ratio

__all__ = [
    "Chunks", "cut", "exact_percentiles", "latest_n", "percent", "plan_chunks", "prefix", "ratio", "runs",
]
