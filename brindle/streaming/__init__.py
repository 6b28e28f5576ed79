from brindle.streaming.run import forget, read_stream, run_append, run_complete
from brindle.streaming.windows import hopping_counts, session_counts, tumbling_counts

__all__ = [
    "forget",
    "hopping_counts",
    "read_stream",
    "run_append",
    "run_complete",
    "session_counts",
    "tumbling_counts",
]
