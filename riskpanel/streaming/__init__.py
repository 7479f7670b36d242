"""Structured Streaming adapter.

The reference has no streaming operators (no watermarks, windows or state).
This package only lets the batch operators run on arriving files: each
micro-batch is handed to a batch function through ``foreachBatch`` with a
checkpointed, restartable query.
"""

from riskpanel.streaming.incremental import dedupe_arrivals, run_incremental  # noqa: F401
