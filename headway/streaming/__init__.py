"""Structured Streaming forms of the event-shaped jobs."""

from headway.streaming.jobs import (  # noqa: F401
    run_now, stream_ask_rates, stream_feedback, stream_health, stream_intake, stream_queue_tick, stream_usage)
