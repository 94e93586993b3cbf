"""Job options. Durations are plain ``datetime.timedelta`` arguments; no
operator reads the wall clock, so every run replays identically."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

# Fixed values that must equal the service being re-expressed.
DEFAULT_BATCH_SIZE = 16383
DEFAULT_BATCH_LINGER = timedelta(hours=1)
DEFAULT_FLUSH_INTERVAL = timedelta(hours=1)
POLL_TICK = timedelta(hours=1)
POLL_LOOK_BACK = timedelta(hours=48)
POLL_MIN_AGE = timedelta(hours=12)
JOB_TTL = timedelta(days=14)
MAX_RECEIVE_COUNT = 3
DEFAULT_MAX_WORKERS = 1
DEFAULT_AMORTIZATION = 1.0
MONITOR_TICK = timedelta(seconds=30)


@dataclass(frozen=True)
class BatchOptions:
    size: int = DEFAULT_BATCH_SIZE
    linger: timedelta = DEFAULT_BATCH_LINGER
    flush: timedelta = DEFAULT_FLUSH_INTERVAL


@dataclass(frozen=True)
class PollOptions:
    now: datetime
    min_age: timedelta = POLL_MIN_AGE
    look_back: timedelta = POLL_LOOK_BACK
    limit: int = DEFAULT_BATCH_SIZE
    tie_safe: bool = False


@dataclass(frozen=True)
class CapacityOptions:
    max_workers: int = DEFAULT_MAX_WORKERS
    amortization: float = DEFAULT_AMORTIZATION
