"""What waits and how fast it goes: a bounded queue with priorities, and a limiter of calls to a provider."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable

from sedimark.errors import IndexingError

PRIORITIES = ("high", "normal", "low")


class JobQueue:
    """At most ``most`` jobs in order of priority, and of arrival within one. Safe between threads."""

    def __init__(self, most: int = 10_000):
        self.most, self._lock = most, threading.Lock()
        self._waiting: dict[str, deque] = {p: deque() for p in PRIORITIES}

    def __len__(self) -> int:
        return sum(map(len, self._waiting.values()))

    def put(self, job, priority: str = "normal") -> bool:
        """Whether there was room."""
        if priority not in self._waiting:
            raise IndexingError(f"no such priority: {priority}")
        with self._lock:
            if len(self) >= self.most:
                return False
            self._waiting[priority].append(job)
            return True

    def take(self):
        """The next job, None if there is none."""
        with self._lock:
            return next((q.popleft() for q in self._waiting.values() if q), None)

    def take_under_pressure(self, busy: Callable[[], bool], wait: float = 0.05, seconds: float = 30.0):
        """The next job as soon as what comes after isn't busy; None if there is none, or not in time. A full queue is drained like any other."""
        end = time.monotonic() + seconds
        while busy():
            if time.monotonic() >= end:
                return None
            time.sleep(wait)
        return self.take()


class RateLimiter:
    """At most ``at_once`` calls at a time and ``per_minute`` begun in any minute; ``clock`` and ``sleep`` may be replaced in tests."""

    def __init__(self, per_minute: int, at_once: int = 1, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep, window: float = 60.0):
        if per_minute < 1 or at_once < 1:
            raise IndexingError("a limiter lets one call through at least")
        self.per_minute, self.window, self._clock, self._sleep = per_minute, window, clock, sleep
        self._slots, self._lock, self._begun = threading.Semaphore(at_once), threading.Lock(), deque()

    def delay(self) -> float:
        """Seconds until the next call may begin."""
        now = self._clock()
        while self._begun and self._begun[0] <= now - self.window:
            self._begun.popleft()
        return self._begun[0] + self.window - now if len(self._begun) >= self.per_minute else 0.0

    def __enter__(self) -> RateLimiter:
        self._slots.acquire()
        with self._lock:
            while (d := self.delay()) > 0:
                self._sleep(d)
            self._begun.append(self._clock())
        return self

    def __exit__(self, *_) -> None:
        self._slots.release()
