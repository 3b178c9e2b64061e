"""Events and counters of runs."""

from __future__ import annotations

import json
import sys
import threading
import time
from collections import Counter
from collections.abc import Callable
from contextlib import contextmanager
from typing import TextIO


def json_lines(stream: TextIO | None = None) -> Callable[..., None]:
    """An emitter that writes each event as a line of JSON."""

    def emit(event: str, **fields) -> None:
        print(json.dumps({"event": event, "time": int(time.time() * 1000), **fields}, default=str), file=stream or sys.stderr, flush=True)

    return emit


def silent(event: str, **fields) -> None:
    """An emitter that drops events."""


class Metrics:
    """Counters and total seconds by name; safe between threads."""

    def __init__(self):
        self._lock, self._counts, self._seconds = threading.Lock(), Counter(), Counter()

    def count(self, name: str, n: int = 1) -> None:
        with self._lock:
            self._counts[name] += n

    @contextmanager
    def timed(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            with self._lock:
                self._counts[name] += 1
                self._seconds[name] += time.perf_counter() - began

    def rate(self, hits: str, misses: str) -> float:
        """The part of hits, 0 without any."""
        total = self._counts[hits] + self._counts[misses]
        return self._counts[hits] / total if total else 0.0

    def snapshot(self) -> dict[str, float]:
        with self._lock:
            return {**self._counts, **{f"{k}_seconds": v for k, v in self._seconds.items()}}
