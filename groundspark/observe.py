"""Counters, timings and traces of calls, without effect on their results."""

from __future__ import annotations

import re
import threading
import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

#: Upper ends of the timing classes in seconds.
BUCKETS = (0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, 30, 60, 120)


class Metrics:
    """Counts by name and outcome, and times by name, in the text form that scrapers read.  What is asked never becomes a label."""

    def __init__(self):
        self._lock, self.counts, self.times = threading.Lock(), {}, {}

    def count(self, name: str, outcome: str, n: int = 1) -> None:
        with self._lock:
            self.counts[name, outcome] = self.counts.get((name, outcome), 0) + n

    def time(self, name: str, seconds: float) -> None:
        with self._lock:
            hits, total = self.times.setdefault(name, ([0] * len(BUCKETS), [0, 0.0]))
            for i, end in enumerate(BUCKETS):
                hits[i] += seconds <= end
            total[0] += 1
            total[1] += seconds

    @contextmanager
    def span(self, name: str):
        """Times the block and counts how it ended, also when it raises."""
        start, outcome = time.perf_counter(), "error"
        try:
            yield
            outcome = "ok"
        finally:
            self.count(name, outcome)
            self.time(name, time.perf_counter() - start)

    def text(self) -> str:
        safe = lambda s: re.sub(r"[^A-Za-z0-9_:]", "_", s)
        with self._lock:
            out = ["# TYPE groundspark_calls_total counter"]
            out += [f'groundspark_calls_total{{name="{safe(n)}",outcome="{safe(o)}"}} {v}' for (n, o), v in sorted(self.counts.items())]
            out.append("# TYPE groundspark_seconds histogram")
            for n, (hits, (count, total)) in sorted(self.times.items()):
                out += [f'groundspark_seconds_bucket{{name="{safe(n)}",le="{end}"}} {h}' for end, h in zip(BUCKETS, hits, strict=True)]
                out += [f'groundspark_seconds_bucket{{name="{safe(n)}",le="+Inf"}} {count}', f'groundspark_seconds_sum{{name="{safe(n)}"}} {total:.6f}', f'groundspark_seconds_count{{name="{safe(n)}"}} {count}']
        return "\n".join(out) + "\n"


class NoMetrics(Metrics):
    """Keeps nothing."""

    def count(self, name: str, outcome: str, n: int = 1) -> None:
        pass

    def time(self, name: str, seconds: float) -> None:
        pass


def observed(metrics: Metrics, name: str, call: Callable) -> Callable:
    """call, timed and counted."""

    def run(*args, **kwargs):
        with metrics.span(name):
            return call(*args, **kwargs)

    return run


class CountingModel:
    """A model that knows how often it was asked."""

    def __init__(self, model: Callable[[str], str]):
        self.model, self.calls = model, 0

    def __call__(self, prompt: str) -> str:
        self.calls += 1
        return self.model(prompt)


@dataclass
class Trace:
    """Steps of one request with their times."""

    request: str
    steps: list[dict] = field(default_factory=list)

    @contextmanager
    def step(self, name: str, **more):
        start, line = time.perf_counter(), {"step": name, "ok": False, "ms": 0.0} | more
        self.steps.append(line)
        try:
            yield line
            line["ok"] = True
        except Exception as e:
            line["detail"] = type(e).__name__
            raise
        finally:
            line["ms"] = round(1000 * (time.perf_counter() - start), 3)
