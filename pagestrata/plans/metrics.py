"""Timers, counters and profiles on the driver, and logging."""

from __future__ import annotations

import functools
import json
import logging
import resource
import threading
import time
from collections import defaultdict
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field


def logger(name: str = "pagestrata", level: str = "INFO", path: str | None = None) -> logging.Logger:
    """A logger with one handler, to stderr or a file."""
    log = logging.getLogger(name)
    log.setLevel(level)
    if not log.handlers:
        handler = logging.FileHandler(path, encoding="utf-8") if path else logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
        log.addHandler(handler)
    return log


@dataclass
class Metrics:
    """Durations by stage (all of them, not only the last), counters, and errors."""

    durations: dict = field(default_factory=lambda: defaultdict(list))
    counters: dict = field(default_factory=lambda: defaultdict(int))
    errors: list = field(default_factory=list)
    started: float = field(default_factory=time.time)

    @contextmanager
    def stage(self, name: str):
        began = time.perf_counter()
        try:
            yield self
        except Exception as e:
            self.errors.append({"stage": name, "error": str(e)})
            raise
        finally:
            self.durations[name].append(time.perf_counter() - began)

    def count(self, name: str, n: int = 1) -> None:
        self.counters[name] += n

    def summary(self) -> dict:
        done, failed = self.counters.get("documents", 0), self.counters.get("failed", 0)
        return {
            "total_seconds": time.time() - self.started, "seconds_per_document": (time.time() - self.started) / done if done else 0.0, "stages": {k: sum(v) for k, v in self.durations.items()}, "counters": dict(self.counters), "success_rate": (done - failed) / done if done else 0.0,
            "peak_memory_mb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024, "errors": list(self.errors),
        }

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump({"durations": {k: list(v) for k, v in self.durations.items()}, "counters": dict(self.counters), "errors": self.errors, "started": self.started}, f)

    @classmethod
    def load(cls, path: str) -> Metrics:
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        out = cls(errors=raw["errors"], started=raw["started"])
        out.durations.update(raw["durations"])
        out.counters.update(raw["counters"])
        return out


@dataclass
class Profile:
    """Duration statistics of one function."""

    calls: int = 0
    total: float = 0.0
    least: float = float("inf")
    most: float = 0.0

    def add(self, seconds: float) -> None:
        self.calls, self.total = self.calls + 1, self.total + seconds
        self.least, self.most = min(self.least, seconds), max(self.most, seconds)


class Profiler:
    """Profiles of functions by name."""

    def __init__(self):
        self.profiles: dict[str, Profile] = defaultdict(Profile)

    def timed(self, f):
        @functools.wraps(f)
        def call(*args, **kwargs):
            began = time.perf_counter()
            try:
                return f(*args, **kwargs)
            finally:
                self.profiles[f.__name__].add(time.perf_counter() - began)

        return call

    def summary(self, name: str) -> dict:
        p = self.profiles[name]
        return asdict(p) | {"average": p.total / p.calls if p.calls else 0.0}

    def summaries(self) -> dict[str, dict]:
        return {k: self.summary(k) for k in list(self.profiles)}


def benchmark(f, runs: int = 5, warm: int = 1, *args, **kwargs) -> dict:
    """Least, median, mean and greatest seconds of ``runs`` calls of a function after ``warm`` uncounted ones, and its last result."""
    took, result = [], None
    for i in range(warm + runs):
        began = time.perf_counter()
        result = f(*args, **kwargs)
        if i >= warm:
            took.append(time.perf_counter() - began)
    took.sort()
    return {"runs": runs, "least": took[0], "median": took[len(took) // 2], "mean": sum(took) / len(took), "greatest": took[-1], "result": result}


class Sampler:
    """Samples peak memory and CPU seconds of this process every ``period`` seconds on a thread, from enter to exit."""

    def __init__(self, period: float = 1.0):
        self.period, self.samples = period, []
        self._stop = threading.Event()

    def _take(self) -> None:
        usage = resource.getrusage(resource.RUSAGE_SELF)
        self.samples.append({"at": time.time(), "peak_memory_mb": usage.ru_maxrss / 1024, "cpu_seconds": usage.ru_utime + usage.ru_stime})

    def _run(self) -> None:
        while not self._stop.wait(self.period):
            self._take()

    def __enter__(self) -> Sampler:
        self._stop.clear()
        self._take()
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._stop.set()
        self._thread.join()
        self._take()

    def summary(self) -> dict:
        """Seconds, CPU seconds, their ratio and peak memory between the first and the last sample."""
        if len(self.samples) < 2:
            return {"seconds": 0.0, "cpu_seconds": 0.0, "cores_busy": 0.0, "peak_memory_mb": 0.0}
        first, last = self.samples[0], self.samples[-1]
        seconds, cpu = last["at"] - first["at"], last["cpu_seconds"] - first["cpu_seconds"]
        return {"seconds": seconds, "cpu_seconds": cpu, "cores_busy": cpu / seconds if seconds else 0.0, "peak_memory_mb": max(s["peak_memory_mb"] for s in self.samples)}
