"""Progress of an operation: phases, steps, and a smoothed estimate of the time left."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import SparkSession

Progress = Callable[[dict[str, Any]], None]
Ratio = Callable[[float], None]

#: How much a new estimate of the time left counts against those before.
SMOOTHING = 0.2


class Reporter:
    """Reports to a callback of a dict, to one of the overall ratio, or to both.

    A report is made when the phase changes, when the ratio has grown by ``step``
    since the last one, and at the end.
    """

    def __init__(self, spark: SparkSession, progress: Progress | None = None, ratio: Ratio | None = None, step: float = 0.05, clock: Callable[[], float] = time.time):
        self.spark, self.progress, self.ratio, self.step, self.clock = spark, progress, ratio, step, clock
        self.began, self.phase, self.last, self.left = clock(), "", -1.0, 0.0
        self.lock = threading.Lock()

    def __call__(self, phase: str, overall: float, within: float = 0.0, size: int = 0) -> None:
        with self.lock:
            overall = max(overall, self.last)
            if phase == self.phase and overall < min(1.0, self.last + self.step) - 1e-9:  # 0.2 + 0.1 is above 0.3
                return
            spent = self.clock() - self.began
            left = spent / overall * (1 - overall) if 0 < overall < 1 else 0.0
            if left and self.left:
                left = SMOOTHING * left + (1 - SMOOTHING) * self.left
            self.phase, self.last, self.left = phase, overall, left
            if self.progress:
                self.progress({"phase": phase, "phase_ratio": 1.0 if phase == "complete" else within, "overall_ratio": overall, "bytes": size, "elapsed_s": spent, "eta_s": left})
            if self.ratio:
                self.ratio(overall)

    @contextmanager
    def during(self, phase: str, start: float, stop: float, size: int = 0) -> Iterator[None]:
        """Report the share of finished tasks of the jobs that run meanwhile as ``start`` to ``stop``."""
        self(phase, start, 0.0, size)
        ended = threading.Event()

        def watch() -> None:
            tracker = self.spark.sparkContext.statusTracker()
            while not ended.wait(0.2):
                stages = [s for s in map(tracker.getStageInfo, tracker.getActiveStageIds()) if s is not None]
                total = sum(s.numTasks for s in stages)
                if total:
                    done = sum(s.numCompletedTasks for s in stages) / total
                    self(phase, start + (stop - start) * done, done, size)

        watcher = threading.Thread(target=watch, daemon=True)
        if self.progress or self.ratio:
            watcher.start()
        try:
            yield
        finally:
            ended.set()
            if watcher.is_alive():
                watcher.join()
