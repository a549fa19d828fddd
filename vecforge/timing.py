"""A stopwatch that adds up what it measured."""

from __future__ import annotations

import time


class Stopwatch:
    """`tic` starts a measurement, `toc` adds it to the total, `reset` clears the total and starts anew."""

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self._total = 0
        self.tic()

    def tic(self) -> None:
        self._start = time.perf_counter_ns()

    def toc(self) -> None:
        self._total += time.perf_counter_ns() - self._start

    @property
    def milliseconds(self) -> float:
        return self._total / 1e6
