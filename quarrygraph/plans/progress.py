"""Progress of a running session on the terminal."""

from __future__ import annotations

import sys
import time
from collections.abc import Callable
from typing import TextIO

from pyspark import SparkContext

from quarrygraph.functions.text import elapsed_text

#: Seconds between lines, and between lines that say nothing new.
RENDER_S, HEARTBEAT_S = 1.0, 10.0


class Progress:
    """Prints a line when something moved, and a heartbeat when nothing did."""

    def __init__(self, out: TextIO = sys.stderr, clock: Callable[[], float] = time.monotonic):
        self.out, self.clock = out, clock
        self.began = self.shown = clock()
        self.last = ""

    def line(self, phase: str, done: int, total: int) -> None:
        now, text = self.clock(), f"{phase} {done}/{total}"
        wait = HEARTBEAT_S if text == self.last else RENDER_S
        if now - self.shown >= wait or not self.last:
            self.out.write(f"[{elapsed_text(int((now - self.began) * 1000))}] {text}\n")
            self.shown, self.last = now, text

    def poll(self, context: SparkContext, phase: str) -> None:
        tracker = context.statusTracker()
        stages = [s for s in map(tracker.getStageInfo, tracker.getActiveStageIds()) if s is not None]
        self.line(phase, sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages))

    def summary(self, extracted: int, reused: int) -> None:
        self.out.write(f"done in {elapsed_text(int((self.clock() - self.began) * 1000))}: {extracted} extracted, {reused} reused\n")
