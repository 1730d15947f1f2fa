"""A session's loop: foreground commands before background work, optimistic answers, scans and recovery."""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable
from typing import Any, TypeVar

from quarrygraph.plans.request import QueryError

#: Concurrent queries of a session, commands waiting, seconds between retries and between scans.
QUERIES, COMMANDS, RETRY_S, SCAN_S = 16, 256, 1.0, 300.0
X = TypeVar("X")


class Admission:
    """At most so many queries at once; the next one is told that the server is busy."""

    def __init__(self, most: int = QUERIES):
        self._free = threading.BoundedSemaphore(most)

    def run(self, work: Callable[[], X]) -> X:
        if not self._free.acquire(blocking=False):
            raise QueryError("server_busy", "too many queries at once")
        try:
            return work()
        finally:
            self._free.release()


class Loop:
    """Single reader of two queues: whatever is in the foreground goes first."""

    def __init__(self, commands: int = COMMANDS):
        self.foreground: queue.Queue[Callable[[], Any]] = queue.Queue(commands)
        self.background: queue.Queue[Callable[[], Any]] = queue.Queue()

    def submit(self, work: Callable[[], Any], background: bool = False) -> None:
        try:
            (self.background if background else self.foreground).put_nowait(work)
        except queue.Full as e:
            raise QueryError("server_busy", "too many commands are waiting") from e

    def step(self) -> bool:
        for q in (self.foreground, self.background):
            try:
                work = q.get_nowait()
            except queue.Empty:
                continue
            work()
            return True
        return False

    def drain(self) -> None:
        while self.step():
            pass


def trusted(answer: Callable[[], X], version: Callable[[], int], tries: int = 3) -> X:
    """An answer during which trust did not move; otherwise it is thrown away and made again."""
    for _ in range(tries):
        before = version()
        out = answer()
        if version() == before:
            return out
    raise QueryError("stale_snapshot", "the evidence kept changing")


def recover(attempt: Callable[[], bool], most: int, delay: float = RETRY_S, sleep: Callable[[float], None] = time.sleep) -> dict[str, int]:
    """Try until it works; counts for the observation."""
    out = {"attempts": 0, "successes": 0, "failures": 0}
    while out["attempts"] < most:
        out["attempts"] += 1
        if attempt():
            out["successes"] += 1
            break
        out["failures"] += 1
        if out["attempts"] < most:
            sleep(delay)
    return out
