"""Session descriptors on disk and the commands that manage them."""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
from dataclasses import asdict, dataclass
from pathlib import Path
from typing import Any

from quarrygraph.functions.identity import SEPARATOR, canonical_text
from quarrygraph.plans.request import QueryError
from quarrygraph.plans.session import atomic_write

SCHEMA = "session/v2"
#: Seconds by which a process's start may differ from the recorded one.
TOLERANCE = 1.0


def started(process_id: int) -> float:
    """Seconds after boot at which a process started; FileNotFoundError if there is none."""
    stat = Path(f"/proc/{process_id}/stat").read_text()
    return int(stat.rpartition(")")[2].split()[19]) / os.sysconf("SC_CLK_TCK")


@dataclass
class Descriptor:
    session_id: str
    process_id: int
    started: float
    root: str
    schema: str = SCHEMA

    @classmethod
    def own(cls, session_id: str, root: str) -> Descriptor:
        return cls(session_id, os.getpid(), started(os.getpid()), root)


class Registry:
    def __init__(self, folder: str):
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def add(self, d: Descriptor) -> None:
        atomic_write(str(self.folder / f"{d.session_id}.json"), json.dumps(asdict(d)))

    def remove(self, session_id: str) -> None:
        (self.folder / f"{session_id}.json").unlink(missing_ok=True)

    def read(self) -> list[tuple[str, Descriptor | None]]:
        """(file, descriptor) of all; a malformed one is reported as None, not left out."""
        out: list[tuple[str, Descriptor | None]] = []
        for f in sorted(self.folder.glob("*.json")):
            try:
                d = Descriptor(**json.loads(f.read_text()))
                out.append((f.name, d if d.schema == SCHEMA else None))
            except (ValueError, TypeError, OSError):
                out.append((f.name, None))
        return out

    def select(self, prefix: str) -> Descriptor:
        found = [d for _, d in self.read() if d is not None and d.session_id.lower().startswith(prefix.lower())]
        if not found:
            raise QueryError("session_not_found", f"no session matches '{prefix}'")
        if len(found) > 1:
            raise QueryError("ambiguous_session", f"several sessions match '{prefix}'")
        return found[0]


def endpoint_name(prefix: str, kind: str, session_id: str, state_folder: str) -> str:
    """The name a session's endpoint has: a prefix and 24 hex digits of what it is, its id and the canonical folder of its state."""
    if not session_id.strip("0-"):
        raise ValueError("an endpoint needs a session id")
    text = SEPARATOR.join([kind, session_id.lower(), canonical_text(os.path.abspath(state_folder))])
    return prefix + hashlib.sha256(text.encode()).hexdigest()[:24]


def is_endpoint(prefix: str, name: str | None) -> bool:
    return name is not None and re.fullmatch(re.escape(prefix) + "[0-9a-f]{24}", name) is not None


def liveness(d: Descriptor) -> str:
    """live, stale (another or no process has the number) or unknown."""
    try:
        now = started(d.process_id)
    except FileNotFoundError:
        return "stale"
    except OSError:
        return "unknown"
    return "live" if abs(now - d.started) <= TOLERANCE else "stale"


def listing(registry: Registry) -> list[dict[str, Any]]:
    return [{"file": f, "session_id": d.session_id if d else None, "state": liveness(d) if d else "malformed"} for f, d in registry.read()]


def diagnostics_report(path: str, view: dict[str, Any]) -> None:
    """Write a report to a file that must not exist yet."""
    try:
        with open(path, "x") as f:
            json.dump(view | {"written": time.time()}, f, indent=2)
    except FileExistsError as e:
        raise QueryError("output_conflict", "the report exists already") from e
