"""Requests: strict parsing, validation, hashes, errors and exit codes."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from typing import Any

from quarrygraph.operators.filters import KINDS

# Bounds of the protocol.
MAX_REQUEST, MAX_RESPONSE, MAX_DEPTH, MAX_CURSOR = 64 << 10, 4 << 20, 32, 8 << 10
DEFAULT_LIMIT, MAX_LIMIT = 100, 1000
DEFAULT_TIMEOUT_MS, MAX_TIMEOUT_MS = 600_000, 3_600_000
COMMANDS = ("symbols", "signature", "usages", "callers", "hierarchy", "arguments", "usage-summary", "export", "refresh")
ONE_SYMBOL = ("signature", "usages", "callers", "hierarchy", "arguments")
DIRECTIONS = ("base", "derived", "contracts", "implementations", "all")
EXIT_CODES = {
    2: ("invalid_arguments", "invalid_request", "symbol_not_found", "invalid_cursor", "unsupported_symbol", "unsupported_capability"),
    3: ("session_not_found", "ambiguous_session", "unreachable", "session_failed", "session_stopping", "incompatible_protocol", "session_mismatch"),
    4: ("server_busy", "timeout", "stale_snapshot"),
    5: ("output_conflict", "io_error", "solution_load_failed", "internal_error"),
    130: ("cancelled",),
}
REQUEST_KEYS = ("protocol_version", "session_id", "command", "analysis_key", "timeout_ms", "query", "output_path", "rebuild")
QUERY_KEYS = ("search", "symbol_id", "filters", "direction", "group_by", "limit", "cursor", "snapshot_id")
FILTER_KEYS = ("path", "project", "namespace", "kind")
PROTOCOL = 1


class QueryError(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def exit_code(code: str | None) -> int:
    return next((n for n, codes in EXIT_CODES.items() if code in codes), 5)


@dataclass(frozen=True)
class Spec:
    command: str
    search: str | None = None
    symbol_id: str | None = None
    filters: dict[str, str] = field(default_factory=dict)
    direction: str | None = None
    group_by: tuple[str, ...] = ()
    limit: int = DEFAULT_LIMIT
    cursor: str | None = None
    snapshot_id: str | None = None
    output_path: str | None = None
    rebuild: bool = False

    @property
    def query_hash(self) -> str:
        """What a cursor is bound to: everything that decides rows and their order, so not the limit."""
        scope = [f"{k}={self.filters.get(k, '<omitted>')}" for k in FILTER_KEYS]
        text = "\x1f".join([self.command, self.search or "", self.symbol_id or "", *scope, self.direction or "", ",".join(self.group_by)])
        return hashlib.sha256(text.encode()).hexdigest()

    def validate(self) -> Spec:
        """The matrix of commands and what they accept."""
        given = {
            "search": self.search is not None, "symbol_id": self.symbol_id is not None, "filters": bool(self.filters), "direction": self.direction is not None,
            "group_by": bool(self.group_by), "cursor": self.cursor is not None, "snapshot_id": self.snapshot_id is not None, "output_path": self.output_path is not None, "rebuild": self.rebuild, "limit": self.limit != DEFAULT_LIMIT,
        }
        accepts = {
            "symbols": {"search", "filters", "cursor", "limit"},
            "usage-summary": {"search", "filters", "group_by", "cursor", "limit"},
            "signature": {"symbol_id", "snapshot_id", "limit"},
            "usages": {"symbol_id", "filters", "cursor", "snapshot_id", "limit"},
            "callers": {"symbol_id", "filters", "cursor", "snapshot_id", "limit"},
            "arguments": {"symbol_id", "filters", "cursor", "snapshot_id", "limit"},
            "hierarchy": {"symbol_id", "filters", "direction", "cursor", "snapshot_id", "limit"},
            "export": {"output_path", "search", "symbol_id", "filters", "cursor", "snapshot_id", "limit"},
            "refresh": {"rebuild"},
        }
        if self.command not in accepts:
            raise QueryError("invalid_arguments", f"unsupported command '{self.command}'")
        if not 1 <= self.limit <= MAX_LIMIT:
            raise QueryError("invalid_arguments", f"limit must be from 1 to {MAX_LIMIT}")
        kind = self.filters.get("kind")
        if kind is not None and kind not in KINDS:
            raise QueryError("invalid_arguments", f"unknown kind '{kind}'")
        for name, on in given.items():
            if on and name not in accepts[self.command]:
                raise QueryError("invalid_arguments", f"{self.command} does not accept {name}")
        if self.command in ONE_SYMBOL and not (self.symbol_id or "").strip():
            raise QueryError("invalid_arguments", f"{self.command} requires symbol_id")
        if self.command == "arguments" and {"kind", "namespace"} & self.filters.keys():
            raise QueryError("invalid_arguments", "a scope of arguments is a path, a project or both")
        if self.direction is not None and self.direction not in DIRECTIONS:
            raise QueryError("invalid_arguments", "unknown direction")
        if len(set(self.group_by)) != len(self.group_by) or not set(self.group_by) <= {"project", "namespace"}:
            raise QueryError("invalid_arguments", "group_by accepts project and namespace, each once")
        if self.command == "export" and not (self.output_path or "").strip():
            raise QueryError("invalid_arguments", "export requires output_path")
        return self


def _unique(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise QueryError("invalid_request", "duplicate key")
    return out


def _depth(x: Any) -> int:
    if isinstance(x, dict):
        return 1 + max(map(_depth, x.values()), default=0)
    return 1 + max(map(_depth, x), default=0) if isinstance(x, list) else 0


def _typed(of: dict[str, Any], key: str, kind: type, default: Any = None) -> Any:
    v = of.get(key)
    if v is None:
        return default
    if not isinstance(v, kind) or kind is int and isinstance(v, bool):
        raise QueryError("invalid_request", f"{key} has the wrong type")
    return v


def _known(of: dict[str, Any], keys: tuple[str, ...]) -> None:
    for k in of:
        if k not in keys:
            raise QueryError("invalid_request", f"unknown key '{k}'")


def parse(raw: bytes | str) -> tuple[Spec, int, str | None]:
    """(validated spec, timeout in ms, session id) of one JSON request; unknown and duplicate keys, deep nesting and excess size are errors."""
    raw = raw.encode() if isinstance(raw, str) else raw
    if len(raw) > MAX_REQUEST:
        raise QueryError("invalid_request", "request is too large")
    try:
        doc = json.loads(raw, object_pairs_hook=_unique)
    except (ValueError, RecursionError) as e:
        raise QueryError("invalid_request", f"not JSON: {e}") from e
    if not isinstance(doc, dict) or _depth(doc) > MAX_DEPTH:
        raise QueryError("invalid_request", "request must be an object of limited depth")
    _known(doc, REQUEST_KEYS)
    if _typed(doc, "protocol_version", int, PROTOCOL) != PROTOCOL:
        raise QueryError("incompatible_protocol", "unsupported protocol version")
    query = _typed(doc, "query", dict, {})
    _known(query, QUERY_KEYS)
    filters = _typed(query, "filters", dict, {})
    _known(filters, FILTER_KEYS)
    group = _typed(query, "group_by", list, [])
    if not all(isinstance(g, str) for g in group):
        raise QueryError("invalid_request", "group_by has the wrong type")
    timeout = _typed(doc, "timeout_ms", int, DEFAULT_TIMEOUT_MS)
    if not 1 <= timeout <= MAX_TIMEOUT_MS:
        raise QueryError("invalid_arguments", "timeout is out of range")
    text = {k: _typed(query, k, str) for k in ("search", "symbol_id", "direction", "cursor", "snapshot_id")}
    spec = Spec(_typed(doc, "command", str, ""), **text, filters={k: _typed(filters, k, str) for k in filters if filters[k] is not None}, group_by=tuple(group), limit=_typed(query, "limit", int, DEFAULT_LIMIT), output_path=_typed(doc, "output_path", str), rebuild=_typed(doc, "rebuild", bool, False))
    return spec.validate(), timeout, _typed(doc, "session_id", str)
