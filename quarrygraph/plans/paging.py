"""Keyset pages, signed cursors and response envelopes. At most limit + 1 rows of a query reach the driver."""

from __future__ import annotations

import base64
import binascii
import hashlib
import hmac
import json
import secrets
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrygraph.plans.request import MAX_CURSOR, MAX_RESPONSE, QueryError, Spec

CURSOR_VERSION = 1
MAX_DIAGNOSTICS, DIAGNOSTIC_CHARS = 100, 4096
SCHEMA = "query/v1"


@dataclass
class View:
    """One state of the evidence that pages are pinned to."""

    revision: int = 0
    session: str = field(default_factory=lambda: str(uuid.uuid4()))
    secret: bytes = field(default_factory=lambda: secrets.token_bytes(32))
    warm: bool = True
    diagnostics: tuple[str, ...] = ()

    @property
    def snapshot_id(self) -> str:
        return f"{self.session}:{self.revision}"


def _b64(raw: bytes) -> str:
    return base64.urlsafe_b64encode(raw).rstrip(b"=").decode()


def _unb64(text: str) -> bytes:
    return base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_", validate=True)


def make_cursor(view: View, spec: Spec, last_key: str) -> str:
    payload = json.dumps({"version": CURSOR_VERSION, "snapshot_id": view.snapshot_id, "query_hash": spec.query_hash, "last_key": last_key}, separators=(",", ":")).encode()
    out = f"{_b64(payload)}.{_b64(hmac.digest(view.secret, payload, hashlib.sha256))}"
    if len(out) > MAX_CURSOR:
        raise QueryError("response_too_large", "the cursor is too large")
    return out


def read_cursor(view: View, spec: Spec) -> str | None:
    """The key after which to go on; the limit may change between pages, the query and the snapshot may not."""
    if spec.cursor is None:
        return None
    parts = spec.cursor.split(".")
    if not spec.cursor.strip() or len(spec.cursor.encode()) > MAX_CURSOR or len(parts) != 2 or not all(parts):
        raise QueryError("invalid_cursor", "the cursor is malformed")
    try:
        payload, signature = map(_unb64, parts)
    except (ValueError, binascii.Error) as e:
        raise QueryError("invalid_cursor", "the cursor is not base64url") from e
    if not hmac.compare_digest(hmac.digest(view.secret, payload, hashlib.sha256), signature):
        raise QueryError("invalid_cursor", "the cursor is not signed by this session")
    got = json.loads(payload)
    if got.get("version") != CURSOR_VERSION or not all(got.get(k) for k in ("snapshot_id", "query_hash", "last_key")):
        raise QueryError("invalid_cursor", "the cursor is incomplete")
    if got["snapshot_id"] != view.snapshot_id:
        raise QueryError("stale_snapshot", "the cursor belongs to an earlier snapshot")
    if got["query_hash"] != spec.query_hash:
        raise QueryError("invalid_cursor", "the cursor belongs to another query")
    return got["last_key"]


def check_snapshot(view: View, spec: Spec) -> None:
    if spec.snapshot_id is not None and spec.snapshot_id != view.snapshot_id:
        raise QueryError("stale_snapshot", "the snapshot is not current")


def page(df: DataFrame, key: str, after: str | None, limit: int) -> DataFrame:
    """Rows after a key: a filter and a top-k, whatever the size of ``df``."""
    return (df if after is None else df.where(F.col(key) > after)).orderBy(key).limit(limit)


def envelope(view: View, spec: Spec, items: list[dict[str, Any]] | None = None, has_more: bool = False, cursor: str | None = None, error: QueryError | None = None, scope: dict[str, Any] | None = None) -> dict[str, Any]:
    shown = sorted({d.strip() for d in view.diagnostics if d.strip()})
    unavailable = has_more and cursor is None
    return {
        "schema_version": SCHEMA,
        "protocol_version": 1,
        "session_id": view.session if view.warm else None,
        "mode": "warm" if view.warm else "cold",
        "command": spec.command,
        "success": error is None,
        "error": None if error is None else {"code": error.code, "message": str(error)},
        "snapshot": {"id": view.snapshot_id},
        "scope": (scope or {}) | {"operation_complete": not shown or spec.command == "refresh"},
        "items": items or [],
        "page": None if error else {"limit": spec.limit, "count": len(items or []), "has_more": has_more, "cursor": cursor, "continuation_unavailable": unavailable},
        "diagnostics": [d[:DIAGNOSTIC_CHARS] for d in shown[:MAX_DIAGNOSTICS]],
        "diagnostics_truncated": len(shown) > MAX_DIAGNOSTICS or any(len(d) > DIAGNOSTIC_CHARS for d in shown),
        "export": None,
        "refresh": None,
    }


def render(response: dict[str, Any]) -> bytes:
    return json.dumps(response, separators=(",", ":"), ensure_ascii=False, default=str).encode()


def respond(df: DataFrame, key: str, view: View, spec: Spec, most: int = MAX_RESPONSE) -> dict[str, Any]:
    """One page as a response. Rows that do not fit its size are left for the next page; a first row that does not fit is an error."""
    check_snapshot(view, spec)
    if spec.cursor is not None and not view.warm:
        raise QueryError("unsupported_capability", "a cold query has no cursor")
    after = read_cursor(view, spec)
    rows = [r.asDict(recursive=True) for r in page(df, key, after, spec.limit + 1).collect()]
    more, rows = len(rows) > spec.limit, rows[: spec.limit]

    def build(n: int) -> dict[str, Any]:
        left = more or n < len(rows)
        cursor = make_cursor(view, spec, rows[n - 1][key]) if left and n and view.warm else None
        return envelope(view, spec, [{k: v for k, v in r.items() if k != key} for r in rows[:n]], left, cursor)

    if len(render(out := build(len(rows)))) <= most:
        return out
    low, high = 0, len(rows)  # the largest number of rows that fits
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if len(render(build(mid))) <= most else (low, mid)
    if not low:
        raise QueryError("response_too_large", "one row does not fit a response")
    return build(low)
