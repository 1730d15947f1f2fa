"""Texts for people: sizes, times, responses."""

from __future__ import annotations

import json
from typing import Any


def byte_text(n: int) -> str:
    return f"{n / 2**30:.1f} GiB" if n >= 2**30 else f"{n / 2**20:.1f} MiB"


def elapsed_text(millis: int) -> str:
    s = millis // 1000
    return f"{s // 3600:02}:{s // 60 % 60:02}:{s % 60:02}" if s >= 3600 else f"{s // 60:02}:{s % 60:02}"


def response_text(response: dict[str, Any]) -> str:
    """A response in lines; failures name their code."""
    if not response["success"]:
        return f"error {response['error']['code']}: {response['error']['message']}"
    lines = ["  ".join(f"{k}={v}" for k, v in item.items() if v is not None) for item in response["items"]]
    page = response["page"] or {}
    if page.get("has_more"):
        lines.append("more rows" + (f"; cursor {page['cursor']}" if page.get("cursor") else ""))
    return "\n".join([*lines, *(f"note: {d}" for d in response["diagnostics"])])


def structured(response: dict[str, Any]) -> str:
    return json.dumps(response, indent=2, default=str)
