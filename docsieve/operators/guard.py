"""FLT-05: whether a tool call may run, so that no document is read but through the scanner."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what names a document in a call.
DOCUMENT = r"(?:^|[\s'\"=:/])[^\s'\"=]*\.(?:txt|md|markdown|html?|docx|pptx|xlsx|pdf|png|jpe?g)(?:$|[\s'\";,)])"
EVENT = "PreToolUse"
PAYLOAD_BYTES = 1 << 20
SCANNER_TOOLS = frozenset(f"mcp__document{a}injection{a}firewall__{b}" for a in "-_" for b in ("inspect_file", "read_low_derivative"))
SCANNER_COMMANDS = ("document-firewall", "document-firewall-mcp")
_DOCUMENT = re.compile(DOCUMENT, re.IGNORECASE)


def strings(value: Any) -> Iterator[str]:
    """Every string inside ``value``; keys are none."""
    if isinstance(value, str):
        yield value
    elif isinstance(value, dict | list):
        for item in value.values() if isinstance(value, dict) else value:
            yield from strings(item)


def denied(payload: str | bytes | None) -> bool:
    """Scanner tools and commands may run, other calls unless a string of theirs names a document; what cannot be understood may not."""
    try:
        raw = payload.encode() if isinstance(payload, str) else payload
        if len(raw) > PAYLOAD_BYTES:
            return True
        call = json.loads(raw)
        if not isinstance(call, dict) or call.get("hook_event_name") != EVENT:
            return True
        tool = call.get("tool_name")
        if tool in SCANNER_TOOLS:
            return False
        found = list(strings(call.get("tool_input")))
        if tool == "Bash" and any(command in item for command in SCANNER_COMMANDS for item in found):
            return False
        return any(_DOCUMENT.search(item) for item in found)
    except Exception:  # whatever is wrong with a payload, it is denied
        return True


def raw_read_denied(payload: Column) -> Column:
    """FLT-05 of each payload, a JSON text; null is malformed."""

    @F.pandas_udf("boolean")
    def run(payloads: pd.Series) -> pd.Series:
        return payloads.map(denied).astype(bool)

    return run(payload)
