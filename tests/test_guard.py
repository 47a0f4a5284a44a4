"""FLT-05 on single payloads."""

import json

import pytest

from docsieve.operators.guard import PAYLOAD_BYTES, denied


def call(tool, given, event="PreToolUse"):
    return json.dumps({"hook_event_name": event, "tool_name": tool, "tool_input": given})


@pytest.mark.parametrize(
    "payload, want",
    [
        (call("Bash", {"command": "document-firewall a.pdf"}), False),
        (call("Read", {"command": "document-firewall a.pdf"}), True),
        (call("mcp__document_injection_firewall__read_low_derivative", {"path": "a.pdf"}), False),
        (call("Edit", {"edits": [{"new": ["x", {"y": "see notes.MD"}]}]}), True),
        (call("Edit", {"a.pdf": 1}), False),
        (call("Bash", {"command": "ls -la"}), False),
        (call("Bash", None), False),
        (call("Bash", {"command": "ls"}, "PostToolUse"), True),
        (call(["Bash"], {"command": "ls"}), True),
        ("[]", True),
        ("{", True),
        ("", True),
        (None, True),
        (b"\xff", True),
        (call("Bash", {"command": "x" * PAYLOAD_BYTES}), True),
        ("[" * 100_000, True),
    ],
)
def test_decision(payload, want):
    assert denied(payload) is want
