"""The text rules on Python strings, for the parsers that have to walk a document.

They state the rules of functions/text.py for texts of any alphabet. A parser
returns ``Parsed``; findings are tuples (risk, evidence, location, anomaly).
"""

from __future__ import annotations

import base64
import binascii
import re
import subprocess
import sys
import time
import unicodedata
import zipfile
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from xml.etree.ElementTree import ParseError

from ..functions.text import ALPHABET, BIDI, DECODE_MOST, RUN_LEAST, ZERO_WIDTH, instruction_pattern
from ..plans.contract import FAILURES, LOCATION, QUARANTINE, REVIEW, Limits

Finding = tuple[int, str, str, str | None]

_WHITE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"[{ALPHABET}][{ALPHABET}{_WHITE}]*")
_INSTRUCTIONS = re.compile(instruction_pattern(r"\s+", r"\b", r"\b"))
#: A word at the beginning of each pattern; most texts hold none.
_FIRST_WORDS = ("ignore", "disregard", "override", "bypass", "reveal", "show", "print", "exfiltrate", "you")


def _of_categories(*categories: str, but: str = "") -> re.Pattern:
    """Any character of some Unicode categories."""
    points = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in categories and chr(c) not in but]
    starts = [c for i, c in enumerate(points) if not i or points[i - 1] != c - 1]
    ends = [c for i, c in enumerate(points) if i + 1 == len(points) or points[i + 1] != c + 1]
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True)) + "]")


_CONTROLS = _of_categories("Cc", "Cf", but="\t\n\r")
_LOCATION = re.compile(LOCATION.replace(r"\z", r"\Z"))


class LimitExceeded(MemoryError):
    """A resource bound was met."""


class Unavailable(FileNotFoundError):
    """A reader, renderer or recogniser that a format needs is not there."""


class IntegrityError(Exception):
    """A result that is not what its own rules allow."""


@dataclass
class Clock:
    """A parse's deadline; ``now`` can be replaced in tests."""

    limits: Limits
    now: Callable[[], float] = time.monotonic
    began: float = field(init=False)

    def __post_init__(self) -> None:
        self.began = self.now()

    def check(self) -> None:
        if self.now() - self.began > self.limits.seconds:
            raise TimeoutError


@dataclass
class Parsed:
    findings: list[Finding]
    visible_text: str
    required: list[str]
    completed: list[str]

    def row(self) -> dict:
        names = ("risk", "evidence", "location", "anomaly")
        return {"findings": [dict(zip(names, f, strict=True)) for f in self.findings], "visible_text": self.visible_text, "required": self.required, "completed": self.completed}


def failure_kind(error: BaseException) -> str:
    """The kind of failure of an exception; its message goes nowhere."""
    if isinstance(error, TimeoutError):
        return "TIMEOUT"
    if isinstance(error, MemoryError | subprocess.TimeoutExpired):
        return "RESOURCE_LIMIT"
    if isinstance(error, FileNotFoundError | ImportError):
        return "DEPENDENCY"
    if isinstance(error, IntegrityError):
        return "RESULT_INTEGRITY"
    if isinstance(error, zipfile.BadZipFile | EOFError | ValueError | ParseError):
        return "PARSER"
    return "UNKNOWN"


def failed(kind: str, checks: Iterable[str]) -> Parsed:
    """A parse that did not end: one finding, no check completed."""
    return Parsed([(QUARANTINE, FAILURES[kind], "file:structure", None)], "", sorted(checks), [])


def guarded(parse: Callable[[], Parsed], checks: Iterable[str]) -> Parsed:
    """``parse()``, or its failure; a finding outside the location grammar is a failure too."""
    try:
        out = parse()
        if not all(_LOCATION.match(f[2]) for f in out.findings):
            raise IntegrityError
        return out
    except Exception as error:  # whatever goes wrong with one document stays with it
        return failed(failure_kind(error), checks)


def no_controls(text: str, lines: list[str]) -> bool:
    """Whether, by a quick look, a text of these ``lines`` holds no control or format character but LF; False leaves it open."""
    return all(map(str.isprintable, lines)) and text.removesuffix("\n") == "\n".join(lines)


def normalise(text: str) -> str:
    """TXT-02; the registered invisible characters are format characters, so they go with the others."""
    plain = text if text.isascii() else unicodedata.normalize("NFKC", text)
    return plain if no_controls(plain, plain.splitlines()) else _CONTROLS.sub("", plain)


def has_disallowed(text: str) -> bool:
    return not no_controls(text, text.splitlines()) and _CONTROLS.search(text) is not None


def anomalies(text: str) -> list[str]:
    return [code for code, chars in (("BIDI_CONTROL_CHARACTERS", BIDI), ("ZERO_WIDTH_CHARACTERS", ZERO_WIDTH)) if not text.isascii() and any(c in text for c in chars)]


def is_instruction(text: str) -> bool:
    return tells(normalise(text))


def tells(plain: str) -> bool:
    """Whether any instruction pattern is in a text in normal form."""
    folded = plain.casefold()
    return any(word in folded for word in _FIRST_WORDS) and _INSTRUCTIONS.search(folded) is not None


def instructions(text: str, location: str, hidden: bool) -> list[Finding]:
    if not is_instruction(text):
        return []
    return [(QUARANTINE, "HIDDEN_INSTRUCTION_PATTERN", location, "DOM_HIDDEN_CONTENT") if hidden else (REVIEW, "VISIBLE_INSTRUCTION_PATTERN", location, None)]


def decode_block(encoded: str) -> str | None:
    compact = "".join(encoded.split())
    if len(compact) > DECODE_MOST or len(compact) % 4 == 1:
        return None
    try:
        return base64.b64decode(compact + "=" * (-len(compact) % 4), altchars=b"-_", validate=True).decode("utf-8")
    except (binascii.Error, UnicodeDecodeError):
        return None


def run_risk(run: str) -> int | None:
    """Rank of the finding that a run of the alphabet and white space makes."""
    n = len("".join(run.split()))
    if n < RUN_LEAST:
        return None
    if len(run) - n > n // 2:
        return QUARANTINE
    decoded = decode_block(run[:DECODE_MOST]) if n <= DECODE_MOST else None
    if decoded is None:
        longest = max(map(len, run.replace("/", " ").split()), default=0)
        return REVIEW if "+" in run or "=" in run or longest >= RUN_LEAST else None
    return QUARANTINE if is_instruction(decoded) else REVIEW


def encoded_blocks(text: str, location: str) -> list[Finding]:
    if len(text) < RUN_LEAST:
        return []
    ranks = (run_risk(run) for run in _RUN.findall(text) if len(run) >= RUN_LEAST)
    return [(r, "ENCODED_INSTRUCTION_PATTERN", location, "LONG_ENCODED_BLOCK") for r in ranks if r is not None]


def mismatch(location: str, anomaly: str | None = None) -> Finding:
    """Text that a reader sees and text that a parser reads may differ here."""
    return (REVIEW, "VISIBLE_EXTRACTED_TEXT_MISMATCH", location, anomaly)


def active(location: str, anomaly: str | None = None) -> Finding:
    return (QUARANTINE, "ACTIVE_CONTENT_PRESENT", location, anomaly)


def external(location: str, anomaly: str | None = None) -> Finding:
    return (REVIEW, "EXTERNAL_REFERENCE_PRESENT", location, anomaly)


def decode_text(content: bytes) -> str:
    """SRC-06: strict UTF-16 by its mark, else strict UTF-8 without one leading mark."""
    return content.decode("utf-16" if content[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8-sig")


def plain_text(text: str, clock: Clock, more: Callable[[str], tuple[list[Finding], bool]] | None = None) -> Parsed:
    """TXT-09, with what ``more`` finds and whether it holds the derivative back."""
    at_top = "text:line=1"
    plain = normalise(text)
    findings = [mismatch(at_top)] if has_disallowed(text) else []
    lines = text.splitlines()
    # no line holds what the whole text does not: most texts are not looked at line by line
    if anomalies(text) or tells(plain if no_controls(text, lines) else normalise("\n".join(lines))):
        for number, line in enumerate(lines, 1):
            clock.check()
            where = f"text:line={number}"
            findings += [mismatch(where, a) for a in anomalies(line)]
            findings += instructions(line, where, hidden=False)
    blocks = encoded_blocks(text, at_top)
    findings += blocks
    extra, held = more(text) if more else ([], False)
    clock.check()
    return Parsed(findings + extra, "" if blocks or held else plain, ["text-patterns"], ["text-patterns"])
