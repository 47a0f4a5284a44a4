"""ZIP containers and Office Open XML packages (SRC-09 to SRC-15, OX-01, OX-02)."""

from __future__ import annotations

import io
import stat
import struct
import zipfile
from dataclasses import dataclass
from pathlib import PurePosixPath
from xml.etree import ElementTree
from xml.parsers import expat

from ..plans.contract import Limits
from .rules import Clock, Finding, LimitExceeded, external

# Record signatures of the ZIP format, and OOXML content types.
END, CENTRAL = b"PK\x05\x06", b"PK\x01\x02"
END_SIZE, CENTRAL_SIZE, COMMENT_MOST = 22, 46, 65_535
CONTENT_TYPES = "[Content_Types].xml"
TYPES_NS = "{http://schemas.openxmlformats.org/package/2006/content-types}"
MAIN_TYPES = {
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml": "DOCX",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation.main+xml": "PPTX",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml": "XLSX",
}
RATIO_MOST = 200


class Corrupt(ValueError):
    """A container that is not what its records say."""


class Refused(Exception):
    """A package outside the bounds of a second look."""


@dataclass(frozen=True)
class Member:
    name: str
    usize: int
    csize: int
    ext_attr: int
    is_dir: bool


def canonical_name(name: str) -> tuple[str, bool]:
    """SRC-11: the name without a directory's slash, and whether it had one."""
    path = name.removesuffix("/")
    drive = len(name) > 1 and name[1] == ":" and name[0].isascii() and name[0].isalpha()
    if "\\" in name or "\0" in name or drive or any(part in ("", ".", "..") for part in path.split("/")):
        raise Corrupt
    return path, path != name


def end_record(data: bytes) -> tuple[int, int, int, int]:
    """SRC-09: (members, directory size, directory offset, place) of the last end record that reaches the end of the file."""
    least = max(0, len(data) - END_SIZE - COMMENT_MOST)
    at = data.rfind(END, least)
    while at >= 0:
        if at + END_SIZE <= len(data):
            disk, first, here, total, size, offset, comment = struct.unpack_from("<4H2LH", data, at + 4)
            if at + END_SIZE + comment == len(data):
                if disk or first or here != total:
                    raise Corrupt
                if total == 0xFFFF or size == 0xFFFFFFFF:
                    raise LimitExceeded
                return total, size, offset, at
        at = data.rfind(END, least, at)
    raise Corrupt


def members(data: bytes, limits: Limits, clock: Clock) -> list[Member]:
    """SRC-10: the central directory's members, checked one by one."""
    count, size, offset, end = end_record(data)
    if count > limits.members or size > limits.directory_bytes:
        raise LimitExceeded
    if offset + size > end:
        raise Corrupt
    out: dict[str, Member] = {}
    directory, at, total = data[offset : offset + size], 0, 0
    for _ in range(count):
        clock.check()
        if directory[at : at + 4] != CENTRAL or at + CENTRAL_SIZE > len(directory):
            raise Corrupt
        flags, csize, usize = struct.unpack_from("<8xH10x2L", directory, at)[0:3]
        n_name, n_extra, n_comment, attributes = struct.unpack_from("<28x3H4xL", directory, at)
        raw = directory[at + CENTRAL_SIZE : at + CENTRAL_SIZE + n_name]
        at += CENTRAL_SIZE + n_name + n_extra + n_comment
        if at > len(directory):
            raise Corrupt
        try:
            name, is_dir = canonical_name(raw.decode("utf-8" if flags & 0x800 else "cp437"))
        except UnicodeDecodeError as e:
            raise Corrupt from e
        if stat.S_ISLNK(attributes >> 16) or name in out:
            raise Corrupt
        total += usize
        if name.count("/") >= limits.depth or usize > limits.member_bytes or total > limits.uncompressed_bytes:
            raise LimitExceeded
        out[name] = Member(name, usize, csize, attributes, is_dir)
    if at != len(directory):
        raise Corrupt
    return list(out.values())


def _refuse_entity(*_: object) -> None:
    raise ValueError("entity declaration in XML")


def safe_xml(raw: bytes) -> ElementTree.Element:
    """XML that declares no entity; a document type alone is let through."""
    if b"<!" in raw.replace(b"\0", b""):
        look = expat.ParserCreate()
        look.EntityDeclHandler = look.UnparsedEntityDeclHandler = look.ExternalEntityRefHandler = _refuse_entity
        try:
            look.Parse(raw, True)
        except expat.ExpatError as e:
            raise ValueError("malformed XML") from e
    return ElementTree.fromstring(raw)


def blank(text: str | None) -> bool:
    return not (text or "").strip()


def main_format(raw: bytes, found: list[Member]) -> str:
    """SRC-13: the format by the one main part that the content types name and the package holds."""
    try:
        root = safe_xml(raw)
    except (ElementTree.ParseError, ValueError) as e:
        raise Corrupt from e
    if root.tag != TYPES_NS + "Types" or root.attrib or not blank(root.text):
        raise Corrupt
    seen: set[tuple[str, str]] = set()
    mains = []
    for child in root:
        key = {TYPES_NS + "Default": "Extension", TYPES_NS + "Override": "PartName"}.get(child.tag, "")
        value, kind = child.get(key, ""), child.get("ContentType", "")
        if not key or len(child) or not blank(child.text) or not blank(child.tail) or set(child.attrib) != {key, "ContentType"} or not value or not kind:
            raise Corrupt
        if key == "Extension":
            value = value.lower()
        else:
            if value[0] != "/":
                raise Corrupt
            value, is_dir = canonical_name(value[1:])
            if is_dir:
                raise Corrupt
            if kind in MAIN_TYPES:
                mains.append((value, MAIN_TYPES[kind]))
        if (key, value) in seen:
            raise Corrupt
        seen.add((key, value))
    if len(mains) != 1 or mains[0][0] not in {m.name for m in found if not m.is_dir}:
        raise Corrupt
    return mains[0][1]


def zip_format(data: bytes, limits: Limits, clock: Clock) -> tuple[str, str | None]:
    """SRC-14: (format, evidence of a preflight finding)."""
    try:
        found = members(data, limits, clock)
    except (LimitExceeded, TimeoutError):
        return "ZIP", "RESOURCE_LIMIT_EXCEEDED"
    except Corrupt:
        return "UNKNOWN", "CORRUPT_DOCUMENT"
    types = next((m for m in found if m.name == CONTENT_TYPES), None)
    if types is None:
        return "ZIP", None
    if types.is_dir:
        return "ZIP", "CORRUPT_DOCUMENT"
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive, archive.open(CONTENT_TYPES) as part:
            raw = part.read(limits.member_bytes + 1)
        if len(raw) > limits.member_bytes:
            return "ZIP", "RESOURCE_LIMIT_EXCEEDED"
        return main_format(raw, found), None
    except Corrupt:
        return "ZIP", "CORRUPT_DOCUMENT"
    except (EOFError, OSError, RuntimeError, ValueError, KeyError, zipfile.BadZipFile, zipfile.LargeZipFile):
        return "UNKNOWN", "CORRUPT_DOCUMENT"


class Package:
    """SRC-15: a package's parts, after checks of its own and with bounded reads."""

    def __init__(self, data: bytes, limits: Limits):
        self.limits = limits
        self.archive = zipfile.ZipFile(io.BytesIO(data))
        self.parts: dict[str, zipfile.ZipInfo] = {}
        total = 0
        for info in self.archive.infolist():
            path = PurePosixPath(info.filename)
            total += info.file_size
            bad = (
                not info.filename
                or path.is_absolute()
                or ".." in path.parts
                or "\\" in info.filename
                or "\0" in info.filename
                or len(path.parts) > limits.depth
                or info.filename in self.parts
                or stat.S_ISLNK(info.external_attr >> 16)
                or max(info.file_size - limits.member_bytes, total - limits.uncompressed_bytes) > 0
                or info.file_size > RATIO_MOST * info.compress_size
            )
            if bad:
                raise Refused
            self.parts[info.filename] = info
        if len(self.parts) > limits.members:
            raise Refused

    def xml(self, name: str) -> ElementTree.Element:
        if name not in self.parts:
            raise Refused
        with self.archive.open(self.parts[name]) as part:
            raw = part.read(self.limits.member_bytes + 1)
        if len(raw) > self.limits.member_bytes:
            raise Refused
        return safe_xml(raw)

    def has_macro(self) -> bool:
        """OX-02."""
        return any(n.casefold().endswith("vbaproject.bin") for n in self.parts)

    def external_relationships(self, name: str, where: str) -> list[Finding]:
        """OX-01."""
        if name not in self.parts:
            return []
        outward = ("http:", "https:", "file:", "ftp:")
        links = [e for e in self.xml(name).iter() if e.tag.endswith("Relationship")]
        return [external(where, "EXTERNAL_RELATIONSHIP") for e in links if e.get("TargetMode", "").casefold() == "external" or e.get("Target", "").casefold().startswith(outward)]
