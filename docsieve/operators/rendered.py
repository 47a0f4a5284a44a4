"""PDF, image and rendered-presentation rules over adapters (PD-*, IM-01, PX-03).

Readers, renderers and text recognition are not part of this engine: a job may
give callables for them (``Adapters``). Without the one that a format needs, its
documents are quarantined as SCANNER_DEPENDENCY_UNAVAILABLE.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from ..plans.contract import QUARANTINE, Limits
from .office import PPTX_CHECKS, pptx_structure
from .rules import Clock, Finding, LimitExceeded, Parsed, Unavailable, active, external, instructions, mismatch, normalise

PDF_CHECKS = ["pdf-ocr", "pdf-render", "pdf-structure"]
IMAGE_CHECKS = ["image-decode", "image-metadata", "image-ocr"]
# Dictionary keys of a PDF that run something.
ACTIVE_KEYS = frozenset({"/AA", "/OpenAction", "/JS", "/JavaScript", "/Launch", "/RichMedia", "/XFA"})
OBJECTS_MOST = 50_000
TINY, NEARLY_WHITE = 4.0, 0xFAFAFA
Box = tuple[float, float, float, float]


@dataclass
class Span:
    size: float
    colour: int
    box: Box
    text: str


@dataclass
class RenderedPage:
    """A page's picture, and the text layer it claims to show."""

    picture: bytes
    pixels: int
    rect: Box = (0, 0, 0, 0)
    layer: str = ""
    spans: list[Span] = field(default_factory=list)


@dataclass
class Pdf:
    """``dictionaries`` gives the key sets of all reachable objects, one each; ``locked`` says that nothing can be read without a password."""

    encrypted: bool
    dictionaries: Iterable[frozenset[str]]
    pages: list[RenderedPage]
    locked: bool = False


@dataclass
class Picture:
    kind: str
    width: int
    height: int
    metadata: list[str]
    least_alpha: int
    on_white: bytes
    on_black: bytes


@dataclass(frozen=True)
class Adapters:
    """What a job can bring along; each callable must be picklable."""

    ocr: Callable[[bytes], str] | None = None
    pdf: Callable[[bytes], Pdf] | None = None
    picture: Callable[[bytes], Picture] | None = None
    presentation: Callable[[bytes], list[RenderedPage]] | None = None

    def need(self, *names: str) -> None:
        if any(getattr(self, n) is None for n in names):
            raise Unavailable


def intersects(a: Box, b: Box) -> bool:
    return min(a[2], b[2]) > max(a[0], b[0]) and min(a[3], b[3]) > max(a[1], b[1])


def span_anomaly(span: Span, page: Box) -> str | None:
    """PD-02."""
    if span.size < TINY:
        return "TINY_TEXT"
    if span.colour & 0xFFFFFF >= NEARLY_WHITE:
        return "WHITE_ON_WHITE_TEXT"
    return None if intersects(page, span.box) else "OFF_CANVAS_TEXT"


def pdf_structure(document: Pdf, limits: Limits) -> list[Finding]:
    """PD-01."""
    whole = "file:structure"
    out: list[Finding] = []
    for n, keys in enumerate(document.dictionaries):
        if n >= min(limits.members, OBJECTS_MOST):
            raise LimitExceeded
        if keys & ACTIVE_KEYS:
            out.append(active(whole, "SCRIPT_CONTENT"))
        if "/EmbeddedFiles" in keys:
            out.append(active(whole))
        if keys & {"/URI", "/GoToR"}:
            out.append(external(whole, "EXTERNAL_RELATIONSHIP"))
    return out


def _bounded(pages: list[RenderedPage], limits: Limits) -> None:
    if len(pages) > limits.pages or any(p.pixels > limits.pixels for p in pages):
        raise LimitExceeded


def pdf(data: bytes, limits: Limits, clock: Clock, adapters: Adapters) -> Parsed:
    """PD-03."""
    adapters.need("ocr", "pdf")
    document = adapters.pdf(data)
    encrypted: list[Finding] = [(QUARANTINE, "ENCRYPTED_DOCUMENT", "file:structure", None)] if document.encrypted else []
    if document.locked:
        return Parsed(encrypted, "", PDF_CHECKS, PDF_CHECKS)
    findings, shown = encrypted + pdf_structure(document, limits), []
    _bounded(document.pages, limits)
    for number, page in enumerate(document.pages, 1):
        clock.check()
        where = f"pdf:page={number}:object=1"
        seen, layer = normalise(adapters.ocr(page.picture)), normalise(page.layer)
        shown.append(seen)
        findings += instructions(seen, where, hidden=False)
        if layer.strip() != seen.strip():
            findings.append(mismatch(where, "OCR_TEXT_LAYER_MISMATCH"))
        unseen = [(s.text, why) for s in page.spans if (why := span_anomaly(s, page.rect))]
        findings += [mismatch(where, why) for _, why in unseen]
        findings += instructions(" ".join(text for text, _ in unseen), where, hidden=True)
        if layer not in seen:
            findings += instructions(layer, where, hidden=True)
    return Parsed(findings, normalise("\n\n".join(shown)), PDF_CHECKS, PDF_CHECKS)


def pptx(data: bytes, limits: Limits, clock: Clock, adapters: Adapters) -> Parsed:
    """PX-03."""
    adapters.need("ocr", "presentation")
    findings, shown = pptx_structure(data, limits), []
    pages = adapters.presentation(data)
    _bounded(pages, limits)
    for number, page in enumerate(pages, 1):
        clock.check()
        shown.append(normalise(adapters.ocr(page.picture)))
        findings += instructions(shown[-1], f"pptx:slide={number}:shape=1", hidden=False)
    return Parsed(findings, normalise("\n\n".join(shown)), PPTX_CHECKS, PPTX_CHECKS)


def image(data: bytes, kind: str, limits: Limits, clock: Clock, adapters: Adapters) -> Parsed:
    """IM-01."""
    adapters.need("ocr", "picture")
    where, picture = "image:region=1", adapters.picture(data)
    if min(picture.width, picture.height) < 1 or picture.width * picture.height > limits.pixels:
        raise LimitExceeded
    if picture.kind != kind:
        raise ValueError("image format")
    findings = instructions(" ".join(picture.metadata)[: limits.member_bytes], "file:metadata", hidden=True)
    seen = adapters.ocr(picture.on_white)
    if picture.least_alpha < 255:
        findings.append(mismatch(where, "TRANSPARENT_TEXT"))
        other = adapters.ocr(picture.on_black)
        if normalise(other).strip() != normalise(seen).strip():
            findings += [mismatch(where, "OCR_TEXT_LAYER_MISMATCH"), *instructions(other, where, hidden=True)]
    findings += instructions(seen, where, hidden=False)
    clock.check()
    return Parsed(findings, normalise(seen), IMAGE_CHECKS, IMAGE_CHECKS)
