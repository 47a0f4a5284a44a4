"""CSS as far as hiding text needs it, after CSS Syntax Level 3 and CSS Color 4.

``tokens`` reads a style text into nested component values; ``rules`` and
``declarations`` group them. A token of kind "error" (bad string, bad url,
stray closing bracket) makes a document fail. ``Proof`` says whether a
declaration leaves text visible, hides it, or cannot be decided.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from enum import Enum

# The colour names of CSS Color 4.
COLOURS = frozenset(
    """aliceblue antiquewhite aqua aquamarine azure beige bisque black blanchedalmond blue blueviolet brown burlywood cadetblue
    chartreuse chocolate coral cornflowerblue cornsilk crimson cyan darkblue darkcyan darkgoldenrod darkgray darkgreen darkgrey
    darkkhaki darkmagenta darkolivegreen darkorange darkorchid darkred darksalmon darkseagreen darkslateblue darkslategray
    darkslategrey darkturquoise darkviolet deeppink deepskyblue dimgray dimgrey dodgerblue firebrick floralwhite forestgreen
    fuchsia gainsboro ghostwhite gold goldenrod gray green greenyellow grey honeydew hotpink indianred indigo ivory khaki lavender
    lavenderblush lawngreen lemonchiffon lightblue lightcoral lightcyan lightgoldenrodyellow lightgray lightgreen lightgrey
    lightpink lightsalmon lightseagreen lightskyblue lightslategray lightslategrey lightsteelblue lightyellow lime limegreen linen
    magenta maroon mediumaquamarine mediumblue mediumorchid mediumpurple mediumseagreen mediumslateblue mediumspringgreen
    mediumturquoise mediumvioletred midnightblue mintcream mistyrose moccasin navajowhite navy oldlace olive olivedrab orange
    orangered orchid palegoldenrod palegreen paleturquoise palevioletred papayawhip peachpuff peru pink plum powderblue purple
    rebeccapurple red rosybrown royalblue saddlebrown salmon sandybrown seagreen seashell sienna silver skyblue slateblue slategray
    slategrey snow springgreen steelblue tan teal thistle tomato turquoise violet wheat white whitesmoke yellow yellowgreen""".split()
)
#: Properties whose value may hide text, so that var() in them leaves it undecided.
HIDING = frozenset({"display", "visibility", "opacity", "font-size", "color", "background-color", "transform", "left", "right", "top", "bottom", "text-indent", "filter"})
OFFSETS = frozenset({"left", "right", "top", "bottom", "text-indent"})
FAR = 1000

_ESCAPE = r"\\(?:[0-9a-fA-F]{1,6}(?:\r\n|[ \t\n\r\f])?|[^\n\r\f0-9a-fA-F])"
_START = rf"(?:[A-Za-z_\u0080-\U0010ffff]|{_ESCAPE})"
_REST = rf"(?:[A-Za-z0-9_\-\u0080-\U0010ffff]|{_ESCAPE})"
_IDENT = rf"(?:--{_REST}*|-?{_START}{_REST}*)"
_TOKEN = re.compile(
    rf"""(?P<comment>/\*.*?(?:\*/|\Z))|(?P<space>[ \t\n\r\f]+)|(?P<string>["'])
    |(?P<number>[+-]?(?:[0-9]*\.)?[0-9]+(?:[eE][+-]?[0-9]+)?)(?:(?P<unit>{_IDENT})|(?P<percent>%))?
    |(?P<cdo><!--)|(?P<cdc>-->)
    |(?P<ident>{_IDENT})(?P<call>\()?|(?P<at>@{_IDENT})|\#(?P<hash>{_REST}+)|(?P<open>[(\[{{])|(?P<close>[)\]}}])|(?P<other>.)""",
    re.S | re.X,
)
_UNESCAPE = re.compile(r"\\(?:([0-9a-fA-F]{1,6})(?:\r\n|[ \t\n\r\f])?|(\r\n|[\n\r\f])|(.)|\Z)", re.S)
_URL_BODY = re.compile(rf"[ \t\n\r\f]*((?:[^\"'()\\ \t\n\r\f\x00-\x08\x0b\x0e-\x1f\x7f]|{_ESCAPE})*)[ \t\n\r\f]*(\)|\Z)")
_QUOTED_URL = re.compile("[ \t\n\r\f]*[\"']")
_CLOSERS = {"(": ")", "[": "]", "{": "}"}


class Proof(Enum):
    VISIBLE = 0
    HIDDEN = 1
    UNCERTAIN = 2


@dataclass
class Token:
    kind: str
    value: object = ""
    unit: str = ""
    inside: list[Token] = field(default_factory=list)

    @property
    def lower(self) -> str:
        return str(self.value).lower()

    def text(self) -> str:
        if self.kind == "function":
            return f"{self.value}({serialise(self.inside)})"
        if self.kind == "block":
            return f"{self.value}{serialise(self.inside)}{_CLOSERS[str(self.value)]}"
        if self.kind == "string":
            return f'"{self.value}"'
        if self.kind == "url":
            return f"url({self.value})"
        return {"hash": "#", "at": "@"}.get(self.kind, "") + str(self.value) + ("%" if self.kind == "percentage" else self.unit)


def serialise(values: list[Token]) -> str:
    return "".join(v.text() for v in values)


def significant(values: list[Token]) -> list[Token]:
    return [v for v in values if v.kind != "space"]


def _plain(raw: str) -> str:
    def one(m: re.Match) -> str:
        if m[1]:
            code = int(m[1], 16)
            return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else "\ufffd"
        return m[3] or ""

    return _UNESCAPE.sub(one, raw)


def _string(css: str, at: int) -> tuple[list[Token], int]:
    """The string whose quote ends before ``at``; a line feed in it, or the end of the text, is an error."""
    body = re.compile(rf"(?:[^\\\n\r\f{css[at - 1]}]|\\(?:\r\n|.|\Z))*", re.S).match(css, at)
    end = body.end()
    if css[end : end + 1] == css[at - 1]:
        return [Token("string", _plain(body[0]))], end + 1
    return [Token("error")] if end < len(css) else [Token("string", _plain(body[0])), Token("error")], end


def _url(css: str, at: int) -> tuple[list[Token], int]:
    """The unquoted address after ``url(``; one that cannot be is an error up to its closing bracket."""
    m = _URL_BODY.match(css, at)
    if m:
        return [Token("url", _plain(m[1]))] + ([] if m[2] else [Token("error")]), m.end()
    end = re.compile(r"(?:[^)\\]|\\.|\\\Z)*\)?", re.S).match(css, at).end()
    return [Token("error")], end


def tokens(css: str) -> list[Token]:
    """Component values, without comments."""
    css = css.replace("\r\n", "\n").replace("\r", "\n").replace("\f", "\n").replace("\0", "\ufffd")
    out: list[Token] = []
    stack: list[tuple[list[Token], str]] = []
    now, closer, at = out, "", 0
    while at < len(css):
        m = _TOKEN.match(css, at)
        at = m.end()
        kind = m.lastgroup
        if kind == "comment":
            continue
        if m["space"]:
            now.append(Token("space", " "))
        elif m["string"]:
            found, at = _string(css, at)
            now += found
        elif m["number"]:
            kind = "dimension" if m["unit"] else "percentage" if m["percent"] else "number"
            now.append(Token(kind, float(m["number"]), _plain(m["unit"] or "").lower()))
        elif m["ident"] and m["call"]:
            name = _plain(m["ident"])
            if name.lower() == "url" and not _QUOTED_URL.match(css, at):
                found, at = _url(css, at)
                now += found
            else:
                now.append(Token("function", name))
                stack.append((now, closer))
                now, closer = now[-1].inside, ")"
        elif m["ident"]:
            now.append(Token("ident", _plain(m["ident"])))
        elif m["at"]:
            now.append(Token("at", _plain(m["at"][1:])))
        elif m["hash"]:
            now.append(Token("hash", _plain(m["hash"])))
        elif m["open"]:
            now.append(Token("block", m["open"]))
            stack.append((now, closer))
            now, closer = now[-1].inside, _CLOSERS[m["open"]]
        elif m["close"]:
            if m["close"] == closer:
                now, closer = stack.pop()
            else:
                now.append(Token("error"))
        else:
            now.append(Token("literal", m[0]))
    return out


@dataclass
class Declaration:
    name: str
    value: list[Token]


def _declaration(values: list[Token]) -> Declaration:
    """``name: value``, without a final !important; anything else is invalid."""
    body = significant(values)
    if len(body) < 2 or body[0].kind != "ident" or (body[1].kind, body[1].value) != ("literal", ":"):
        raise ValueError("invalid CSS declaration")
    value = values[next(i for i, v in enumerate(values) if v is body[1]) + 1 :]
    tail = significant(value)[-2:]
    if len(tail) == 2 and (tail[0].kind, tail[0].value) == ("literal", "!") and tail[1].kind == "ident" and tail[1].lower == "important":
        value = value[: next(i for i, v in enumerate(value) if v is tail[0])]
    return Declaration(body[0].lower, value)


def declarations(values: list[Token]) -> Iterator[Declaration]:
    """The declarations of a list; at-rules in it are passed over."""
    part: list[Token] = []
    in_rule = False
    for v in [*values, Token("literal", ";")]:
        if in_rule:
            in_rule = not ((v.kind, v.value) in (("literal", ";"), ("block", "{")))
        elif (v.kind, v.value) == ("literal", ";"):
            if significant(part):
                yield _declaration(part)
            part = []
        elif v.kind == "at" and not significant(part):
            in_rule, part = True, []
        else:
            part.append(v)


@dataclass
class Rule:
    """A qualified rule, or an at-rule with its keyword."""

    keyword: str
    prelude: list[Token]
    body: list[Token]


def rules(values: list[Token]) -> Iterator[Rule]:
    prelude: list[Token] = []
    keyword = ""
    for v in values:
        if not keyword and not significant(prelude) and (v.kind == "space" or (v.kind == "literal" and v.value in ("<!--", "-->"))):
            continue
        if not keyword and not prelude and v.kind == "at":
            keyword = v.lower
        elif (v.kind, v.value) == ("block", "{") or (keyword and (v.kind, v.value) == ("literal", ";")):
            yield Rule(keyword, prelude, v.inside)
            keyword, prelude = "", []
        else:
            prelude.append(v)
    if keyword:
        yield Rule(keyword, prelude, [])
    elif significant(prelude):
        raise ValueError("invalid CSS stylesheet")


def urls(values: list[Token]) -> Iterator[str]:
    """Every address in some values; an error among them fails the document."""
    for v in values:
        if v.kind == "error":
            raise ValueError("invalid CSS token")
        if v.kind == "url":
            yield str(v.value)
        elif v.kind == "function":
            if v.lower == "url":
                yield str(v.inside[0].value) if len(v.inside) == 1 and v.inside[0].kind == "string" else serialise(v.inside).strip().strip("'\"")
            yield from urls(v.inside)


def has_var(values: list[Token]) -> bool:
    return any(v.kind == "function" and (v.lower == "var" or has_var(v.inside)) for v in values)


def opaque(value: float | None, full: float = 1) -> Proof:
    if value is None or not math.isfinite(value):
        return Proof.UNCERTAIN
    return Proof.VISIBLE if value >= full else Proof.HIDDEN


def opacity(values: list[Token]) -> Proof:
    one = significant(values)
    if len(one) != 1 or one[0].kind not in ("number", "percentage"):
        return Proof.UNCERTAIN
    return opaque(one[0].value, 100 if one[0].kind == "percentage" else 1)


def _channels(name: str, three: list[Token]) -> bool:
    """Whether three values are literal channels of rgb or hsl."""
    kinds = [v.kind for v in three]
    if name.startswith("rgb"):
        return all(k in ("number", "percentage") for k in kinds)
    hue = kinds[0] == "number" or (kinds[0] == "dimension" and three[0].unit in ("deg", "grad", "rad", "turn"))
    return hue and kinds[1:] == ["percentage", "percentage"]


def colour(values: list[Token]) -> Proof:
    one = significant(values)
    if len(one) != 1:
        return Proof.UNCERTAIN
    v = one[0]
    if v.kind == "ident":
        return Proof.HIDDEN if v.lower == "transparent" else Proof.VISIBLE if v.lower in COLOURS else Proof.UNCERTAIN
    if v.kind == "hash":
        digits = str(v.value)
        if not re.fullmatch("[0-9a-fA-F]+", digits) or len(digits) not in (3, 4, 6, 8):
            return Proof.UNCERTAIN
        alpha = {4: digits[3:] * 2, 8: digits[6:]}.get(len(digits), "ff")
        return opaque(int(alpha, 16) / 255)
    if v.kind != "function" or v.lower not in ("rgb", "rgba", "hsl", "hsla"):
        return Proof.UNCERTAIN
    signs = [x.value for x in v.inside if x.kind == "literal" and x.value in ("/", ",")]
    if signs.count("/") > 1 or ("/" in signs and "," in signs):
        return Proof.UNCERTAIN
    groups: list[list[Token]] = [[]]
    for x in v.inside:
        if x.kind == "literal" and x.value in ("/", ","):
            groups.append([])
        elif x.kind != "space":
            groups[-1].append(x)
    if "," not in signs:
        if len(groups[0]) != 3 or not _channels(v.lower, groups[0]):
            return Proof.UNCERTAIN
        return opacity(groups[1]) if signs else Proof.VISIBLE
    if len(groups) not in (3, 4) or any(len(g) != 1 for g in groups[:3]) or not _channels(v.lower, [g[0] for g in groups[:3]]):
        return Proof.UNCERTAIN
    with_alpha = v.lower.endswith("a")
    if len(groups) == 3:
        return Proof.UNCERTAIN if with_alpha else Proof.VISIBLE
    return opacity(groups[3]) if with_alpha else Proof.UNCERTAIN


def filters(values: list[Token]) -> Proof:
    all_ = significant(values)
    if len(all_) == 1 and all_[0].kind == "ident":
        return Proof.VISIBLE if all_[0].lower == "none" else Proof.UNCERTAIN
    out = Proof.VISIBLE if all_ else Proof.UNCERTAIN
    for v in all_:
        if v.kind != "function":
            return Proof.UNCERTAIN
        found = opacity(v.inside) if v.lower == "opacity" else Proof.UNCERTAIN
        if found is Proof.HIDDEN:
            return found
        out = Proof.UNCERTAIN if found is Proof.UNCERTAIN else out
    return out


def hides(d: Declaration) -> tuple[bool, bool]:
    """HT-05: (hidden, undecided) of a declaration; what is undecided is hidden as well."""
    text = serialise(d.value).strip().casefold()
    one = significant(d.value)
    proof = {"opacity": opacity, "color": colour, "background-color": colour, "filter": filters}.get(d.name, lambda _: Proof.VISIBLE)(d.value)
    undecided = proof is Proof.UNCERTAIN or (d.name in HIDING and has_var(d.value))
    hidden = (
        undecided
        or proof is Proof.HIDDEN
        or (d.name == "display" and text == "none")
        or (d.name == "visibility" and text in ("hidden", "collapse"))
        or (d.name == "font-size" and len(one) == 1 and one[0].kind in ("number", "percentage", "dimension") and one[0].value == 0)
        or (d.name == "transform" and "translate" in text)
        or (d.name in OFFSETS and any(v.kind in ("dimension", "percentage") and abs(v.value) >= FAR for v in d.value))
    )
    return hidden, undecided
