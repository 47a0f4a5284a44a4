"""Text rules as Columns: controls, instruction patterns, encoded blocks, lines.

All of it is evaluated in the JVM. The one thing Spark lacks is NFKC: texts of a
stable alphabet (ASCII and the Latin-1 letters that NFKC leaves alone) are their
own normal form, so ``stable`` tells which rows may stay here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two registered sets of invisible characters.
BIDI = "\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff"
#: Characters of U+0080-U+00FF that NFKC changes, or that combine with others.
UNSTABLE_LATIN = "\\u00a0\\u00a8\\u00aa\\u00af\\u00b2-\\u00b5\\u00b8-\\u00ba\\u00bc-\\u00be"
WHITE = r"\t-\r\x1c-\x1f\x85\p{Z}"
DISALLOWED = r"[\p{Cc}\p{Cf}&&[^\t\n\r]]"
BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
ALPHABET = "A-Za-z0-9+/=_\\-"
RUN = f"[{ALPHABET}][{ALPHABET}{WHITE}]*"
RUN_LEAST, DECODE_MOST = 80, 8192
#: Letters with a mark whose case folding begins with an ASCII letter though lower() keeps them whole.
FOLDS = {"\u00df": "ss", "\u01f0": "j\u030c", "\u1e96": "h\u0331", "\u1e97": "t\u0308", "\u1e98": "w\u030a", "\u1e99": "y\u030a"}


# The four instruction patterns, with S for white space, between word borders.
INSTRUCTION_PATTERNS = (
    "ignoreS(?:(?:all|any)S)?(?:previous|prior|above)S(?:instructions?|directions?)",
    "(?:disregard|override|bypass)S(?:theS)?(?:previous|prior|system|developer)",
    "(?:reveal|show|print|exfiltrate)S(?:theS)?(?:system|developer)S(?:prompt|instructions?)",
    "youSareSnow",
)


def instruction_pattern(white: str, before: str, after: str) -> str:
    """The patterns as one expression of any dialect, given its white space and word borders."""
    return f"{before}(?:{'|'.join(INSTRUCTION_PATTERNS).replace('S', white)}){after}"


INSTRUCTION = instruction_pattern(r"[\t\n\r\p{Z}]+", r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])")

def stable(text: Column) -> Column:
    """Whether a text is its own NFKC: Latin-1 without the letters that change, and the registered controls."""
    return text.rlike(rf"\A(?:[\x00-\xff&&[^{UNSTABLE_LATIN}]]|[{BIDI}{ZERO_WIDTH}])*+\z")


def strip_controls(text: Column) -> Column:
    """TXT-01: without the registered directional and zero-width characters."""
    return F.translate(text, BIDI + ZERO_WIDTH, "")


def drop_controls(text: Column) -> Column:
    """TXT-02 after NFKC: without any control or format character but tab, LF and CR."""
    return F.regexp_replace(strip_controls(text), DISALLOWED, "")


def has_bidi(text: Column) -> Column:
    return text.rlike(f"[{BIDI}]")


def has_zero_width(text: Column) -> Column:
    return text.rlike(f"[{ZERO_WIDTH}]")


def anomalies(text: Column) -> Column:
    """TXT-03: the anomaly codes of a text."""
    return F.array_compact(F.array(F.when(has_bidi(text), F.lit("BIDI_CONTROL_CHARACTERS")), F.when(has_zero_width(text), F.lit("ZERO_WIDTH_CHARACTERS"))))


def has_disallowed(text: Column) -> Column:
    """TXT-04."""
    return text.rlike(DISALLOWED)


def casefold(text: Column) -> Column:
    """Case folding as far as ASCII patterns can tell."""
    out = F.lower(text)
    for letter, folded in FOLDS.items():
        out = F.replace(out, F.lit(letter), F.lit(folded))
    return out


def is_instruction(text: Column) -> Column:
    """TXT-05 on a text in normal form: whether any instruction pattern is in it."""
    return casefold(drop_controls(text)).rlike(INSTRUCTION)


def lines(text: Column) -> Column:
    """TXT-08: the lines, without an empty one at the end."""
    parts = F.split(text, BREAKS)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def runs(text: Column) -> Column:
    """The stretches of the encoding alphabet and white space that can be long enough."""
    return F.filter(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), lambda r: F.length(r) >= RUN_LEAST)


def payload(run: Column) -> Column:
    return F.length(F.regexp_replace(run, f"[{WHITE}]", ""))


def decode_block(encoded: Column) -> Column:
    """TXT-06: strict Base64 of either alphabet, padded, as strict UTF-8; null if it is not."""
    compact = F.translate(F.regexp_replace(encoded, f"[{WHITE}]", ""), "-_", "+/")
    n = F.length(compact)
    padded = F.concat(compact, F.repeat(F.lit("="), F.pmod(-n, F.lit(4))))
    raw = F.when((n <= DECODE_MOST) & (n % 4 != 1), F.try_to_binary(padded, F.lit("base64")))
    return F.when(F.is_valid_utf8(raw), F.decode(raw, "UTF-8"))


def run_risk(run: Column) -> Column:
    """TXT-07: rank of a run's finding, null for none; -1 if the decoded text leaves the stable alphabet (``operators.parse.run_rank`` ranks that too)."""
    n = payload(run)
    white = F.length(run) - n
    decoded = F.when(n <= DECODE_MOST, decode_block(F.substring(run, 1, DECODE_MOST)))
    longest = F.array_max(F.transform(F.split(run, f"[/{WHITE}]"), F.length))
    plain = decoded.isNull() & ~run.rlike("[+=]") & (longest < RUN_LEAST)
    return (
        F.when(n < RUN_LEAST, None)
        .when(white > F.floor(n / 2), F.lit(2))
        .when(plain, None)
        .when(decoded.isNotNull() & ~stable(decoded), F.lit(-1))
        .when(decoded.isNotNull() & is_instruction(decoded), F.lit(2))
        .otherwise(F.lit(1))
    )


def run_risks(text: Column) -> Column:
    """The ranks of all findings of a text's runs."""
    return F.array_compact(F.transform(runs(text), run_risk))
