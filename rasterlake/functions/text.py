"""Strings of readings: folding, priors, evidence, harmonising and escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters of each class, as the readings' rules name them.
COMMON_MARKS = ".,:;-/'()@&%$!?\"#+*€£’"
CASE_TWINS = "cosvwxzuCOSVWXZU"
NO_PLACEMENT = "cCoOsSvVwWxXzZuU0.,:;'\"`-_~=+*^°·•’“”|"
MARKS_TO_ASCII = {"»": ">", "«": "<", "’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-", "ı": "i"}

UPPER = "".join(chr(c) for c in (*range(0x41, 0x5B), *(c for c in range(0xC0, 0xDF) if c != 0xD7)))
LOWER = "".join(chr(ord(c) + 0x20) for c in UPPER)


def fold_case(s: Column) -> Column:
    """Lower case of A-Z and of Latin-1 capitals only."""
    return F.translate(s, UPPER, LOWER)


def ascii_marks(s: Column) -> Column:
    """Typographic marks as ASCII, and a dotless i as i."""
    return F.translate(s, "".join(MARKS_TO_ASCII), "".join(MARKS_TO_ASCII.values()))


def prior(ch: Column) -> Column:
    """What a character costs by its rarity: letters and digits nothing, common marks and accents some, others much."""
    accented = (ch >= "À") & (ch <= "ÿ") & (ch != "×")
    return F.when(ch.rlike("^[a-zA-Z0-9ı]$"), 0.0).when(F.instr(F.lit(COMMON_MARKS), ch) > 0, 1.5).when(accented, 2.5).otherwise(6.0)


def placement_ambiguous(ch: Column) -> Column:
    return F.instr(F.lit(NO_PLACEMENT), ch) > 0


def alnum_share(s: Column) -> Column:
    """The share of letters (to Latin Extended-A) and digits among a text's characters; 0 for an empty one."""
    n = F.length(s)
    return F.when(n > 0, F.length(F.regexp_replace(s, "[^a-zA-Z0-9À-ſ]", "")) / n).otherwise(F.lit(0.0))


def confidence(glyphs: Column, mean_dist: Column, alnum: Column, fitted: Column, residual: Column, most_dist: float = 22.0, most_residual: float = 0.5, least_glyphs: int = 3) -> Column:
    """How much a reading looks like text, from 0 to 1: shape, letters, fit to a line, and length."""
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    shape = clamp(1 - mean_dist / most_dist)
    fit = F.when(fitted, clamp(1 - residual / most_residual)).otherwise(F.lit(0.5))
    count = F.least(F.lit(1.0), glyphs / max(1, least_glyphs))
    return F.when(glyphs == 0, 0.0).otherwise(clamp(0.35 * shape + 0.35 * alnum + 0.15 * fit + 0.15 * count))


def verified(glyphs: Column, mean_dist: Column, alnum: Column, fitted: Column, residual: Column, most_dist: float = 22.0, most_residual: float = 0.5, least_glyphs: int = 3, least_alnum: float = 0.7) -> Column:
    """Whether a reading passes as text."""
    return (glyphs >= least_glyphs) & (alnum >= least_alnum) & (mean_dist <= most_dist) & (~fitted | (residual <= most_residual))


def escape(s: Column) -> Column:
    r"""Backslash, tab and line feed as \\, \t and \n."""
    return F.replace(F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n"))


def unescape(s: Column) -> Column:
    r"""The inverse of escape(); an escaped backslash is set aside while the others are undone."""
    aside = F.lit("\x00")
    t = F.replace(s, F.lit("\\\\"), aside)
    return F.replace(F.replace(F.replace(t, F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n")), aside, F.lit("\\"))


def one_line(s: Column) -> Column:
    """Tabs and line feeds as blanks."""
    return F.translate(s, "\t\n", "  ")


def harmonized(word: str) -> str:
    """A word with look-alikes settled by context, without a dictionary.

    Among digits only, look-alikes of 0, 1 and 5 are digits. Among letters, they are letters, and letters whose capital
    has the same shape follow the case of the others; a capital at the start may stay.
    """
    digits = sum(c in "23456789" for c in word)
    upper = sum("A" <= c <= "Z" and c not in CASE_TWINS and c != "I" for c in word)
    lower = sum("a" <= c <= "z" and c not in CASE_TWINS and c != "l" for c in word)
    letters = upper + lower
    if digits and not letters:
        return word.translate(str.maketrans("oOlI|sS", "0011155"))
    low = lower >= upper
    out = []
    for i, c in enumerate(word):
        if c == "5" and digits == 1 and letters >= 2:
            c = "s" if low else "S"
        if letters:
            if c == "0":
                c = "o" if low else "O"
            elif c == "1" and letters > digits:
                c = "l" if low else "I"
            elif c in CASE_TWINS:
                if not low:
                    c = c.upper()
                elif i or not lower:
                    c = c.lower()
            elif c in "ÍÌÎÏ" and low and i:
                c = "i"
            elif c == "I" and low and i:
                c = "l"
            elif c == "l" and not low:
                c = "I"
        out.append(c)
    return "".join(out)


def harmonize(word: Column) -> Column:
    @F.arrow_udf("string")
    def run(words):
        import pyarrow as pa

        return pa.array([None if w is None else harmonized(w) for w in words.to_pylist()], pa.string())

    return run(word)


def decoded_utf8(data: bytes) -> str:
    """Text of UTF-8 that may be broken: a byte that can't begin a character is U+FFFD, and so is a tail that is cut off.

    What follows a leading byte isn't checked, and counts by its lower six bits.
    """
    out, at = [], 0
    while at < len(data):
        lead = data[at]
        more = 0 if lead < 0x80 else 1 if lead >> 5 == 6 else 2 if lead >> 4 == 14 else 3 if lead >> 3 == 30 else -1
        if more >= 0 and at + more >= len(data):
            out.append("\ufffd")
            break
        point = 0xFFFD if more < 0 else lead if not more else lead & (0x3F >> more)
        for b in data[at + 1 : at + 1 + max(0, more)]:
            point = point << 6 | b & 0x3F
        out.append(chr(point) if point < 0x110000 else "\ufffd")
        at += 1 + max(0, more)
    return "".join(out)


def decode_utf8(data: Column) -> Column:
    """decoded_utf8() of a binary column; null stays null."""

    @F.arrow_udf("string")
    def run(values):
        import pyarrow as pa

        return pa.array([None if v is None else decoded_utf8(v).encode("utf-8", "replace").decode() for v in values.to_pylist()], pa.string())

    return run(data)
