"""Formulas from placed symbols, canonical forms and token distances."""

import pytest

from rasterlake.functions import latex
from rasterlake.operators import formulas, scores


class Page:
    """A formula drawn symbol by symbol: boxes of a size, on a baseline, from left to right."""

    def __init__(self):
        self.symbols = []

    def glyph(self, ch, left, base, size, width=None, height=None):
        height = height or round(0.7 * size)
        self.symbols.append(dict(x=left, y=base - height, w=width or round(0.6 * size), h=height, ch=ch, kind="Glyph", scale=float(size), baseline=float(base), radicand_x=None))
        return self

    def row(self, text, left, base, size):
        for k, ch in enumerate(text):
            self.glyph(ch, left + k * size, base, size)
        return self

    def rule(self, left, top, width, height=2):
        self.symbols.append(dict(x=left, y=top, w=width, h=height, ch="-", kind="Bar", scale=0.0, baseline=0.0, radicand_x=None))
        return self

    def root(self, left, top, width, height, hook):
        self.symbols.append(dict(x=left, y=top, w=width, h=height, ch="", kind="Radical", scale=0.0, baseline=0.0, radicand_x=left + hook))
        return self


CASES = [
    # both scripts on one symbol: the lower one is written first
    (Page().glyph("z", 0, 60, 20).glyph("3", 14, 48, 11).glyph("k", 14, 66, 11), "z _ { k } ^ { 3 }"),
    # a script of a script
    (Page().row("bcd", 0, 60, 24).row("mn", 66, 46, 14).glyph("q", 94, 40, 8), "b c d ^ { m n ^ { q } }"),
    # a script with nothing before it hangs on an empty group
    (Page().glyph("s", 0, 66, 10).glyph("T", 12, 60, 20).glyph("U", 40, 60, 20), "{ } _ { s } T U"),
    # roots within roots
    (Page().root(0, 0, 70, 40, 10).root(20, 8, 40, 28, 10).glyph("m", 36, 30, 20), r"\sqrt { \sqrt { m } }"),
    (Page().root(0, 10, 60, 30, 10).row("u+", 14, 36, 16).glyph("w", 80, 36, 16), r"\sqrt { u + } w"),
    # an accent, and one on a symbol within a root
    (Page().glyph("→", 4, 38, 8, width=10, height=4).glyph("v", 2, 60, 22, height=18).row("=w", 40, 60, 22), r"\vec { v } = w"),
    (Page().root(0, 0, 60, 44, 10).glyph("^", 24, 18, 8, width=8, height=4).glyph("n", 22, 40, 22, height=18), r"\sqrt { \hat { n } }"),
    # fractions: in one another, and a lone rule
    (Page().row("p+q", 4, 30, 16).rule(0, 36, 56).glyph("r", 22, 56, 16), r"\frac { p + q } { r }"),
    (Page().rule(0, 40, 60).glyph("h", 2, 60, 16).glyph("t", 46, 60, 16).rule(20, 18, 18).glyph("f", 22, 14, 16).glyph("g", 22, 34, 16), r"\frac { \frac { f } { g } } { h t }"),
    (Page().glyph("e", 0, 40, 20).rule(20, 32, 12).glyph("d", 40, 40, 20), "e - d"),
    # a rule with content on one side only
    (Page().row("xy", 2, 30, 16).rule(0, 34, 34), r"\overline { x y }"),
    # limits over and under, of more than one symbol each; and one of them alone
    (Page().glyph("∏", 16, 60, 30, width=30, height=30).row("k=0", 16, 76, 10).glyph("N", 24, 24, 12).glyph("b", 70, 58, 24), r"\prod _ { k = 0 } ^ { N } b"),
    (Page().glyph("∑", 20, 60, 30, height=30).glyph("j", 28, 76, 10).glyph("c", 70, 58, 24), r"\sum _ { j } c"),
    # thin stems beside digits are ones, alone they are letters
    (Page().glyph("2", 0, 40, 16).glyph("l", 12, 40, 16, width=4).glyph("+", 30, 38, 16).glyph("I", 54, 40, 16, width=4).glyph("3", 62, 40, 16), "2 1 + 1 3"),
    (Page().row("al", 0, 40, 16), "a l"),
]


@pytest.mark.parametrize("page,tex", CASES)
def test_layouts(page, tex):
    assert formulas.formula(page.symbols) == tex
    assert formulas.formula(page.symbols[::-1]) == tex


def test_parsed_in_spark(spark):
    df = spark.createDataFrame([(k, page.symbols) for k, (page, _) in enumerate(CASES)] + [(99, None)], f"id int, s array<{formulas.SYMBOL}>")
    got = {r["id"]: r["tex"] for r in df.select("id", formulas.parsed(df["s"]).alias("tex")).collect()}
    assert got == {**{k: t for k, (_, t) in enumerate(CASES)}, 99: None}


def test_canonical_forms(spark):
    # sizes and spaces go, other names of a sign and braces around one token count as without
    assert latex.canonical(r"\Bigl[ \alpha \right] \quad \ne { \beta } _ { 7 }") == latex.canonical(r"\Bigl[ \alpha ] \neq \beta _ 7")
    assert latex.canonical(r"\vspace { 1 { pt } } m \kern n") == ["m", "n"]
    assert latex.canonical(r"\sqrt { } { { { g } } } { }") == [r"\sqrt", "{", "}", "g"]
    assert latex.canonical(r"\frac { } { 2 } { } \hspace { 3 { a } } . . . .") == [r"\frac", "{", "}", "2", r"\cdots", "."]
    assert latex.canonical("") == []
    assert latex.edit_distance("abcd", "xbd") == 2 and latex.edit_distance([], ["a"]) == 1
    rows = spark.createDataFrame([(1, r"\lbrack \gamma \rbrack ^ { 3 }", r"[ \gamma ] ^ 3"), (2, r"\frac { c } { d } + e", r"\frac { c } { f }")], "id int, gt string, pred string")
    s = scores.formula_score(rows).first()
    # symbols: [ gamma ] 3 and c d + e against [ gamma ] 3 and c f
    assert (s["n"], s["exact"], s["edits"], s["sym_tp"], s["sym_gt"], s["sym_pred"]) == (2, 1, 3, 5, 8, 6)
