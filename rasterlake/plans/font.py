"""A small bitmap font of capitals and digits, for frames with text in them: glyphs of 5 by 7, and drawn lines."""

from __future__ import annotations

from functools import cache

import numpy as np

#: Rows from top to bottom, five dots each.
GLYPHS = {
    "A": ".###. #...# #...# ##### #...# #...# #...#", "B": "####. #...# #...# ####. #...# #...# ####.", "C": ".#### #.... #.... #.... #.... #.... .####",
    "D": "####. #...# #...# #...# #...# #...# ####.", "E": "##### #.... #.... ####. #.... #.... #####", "F": "##### #.... #.... ####. #.... #.... #....",
    "G": ".#### #.... #.... #..## #...# #...# .####", "H": "#...# #...# #...# ##### #...# #...# #...#", "I": "##### ..#.. ..#.. ..#.. ..#.. ..#.. #####",
    "J": "....# ....# ....# ....# #...# #...# .###.", "K": "#...# #..#. #.#.. ##... #.#.. #..#. #...#", "L": "#.... #.... #.... #.... #.... #.... #####",
    "M": "#...# ##.## #.#.# #.#.# #...# #...# #...#", "N": "#...# ##..# ##..# #.#.# #..## #..## #...#", "O": ".###. #...# #...# #...# #...# #...# .###.",
    "P": "####. #...# #...# ####. #.... #.... #....", "Q": ".###. #...# #...# #...# #.#.# #..#. .##.#", "R": "####. #...# #...# ####. #.#.. #..#. #...#",
    "S": ".#### #.... #.... .###. ....# ....# ####.", "T": "##### ..#.. ..#.. ..#.. ..#.. ..#.. ..#..", "U": "#...# #...# #...# #...# #...# #...# .###.",
    "V": "#...# #...# #...# #...# .#.#. .#.#. ..#..", "W": "#...# #...# #...# #.#.# #.#.# ##.## #...#", "X": "#...# #...# .#.#. ..#.. .#.#. #...# #...#",
    "Y": "#...# #...# .#.#. ..#.. ..#.. ..#.. ..#..", "Z": "##### ....# ...#. ..#.. .#... #.... #####",
    "0": ".###. #...# #..## #.#.# ##..# #...# .###.", "1": "..#.. .##.. ..#.. ..#.. ..#.. ..#.. .###.", "2": ".###. #...# ....# ...#. ..#.. .#... #####",
    "3": "##### ...#. ..#.. ...#. ....# #...# .###.", "4": "...#. ..##. .#.#. #..#. ##### ...#. ...#.", "5": "##### #.... ####. ....# ....# #...# .###.",
    "6": "..##. .#... #.... ####. #...# #...# .###.", "7": "##### ....# ...#. ..#.. ..#.. ..#.. ..#..", "8": ".###. #...# #...# .###. #...# #...# .###.",
    "9": ".###. #...# #...# .#### ....# ...#. .##..",
}
ROWS, COLUMNS = 7, 5


@cache
def bitmap(ch: str, scale: int) -> np.ndarray:
    """A glyph as a mask, each dot a square of scale pixels; made once, and not to be written to."""
    dots = np.array([[c == "#" for c in row] for row in GLYPHS[ch].split(" ")]).repeat(scale, 0).repeat(scale, 1)
    dots.flags.writeable = False
    return dots


def line(text: str, scale: int) -> np.ndarray:
    """A line as a mask: one dot between glyphs, three more for a blank; characters without a glyph are blanks."""
    out = np.zeros((ROWS * scale, max(1, scale * sum(COLUMNS + 1 if c in GLYPHS else 3 for c in text))), bool)
    x = 0
    for c in text:
        if c in GLYPHS:
            out[:, x : x + COLUMNS * scale] = bitmap(c, scale)
        x += scale * (COLUMNS + 1 if c in GLYPHS else 3)
    return out


def atlas(scales: tuple[int, ...] = (2, 3)) -> list[tuple]:
    """Glyph records of the font at some scales, as sources.files reads them from an atlas."""
    rows = []
    for s in scales:
        for ch in GLYPHS:
            ink = bitmap(ch, s).astype(np.uint8) * 255
            y = np.flatnonzero(ink.any(1))
            x = np.flatnonzero(ink.any(0))
            own = ink[y[0] : y[-1] + 1, x[0] : x[-1] + 1]
            rows.append(("dots", ord(ch), s * ROWS, int(y[0]) - s * ROWS, own.shape[1], own.shape[0], s * ROWS, s * ROWS, own.tobytes()))
    return rows


def page(lines: list[str], scale: int = 3, width: int = 0, ground: tuple[int, int, int] = (250, 250, 250), ink: tuple[int, int, int] = (20, 20, 60)) -> np.ndarray:
    """A frame (height, width, 3) with lines of text under each other, far enough apart to be lines of their own."""
    masks = [line(t, scale) for t in lines]
    step = 3 * ROWS * scale
    out = np.empty((step * len(masks) + 2 * ROWS * scale, max([width, *(m.shape[1] for m in masks)]) + 8 * scale, 3), np.uint8)
    out[:] = ground
    for k, m in enumerate(masks):
        y = ROWS * scale + k * step
        out[y : y + m.shape[0], 4 * scale : 4 * scale + m.shape[1]][m] = ink
    return out
