"""Scanned pages as text: printed order of lines, broken words, and folding of misreadings."""

from __future__ import annotations

import re
from bisect import bisect_right

#: Marks that stand at a line's end where a word was broken.
BREAKS = "-\u00ac\u00ad\u2010\u2011\u2013\u2014"
#: Horizontal distance in pixels between the starts of lines of different columns.
COLUMN_GAP = 120

# What scans mistake for each other. Signs and pairs are replaced first, then single letters, each class by one letter.
SIGNS = (("\ufb00", "ff"), ("\ufb01", "fi"), ("\ufb02", "fl"), ("\u017f", "s"), ("\u00e9", "o"), ("\u00e8", "o"), ("vv", "w"), ("rn", "m"), ("cl", "d"))
LETTERS = bytes.maketrans(b"huyqaec0i1rt5", b"bnvgoooolllfs")

WORD = re.compile(r"[^\W_]+")
_GAP = re.compile(r" {3,}|\t+")


def fold(text: str) -> str:
    """Lower case, with confusable letters made equal."""
    text = text.lower()
    for seen, meant in SIGNS:
        text = text.replace(seen, meant)
    return text.encode("utf-8", "replace").translate(LETTERS).decode()


def printed_lines(text: str, x0: list[int] | None, y0: list[int] | None) -> list[str]:
    """The lines in printed order: by columns from the left, each top to bottom, where
    boxes are given for all lines; else as they come, lines with wide gaps split into cells."""
    lines = text.split("\n")
    if x0 is None or len(x0) != len(lines) or any(v is None or v != v for v in x0) or any(v is None or v != v for v in y0):
        if "   " not in text and "\t" not in text:
            return lines
        cells = [_GAP.split(line.strip()) for line in lines]
        width = max(map(len, cells))
        return [row[k] for k in range(width) for row in cells if k < len(row)]
    starts = sorted(set(x0))
    edges = [b for a, b in zip(starts, starts[1:]) if b - a > COLUMN_GAP]
    places = sorted(zip((bisect_right(edges, x) for x in x0), y0, range(len(lines)))) if edges else sorted(zip(y0, range(len(lines))))
    ordered = [lines[place[-1]] for place in places]
    if "   " not in text and "\t" not in text:
        return ordered
    return [cell for line in ordered for cell in (_GAP.split(line.strip()) if _GAP.search(line) else (line,))]


def joined(lines: list[str]) -> str:
    """The lines as running text; words broken at a line's end are put together."""
    out = []
    for line in lines:
        line = line.strip()
        if line and line[-1] in BREAKS and len(line) > 1 and line[-2].isalnum():
            out.append(line[:-1])
        else:
            out.append(line + " ")
    return "".join(out)
