"""Visual lines to text: rows, paragraphs, pieces of bounded length. A region's lines are few and their grouping is sequential, so the
lines of each region are read as one sorted run."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.tables import clean
from ..functions.text import BULLET, CJK
from .layout import by_page

_CJK = re.compile("[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), CJK) + "]")
_BULLET = re.compile(BULLET)


def is_cjk(ch: str) -> bool:
    return bool(_CJK.fullmatch(ch))


def joined(left: str, right: str) -> str:
    """Two parts of a line: no space between CJK characters."""
    return left + right if not left or not right or is_cjk(left[-1]) and is_cjk(right[0]) else f"{left} {right}"


def rows_of(lines: list[dict]) -> list[list[dict]]:
    """TXT-16: fragments whose middle is within half a height of a row's mean middle are in that row."""
    middle = lambda x: (x["y0"] + x["y1"]) / 2
    tall = lambda x: max(1e-6, x["y1"] - x["y0"])
    mean = lambda f, row: sum(map(f, row)) / len(row)
    out: list[list[dict]] = []
    for x in sorted(lines, key=lambda x: (middle(x), x["x0"])):
        if out and abs(middle(x) - mean(middle, out[-1])) < 0.5 * min(mean(tall, out[-1]), tall(x)):
            out[-1].append(x)
        else:
            out.append([x])
    return [sorted(row, key=lambda x: x["x0"]) for row in out]


def text_of(lines: list[dict], keep_breaks: bool = False) -> str:
    """TXT-17: rows to paragraphs. A gap of over 0.8 heights starts a paragraph; a list item (or, with keep_breaks, any row) a line; a
    hyphen before a lower-case letter goes."""
    out, bottom, height = [], None, None
    for row in rows_of([x for x in lines if x["text"].strip()]):
        text = ""
        for x in row:
            text = joined(text, clean(x["text"]))
        if not (text := clean(text)):
            continue
        tall = max(max(1e-6, x["y1"] - x["y0"]) for x in row)
        gap = None if bottom is None else min(x["y0"] for x in row) - bottom
        if gap is None or gap > 0.8 * max(tall, height):
            out.append(text)
        elif keep_breaks or _BULLET.match(text):
            out[-1] += "\n" + text
        elif re.search(r"[^\W\d_]-$", out[-1]) and text[0].islower():
            out[-1] = out[-1][:-1] + text
        else:
            out[-1] = joined(out[-1], text)
        bottom, height = max(x["y1"] for x in row), tall
    return "\n\n".join(out)


def region_texts(lines: DataFrame, keys: list[str], keep_breaks: bool = False) -> DataFrame:
    """TXT-17 for each region: lines (keys, text, x0, y0, x1, y1) to (keys, text)."""
    schema = T.StructType([*(lines.schema[k] for k in keys), T.StructField("text", T.StringType())])
    return by_page(lines.select(*keys, "text", "x0", "y0", "x1", "y1"), keys, lambda page: [{k: page[0][k] for k in keys} | {"text": text_of(page, keep_breaks)}], schema)


def pieces(chars: list[tuple[str, tuple | None]], most: int = 23) -> list[tuple[str, tuple]]:
    """TXT-29: a line's characters with boxes, cut at spaces to pieces of at most `most` characters; longer words are left out."""
    size = lambda part: len(unicodedata.normalize("NFC", "".join(c for c, _ in part)))
    words: list[list] = [[]]
    for c, box in chars:
        if c.isspace():
            words.append([])
        else:
            words[-1].append((c, box))
    out: list[list] = [[]]
    for word in filter(None, words):
        longer = [*out[-1], *([(" ", None)] if out[-1] else []), *word]
        if size(longer) <= most:
            out[-1] = longer
        else:
            out.append(word if size(word) <= most else [])
    made = []
    for part in filter(None, out):
        boxes = [b for _, b in part if b]
        x0, y0, x1, y1 = zip(*boxes, strict=True)
        made.append((unicodedata.normalize("NFC", "".join(c for c, _ in part)), (min(x0), min(y0), max(x1), max(y1))))
    return made
