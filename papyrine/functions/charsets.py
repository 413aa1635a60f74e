"""Character sets of recognition models, built from rules."""

from __future__ import annotations

import string
import unicodedata

#: Fixed values.
VOWELS = "aăâeêioôơuưy"
TONES = ("", "̀", "́", "̉", "̃", "̣")
SYMBOLS = "₫€£¥°±×÷≤≥≠≈→←↑↓↔…“”‘’–—•·§©®™‰½¼¾²³µπΩαβγδλσΣ∑√∞∆№«»"


def vietnamese_letters() -> list[str]:
    made = [unicodedata.normalize("NFC", v + t) for v in VOWELS for t in TONES]
    return [x for c in made for x in (c, c.upper())] + ["đ", "Đ"]


def in_cp932(ch: str) -> bool:
    try:
        return bool(ch.encode("cp932"))
    except UnicodeEncodeError:
        return False


def charset(languages: tuple[str, ...] = ("vi", "en"), base: list[str] | None = None) -> list[str]:
    """TXT-30: digits, letters, punctuation, Vietnamese letters, symbols; for Japanese after the base dictionary's CP932 part."""
    own = [*string.digits, *string.ascii_letters, *string.punctuation, *vietnamese_letters(), *SYMBOLS]
    if "ja" in languages:
        if not base:
            raise ValueError("Japanese needs a base dictionary")
        own = [*filter(in_cp932, base), *own]
    return [c for c in dict.fromkeys(own) if c and not c.isspace()]


def fallbacks(ch: str) -> list[str]:
    """TXT-31: the nearest plainer characters: without the tone, then without any mark."""
    parts = unicodedata.normalize("NFD", ch)
    no_tone = unicodedata.normalize("NFC", "".join(c for c in parts if c not in TONES[1:]))
    bare = "".join(c for c in parts if not unicodedata.combining(c)).translate(str.maketrans("đĐ", "dD"))
    return [*([no_tone] if no_tone != ch else []), bare]
