"""Text signals and clean-up as Column functions. Patterns use only what Java's regex and RE2 share, so that checks can reuse them."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from .udf import each

# --- fixed values: character sets, patterns and word lists that results depend on --------------------------------------
SPACE_RUN = r"[ \t\x{00A0}\x{2000}-\x{200B}\x{202F}\x{3000}]+"
CID = r"\(cid:[0-9]+\)"
BROKEN = r"[\x{FFFD}\x{E000}-\x{F8FF}\x{0000}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}\x{007F}-\x{009F}]"
VI_LATIN1 = "àáâãèéêìíòóôõùúýÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚÝ"
LATIN1_SYMBOLS = "°±×÷©®§«»µ¼½¾²³¹¢£¥¤¦¬¯´·¸¿¡ªº"
IN_WORD_SYMBOLS = "¸µ¶·¹¨©ª«¬®¯°±²³´»¼½¾"
LEGACY_FONTS = (".vn", "vni-", "vni_", "vn-", "abc")
VI_MARKS = "ăâêôơưđĂÂÊÔƠƯĐ"
VI_ONLY = "ăắằẳẵặơớờởỡợưứừửữựđạảấầẩẫậẹẻẽếềểễệỉịọỏốồổỗộụủỳỵỷỹ"
TONES = "̣̀́̃̉"
CJK = r"\x{3000}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}"
EXPECTED = rf"\x{{0000}}-\x{{024F}}\x{{0370}}-\x{{03FF}}\x{{1E00}}-\x{{1EFF}}\x{{2100}}-\x{{214F}}{CJK}"
SPECIAL = "%$€£¥₫円±≤≥≠≈×÷°§©®™→←↑↓↔⇒√∞∑∏∫∂∆∇µπσΩαβγδλ‰′″※〒"
BULLET = r"^[\t-\r ]*([-•●▪◦‣∙*+]|[0-9]{1,3}[.)]|[a-zA-Z][.)]|[ivxIVX]{1,5}[.)])[\t-\r ]+"
NUMBER = r"[-+−]?[0-9]+(?:[.,\x{00A0}\x{202F}][0-9]+)*%?"
EN_WORDS = ("the", "and", "of", "to", "in", "for", "is", "on", "with", "by", "as", "at", "from", "that", "this", "are", "be", "was", "our", "we", "or", "an", "it", "which")
VI_ABBREVIATIONS = (
    "UBND", "HĐND", "MTTQ", "TNHH", "CTCP", "TP", "HCM", "QĐ", "NĐ", "CP", "TT", "TTG", "BTC", "BCT", "BYT", "BGDĐT", "BXD", "BKHĐT", "NHNN", "NSNN",
    "VN", "VNĐ", "VND", "USD", "TW", "KT", "XH", "KH", "BC", "CV", "SXKD", "GTGT", "TNDN", "TNCN", "BHXH", "BHYT", "BHTN", "CBCNV", "CNTT", "THPT",
    "THCS", "ĐH", "PGS", "TS", "THS", "GS", "STT", "ĐVT", "HĐQT", "ĐHĐCĐ", "BKS", "MST", "CMND", "CCCD", "QLDA", "XDCB", "HĐ", "KHCN", "PCCC",
    "ATTP",
)
#: Letters of the basic plane that came after Unicode 13, which Java 17 knows.
NEW_LETTERS = r"\x{0870}-\x{0887}\x{0889}-\x{088E}\x{08C8}\x{08C9}\x{0C5D}\x{0CDD}\x{1C89}\x{1C8A}\x{2C2F}\x{2C5F}\x{A7C0}\x{A7C1}\x{A7D0}-\x{A7D9}\x{A7F2}-\x{A7F4}"
#: Assigned characters of the basic plane, the frequent ones first and then others, that a normal form leaves as they are in text made of them alone: none
#: combines or is the second half of a composition, and none is changed by itself.
COMPOSED = {
    "NFC": (r"\x{0000}-\x{02FF}", r"\x{1E00}-\x{1EFF}\x{3400}-\x{9FFF}\x{3041}-\x{3096}\x{309B}-\x{30FF}\x{3000}-\x{3029}\x{3030}-\x{303F}\x{FF01}-\x{FFBE}\x{2010}-\x{2064}\x{2190}-\x{2328}\x{0391}-\x{03A1}\x{03A3}-\x{03FF}\x{0400}-\x{0482}\x{AC00}-\x{D7A3}"),
    "NFKC": (r"\x{0000}-\x{007F}", r"\x{00C0}-\x{0131}\x{0134}-\x{013E}\x{0141}-\x{0148}\x{014A}-\x{017E}\x{01A0}-\x{01B0}\x{1E00}-\x{1E99}\x{1EA0}-\x{1EFF}\x{3400}-\x{9FFF}\x{3041}-\x{3096}\x{30A0}-\x{30FE}\x{3001}-\x{3029}"),
}
# --- end of fixed values -------------------------------------------------------------------------------------------------

WORD = r"[\p{L}\p{Nl}\p{No}]+"
TOKEN = r"[\p{L}\p{N}_]+"


def with_marks(marks: str, n: int) -> str:
    """All precomposed letters of the basic plane whose decomposition has n of the marks (and the marks themselves for n = 1)."""
    found = [chr(c) for c in range(0xC0, 0x2000) if sum(x in marks for x in unicodedata.normalize("NFD", chr(c))) == n]
    return "".join(found)


def vowelled() -> str:
    """Letters of the basic plane whose decomposition has one of the vowels a, e, i, o, u, y in either case."""
    return "".join(chr(c) for c in range(0x41, 0x2000) if any(x in "aeiouy" for x in unicodedata.normalize("NFD", chr(c).lower())))


TONED_1, TONED_2 = with_marks(TONES, 1), with_marks(TONES, 2)
VOWEL = f"[{vowelled()}]"
#: The same for Java, quick on ASCII.
VOWEL_FAST = rf"[AEIOUYaeiouy]|[[^\x00-\x7F]&&{VOWEL}]"


def _normal_form(form: str):
    @each("string")
    def convert(text: str | None) -> str | None:
        return text if text is None or text.isascii() else unicodedata.normalize(form, text)

    def call(c: Column, source: Column | None = None) -> Column:
        frequent, others = COMPOSED[form]
        doubtful = (c if source is None else source).rlike(f"[^{frequent}](?<![{others}])")  # one class of all takes Java three times as long
        return F.coalesce(convert(F.when(doubtful, c)), c)

    return call


def nfc(c: Column, source: Column | None = None) -> Column:
    """Python gets only texts with characters that may change, and nulls for the others. source: what c was made of by leaving out and
    putting in ASCII alone, so that c isn't worked out once more to look at its characters."""
    return _normal_form("NFC")(c, source)


def nfkc(c: Column) -> Column:
    return _normal_form("NFKC")(c)


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize(c: Column) -> Column:
    """TXT-01: NFC, no soft hyphens, runs of blanks as one space, stripped."""
    return strip(F.regexp_replace(F.replace(nfc(c), F.lit("­"), F.lit("")), SPACE_RUN, " "))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value worked out once however often body uses it (branches of conditions don't share subexpressions)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def of_class(c: Column, signs: str) -> Column:
    """The number of characters of a class; runs are cut out at once, which is faster than collecting single matches."""
    return F.length(c) - F.length(F.regexp_replace(c, f"[{signs}]+", ""))


def only(c: Column, signs: str) -> Column:
    return F.regexp_replace(c, f"[^{signs}]+", "")


def beyond_ascii(c: Column) -> Column:
    """What classes of many letters have to look at."""
    return F.regexp_replace(c, r"[\x00-\x7F]+", "")


def letters(c: Column) -> Column:
    return of_class(c, r"\p{L}" + NEW_LETTERS)


def foreign_script_ratio(c: Column) -> Column:
    """TXT-03."""

    def share(x: Column) -> Column:
        return F.when((x.n >= 20) & (x.foreign >= 0.05 * x.n), x.foreign / x.n).otherwise(0.0)

    return let(F.struct(letters(c).alias("n"), letters(F.regexp_replace(c, f"[{EXPECTED}]+", "")).alias("foreign")), share)


def legacy_encoding_ratio(c: Column) -> Column:
    """TXT-04."""
    latin1 = only(beyond_ascii(c), r"\x{00A1}-\x{00FF}")
    odd = F.length(F.regexp_replace(latin1, f"[{VI_LATIN1}{LATIN1_SYMBOLS}]+", ""))
    counts = F.struct(of_class(c, r"\p{L}\x{00A1}-\x{00FF}").alias("n"), (odd + 2 * count(c, f"[a-zA-Z][{IN_WORD_SYMBOLS}][a-zA-Z]")).alias("odd"))
    return let(counts, lambda x: F.when((x.n >= 20) & (x.odd / F.greatest(x.n, F.lit(1)) >= 0.08), x.odd / F.greatest(x.n, F.lit(1))).otherwise(0.0))


def garbled_ratio(c: Column) -> Column:
    """TXT-02."""
    rest = F.regexp_replace(c, CID, "")
    bad = of_class(rest, BROKEN[1:-1]) + F.length(c) - F.length(rest)
    return F.when(F.length(c) == 0, 0.0).otherwise(F.least(F.lit(1.0), bad / F.length(c) + legacy_encoding_ratio(c) + foreign_script_ratio(c)))


def is_legacy_font(c: Column) -> Column:
    """TXT-05."""
    return F.substring_index(F.lower(c), "+", -1).rlike("^(" + "|".join(map(re.escape, LEGACY_FONTS)) + ")")


def _tone_marks(c: Column) -> Column:
    return let(beyond_ascii(c), lambda x: of_class(x, f"{TONES}{TONED_1}") + 2 * of_class(x, TONED_2) + of_class(x, VI_MARKS))


def _scripts(c: Column) -> Column:
    """Letters of CJK and of other scripts, and tone marks."""
    cjk = letters(only(beyond_ascii(c), CJK))
    return F.struct(cjk.alias("cjk"), (letters(c) - cjk).alias("other"), _tone_marks(c).alias("marks"))


def looks_vietnamese(c: Column) -> Column:
    """TXT-06; on composed or decomposed text, without a normal form."""
    return let(_scripts(c), lambda x: x.marks >= F.greatest(F.lit(2.0), 0.02 * x.other))


def detect_language(c: Column, languages: tuple[str, ...] = ("vi", "en", "ja"), least: int = 12) -> Column:
    """TXT-07 on NFC text."""

    def choose(x: Column) -> Column:
        is_vi = F.lit("vi" in languages) & (x.marks >= F.greatest(F.lit(2.0), 0.02 * x.other))
        latin = F.when(is_vi, "vi").otherwise("en" if "en" in languages else "vi")
        ja = 2 * x.cjk if "ja" in languages else F.lit(-1)
        best = F.when((x.other > 0) & (x.other > ja), latin).when(ja >= 0, F.lit("ja"))
        return F.when(2 * x.cjk + x.other >= least, F.when(best.isin(*languages), best))

    return let(_scripts(c), choose)


def dropout_ratio(c: Column) -> Column:
    """TXT-08 on NFC text: the share of Vietnamese words without a vowel."""
    upper = lambda t: (F.upper(t) == t) & (F.lower(t) != t)
    vowel = lambda t: t.rlike(VOWEL_FAST)

    def share(x: Column) -> Column:
        capitals = F.filter(x.dry, lambda t: upper(t) & (F.length(t) >= 2) & ~t.isin(*VI_ABBREVIATIONS))
        bad = F.size(F.filter(x.dry, lambda t: ~upper(t))) + F.when(x.titled, F.size(capitals)).otherwise(0)
        ratio = bad / F.greatest(x.n, F.lit(1))
        return F.when((x.n >= 20) & ~x.dots, F.greatest(ratio, F.lit(0.5))).otherwise(ratio)

    def counts(words: Column) -> Column:
        titled = F.size(F.filter(words, lambda t: upper(t) & (F.length(t) >= 2) & vowel(t))) >= 3
        return F.struct(F.filter(words, lambda t: ~vowel(t)).alias("dry"), titled.alias("titled"), F.size(words).alias("n"), c.rlike(r"[\x{1EA0}-\x{1EF9}]").alias("dots"))

    made = let(F.regexp_extract_all(c, F.lit(WORD), F.lit(0)), lambda w: let(counts(w), lambda x: F.when(x.n >= 3, share(x)).otherwise(0.0)))
    return F.when(looks_vietnamese(c), made).otherwise(0.0)


def confirmed_language(c: Column) -> Column:
    """TXT-09 on NFC text."""
    low = F.lower(c)
    wide = beyond_ascii(low)
    words = F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0))
    english = let(words, lambda w: F.struct(F.size(w).alias("n"), F.size(F.filter(w, lambda x: x.isin(*EN_WORDS))).alias("hits")))
    counts = F.struct(
        of_class(wide, r"\x{3040}-\x{9FFF}").alias("cjk"), of_class(wide, r"\x{3040}-\x{30FF}").alias("kana"), letters(only(low, r"\x{0000}-\x{2E7F}")).alias("latin"), of_class(wide, VI_ONLY).alias("vi"), english.alias("en"),
    )
    return let(counts, _confirmed)


def _confirmed(x: Column) -> Column:
    cjk, kana, latin, vi_letters = x.cjk, x.kana, x.latin, x.vi
    ja = F.when((cjk > 0) & (kana >= 0.05 * cjk), 2.0 * cjk).otherwise(0.0)
    vi = F.when(vi_letters >= 0.02 * latin, vi_letters / 0.1).otherwise(0.0)
    en = F.when((x.en.n > 0) & (x.en.hits >= 0.02 * x.en.n), latin.cast("double")).otherwise(0.0)
    en = F.when((vi > 0) & (en > 0), F.greatest(F.lit(0.0), latin - vi)).otherwise(en)
    best = F.greatest(ja, vi, en)
    return F.when(2 * cjk + latin < 12, "unknown").when(best <= 0, "other").when(ja == best, "ja").when(vi == best, "vi").otherwise("en")


def numbers(c: Column, folded: bool = True) -> Column:
    """TXT-10: numbers as their digits; `folded` False skips NFKC for texts known to have no wide forms."""
    found = F.regexp_extract_all(nfkc(c) if folded else c, F.lit("(?<![0-9A-Za-z])" + NUMBER), F.lit(0))
    return F.filter(F.transform(found, lambda x: F.regexp_replace(x, "[^0-9]", "")), lambda x: x != "")


def special_counts(c: Column) -> Column:
    """TXT-11: map of each special sign to its number."""
    signs = F.regexp_extract_all(c, F.lit(f"[{SPECIAL}]"), F.lit(0))
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(signs)), lambda s: F.struct(s, F.size(F.filter(signs, lambda x: x == s)))))


def multiset_recall(reference: Column, candidate: Column) -> Column:
    """TXT-12 on two arrays: items of reference, by number, that candidate has; 1 if there are none."""
    from_side = lambda items, side: F.transform(items, lambda x: F.struct(x.alias("item"), F.lit(side).alias("side")))
    start = F.struct(F.lit(None).cast("string").alias("item"), F.lit(0).alias("left"), F.lit(0).alias("hits"))

    def step(acc, x):  # in sorted order an item's references come before its candidates, each of which uses up one of them
        left = F.when(acc["item"].eqNullSafe(x["item"]), acc["left"]).otherwise(0)
        used = (x["side"] == 1) & (left > 0)
        return F.struct(x["item"].alias("item"), F.when(x["side"] == 0, left + 1).otherwise(left - used.cast("int")).alias("left"), (acc["hits"] + used.cast("int")).alias("hits"))

    hits = F.aggregate(F.array_sort(F.concat(from_side(reference, 0), from_side(candidate, 1))), start, step)["hits"]
    return F.when(F.size(reference) == 0, 1.0).otherwise(hits / F.size(reference))


def is_list_item(c: Column) -> Column:
    """TXT-13."""
    return c.rlike(BULLET)


def strip_bullet(c: Column) -> Column:
    return F.regexp_replace(c, BULLET, "")


def is_cjk(ch: Column) -> Column:
    """TXT-14."""
    return ch.rlike(f"^[{CJK}]$")


def join_inline(left: Column, right: Column) -> Column:
    """TXT-15."""
    glue = F.when(is_cjk(F.right(left, F.lit(1))) & is_cjk(F.left(right, F.lit(1))), "").otherwise(" ")
    return F.when(left == "", right).when(right == "", left).otherwise(F.concat(left, glue, right))


#: TXT-18, in order. Fixed values.
MARKDOWN_STEPS = (
    (r"(?s)<!--.*?-->", " "), (r"</t[dh]>", " "), (r"<br\s*/?>", " "), (r"<[^>]+>", " "), (r"(?m)^\s{0,3}#{1,6}\s+", ""), (r"(?m)^\s*[-*+]\s+", ""), (r"(?m)^\s*>\s?", ""),
    (r"(?m)^\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)*\|?\s*$", " "), (r"\|", " "), (r"(\*\*|__|`{1,3}|\$\$)", ""),
)
EMPHASIS = r"(?<![\p{L}\p{N}_])[*_](?=\S)|(?<=\S)[*_](?![\p{L}\p{N}_])"


def markdown_to_plain(c: Column, composed: bool = False) -> Column:
    """TXT-18; `composed` says that the text is NFC already."""
    source = c
    for pattern, by in MARKDOWN_STEPS:
        c = F.regexp_replace(c, pattern, by)
    c = F.regexp_replace(c, EMPHASIS, "")
    c = c if composed else nfc(c, source)
    c = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.regexp_replace(c, f"(?<=[{CJK}]) (?=[{CJK}])", "")


def tokens(c: Column) -> Column:
    """TXT-19 on normalised text: lower-case words; a word with a CJK letter is cut into its letters and runs of digits."""
    words = F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))
    return F.flatten(F.transform(words, lambda w: F.when(w.rlike(f"[{CJK}]"), F.regexp_extract_all(w, F.lit(r"[\p{L}\p{Nl}\p{No}]|\p{Nd}+"), F.lit(0))).otherwise(F.array(w))))


def words(c: Column) -> Column:
    """TXT-20 on NFC text."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


@each("string")
def _without_latin_marks(text: str | None) -> str | None:
    if text is None or text.isascii():
        return text
    out: list[str] = []
    for ch in unicodedata.normalize("NFD", text):
        if not (out and unicodedata.combining(ch) and ord(out[-1]) < 0x250):
            out.append(ch)
    return unicodedata.normalize("NFC", "".join(out))


def fold(c: Column) -> Column:
    """TXT-21: a slug without the accents of Latin letters."""
    plain = F.translate(_without_latin_marks(F.lower(c)), "đ", "d")
    return F.regexp_replace(F.regexp_replace(plain, r"[^\p{L}\p{N}/]+", "-"), "^-+|-+$", "")


def domain(url: Column) -> Column:
    """TXT-23."""
    full = F.when(url.contains("//"), url).otherwise(F.concat(F.lit("//"), url))
    host = F.regexp_extract(full, r"^[^/]*//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def headings(c: Column) -> Column:
    """TXT-24: headings of Markdown."""
    return F.regexp_extract_all(c, F.lit(r"(?m)^#{1,6}[ \t]+(.+?)[ \t]*$"), F.lit(1))


def page_numbers(spec: Column) -> Column:
    """TXT-25: '1-3,5' as the sorted distinct positive numbers."""
    parts = F.filter(F.split(F.regexp_replace(spec, r"\s", ""), ","), lambda x: x != "")
    ends = lambda p: (F.split(p, "-")[0].cast("int"), F.element_at(F.split(p, "-"), -1).cast("int"))
    runs = F.transform(parts, lambda p: F.when(ends(p)[0] <= ends(p)[1], F.sequence(*ends(p))).otherwise(F.array().cast("array<int>")))
    return F.array_sort(F.array_distinct(F.filter(F.flatten(runs), lambda n: n > 0)))


def clean_model_output(c: Column) -> Column:
    """TXT-26: without thoughts and code fences."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""), r"(?m)^\s*```[a-zA-Z]*\s*$", ""))


def first_json(c: Column) -> Column:
    """TXT-26: the outermost {...} as VARIANT, or null."""
    return F.try_parse_json(F.regexp_extract(clean_model_output(c), r"(?s)\{.*\}", 0))


def escape_html(c: Column) -> Column:
    """TXT-34."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def single_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def hex_modulo(digest: Column, n: int) -> Column:
    """FLT-15: a hexadecimal number of any length modulo n, digit by digit."""
    digits = F.transform(F.filter(F.split(F.lower(digest), ""), lambda d: d != ""), lambda d: F.conv(d, 16, 10).cast("int"))
    return F.aggregate(digits, F.lit(0), lambda acc, d: (acc * 16 + d) % n)
