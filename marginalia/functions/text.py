"""Text functions as Columns. Offsets are 0-based code points."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.arrow import arrow_function

# White space, Japanese letters and the signs that comparisons leave out.
SPACE = r"\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
JAPANESE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"
LEFT_OUT = SPACE + r"""'"“”「」『』（）()\[\]{}.,，。、:：;；・\-–—"""
LEFT_OUT_ALSO = "‘’"
#: Pairs of texts of an Arrow batch whose characters are laid out together, and how many characters.
_AT_ONCE, _CHARACTERS = 1_000, 1 << 20


@arrow_function("string")
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition; Spark has no function for it."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def composed(text: Column) -> Column:
    """NFKC. Only texts with characters outside ASCII travel to Python; the others are null there."""
    return F.coalesce(nfkc(F.when(text.rlike(r"[^\x00-\x7f]"), text)), text)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once, however many of its fields are read. A projection would be repeated in each of them."""
    return rows.withColumn(name, F.explode(F.array(value)))


_UNIT = "\x1f"


def composed_each(texts: Column) -> Column:
    """NFKC of an array's texts, which travel as one; a unit separator inside them counts as a space."""
    joined = F.array_join(F.transform(texts, lambda x: F.translate(x, _UNIT, " ")), _UNIT)
    return F.when(F.size(texts) == 0, texts).otherwise(F.split(composed(joined), _UNIT))


def sign_spans(parts: Column, opening: str, found: Callable[[Column, Column], Column]) -> Column:
    """``parts`` of a text cut at closing signs: the first end at which no opening sign is open, or null; ``found`` gets (parts, end)."""
    opened = F.transform(parts, lambda x: F.length(x) - F.length(F.replace(x, F.lit(opening), F.lit(""))))
    depths = F.transform(opened, lambda _, i: F.aggregate(F.slice(opened, F.lit(1), i + 1), F.lit(0), lambda n, x: n + x) - i)
    return let(F.array_position(F.slice(depths, F.lit(1), F.size(parts) - 1), 0), lambda at: F.when(at > 0, found(parts, at.cast("int"))))


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+\\z", "")


def clean(text: Column) -> Column:
    """White space to single spaces, trimmed, the first 500 code points."""
    return F.left(stripped(F.regexp_replace(or_empty(text), f"[{SPACE}\\u200b]+", " ")), F.lit(500))


def _signs(pattern: str) -> str:
    """The characters of a class."""
    return "".join(re.findall(f"[{pattern}]", "".join(map(chr, range(0x10000))), re.DOTALL))


#: The signs that ``folded`` leaves out: a class of Latin ones, which is one look at a table, and the others in order. All in one class take twenty times as long.
LATIN_SIGNS, OTHER_SIGNS = "[" + "".join(f"\\x{ord(x):02x}" for x in _signs(LEFT_OUT + LEFT_OUT_ALSO) if x < "\u0100") + "]", "".join(x for x in _signs(LEFT_OUT + LEFT_OUT_ALSO) if x >= "\u0100")
_SPACES, _NO_SIGNS, _NO_SOURCE_SIGNS = str.maketrans(dict.fromkeys(_signs(SPACE + r"\u200b"), " ")), *(str.maketrans(dict.fromkeys(_signs(x))) for x in (LEFT_OUT + LEFT_OUT_ALSO, LEFT_OUT))


@arrow_function("string")
def _folded(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFKC", x or "").lower().translate(_NO_SIGNS))


@arrow_function("string")
def _folded_source(text: pd.Series) -> pd.Series:
    spaced = text.map(lambda x: " ".join(filter(None, (x or "").translate(_SPACES).split(" "))))
    return spaced.map(lambda x: unicodedata.normalize("NFKC", x).lower().translate(_NO_SOURCE_SIGNS))


def folded(text: Column) -> Column:
    """The form in which titles and names are compared. Patterns in Spark take longer."""
    return _folded(text)


def folded_source(text: Column) -> Column:
    """The form in which what a page says is compared: ``clean``, composed and folded; single curved quotes stay."""
    return _folded_source(clean(text))


def folded_line(text: Column) -> Column:
    """As ``folded_source``, of the whole text."""
    return _folded_source(text)


def bigrams(folded_text: Column) -> Column:
    """Distinct pairs of neighbours; a single character is its own."""
    pairs = F.array_distinct(F.regexp_extract_all(folded_text, F.lit("(?s)(?=(..))."), F.lit(1)))
    return F.when(F.length(folded_text) == 1, F.array(folded_text)).otherwise(pairs)


def bigrams_and_tail(folded_text: Column) -> Column:
    """As ``bigrams``, and the last character alone."""
    return F.array_distinct(F.regexp_extract_all(folded_text, F.lit("(?s)(?=(..?))."), F.lit(1)))


def dice_of_sets(a: Column, b: Column) -> Column:
    both = F.size(a) + F.size(b)
    score = 2.0 * F.size(F.array_intersect(a, b)) / both
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(score)


def dice(a: Column, b: Column) -> Column:
    """Of two raw texts."""
    return dice_of_sets(bigrams(folded(a)), bigrams(folded(b)))


def overlap(a: Column, b: Column) -> Column:
    return overlap_of_folded(folded_line(a), folded_line(b))


def overlap_of_folded(a: Column, b: Column) -> Column:
    """The Dice score of the sets that ``bigrams_and_tail`` gives; 0 where either is empty."""
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(arrow_function("double")(overlaps_of)(a, b))


def distinct_sorted(numbers: np.ndarray) -> np.ndarray:
    """As ``np.unique``, which hashes and takes some nine times as long."""
    ordered = np.sort(numbers)
    return ordered[np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)]]


def _pairs_and_tails(texts: pd.Series) -> np.ndarray:
    """The distinct pairs of neighbours and the last characters of all texts, in ascending order: the text's row above 42 bits of characters."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
    size = texts.str.len().to_numpy(np.int64)
    following = np.append(points[1:], 0)[: len(points)] + 1
    following[np.cumsum(size)[size > 0] - 1] = 0  # after the last character nothing follows
    return distinct_sorted(np.repeat(np.arange(len(size)), size) << 42 | points << 21 | following)


def overlaps_of(a: pd.Series, b: pd.Series) -> pd.Series:
    """The scores of an Arrow batch of folded texts, by sorted numbers."""
    scores = []
    upto = (a.str.len().fillna(0) + b.str.len().fillna(0)).to_numpy(np.int64).cumsum()
    at = 0
    while at < len(a):
        before = upto[at - 1] if at else 0
        n = min(_AT_ONCE, max(1, int(np.searchsorted(upto, before + _CHARACTERS, side="right")) - at), len(a) - at)
        x, y = (_pairs_and_tails(side.iloc[at : at + n].fillna("")) for side in (a, b))
        own, other, common = (np.bincount(z >> 42, minlength=n) for z in (x, y, np.intersect1d(x, y, assume_unique=True)))
        scores.append(2.0 * common / np.maximum(own + other, 1))
        at += n
    return pd.Series(np.concatenate(scores) if scores else [], index=a.index, dtype="float64")


def distinct_texts(values: Column) -> Column:
    """Without nulls and empty texts, each once, in order of first occurrence."""
    return F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != "")))


_ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;|&#0?39;": "'"}


def entities_decoded(text: Column) -> Column:
    out = or_empty(text)
    for pattern, sign in _ENTITIES.items():
        out = F.regexp_replace(out, f"(?i){pattern}", sign)
    tokens = F.regexp_extract_all(out, F.lit(r"&#\d+;|[^&]+|&"), F.lit(0))
    codes = F.transform(tokens, lambda t: F.when(t.rlike(r"^&#\d+;\z"), F.coalesce(F.regexp_extract(t, r"\d+", 0).try_cast("int"), F.lit(_NO_CHARACTER))))
    decoded = F.array_join(F.transform(tokens, lambda t, i: F.coalesce(_character(F.get(codes, i), F.get(codes, i - 1), F.get(codes, i + 1)), t)), "")
    return F.when(out.rlike(r"&#\d+;"), decoded).otherwise(out)


_NO_CHARACTER = 0xFFFD


def _character(code: Column, before: Column, after: Column) -> Column:
    """The character of a numeric entity, written as UTF-16; null for no entity.

    The two halves of a surrogate pair give one character, the second of them nothing;
    what no text can hold gives U+FFFD.
    """
    def first_half(c: Column) -> Column:
        return F.coalesce(c.between(0xD800, 0xDBFF), F.lit(False))

    def second_half(c: Column) -> Column:
        return F.coalesce(c.between(0xDC00, 0xDFFF), F.lit(False))

    def units(first: Column, second: Column) -> Column:
        return F.decode(F.unhex(F.concat(F.hex(first), F.hex(second))), "UTF-16BE")

    one = F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")
    two = units(F.lit(0xD800) + F.shiftright(code - 0x10000, 10), F.lit(0xDC00) + (code - 0x10000).bitwiseAND(1023))
    return (
        F.when(code.isNull(), F.lit(None).cast("string"))
        .when(first_half(code) & second_half(after), units(code, after))
        .when(second_half(code) & first_half(before), F.lit(""))
        .when(code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), F.lit(chr(_NO_CHARACTER)))
        .when(code > 0xFFFF, two)
        .otherwise(one)
    )


def has_japanese(text: Column) -> Column:
    return text.rlike(f"[{JAPANESE}]")


def without_quotes(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(text, "「[^」]*」", ""), "『[^』]*』", "")
    return F.regexp_replace(out, "[“\"][^”\"]*[”\"]", "")


def sentences(text: Column) -> Column:
    """Split after 。！？!? ; trimmed, without empty ones."""
    found = F.regexp_extract_all(text, F.lit("[^。！？!?]+[。！？!?]?"), F.lit(0))
    return F.filter(F.transform(found, stripped), lambda x: x != "")


def half_width_number(digits: Column) -> Column:
    return F.translate(digits, "０１２３４５６７８９", "0123456789").cast("int")


def query_variants(text: Column) -> Column:
    """Search terms for a title, the most exact first; at least four code points each."""
    source = stripped(or_empty(text))
    bare = F.regexp_replace(source, "[「」『』“”\"']", "")
    prefix = F.when(has_japanese(source) & (F.length(bare) > 20), F.left(bare, F.lit(16)))
    no_brackets = stripped(F.regexp_replace(source, "[（(][^）)]{2,}[）)]", " "))
    before_subtitle = stripped(F.split(source, r"[：:－\-―–]").getItem(0))
    japanese = F.array_join(F.regexp_extract_all(source, F.lit(f"[{JAPANESE}ー々]+"), F.lit(0)), " ")
    found = F.array(source, bare, prefix, no_brackets, before_subtitle, F.when(F.length(japanese) >= 6, japanese))
    return F.filter(distinct_texts(found), lambda x: F.length(x) >= 4)
