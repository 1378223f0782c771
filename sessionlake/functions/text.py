"""Text functions as Columns: trimming, tokens, accent folding, CJK bigrams.

One set of rules serves the index (Columns over whole tables) and queries (one
short string on the driver): the character classes and the folding below. Level 1
cuts a text into words and bigrams of CJK runs; the index tokens are the letters
and digits of those, lower case, without the marks that the index ignores.
"""

from __future__ import annotations

import re
import unicodedata

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .segment import Dictionary, spaced

#: The dictionary of scripts without spaces, for whatever is indexed or asked from now on.
_dictionary: Dictionary | None = None


def use_dictionary(dictionary: Dictionary | None) -> None:
    """Words of scripts without spaces come from this dictionary, in texts and in queries alike."""
    global _dictionary
    _dictionary = dictionary


def dictionary_digest() -> str:
    """What tells the dictionary in use from others; empty without one."""
    return _dictionary.digest if _dictionary else ""


CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"
WORD = r"[\p{L}\p{M}\p{N}_]+(?:['.][\p{L}\p{M}\p{N}_]+)*"
TOKEN = r"[\p{L}\p{N}\p{Co}]+"
_CJK_RUN = regex.compile(f"([{CJK}]+)")
_WORD, _TOKEN = regex.compile(WORD), regex.compile(TOKEN)
# what the same rules are for lower-case ASCII, which needs no tables of characters
_ASCII_WORD, _ASCII_TOKEN = re.compile(r"[a-z0-9_]+(?:['.][a-z0-9_]+)*"), re.compile(r"[a-z0-9]+")

# Combining marks that index tokens leave out, and letter forms that they unite.
MARKS = "\u0300\u0301\u0302\u0303\u0304\u0306\u0307\u0308\u0309\u030a\u030b\u030c\u030f\u0311\u031b\u0323\u0324\u0325\u0326\u0327\u0328\u032d\u032e\u0330\u0331"
FORMS = {"µ": "μ", "ſ": "s", "ς": "σ", "ϐ": "β", "ϑ": "θ", "ϕ": "φ", "ϖ": "π", "ϰ": "κ", "ϱ": "ρ", "ϵ": "ε"}


def _fold_table() -> tuple[str, str]:
    """Lower-case letters that are an ASCII letter with one mark, and that letter; letters of two marks stay."""
    pairs = dict(FORMS)
    for cp in range(0xC0, 0x2000):
        c = chr(cp)
        parts = unicodedata.normalize("NFD", c)
        if c == c.lower() and len(parts) == 2 and parts[0].isascii():
            pairs[c] = parts[0]
    return "".join(pairs) + MARKS, "".join(pairs.values())


FOLD_FROM, FOLD_TO = _fold_table()
_FOLD = str.maketrans(FOLD_FROM[: len(FOLD_TO)], FOLD_TO, MARKS)


def trim(c: Column) -> Column:
    """Unicode trim."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; trimmed."""
    return trim(F.regexp_replace(c, r"(?U)\s+", " "))


def fold(c: Column) -> Column:
    return F.translate(F.lower(c), FOLD_FROM, FOLD_TO)


def has_cjk(c: Column) -> Column:
    return c.rlike(f"[{CJK}]")


def cjk_bigrams(c: Column) -> Column:
    """Overlapping pairs of every CJK run; runs of one character give none."""
    runs = F.filter(F.regexp_extract_all(c, F.lit(f"[{CJK}]+"), F.lit(0)), lambda r: F.length(r) > 1)
    return F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))))


def words(c: Column) -> Column:
    """Level-1 words other than CJK: letters, digits and inner ' . _ of a word, lower case."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(c, f"[{CJK}]+", " ")), F.lit(WORD), F.lit(0))


def fts_tokens(c: Column) -> Column:
    """Index tokens: words without marks, and CJK bigrams in their place."""
    c = spaced(c, _dictionary)
    spread = F.when(has_cjk(c), F.array_join(F.transform(
        F.regexp_extract_all(c, F.lit(f"[{CJK}]+|[^{CJK}]+"), F.lit(0)),
        lambda p: F.when(p.rlike(f"^[{CJK}]"), F.concat(F.lit(" "), F.array_join(cjk_bigrams(p), " "), F.lit(" "))).otherwise(p)), "")).otherwise(c)
    return F.regexp_extract_all(fold(spread), F.lit(TOKEN), F.lit(0))


def is_cjk(text: str) -> bool:
    """Whether a string holds any CJK character."""
    return bool(_CJK_RUN.search(text))


def level1(text: str) -> list[str]:
    """Level-1 tokens of one string, in order."""
    out: list[str] = []
    text = _dictionary.spaced(text) if _dictionary else text
    for n, piece in enumerate([text] if text.isascii() else _CJK_RUN.split(text)):
        if n % 2:
            out += [piece[i : i + 2] for i in range(len(piece) - 1)]
        elif piece.isascii():
            found = _ASCII_WORD.findall(piece.lower())
            out += [w for w in found if w.strip("_.'")] if "_" in piece else found
        else:
            out += [w for w in _WORD.findall(piece.lower()) if _TOKEN.search(w)]
    return out


def query_terms(query: str) -> list[str]:
    """Distinct level-1 terms of a query, in order (on the driver: a query is one short string)."""
    return list(dict.fromkeys(level1(query)))


def term_tokens(term: str) -> list[str]:
    """Index tokens of one query term: a phrase if there are several."""
    return _ASCII_TOKEN.findall(term.lower()) if term.isascii() else _TOKEN.findall(term.lower().translate(_FOLD))


def query_tokens(query: str) -> list[str]:
    """Index tokens of all level-1 tokens of a query, in order; those of ASCII letters and digits alone are index tokens."""
    out: list[str] = []
    for term in level1(query):
        if term.isascii() and term.isalnum():
            out.append(term)
        else:
            out += term_tokens(term)
    return out


def phrase_count(tokens: Column, phrase: list[str]) -> Column:
    """Occurrences of the phrase in an array of tokens, overlaps counted."""
    if len(phrase) == 1:
        return F.size(F.filter(tokens, lambda t: t == phrase[0]))
    # tokens hold neither spaces nor signs of patterns; a look-ahead lets occurrences overlap
    line = F.concat(F.lit(" "), F.array_join(tokens, "  "), F.lit(" "))
    return F.regexp_count(line, F.lit("(?= " + "  ".join(phrase) + " )"))


def like_snippet(c: Column, needle: str, before: int = 40, after: int = 80, fallback: int = 160) -> Column:
    """First hit with its surroundings, all hits marked; without a hit the start of the text."""
    at = F.instr(F.lower(c), needle.lower())
    start = F.greatest(F.lit(1), at - before)
    window = F.substr(c, start, at + len(needle) + after - start)
    marked = F.regexp_replace(window, "(?i)" + re.escape(needle), "<mark>$0</mark>")
    body = F.concat(F.when(start > 1, "…").otherwise(""), marked, F.when(at + len(needle) + after - 1 < F.length(c), "…").otherwise(""))
    return F.when(at > 0, body).otherwise(F.substring(c, 1, fallback))


def trim_text(c: Column, most: int) -> Column:
    """White space squeezed, marks taken out, cut with an ellipsis."""
    flat = squeeze(F.replace(F.replace(c, F.lit("<mark>"), F.lit("")), F.lit("</mark>"), F.lit("")))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)
