"""Snippets of the few rows shown. Plain functions: they run on at most a page of results."""

from __future__ import annotations

import re

import regex

from .text import MARKS, level1, term_tokens

# What a window is worth for each distinct phrase, and the bonus of the text's start.
PHRASE_WORTH, START_BONUS = 1000, 120


def stored_text(text: str) -> str:
    """What the full-text surface holds of a text: its level-1 tokens joined by a space."""
    return " ".join(level1(text))


def token_snippet(text: str, terms: list[str], size: int = 16, before: str = "<mark>", after: str = "</mark>", gap: str = "…") -> str:
    """The window of ``size`` index tokens that has most distinct phrases, with their occurrences marked.

    A window starts at an occurrence and is then centred on what it has; the
    start of the text counts as a start as well, with a bonus.
    """
    spans = [m.span() for m in regex.finditer(rf"[\p{{L}}\p{{N}}\p{{Co}}][\p{{L}}\p{{N}}\p{{Co}}{MARKS}]*", text)]
    tokens = ["".join(term_tokens(text[a:b])) for a, b in spans]
    phrases = [p for p in map(term_tokens, terms) if p]
    hits = sorted((i, k) for k, p in enumerate(phrases) for i in range(len(tokens) - len(p) + 1) if tokens[i : i + len(p)] == p)

    def worth(start: int) -> tuple[int, int]:
        inside = [(i, k) for i, k in hits if start <= i < start + size]
        kinds = len({k for _, k in inside})
        width = inside[-1][0] + len(phrases[inside[-1][1]]) - inside[0][0]
        centred = inside[0][0] - int((size - width) / 2)
        return PHRASE_WORTH * kinds + len(inside) - kinds, max(0, min(centred, len(tokens) - size))

    best, start = 0, 0
    for i, _ in hits:
        value, centred = worth(i)
        if value > best:
            best, start = value, centred
        if i > 0 and len(tokens) > size and any(at < size for at, _ in hits) and worth(0)[0] + START_BONUS > best:
            best, start = worth(0)[0] + START_BONUS, 0
    end = min(start + size, len(tokens))
    if not tokens:
        return text
    marked: list[list[int]] = []
    for i, k in hits:
        stop = i + len(phrases[k])
        if marked and i < marked[-1][1]:
            marked[-1][1] = max(stop, marked[-1][1])
        else:
            marked.append([i, stop])
    at = spans[start][0] if start else 0
    out = [gap] if start else []
    for i, stop in marked:
        i, stop = max(i, start), min(stop, end)
        if i < stop:
            out += [text[at : spans[i][0]], before, text[spans[i][0] : spans[stop - 1][1]], after]
            at = spans[stop - 1][1]
    out.append(text[at:] if end == len(tokens) else text[at : spans[end - 1][1]] + gap)
    return "".join(out)


def _places(low: str, needle: str) -> list[int]:
    """Where the needle occurs, without overlaps."""
    return [m.start() for m in re.finditer(re.escape(needle), low)]


def _marked(text: str, needles: list[str]) -> str:
    """Every needle marked; of several at one place the longest."""
    pattern = "|".join(re.escape(n) for n in sorted(needles, key=len, reverse=True))
    return re.sub(pattern, lambda m: f"<mark>{m.group()}</mark>", text, flags=re.IGNORECASE) if pattern else text


def raw_snippet(text: str, query: str, terms: list[str], left: int = 40, right: int = 80, fallback: int = 160) -> str:
    """Surroundings of the whole query, else of the densest cluster of its terms; else the start of the text.

    A cluster is worth 1000 for each distinct term in its window, 10 for each
    letter of all their hits and 1 for each hit; of equal ones the first counts.
    Only what was looked for is marked: the query, or the terms.
    """
    low, phrase = text.lower(), query.lower()
    needles = [n for n in dict.fromkeys(t.lower() for t in terms) if n]

    def window(at: int, n: int) -> tuple[int, int]:
        return max(0, at - left), min(len(text), at + n + right)

    def worth(a: int, b: int) -> int:
        hits = {n: low.count(n, a, b) for n in needles}
        return sum(1000 * (k > 0) + k * (10 * len(n) + 1) for n, k in hits.items())

    whole = low.find(phrase) if phrase else -1
    if whole >= 0:
        (a, b), needles = window(whole, len(phrase)), [phrase]
    else:
        anchors = sorted((at, -len(n)) for n in needles for at in _places(low, n))
        if not anchors:
            return text[:fallback]
        a, b = max((window(at, -n) for at, n in anchors), key=lambda w: worth(*w))
    return ("…" if a else "") + _marked(text[a:b], needles) + ("…" if b < len(text) else "")
