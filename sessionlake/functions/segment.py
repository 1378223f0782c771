"""Words of scripts that are written without spaces (Thai, Lao, Khmer, Burmese), by a dictionary.

A run of such characters is cut where the words cost least (Viterbi over the places of
the run): a word of the dictionary costs what its frequency says, and what no word
covers costs more than any word. The dictionary is a file of words, one a line with an
optional count behind a tab; it belongs to whoever runs the index, and none comes with
this library. Without one a run stays one word.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

SCRIPTS = r"\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
_RUN = regex.compile(f"[{SCRIPTS}]+")
UNKNOWN = 4.0  #: times the dearest word, for each character that no word covers


class Dictionary:
    def __init__(self, words: Iterable[str | tuple[str, float]]):
        counts: dict[str, float] = {}
        for w in words:
            word, n = (w, 1.0) if isinstance(w, str) else w
            if word:
                counts[word] = counts.get(word, 0.0) + max(float(n), 1e-9)
        total = sum(counts.values())
        self.costs = {w: math.log(total / n) + 1.0 for w, n in counts.items()}
        self.longest = max(map(len, self.costs), default=0)
        self.unknown = UNKNOWN * max(self.costs.values(), default=1.0)
        told = "\n".join(f"{w}\t{n:.9g}" for w, n in sorted(counts.items()))
        self.digest = hashlib.sha256(told.encode()).hexdigest()

    @classmethod
    def read(cls, lines: Iterable[str]) -> Dictionary:
        """From the lines of a dictionary file."""
        pairs = (line.rstrip("\r\n").split("\t") for line in lines)
        return cls((p[0].strip(), float(p[1]) if len(p) > 1 else 1.0) for p in pairs if p[0].strip() and not p[0].startswith("#"))

    def words(self, run: str) -> Iterator[str]:
        """The words of a run, in order; neighbours that no word covers are one."""
        n = len(run)
        best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        for i in range(n):
            for j in range(i + 1, min(n, i + max(self.longest, 1)) + 1):
                cost = self.costs.get(run[i:j], self.unknown if j == i + 1 else math.inf)
                if best[i] + cost < best[j]:
                    best[j], back[j] = best[i] + cost, i
        cuts, at = [n], n
        while at:
            at = back[at]
            cuts.append(at)
        cuts.reverse()
        held = ""
        for a, b in zip(cuts, cuts[1:]):
            if run[a:b] in self.costs:
                if held:
                    yield held
                held = ""
                yield run[a:b]
            else:
                held += run[a:b]
        if held:
            yield held

    def spaced(self, text: str) -> str:
        """The text with spaces around the words of its runs."""
        return _RUN.sub(lambda m: " " + " ".join(self.words(m.group())) + " ", text)


def spaced(c: Column, dictionary: Dictionary | None) -> Column:
    """The same of a column; only texts with such characters leave the JVM."""
    if dictionary is None:
        return c

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(dictionary.spaced, na_action="ignore")

    return F.coalesce(cut(F.when(c.rlike(f"[{SCRIPTS}]"), c)), c)
