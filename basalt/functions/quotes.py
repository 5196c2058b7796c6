"""Aligned quotes of one text at a time, for workers: what operators.grounding says of claims, contents and their sentences, by the same rules.

A text's sentences are read once for all claims about it that follow each other.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right

import pandas as pd

from basalt.operators.grounding import NEGATIONS, NUMBER, QUOTED, STOP

#: White space as grounding has it, without the separators \x1c to \x1f that str.split takes for such.
SPACE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACES, _SEPARATORS = re.compile(f"[{SPACE}]+"), ("\x1c", "\x1d", "\x1e", "\x1f")
_WORDS = re.compile(r"[^\W_]{3,}")
_END = re.compile("[.!?]+[\"”’')\\]]*(?=[ \t-\r]|\\Z)|\n{2,}")
# \w, \d, \s and letter case are those of ASCII there.
_NUMBER, _QUOTED, _DIGIT = re.compile(NUMBER, re.ASCII), re.compile(QUOTED), re.compile("[0-9]")
_STOP, _TURNS = frozenset(STOP), frozenset(NEGATIONS)
#: Sentences and claims that a worker remembers at most, of so many signs at most.
REMEMBERED, SHORT = 8_192, 1_024


def _parts(low: str) -> list[str]:
    """What stands between white space."""
    for sign in _SEPARATORS:
        if sign in low:
            return [x for x in _SPACES.split(low) if x]
    return low.split()


def _spans(text: str) -> list[tuple[int, int]]:
    """grounding.sentences."""
    out, at, n = [], 0, len(text)
    while at < n:
        m = _END.search(text, at + 1)
        end = last = m.end() if m else n
        while at < last and text[at] in SPACE:
            at += 1
        while at < last and text[last - 1] in SPACE:
            last -= 1
        if at < last:
            out.append((at, last))
        at = end
    return out


def _sentence(sentence: str) -> tuple[str, frozenset, frozenset]:
    """A sentence's plain form, its significant words and its negations."""
    parts = _parts(sentence.lower())
    plain = " ".join(parts)
    return plain, frozenset(_WORDS.findall(plain)) - _STOP, _TURNS.intersection(parts)


def _claim(claim: str) -> tuple[list, list, list]:
    """A claim's words, negations and anchors."""
    low = claim.lower()
    found = [*(_NUMBER.findall(claim) if _DIGIT.search(claim) else ()), *_QUOTED.findall(claim)]
    plain = (" ".join(_parts(x.lower())) for x in found)
    return list({*_WORDS.findall(low)} - _STOP), list(_TURNS.intersection(_parts(low))), [x for x in plain if x]


#: A worker remembers what it read of short sentences and claims, since many come again.
_met_sentence, _met_claim = functools.lru_cache(REMEMBERED)(_sentence), functools.lru_cache(REMEMBERED)(_claim)


class Content:
    """A text's sentences with their words and negations. An item is found as the runs of sentences that hold it, numbers of one sentence each or (first, last)."""

    def __init__(self, text: str):
        self.text, self.spans = text, _spans(text)
        held = [_met_sentence(text[a:b]) if b - a <= SHORT else _sentence(text[a:b]) for a, b in self.spans]
        self.plain, self.words, self.turns = ([x[i] for x in held] for i in range(3))
        self.whole = " ".join(self.plain)
        self.begins, self._latest = None, {}

    def anchored(self, part: str) -> list:
        """Only an anchor with a blank can go over the end of a sentence."""
        if " " not in part:
            return [i for i, p in enumerate(self.plain) if part in p]
        if self.begins is None:
            self.begins = [0]
            for p in self.plain[:-1]:
                self.begins.append(self.begins[-1] + len(p) + 1)
        out, at = [], self.whole.find(part)
        while at >= 0:
            out.append((bisect_right(self.begins, at) - 1, bisect_right(self.begins, at + len(part) - 1) - 1))
            at = self.whole.find(part, at + 1)
        return out

    def latest(self, runs: tuple) -> list[int]:
        """For each sentence where the latest of some runs begins that ends there or before, -1 without one. Items of the same runs share it."""
        row = self._latest.get(runs)
        if row is None:
            row, latest = [], -1
            for run in runs:
                first, last = (run, run) if isinstance(run, int) else run
                row += [latest] * (last - len(row))
                latest = max(latest, first)
            row += [latest] * (len(self.spans) - len(row))
            self._latest[runs] = row
        return row

    def quote(self, claim: str) -> tuple[int, int]:
        """The shortest run of whole sentences with all that the text has of the claim, the earliest of equal ones; the whole text where there is none."""
        words, turns, anchors = _met_claim(claim) if len(claim) <= SHORT else _claim(claim)
        asked = {tuple([i for i, held in enumerate(self.words) if w in held]) for w in words}
        asked.update(tuple([i for i, held in enumerate(self.turns) if w in held]) for w in turns)
        asked.update(tuple(self.anchored(x)) for x in anchors if x in self.whole)
        # What the text hasn't isn't asked of it.
        asked.discard(())
        if not asked:
            return 0, len(self.text)
        best, size, spans = None, 0, self.spans
        rows = [self.latest(x) for x in asked]
        # Every run ends at a sentence and begins at the earliest of each item's latest place; one that ends later than it need be is longer.
        for j, first in enumerate(map(min, *rows) if len(rows) > 1 else rows[0]):
            if first >= 0:
                n = spans[j][1] - spans[first][0]
                if best is None or n < size:
                    best, size = (spans[first][0], spans[j][1]), n
        return best or (0, len(self.text))


def aligned(claims: pd.Series, contents: pd.Series) -> pd.DataFrame:
    """start and end of each claim's quote; null claims keep the whole content, null contents have no end."""
    out, last, held = [], None, None
    for claim, content in zip(claims.to_list(), contents.to_list(), strict=True):
        if content is None or claim is None:
            out.append((0, None if content is None else len(content)))
            continue
        if held is None or content != last:
            last, held = content, Content(content)
        out.append(held.quote(claim))
    return pd.DataFrame(out, columns=["start", "end"], dtype="Int32")
