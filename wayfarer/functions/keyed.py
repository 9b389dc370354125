"""Key forms of texts inside tasks, and where their letters stand in the original."""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import regex

from wayfarer.functions.text import marked_letters

_BARE = str.maketrans(*marked_letters())
_FOREIGN = re.compile(r"[^\x00-\x7f]+")
_MARKS = regex.compile(r"\p{Mn}+")
#: White space as the column functions know it.
_WHITE = r"[ \t\n\x0b\f\r]"
_SPACES = re.compile(f"{_WHITE}+")
#: What has no letter in the key form: white space at the beginning, all but the first of a run of it, loose marks.
_GONE = regex.compile(rf"(?P<head>\A\p{{Mn}}*(?:{_WHITE}\p{{Mn}}*)+)|{_WHITE}(?P<run>\p{{Mn}}*(?:{_WHITE}\p{{Mn}}*)+)|(?P<mark>\p{{Mn}}+)")


def bare(text: str) -> str:
    """``text.strip_marks``."""
    return text if text.isascii() else _FOREIGN.sub(lambda m: m[0].translate(_BARE), _MARKS.sub("", text))


def key_text(text: str) -> str:
    """``text.fold_key`` but for white space at the end."""
    return _SPACES.sub(" ", bare(text).lower().replace("ς", "σ")).lstrip(" ")


class Places:
    """From places in the key form of a text to places in the text."""

    def __init__(self, text: str):
        self.after, lengths, gone = [], [], 0
        for m in _GONE.finditer(text):
            start, end = m.span(m.lastgroup)
            self.after.append(start - gone)
            gone += end - start
            lengths.append(end - start)
        self.gone = list(accumulate(lengths, initial=0))

    def __call__(self, at: int) -> int:
        return at + self.gone[bisect_right(self.after, at)]


class Folded:
    """A text with its key form, made once for many needles."""

    def __init__(self, text: str):
        self.text, self.key, self.places = text, key_text(text), None

    def find(self, key: str) -> tuple[int, int] | None:
        """Start and end in the text of the first place of ``key`` in its key form."""
        at = self.key.find(key)
        if at < 0:
            return None
        if self.places is None:
            # of a key form as long as the text nothing is left out
            self.places = (lambda i: i) if len(self.key) == len(self.text) else Places(self.text)
        return self.places(at), self.places(at + len(key) - 1) + 1 if key else self.places(at)


def find(text: str | None, key: str | None) -> tuple[int, int] | None:
    """``Folded.find`` of one needle; null if one of both is."""
    return None if text is None or key is None else Folded(text).find(key)
