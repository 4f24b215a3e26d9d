"""Splitting of text into the pieces within which byte-pair merges happen."""

from __future__ import annotations

import re
from collections.abc import Iterator

import regex

#: The splitting pattern for ASCII texts, which ``re`` runs faster; the same matches there.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
# Letters, numbers and white space below U+0250; all other characters there are neither.
_LETTER, _NUMBER, _SPACE = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\t-\r \u0085\u00a0"
#: The same for texts in Latin script with common punctuation.
_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: A character beyond that: the dashes, quotes and marks from U+2010 on are neither letter, number nor space.
_FAR = re.compile("[^\\x00-\u024f\u2010-\u2027\u2030-\u205e]")
#: Characters of a text whose pieces are held in memory at once.
LONG = 1 << 20


class Splitter:
    """Matches of a splitting pattern, in order."""

    def __init__(self, pattern: str):
        self.pattern = regex.compile(pattern)
        from public_tokenizers import PATTERN
        self.known = pattern == PATTERN

    def split(self, text: str) -> Iterator[list[str]]:
        """Lists of pieces that together are all matches in ``text``."""
        pattern = self.pattern
        if self.known:
            pattern = _ASCII if text.isascii() else pattern if _FAR.search(text) else _LATIN
        if len(text) <= LONG:
            yield pattern.findall(text)
            return
        held = []
        for match in pattern.finditer(text):
            held.append(match.group())
            if len(held) >= LONG // 4:
                yield held
                held = []
        yield held
