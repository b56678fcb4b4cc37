"""Text pieces shared by the operators: ASCII words, segments, and a cache of encoded segments."""

from __future__ import annotations

from collections.abc import Callable

import regex

_SPACE_AFTER_SPACE = regex.compile(r"\s ")
_SOLO_SPACE = regex.compile(r"(?<=\S) ")


def ascii_words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of a text with A-Z lower-cased, as UTF-8 bytes; null has none.

    bytes.lower and bytes.split touch ASCII only, which is just this definition.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def segments(text: str) -> list[str]:
    """Cut a text before every blank that follows a non-blank; all but the first lose that blank.

    Every cut is a token boundary of the public split pattern: a match can hold a blank only as
    its first character or inside a run of white space, and its only look-ahead asks what follows
    white space. Segments may therefore be encoded one by one.
    """
    return _SOLO_SPACE.split(text) if _SPACE_AFTER_SPACE.search(text) or text[:1] == " " else text.split(" ")


class Encoded(dict):
    """Segments encoded when first met, kept up to a limit; later new ones are encoded each time."""

    def __init__(self, encode: Callable[[str], bytes], lead: str, limit: int = 300_000):
        super().__init__()
        self.encode, self.lead, self.limit = encode, lead, limit

    def __missing__(self, segment: str) -> bytes:
        value = self.encode(self.lead + segment)
        if len(self) < self.limit:
            self[segment] = value
        return value
