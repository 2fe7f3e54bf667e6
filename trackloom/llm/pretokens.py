"""Splitting texts for the tokenizers: units that can be encoded apart from each other, each distinct one once.

``path`` of ``public_tokenizers`` names the vocabulary files; other files can be given by path.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

#: Characters whose classes and normal form every Unicode version since 5 agrees on, white space being these four.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-˿]*").fullmatch


def vocabulary_file(name: str) -> str:
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def is_plain(text: str) -> bool:
    return _PLAIN(text) is not None


def spaced_units(text: str) -> list[str] | None:
    """The text cut before each space, if the splitting pattern certainly cuts there too: a space that white space
    doesn't follow starts a new match, whatever stands before it."""
    if "  " in text or " \n" in text or " \t" in text or " \r" in text or text[-1:] == " " or not is_plain(text):
        return None
    first, *rest = text.split(" ")
    return ([first] if first else []) + [" " + x for x in rest]


class Cache(dict):
    """Unit -> what ``make`` gives for it. When ``limit`` units are held, they become the old ones, of which those that
    are asked for again stay; so memory is bounded by twice the limit and frequent units are kept."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, unit: str):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        value = self.old.get(unit)
        if value is None:
            value = self.make(unit)
        if len(unit) <= 256:
            self[unit] = value
        return value


def json_tokenizer(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_file(name))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer
