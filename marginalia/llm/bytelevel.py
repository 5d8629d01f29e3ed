"""Pre-tokens of byte-level tokenizers that are plain enough to go straight to the model.

A run of Latin letters, and a run of ASCII signs other than the apostrophe after it, are
one pre-token each for the byte-level tokenizers used here. The tokenizer's own model then
merges them without the steps before it, which take most of the time.
"""

from __future__ import annotations

import re

_PLAIN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_REST = [b for b in range(256) if b not in set(_PLAIN)]
#: How byte-level models write bytes as characters.
_WRITTEN = {b: b for b in _PLAIN} | {b: 256 + i for i, b in enumerate(_REST)}
_SPACE = chr(_WRITTEN[32])

#: An optional space, letters, signs.
WORD_AND_SIGNS = re.compile(r"( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\[-`{-~]*)")


def written(pre_token: str) -> str:
    if pre_token.isascii() and pre_token.isprintable():
        return pre_token.replace(" ", _SPACE)
    return pre_token.encode().decode("latin-1").translate(_WRITTEN)


_LETTERS = {c: "".join(chr(_WRITTEN[b]) for b in chr(c).encode()) for c in (32, *range(0xC0, 0x100))}


def written_part(part: str) -> str:
    """As ``written``, of what ``WORD_AND_SIGNS`` finds."""
    return part.replace(" ", _SPACE) if part.isascii() else part.translate(_LETTERS)
