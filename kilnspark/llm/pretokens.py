"""Byte-level vocabularies and the pattern that cuts a text before their pieces are looked up."""

from __future__ import annotations

import base64
import re

#: Characters below U+0180 by class; texts with others take the Unicode properties.
_LETTER = r"A-Za-zªµºÀ-ÖØ-öø-ſ"
_NUMBER = r"0-9²³¹¼-¾"
_SPACE = r"\t-\r \u0085 "
_WIDE_SPACE = _SPACE + r"  -     　"
_SHAPE = "'s|'t|'re|'ve|'m|'ll|'d| ?[{l}]+| ?[{n}]+| ?[^{s}{l}{n}]+|[{s}]+(?![^{s}])|[{s}]+"
_NARROW = re.compile(_SHAPE.format(l=_LETTER, n=_NUMBER, s=_SPACE))
_OTHER = re.compile(r"[^\x00-ſ]")
_wide: list = []


def pieces(text: str) -> list[str]:
    """The matches of public_tokenizers.PATTERN in the text, which they cover wholly."""
    if not _OTHER.search(text):
        return _NARROW.findall(text)
    if not _wide:
        import regex

        _wide.append(regex.compile(_SHAPE.format(l=r"\p{L}", n=r"\p{N}", s=_WIDE_SPACE)))
    return _wide[0].findall(text)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
