"""Lower-cased terms of a text: runs of digits, ASCII letters and all characters beyond ASCII."""

from __future__ import annotations

#: Every byte that is no digit, letter or part of a longer character becomes a space; only A-Z change case.
_KEPT = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def split_terms(text: str) -> list[bytes]:
    """UTF-8 bytes of the terms, in order."""
    return text.encode().translate(_KEPT).split()
