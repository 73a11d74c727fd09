"""Plain words: runs of a-z, 0-9 and characters beyond ASCII, A-Z lower-cased."""

from __future__ import annotations

#: The same words as a pattern over lower-cased text.
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _table() -> bytes:
    kept = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
    return bytes(c if c in kept else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


_TABLE = _table()


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text; null has none."""
    return text.translate(_TABLE).split() if text else []
