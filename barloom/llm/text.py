"""Small text helpers shared by the operators."""

from __future__ import annotations

import zlib

WHITE = b" \t\n\x0b\x0c\r"


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; ``bytes.split`` cuts at exactly these six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def crc32_text(text: str | None) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) if text else 0
