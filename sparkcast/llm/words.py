"""Words of a text: maximal runs of bytes other than space, tab, line feed, vertical tab, form feed, carriage return.

``bytes.split`` cuts at just these six. Long texts are walked in blocks, so that a task holds the words of one block.
"""

from __future__ import annotations

from collections.abc import Iterator

BLOCK = 1 << 20
_SPACE = b" \t\n\x0b\x0c\r"


def word_blocks(data: bytes, block: int = BLOCK) -> Iterator[list[bytes]]:
    """The words of ``data`` in order, one list per block of about ``block`` bytes; no list is empty."""
    start, size = 0, len(data)
    while start < size:
        stop = min(size, start + block)
        while stop < size and data[stop] not in _SPACE:
            stop += 1
        words = data[start:stop].split()
        if words:
            yield words
        start = stop
