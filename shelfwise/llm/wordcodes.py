"""Words of many texts at once, as numbers into a list of distinct words."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa

#: Bytes that no UTF-8 text holds: the end of a piece of a text, and of a text.
PIECE, TEXT = b"\xff", b"\xfe"
#: Codes of the two marks; words count from 2.
PIECE_CODE, TEXT_CODE, FIRST_WORD = 0, 1, 2


def fold_table(spaces: bytes, ends: bytes, lower: bool = True) -> bytes:
    """A table for ``bytes.translate``: A-Z to a-z, ``spaces`` to a space and ``ends`` to the end of a piece."""
    table = bytearray(range(256))
    if lower:
        table[65:91] = range(97, 123)
    for byte in spaces:
        table[byte] = 32
    for byte in ends:
        table[byte] = PIECE[0]
    # what is left of ASCII white space would part words too
    assert all(table[byte] in (32, PIECE[0]) for byte in b"\t\n\r\x0b\x0c")
    return bytes(table)


def word_codes(texts: Iterable[bytes], table: bytes) -> tuple[np.ndarray, pa.Array]:
    """Codes of the words and marks of the texts, in order, and the distinct words (binary, of the codes from 2)."""
    mark = b" " + TEXT + b" "
    joined = mark.join([b"", *(t.translate(table).replace(PIECE, b" \xff ") for t in texts)])
    tokens = pa.array([PIECE, TEXT, *joined.split()], pa.binary()).dictionary_encode()
    codes = tokens.indices.to_numpy(zero_copy_only=False)[2:].astype(np.int32)
    return codes, tokens.dictionary[2:]
