"""Words of whole Arrow batches of texts, as bytes: A-Z lower-cased, then runs of 0-9, a-z and all
characters beyond ASCII, which is ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: For bytes.translate(): ASCII other than letters and digits becomes a space. UTF-8 has no ASCII byte
#: within other characters, so this is exact on bytes.
_LOWERED = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def words_of(texts: pa.Array) -> Iterator[list[bytes]]:
    """The words of each text; none for null."""
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = texts.buffers()[2]
    lowered = bytes(memoryview(data)[offsets[0] : offsets[-1]]).translate(_LOWERED) if data is not None else b""
    valid = texts.is_valid().to_pylist()
    at = (offsets - offsets[0]).tolist()
    for k, there in enumerate(valid):
        yield lowered[at[k] : at[k + 1]].split() if there else []
