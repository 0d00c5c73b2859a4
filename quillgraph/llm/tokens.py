"""Words of whole batches of texts at once: bytes are classed by a table, words are runs of word bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Classes of bytes.
WORD, SPACE, BREAK = 0, 1, 2


def byte_classes(spaces: bytes, breaks: bytes = b"") -> np.ndarray:
    """The class of each byte value. Bytes of multi-byte characters are word bytes, so only ASCII may be given."""
    classes = np.full(256, WORD, np.uint8)
    classes[list(spaces)] = SPACE
    classes[list(breaks)] = BREAK
    return classes


#: Each byte value, A-Z as a-z.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


@dataclass
class Words:
    """codes: each word's place in `distinct` (binary); row: the text that it is in; piece: rises at every break and text."""

    codes: np.ndarray
    distinct: pa.Array
    row: np.ndarray
    piece: np.ndarray


def words(texts: pa.Array, classes: np.ndarray, written: np.ndarray = LOWER) -> Words:
    """The words of texts in order, A-Z lower-cased or as `written` says. Null texts have none.

    Memory is some ten times the texts'."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    empty = Words(np.zeros(0, np.int64), pa.array([], pa.binary()), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if not len(texts) or ends[-1] == ends[0]:
        return empty
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    kinds = classes[data]
    inside = kinds == WORD
    breaks = np.flatnonzero(kinds == BREAK)
    del kinds
    begins = np.zeros(len(data) + 1, bool)  # a text begins here
    begins[ends[:-1]] = begins[-1] = True
    firsts = inside.copy()
    firsts[1:] &= ~inside[:-1] | begins[1:-1]
    starts = np.flatnonzero(firsts)
    if not len(starts):
        return empty
    lasts = np.logical_not(inside[1:], out=firsts[:-1])
    lasts |= begins[1:-1]
    lasts &= inside[:-1]
    firsts[-1] = inside[-1]
    offsets = np.append(0, np.cumsum(np.flatnonzero(firsts) + 1 - starts))
    spelled = written[data[inside]]
    del inside, firsts, lasts
    wide = len(spelled) >= 1 << 31
    kind, width = (pa.large_binary(), np.int64) if wide else (pa.binary(), np.int32)
    found = pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(offsets.astype(width)), pa.py_buffer(spelled)]).dictionary_encode()
    row = np.searchsorted(ends[1:], starts, side="right")
    return Words(found.indices.to_numpy().astype(np.int64), found.dictionary.cast(pa.binary()), row, np.searchsorted(breaks, starts) + row)
