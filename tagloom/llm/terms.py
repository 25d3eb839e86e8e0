"""Cut texts into terms: maximal runs of term characters, A-Z in lower case.

Every character beyond ASCII belongs to terms, so the bytes of UTF-8 can be looked up
one by one in a table of 256, and a whole batch of texts is cut at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are cut at once (or one text, where it is longer).
CHUNK = 8 << 20


def term_table(*spans: tuple[int, int]) -> np.ndarray:
    """For each byte what stands for it in a term, or 0; spans (first, last) of ASCII separate terms."""
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    for first, last in spans:
        table[first : last + 1] = 0
    table[0] = 0
    return table


#: Letters alone, and letters with digits.
LETTERS = term_table((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
LETTERS_DIGITS = term_table((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def spans_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins and the last ends; a null text is empty."""
    flat = texts.fill_null("").cast(pa.large_binary())
    _, offsets, data = flat.buffers()
    starts = np.frombuffer(offsets, np.int64)[flat.offset : flat.offset + len(flat) + 1]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_[starts[0] : starts[-1]], starts - starts[0]


def chunks(batch: pa.RecordBatch, column: int, size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have ``size`` bytes together, or one row."""
    _, starts = spans_of(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + size, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def cut(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """All terms in order: the row of each, and the terms as bytes."""
    data, starts = spans_of(texts)
    mapped = table[data]
    inside = mapped != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    borders = starts[:-1][starts[:-1] < len(data)]
    first[borders] = inside[borders]  # a text's first term does not continue the text before
    places = np.flatnonzero(first)
    offsets = np.append(np.cumsum(inside, dtype=np.int32)[places] - 1, np.count_nonzero(inside)).astype(np.int32)
    terms = pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(offsets), pa.py_buffer(mapped[inside])])
    return np.searchsorted(starts, places, "right") - 1, terms


def counted(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Each text's different terms: row, number of the term, occurrences; and the terms by number."""
    rows, terms = cut(texts, table)
    coded = terms.dictionary_encode()
    base = max(1, len(coded.dictionary))
    pairs, counts = np.unique(rows * base + coded.indices.to_numpy(), return_counts=True)
    return *np.divmod(pairs, base), counts, coded.dictionary
