"""Byte-level BPE through a sentencepiece model made from the vocabulary.

The model file is written field by field: every token's bytes become a piece of
printable characters, one per byte, scored by its negative rank, so the merge
with the best score is the merge with the lowest rank.  Normalisation is the
identity.  A text is cut into pre-tokens by the vocabulary's pattern, each
pre-token is encoded by itself, and ids decode through the inverse mapping.

Pre-tokens repeat, so each task remembers those it has seen, up to a fixed
number; a forgotten one is encoded again, results do not change.

Defined cases: a null text is the empty text, which has no ids; equal texts get
equal ids; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import pandas as pd
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pre-tokens that a task remembers between groups of texts, and the characters of a group.
REMEMBERED, GROUP_CHARACTERS = 300_000, 500_000
# White space as the pattern's engine defines it.
WHITE = r"\p{White_Space}"


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is visible, else one above 255."""
    visible = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | str | int | float) -> bytes:
    """One protocol-buffer field: integers as varints, floats as 32 bits, the rest with a length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    raw = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(raw)) + raw


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised BPE model; piece 0 is the unknown piece, piece rank + 1 a token."""
    # Field and enum numbers of the public sentencepiece model format.
    pieces, trainer, normalizer = 1, 2, 3
    piece, score, kind, unknown = 1, 2, 3, 2
    model_type, bpe, vocab_size = 3, 2, 4
    name, dummy_prefix, extra_spaces, escape_spaces = 1, 3, 4, 5
    characters = byte_characters()
    out = [_field(pieces, _field(piece, "<unk>") + _field(score, 0.0) + _field(kind, unknown))]
    for rank, token in enumerate(tokens):
        out.append(_field(pieces, _field(piece, "".join(characters[b] for b in token)) + _field(score, -float(rank))))
    out.append(_field(trainer, _field(model_type, bpe) + _field(vocab_size, len(tokens) + 1)))
    plain = _field(name, "identity") + b"".join(_field(f, 0) for f in (dummy_prefix, extra_spaces, escape_spaces))
    return b"".join([*out, _field(normalizer, plain)])


class Codec:
    """Encoder and decoder of one vocabulary, kept for the life of a Python worker."""

    def __init__(self, path: str, pattern: str):
        self.tokens = read_ranks(path)
        self.whole = {token: rank for rank, token in enumerate(self.tokens)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.tokens))
        characters = byte_characters()
        self.mapped = {b: c for b, c in enumerate(characters)}
        white = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{WHITE}\p{{L}}\p{{N}}]")
        self.split = regex.compile(white.replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")).findall
        self.seen: dict[str, tuple] = {}

    def learn(self, pre_tokens: set[str]) -> None:
        """Encode pre-tokens together and remember (ids, their decimal text, their bytes) of each."""
        new = list(pre_tokens)
        raws = [p.encode() for p in new]
        parts = [raw.decode("latin-1").translate(self.mapped) for raw in raws]
        for p, raw, pieces in zip(new, raws, self.model.encode(parts, num_threads=1)):
            rank = self.whole.get(raw)
            ids = [i - 1 for i in pieces] if rank is None else [rank]
            self.seen[p] = ids, " ".join(map(str, ids)), self.decode(ids)

    def remember(self, texts: list[str | None]) -> Iterator[list[tuple]]:
        """What is remembered of the pre-tokens of each text, a group of texts at a time."""
        at = 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and size < GROUP_CHARACTERS:
                group.append(self.split(texts[at] or ""))
                size += len(texts[at] or "")
                at += 1
            wanted = set(chain.from_iterable(group))
            if len(self.seen) + len(wanted) > REMEMBERED:
                self.seen.clear()
            self.learn(wanted.difference(self.seen))
            yield from ([self.seen[p] for p in pre_tokens] for pre_tokens in group)

    def encode(self, text: str | None) -> list[int]:
        return next(self.encoded([text]))

    def encoded(self, texts: list[str | None]) -> Iterator[list[int]]:
        for parts in self.remember(texts):
            yield [i for ids, _, _ in parts for i in ids]

    def decode(self, ids) -> bytes:
        return b"".join([self.tokens[i] for i in ids])

    def digests(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """Number of ids, digest of the ids' decimal text, digest of the decoded bytes, for each text."""
        for parts in self.remember(texts):
            written = " ".join([p[1] for p in parts])
            decoded = hashlib.sha256(b"".join([p[2] for p in parts])).hexdigest()
            yield (written.count(" ") + 1 if parts else 0), hashlib.sha256(written.encode()).hexdigest(), decoded


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str = public_tokenizers.PATTERN) -> Codec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encode(text: Column | str, path: str) -> Column:
    """The ids of a text."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(codec(path).encoded(texts.tolist())), dtype=object)

    return run(text)


def decode(ids: Column | str, path: str) -> Column:
    """The bytes of some ids."""

    @F.pandas_udf("binary")
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: codec(path).decode(x if x is not None else ()))

    return run(ids)


def round_trip(text: Column | str, path: str) -> Column:
    """A struct: number of ids, digests of the ids and of the bytes decoded from them."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(texts: pd.Series) -> pd.DataFrame:
        digests = list(codec(path).digests(texts.tolist()))
        return pd.DataFrame(digests, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return run(text)
