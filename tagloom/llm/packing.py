"""Pack documents into fixed windows, filled with lexically related documents.

The documents of a scan task are cut into shards of bounded token count.  A shard
gets a BM25 inverted index over token ids.  Documents longer than the window fill
whole windows by themselves; what is left of every document is then packed: the
first unused document is a seed, its strongest terms query the index, and unused
neighbours fill the seed's window in order of score.  The neighbour that does not
fit is cut, its rest stays unused, so all windows of a shard but the last one are
full.

Nothing is shuffled: a shard belongs to one scan task, its sequence ids are made
of the task's partition number and a counter, and a lost task repeats its own
windows.  Memory is bounded by the shard size and the longest document.

Ids are those of the tokenizer file's byte-level BPE; its merges are run by a
faster library where the file has nothing else, which is checked on loading.

Defined cases: a null text is empty; an empty text is one piece that holds only
the closing id; rows are packed one by one, so repeated rows repeat their pieces;
equal scores are taken in the order read; a null id is passed through; an empty
table has no pieces.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from public_tokenizers import PATTERN
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tagloom.llm.bpe import byte_characters

#: Tokens of a window, the id that closes a document, tokens of a shard.
WINDOW, CLOSE, SHARD_TOKENS = 2048, 1, 3_000_000
#: Terms of a seed that query the index, and the two BM25 constants.
QUERY_TERMS, K1, B = 24, 1.2, 0.75
#: Neighbours ranked at once; more are ranked when a window needs them.
NEIGHBOURS = 32
#: Documents that one query scores together.
OUT = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Ids:
    """Token ids of texts by a tokenizer file, without added special tokens, closed by one id."""

    def __init__(self, path: str, close: int = CLOSE):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.close = np.array([close], np.uint32)
        self.fast = self._ranked(spec)
        self.slow = None if self.fast else Tokenizer.from_file(path)

    @staticmethod
    def _ranked(spec: dict) -> tiktoken.Encoding | None:
        """The same BPE by ranks, if ids are ranks and nothing but byte-level merges happens."""
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        odd = [spec["normalizer"], spec["post_processor"], model.get("dropout"), model.get("unk_token"), model.get("ignore_merges")]
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        if model["type"] != "BPE" or not plain or any(odd):
            return None
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in model["vocab"].items() if t not in special}
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        bare = any(t.get(f) for t in spec["added_tokens"] for f in ("lstrip", "rstrip", "single_word", "normalized"))
        if bare or [model["vocab"].get(m) for m in merged] != list(range(256, 256 + len(merged))):
            return None
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str | None) -> np.ndarray:
        if self.fast:
            ids = self.fast.encode_to_numpy(text or "", allowed_special="all")
        else:
            ids = np.array(self.slow.encode(text or "", add_special_tokens=False).ids, np.uint32)
        return np.concatenate([ids, self.close])


_LOADED: dict[tuple[str, int], Ids] = {}


def ids_by(path: str, close: int = CLOSE) -> Ids:
    if (path, close) not in _LOADED:
        _LOADED[path, close] = Ids(path, close)
    return _LOADED[path, close]


class Index:
    """BM25 weights of a shard, by document and by term."""

    def __init__(self, docs: list[np.ndarray]):
        n = len(docs)
        lengths = np.fromiter(map(len, docs), np.int64, n)
        base = int(max(ids.max() for ids in docs)) + 1
        keys = np.concatenate(docs).astype(np.int64)
        keys += np.repeat(np.arange(n) * base, lengths)
        pairs, counts = np.unique(keys, return_counts=True)
        doc, term = np.divmod(pairs, base)
        in_docs = np.bincount(term, minlength=base)
        idf = np.log1p((n - in_docs + 0.5) / (in_docs + 0.5))
        norm = K1 * (1 - B + B * lengths / lengths.mean())
        weight = (idf[term] * counts * (K1 + 1) / (counts + norm[doc])).astype(np.float32)
        self.terms = term
        self.bounds = np.r_[0, np.cumsum(np.bincount(doc, minlength=n))]
        order = np.argsort(term, kind="stable")
        self.doc, self.weight, self.own = doc[order].astype(np.int32), weight[order], weight
        self.starts = np.r_[0, np.cumsum(in_docs)]
        self.n = n

    def scores(self, seed: int) -> np.ndarray:
        """BM25 scores of all documents for the strongest terms of one."""
        lo, hi = self.bounds[seed], self.bounds[seed + 1]
        terms = self.terms[lo:hi]
        if hi - lo > QUERY_TERMS:
            terms = terms[np.argpartition(-self.own[lo:hi], QUERY_TERMS)[:QUERY_TERMS]]
        spans = [slice(self.starts[t], self.starts[t + 1]) for t in terms]
        found = np.concatenate([self.doc[s] for s in spans])
        return np.bincount(found, np.concatenate([self.weight[s] for s in spans]), self.n)


def pack_shard(docs: list[np.ndarray], window: int = WINDOW) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of a shard, each a list of pieces (document, start, length)."""
    n = len(docs)
    lengths = np.fromiter(map(len, docs), np.int64, n)
    start = lengths // window * window
    for d in np.flatnonzero(start).tolist():
        for at in range(0, int(start[d]), window):
            yield [(d, at, window)]
    unused = start < lengths
    index, seed = None, 0
    while seed < n:
        if not unused[seed]:
            seed += 1
            continue
        index = index or Index(docs)
        pieces, free = [(seed, int(start[seed]), int(lengths[seed] - start[seed]))], window
        free -= pieces[0][2]
        unused[seed] = False
        if free and unused.any():
            ranked = np.where(unused, index.scores(seed), -1.0)
            taken, wanted = 0, NEIGHBOURS
            while free:
                if wanted < n:
                    top = np.argpartition(-ranked, wanted)[:wanted]
                    top = top[np.lexsort((top, -ranked[top]))]
                else:
                    top = np.argsort(-ranked, kind="stable")
                for d in top[taken:].tolist():
                    taken += 1
                    if not free or not unused[d]:
                        break
                    size = min(free, int(lengths[d] - start[d]))
                    pieces.append((d, int(start[d]), size))
                    start[d] += size
                    free -= size
                    unused[d] = start[d] < lengths[d]
                else:
                    if wanted < n:  # all ranked neighbours are in the window: rank more
                        ranked[top] = -1.0
                        taken = 0
                        continue
                break
        yield pieces


def pack(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", window: int = WINDOW, close: int = CLOSE, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pieces of all documents: key, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    key_type = docs.schema[key].dataType.simpleString()
    numbers = [f.split()[0] for f in OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, sequence = ids_by(tokenizer, close), TaskContext.get().partitionId() << 36
        keys, shard, size = [], [], 0

        def rows(sequence: int) -> Iterator[tuple]:
            for pieces in pack_shard(shard, window):
                offset = 0
                for d, start, length in pieces:
                    crc = zlib.crc32(shard[d][start : start + length].astype("<u4").tobytes())
                    yield d, start, length, crc, len(shard[d]), sequence, offset
                    offset += length
                sequence += 1

        def packed() -> pa.RecordBatch:
            nonlocal sequence
            columns = np.array(list(rows(sequence)), np.int64).T
            sequence = int(columns[5, -1]) + 1
            names = pa.array(keys, key_arrow).take(pa.array(columns[0]))
            return pa.RecordBatch.from_arrays([names, *map(pa.array, columns[1:])], names=[key, *numbers])

        key_arrow = None
        for batch in batches:
            key_arrow = batch.schema.field(0).type
            for name, value in zip(batch.column(0), batch.column(1)):
                ids = ids_of(value.as_py())
                if shard and size + len(ids) > shard_tokens:
                    yield packed()
                    keys, shard, size = [], [], 0
                keys.append(name.as_py())
                shard.append(ids)
                size += len(ids)
        if shard:
            yield packed()

    return docs.select(key, text).mapInArrow(run, f"`{key}` {key_type}, {OUT}")
