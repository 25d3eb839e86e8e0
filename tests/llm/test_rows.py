"""Operators that judge or code each document by itself."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers as public
import pyarrow as pa
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tagloom.llm import bpe, classifier, packing, quality_rules as qr

RANKS, JSON = public.path("byte_bpe_50k.tiktoken"), public.path("byte_bpe_50k.json")


def repeats(units: list) -> list[int]:
    """Longest repeat from each place, by comparing all suffixes."""
    n = len(units)
    out = [0] * n
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while max(i, j) + k < n and units[i + k] == units[j + k]:
                    k += 1
                out[i] = max(out[i], k)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=25), min_size=1, max_size=4))
def test_longest_repeats(sequences):
    docs = np.repeat(np.arange(len(sequences)), [len(s) for s in sequences])
    codes = np.array([x for s in sequences for x in s], np.int64)
    assert qr.longest_repeats(codes, docs).tolist() == [x for s in sequences for x in repeats(s)]


def test_rules_on_odd_rows(odd, none):
    rows = qr.judge(odd, into="judged").collect()
    found = {(r.doc_id, r.text[:3] if r.text else r.text): r.judged for r in rows}
    assert len(rows) == odd.count() and rows[0].rules == "kept"
    assert found[3, None].n_words == found[4, ""].n_words == 0 and found[3, None].base_failed
    assert found[6, "wor"].n_repeat_words == 30_000 and not found[6, "wor"].kept
    assert found[7, "xxx"].n_words == 1 and found[7, "xxx"].covered == 1.0
    assert found[1, "One"].kept and found[1, "One"].word_chars == len(re.sub(r"\s", "", rows[0].text))
    assert qr.keep_good(odd).columns == odd.columns and qr.judge(none).count() == 0


def test_long_words_are_one_unit_of_clean_texts(spark):
    rnd = random.Random(5)
    clean = lambda n: " ".join("".join(rnd.choices("abcdefghij", k=6)) for _ in range(n))
    url = "https://a.org/" + "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=111))
    rules = "\n".join(clean(233) + "\n" + c * 80 for c in "=-_")
    kept = [f"{clean(1500)}\n{'=' * 130}\n{clean(1500)}", f"{clean(1500)} {url} {clean(1500)} {url}", rules, f"{clean(700)}\n{'=' * 64}", f"{clean(700)}\n{'=' * 65}"]
    sentence = "".join(chr(0x4E00 + rnd.randrange(5000)) for _ in range(90))
    dropped = [clean(20) + " " + "x" * 400, "\n".join([clean(12), *[sentence + chr(0x4E00 + i) for i in range(6)]])]
    rows = spark.createDataFrame(list(enumerate(kept + dropped)), "doc_id int, text string")
    found = {r.doc_id: r.rules.kept for r in qr.judge(rows).collect()}
    assert [found[i] for i in range(len(found))] == [True] * len(kept) + [False] * len(dropped)
    only = qr.measure_texts(["x" * 200 + " " + "word " * 1]).iloc[0]
    assert only.covered == 200 / 204 and only.longest_repeat == 0


def many_texts(n: int, words: int) -> pa.Array:
    rnd = random.Random(8)
    return pa.array([None, "", *(" ".join(f"w{rnd.randrange(2000)}" for _ in range(words)) for _ in range(n))])


def most_mb(work) -> float:
    tracemalloc.start()
    work()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / 1e6


def test_the_rules_hold_few_texts_of_a_batch_at_once():
    texts = many_texts(1500, 400)
    assert most_mb(lambda: qr.measure_texts(t.as_py() for t in texts)) < 20  # 600,000 words; 70 MB when 400,000 were sorted together
    few = texts.slice(0, 300)
    alone = [qr.measure_texts([t]).iloc[0].to_dict() for t in few.to_pylist()]
    assert qr.measure_array(few).to_pylist() == alone
    assert len(qr.measure_array(few.slice(0, 0))) == 0


def test_scores_hold_the_features_of_few_texts_at_once():
    rng, d = np.random.default_rng(3), len(classifier.STATISTICS)
    model = classifier.Model(
        np.zeros(d), np.ones(d), rng.normal(size=(d, 256)), rng.uniform(0, 6, 256), rng.normal(size=257), np.array([0.0, 1.0]), np.array([0.0, 1.0])
    )
    texts = many_texts(8000, 12)
    found = []
    assert most_mb(lambda: found.append(classifier.scores(texts, model))) < 16  # one array of all features takes 16 MB
    whole = model.score(np.array([classifier.statistics(t) for t in texts.to_pylist()]))
    assert len(found[0]) == len(texts) and np.allclose(found[0], whole, rtol=0, atol=1e-12)
    assert len(classifier.scores(texts.slice(0, 0), model)) == 0


def reference_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_codec_equals_the_reference():
    reference, codec, rnd = reference_encoding(), bpe.codec(RANKS), random.Random(3)
    parts = ["a", " ", "  ", "\n", "\x1c", "\x85", "é", "漢", "🙂", "1", "٣", "'s", "'", "\t", "\u2028", "_", "Ⅷ", "<|endoftext|>", "\u3000", "the"]
    for _ in range(400):
        text = "".join(rnd.choices(parts, k=rnd.randint(0, 15)))
        ids = codec.encode(text)
        assert ids == reference.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_round_trip_of_odd_rows(odd, none, docs):
    reference = reference_encoding()
    for r in odd.union(docs.limit(0).select("doc_id", "text", *[F.lit("") for _ in odd.columns[2:]])).select("text", bpe.round_trip("text", RANKS).alias("c")).collect():
        ids = reference.encode_ordinary(r.text or "")
        assert r.c.n_tokens == len(ids) and r.c.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.c.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    coded = odd.select("text", bpe.decode(bpe.encode("text", RANKS), RANKS).alias("raw"))
    assert all(bytes(r.raw) == (r.text or "").encode() for r in coded.collect())
    assert none.select(bpe.round_trip("text", RANKS)).count() == 0


def test_packing(odd, none, docs):
    assert packing.pack(none, JSON).count() == 0
    slow = Tokenizer.from_file(JSON)
    for table in (odd, docs):
        texts = table.select("doc_id", "text").collect()
        rows = packing.pack(table, JSON, shard_tokens=60_000).collect()
        ids = {}
        for r in texts:
            ids.setdefault(r.doc_id, []).append(np.array([*slow.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4"))
        pieces, sequences = {}, {}
        for r in rows:
            pieces.setdefault(r.doc_id, []).append(r)
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
            assert any(r.doc_tokens == len(x) and r.ids_crc32 == zlib.crc32(x[r.start : r.start + r.length].tobytes()) for x in ids[r.doc_id])
        for key, own in pieces.items():  # repeated ids repeat their pieces
            assert sum(r.length for r in own) == sum(map(len, ids[key]))
            if len(ids[key]) == 1:
                at = 0
                for r in sorted(own, key=lambda r: r.start):
                    assert r.start == at
                    at += r.length
        assert set(pieces) == set(ids)
        short = 0
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= packing.WINDOW
            short += at < packing.WINDOW
        total = sum(len(x) for xs in ids.values() for x in xs)
        assert short <= total // 30_000 + 9  # one for each shard


def test_neighbours_share_words():
    shard = [np.array([10 + d % 3] * 6 + [100 + d, 1], np.uint32) for d in range(30)]
    first = next(packing.pack_shard(shard, window=32))
    assert {d % 3 for d, _, _ in first} == {first[0][0] % 3}


def test_classifier_separates_held_out_rows(spark, odd, none):
    rnd = random.Random(1)
    words = ["the", "ship", "sailed", "over", "a", "calm", "sea", "with", "crew", "tide"]
    rows = []
    for i in range(1200):
        bad = i % 4 == 3
        text = " ".join((rnd.choice(words) + rnd.choice(["***", "$$$", "###"]) if bad else rnd.choice(words)) for _ in range(rnd.randint(5, 60)))
        rows.append((i, text, int(not bad)))
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = table.select("doc_id", "quality").union(spark.createDataFrame([(None, 1), (5, None), (10**9, 0)], "doc_id long, quality int"))
    model = classifier.fit_documents(table, labels)
    held = table.where(classifier.fold() == 2).select("quality", classifier.score("text", model).alias("s")).collect()
    assert np.mean([(r.s >= 0.7) == bool(r.quality) for r in held]) > 0.98
    flipped = labels.withColumn("quality", F.when(classifier.fold() == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = classifier.fit_documents(table, flipped)  # held-out labels are not read
    assert np.allclose(again.ridge, model.ridge) and np.array_equal(again.values, model.values)
    assert all(0 <= r.s <= 1 for r in odd.select(classifier.score("text", model).alias("s")).collect())
    assert none.select(classifier.score("text", model)).count() == 0
    assert {r.s for r in odd.select(classifier.score("text", classifier.fit_documents(odd, labels.limit(0))).alias("s")).collect()} == {0.5}


def test_isotonic_pools_violators():
    knots, values = classifier.isotonic(np.array([1.0, 2.0, 3.0]), np.array([1.0, 0.0, 2.0]), np.array([2.0, 2.0, 2.0]))
    assert knots.tolist() == [1.5, 3.0] and values.tolist() == [0.25, 1.0]


def test_classifier_equals_a_direct_solution(spark):
    """Scaling, ridge and calibration against numpy over all labelled rows at once."""
    sf = "/root/testdata/sf0.01"
    texts, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = classifier.fit_documents(texts, labels)
    y_of = {r.doc_id: float(r.quality) for r in labels.collect() if r.quality is not None}
    folds = {k: zlib.crc32(str(k).encode()) % 4 for k in y_of}
    stats = {r.doc_id: classifier.statistics(r.text) for r in texts.collect() if r.doc_id in y_of}
    fits, tunes = ([k for k in stats if folds[k] in chosen] for chosen in ((0, 1), (3,)))
    x, y = np.array([stats[k] for k in fits]), np.array([y_of[k] for k in fits])
    np.testing.assert_allclose(model.mean, x.mean(axis=0), rtol=1e-9, atol=1e-12)
    spread = x.std(axis=0)
    np.testing.assert_allclose(model.scale, np.where(spread > 1e-9, spread, 1.0), rtol=1e-6)
    z = model.features(x)
    penalties = np.full(z.shape[1], max(classifier.PENALTY * len(x), 1e-6))
    penalties[0] = 0.0
    want = np.linalg.solve(z.T @ z + np.diag(penalties), z.T @ y)
    np.testing.assert_allclose(model.raw(x), np.clip(z @ want, -1, 2), atol=1e-6)
    bins = np.rint(model.raw(np.array([stats[k] for k in tunes])) / classifier.BIN)
    hits = np.array([y_of[k] for k in tunes])
    values, at = np.unique(bins, return_inverse=True)
    n, h = np.bincount(at), np.bincount(at, hits)
    # isotonic regression by its definition: the largest of the smallest means of runs around each value
    mean = lambda i, j: h[i : j + 1].sum() / n[i : j + 1].sum()
    best = np.array([max(min(mean(i, j) for j in range(k, len(n))) for i in range(k + 1)) for k in range(len(n))])
    pooled = np.unique(best)
    np.testing.assert_allclose(model.values, pooled, atol=1e-9)
    centres = [(values[best == v] * n[best == v]).sum() / n[best == v].sum() * classifier.BIN for v in pooled]
    np.testing.assert_allclose(model.knots, centres, atol=1e-9)
