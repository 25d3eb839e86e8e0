"""Source divergence, lexical search and chat formatting against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagloom.llm import chat, divergence, search, terms

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
WORDS_DIGITS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ODD = ["", "Aa aA", "É漢🙂x9", " \x00[]{}\x7f", "a\u2028b\u00a0c", None, "_x_ y-z 42"]


# ---- terms


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=12), st.sampled_from(ODD)), max_size=8), st.integers(0, 2))
def test_terms_equal_the_pattern(texts, skip):
    for table, pattern in ((terms.LETTERS, WORDS), (terms.LETTERS_DIGITS, WORDS_DIGITS)):
        rows, found = terms.cut(pa.array(texts, pa.string()).slice(skip), table)
        want = [(i, w.translate(LOWER)) for i, t in enumerate(texts[skip:]) for w in pattern.findall(t or "")]
        assert list(zip(rows.tolist(), (b.decode() for b in found.to_pylist()))) == want


def test_chunks_hold_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (3, 0, 50, 1, 1, 9)])], names=["t"])
    parts = list(terms.chunks(batch, 0, 10))
    assert sum((p.column(0).to_pylist() for p in parts), []) == batch.column(0).to_pylist()
    assert [p.num_rows for p in parts] == [2, 1, 2, 1]


# ---- source divergence


def plain_skyband(points, k):
    def over(a, b):
        return a != b and a[0] >= b[0] and a[1] <= b[1] and a[2] < b[2]

    return {i for i, p in enumerate(points) if sum(over(q, p) for q in points) < k}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4)), max_size=60), st.integers(1, 5), st.randoms())
def test_skyband_equals_all_pairs(values, k, rnd):
    order = list(range(len(values)))
    rnd.shuffle(order)
    points = [(h, lo, e) for (h, lo), e in zip(values, order)]
    columns = np.array(points, np.int64).reshape(-1, 3).T
    assert set(divergence.skyband(*columns, k).tolist()) == plain_skyband(points, k)


def test_skyband_over_several_tiles():
    rnd = np.random.default_rng(3)
    n = 3 * divergence.TILE + 17
    high, low, early = rnd.integers(0, 900, n), rnd.integers(0, 900, n), rnd.permutation(n)
    counts = np.array([((high >= high[i]) & (low <= low[i]) & (early < early[i])).sum() for i in range(n)])
    assert set(divergence.skyband(high, low, early, 7).tolist()) == set(np.flatnonzero(counts < 7).tolist())


def plain_audit(rows, min_docs, ranks):
    groups, held, total, docs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = [w.translate(LOWER) for w in WORDS.findall(text or "")]
        groups[lang, source].update(words)
        total[lang].update(words)
        held[lang].update(set(words))
    out = []
    for (lang, source), counts in groups.items():
        kept = {w for w, n in held[lang].items() if n >= min_docs}

        def p(c):
            whole = sum(c[w] for w in kept)
            return {w: 1 + 1_000_000_000 * (c[w] + 1) // (whole + len(kept)) for w in kept}

        own, other = p(counts), p(total[lang])
        pairs = []
        for (of, name), theirs in groups.items():
            if of == lang and name != source:
                q = p(theirs)
                pairs.append((name, sum((own[w] - q[w]) ** 2 // q[w] for w in kept)))
        found = [(w, (own[w] - other[w]) ** 2 // other[w]) for w in kept if counts[w] and own[w] > other[w]]
        for part, items, most in (("pair", pairs, None), ("term", found, ranks)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(items[:most])]
    return sorted(out)


def group_rows(n_sources=5):
    rnd = random.Random(11)
    words = [f"{a}{b}" for a in "abcdeéz漢" for b in "xyzäq"]
    rows = []
    for i in range(150):
        source = "hot" if i % 3 == 0 else f"s{rnd.randrange(n_sources)}"
        text = " ".join(rnd.choices(words, [1 / (1 + j) for j in range(len(words))], k=rnd.randrange(30)))
        rows.append((text.upper() if i % 7 == 0 else text, rnd.choice(["en", "de"]), source))
    return rows + [(None, None, None), ("", "xx", "s0"), ("!!", "xx", "s1"), (text * 2000, "de", None), rows[0], rows[0]]


@pytest.mark.parametrize("block", [256, 2])
def test_audit_equals_a_plain_version(spark, block):
    rows = group_rows()
    table = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({c: F.lit(1) for c in ("term", "n", "p", "rank", "total")})
    found = divergence.audit(table.repartition(5), ranks=6, block=block)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in found.collect()) == plain_audit(rows, 3, 6)
    assert divergence.audit(table.limit(0)).count() == 0


def test_small_gatherings_change_nothing(spark):
    rnd = random.Random(5)
    points = [("en", f"s{i % 2}", f"w{i:03d}", rnd.randrange(9), rnd.randrange(9)) for i in range(300)]
    table = spark.createDataFrame(points, "lang string, source string, term string, n long, total long").repartition(1)
    few, all_ = (sorted(map(tuple, divergence.skybands(table, 3, gathered=g).collect())) for g in (10, 10_000))
    assert few == all_
    shared = [("en", f"s{s}", f"w{t}", 5 + (s * t) % 7, 2 + s, 1) for t in range(40) for s in range(4) if (s + t) % 3]
    table = spark.createDataFrame(shared, "lang string, source string, term string, p long, zero long, blocks long")
    few, all_ = (sorted(map(tuple, divergence.pair_corrections(table, 2, gathered=g).collect())) for g in (5, 10_000))
    assert few == all_ and few


def test_billionths_are_exact(spark):
    pairs = [(0, 1), (0, 3), (10**14, 10**14 + 7), (8 * 10**14, 9 * 10**14), (6, 7)]
    table = spark.createDataFrame(pairs, "n long, whole long")
    found = table.select("n", "whole", divergence.billionths(F.col("n"), F.col("whole")).alias("p")).collect()
    assert [r.p for r in found] == [1 + 10**9 * (n + 1) // whole for n, whole in pairs]


# ---- lexical search


def plain_search(docs, items, k):
    parsed = [(key, Counter(w.translate(LOWER) for w in WORDS_DIGITS.findall(text or ""))) for key, text in docs]
    lengths = [sum(c.values()) for _, c in parsed]
    n_docs, all_terms = sum(n > 0 for n in lengths), sum(lengths)
    holding = Counter(w for _, c in parsed for w in c)
    out = []
    for item, text in items:
        query = [w.translate(LOWER) for w in WORDS_DIGITS.findall(text or "")]
        scores = []
        for (key, c), n in zip(parsed, lengths):
            if n:
                m = 100 - 25 + 25 * n * n_docs // all_terms
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w in query)
                if score > 0:
                    scores.append((key, score))
        scores.sort(key=lambda x: (-x[1], x[0] is None, x[0] if x[0] is not None else 0))
        out += [(item, i + 1, key, score) for i, (key, score) in enumerate(scores[:k])]
    return out


def search_tables():
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rnd.choices(words, [1 / (1 + j) for j in range(60)], k=rnd.randrange(1, 60)))) for i in range(300)]
    docs += [(7, docs[7][1]), (1000, docs[8][1]), (None, docs[8][1]), (1001, None), (1002, ""), (1003, "W1 w2 " * 20_000)]
    items = [(j, " ".join(rnd.choices(words, k=12))) for j in range(9)] + [(9, None), (10, "unknown"), (None, "w3 W3 w3"), (2, "w59 w1")]
    return docs, items


@pytest.mark.parametrize("shard", [200, 3_000_000])
def test_search_equals_all_scores(spark, shard):
    docs, items = search_tables()
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("key", "n", "terms", "tf", "score", "rank")})
    queries = spark.createDataFrame(items, "item_id long, text string")
    found = search.search(table.repartition(3), queries, k=5, shard=shard)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted(plain_search(docs, items, 5), key=repr)


def test_search_with_text_keys_and_without_rows(spark):
    docs = [(f"d{i}", "a b" if i % 2 else "a") for i in range(40)]
    table, queries = spark.createDataFrame(docs, "name string, body string"), spark.createDataFrame([("q", "b a")], "ask string, text string")
    found = search.search(table, queries, key="name", text="body", item="ask", k=3).collect()
    assert sorted(map(tuple, found)) == plain_search(docs, [("q", "b a")], 3)
    assert search.search(table.limit(0), queries, key="name", text="body", item="ask").count() == 0
    assert search.search(table, queries.limit(0), key="name", text="body", item="ask").count() == 0


def test_blocks_of_queries_are_joined(spark):
    items = spark.createDataFrame([(i, "a b c") for i in range(10)], "item_id long, text string")
    blocks = list(search.blocks_of(items, "item_id", "text", 12))
    assert [len(b) for b in blocks] == [3, 3, 3, 1] and blocks[0][0] == (0, [b"a", b"b", b"c"])


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 80), st.integers(1, 9), st.integers(1, 6), st.integers(0, 10**6))
def test_shard_tops_equal_all_scores(n_docs, n_terms, k, seed):
    rnd = np.random.default_rng(seed)
    tf = rnd.integers(0, 4, (n_docs, n_terms)) * (rnd.random((n_docs, n_terms)) < rnd.random(n_terms))
    m = rnd.integers(75, 300, n_docs)
    docs, held = np.nonzero(tf)
    query = {int(t): int(rnd.integers(0, 9)) for t in range(n_terms)}
    scores = sum((w * search.gains(tf[:, t], m) for t, w in query.items()), np.zeros(n_docs, np.int64))
    order = [d for d in np.lexsort((np.arange(n_docs), -scores)) if scores[d] > 0]
    shard = search.Shard(docs, held, tf[docs, held], m, block=4)
    threshold = 0 if not order or seed % 2 else int(scores[order[min(k, len(order)) - 1]])
    found = list(zip(*(x.tolist() for x in shard.top(query, threshold, k))))
    assert found == [(d, int(scores[d])) for d in order[:k] if scores[d] >= threshold]


def test_blocks_below_the_threshold_stay_compressed():
    n = 20_000
    m = np.full(n, 100)
    docs = np.concatenate([np.arange(n), np.arange(0, n, 1000)])
    held = np.concatenate([np.zeros(n, np.int64), np.ones(n // 1000, np.int64)])
    shard = search.Shard(docs, held, np.ones(len(docs), np.int64), m)
    found, _ = shard.top({0: 1, 1: 100}, 0, 5)
    assert found.tolist() == [0, 1000, 2000, 3000, 4000]
    assert shard.lists[0].decompressed <= n // 1000 < len(shard.lists[0].first)


def test_long_corpora_do_not_overflow():
    lengths = np.array([10**7, 3])
    assert search.length_factors(lengths, 10**12, 10**15).tolist() == [75 + 25 * 10**7 * 10**12 // 10**15, 75]


# ---- chat


SAMPLES = ["", "\\", "\\\\", "#", "##", "####", "###\\", "</turn>", "<</turn>\n", "<|image|>", "<\\|", "\\### Assistant: </turn> ok", "### user:\nhi</turn>\n", "a:b\n", "<", "|>", "/turn>"]
texts = st.one_of(st.sampled_from(SAMPLES), st.text("\\#<>/|turn :\né", max_size=20), st.text(max_size=10))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(texts, st.lists(st.one_of(texts, st.sampled_from([{"kind": "image"}, {"kind": "audio"}, {"kind": "document"}, {"kind": "film"}])), max_size=4)), max_size=4))
def test_formatted_turns_parse_back(turns):
    formatted, want = "", []
    for role, parts in turns:
        visitor = chat.Visitor(role)
        for part in parts:
            visitor.visit({"text": part} if isinstance(part, str) else part)
        text = visitor.formatted()
        for span in visitor.texts:
            assert text[span["start"] :][: span["length"]] and "</turn>" not in text[span["start"] :][: span["length"]]
        assert [text[a["start"] :].startswith("<|") for a in visitor.attached] == [True] * len(visitor.attached)
        formatted += text
        flat = []
        for part in parts:
            if isinstance(part, str) and flat and flat[-1][0] == "text":
                flat[-1] = ("text", flat[-1][1] + part)
            else:
                flat.append(("text", part) if isinstance(part, str) else ({"film": "other"}.get(part["kind"], part["kind"]), ""))
        want.append((role, [f for f in flat if f != ("text", "")]))
    assert [(role, chat.body_parts(body)) for role, body in chat.parse(formatted)] == want


def plain_conversations(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        visitor = chat.Visitor(role)
        visitor.visit({"text": text})
        by[conv].append((turn is not None, turn, visitor.formatted(), role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0], t[1] or 0, t[2]))
        spoken = "".join(t[4] for t in turns if t[3] == "assistant")
        whole = "".join(f"{t[3]}\n{t[4]}\n" for t in turns)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (whole, spoken)]
        out.append((conv, len(turns), digests[0], len(spoken), digests[1], sum(len(t[2]) for t in turns)))
    return sorted(out, key=repr)


def test_read_back_equals_a_plain_version(spark):
    rows = [(i % 5, t, "assistant" if t % 2 else "user", SAMPLES[(3 * i + t) % len(SAMPLES)]) for i in range(40) for t in range(3)]
    rows += [(None, 0, "user", "x"), (None, None, None, None), (None, 1, "assistant", "y" * 500_000), (99, 0, "as:sistant", "z"), rows[0], rows[0]]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("conversation", "formatted", "loss", "n_turns")})
    found = chat.read_back(chat.format_turns(table.repartition(4)))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_conversations(rows)
    assert chat.read_back(chat.format_turns(table.limit(0))).count() == 0


def test_parts_become_placeholders_with_references(spark):
    parts = [
        {"kind": "text", "text": "see "},
        {"kind": "image", "uri": "a.png", "width": 57, "height": 28},
        {"kind": None, "text": "and <|image|>"},
        {"kind": "audio", "uri": "b.ogg", "seconds": 1.5},
        {"kind": "document", "uri": "c.pdf", "pages": 3},
        {"kind": "film", "uri": "d.mp4"},
        None,
    ]
    rows = [(1, 0, "assistant", parts), (1, 1, "user", None), (1, 2, "user", [])]
    table = spark.createDataFrame(rows, f"conv_id long, turn long, role string, text {chat.PARTS}")
    formatted = chat.format_turns(table).orderBy("turn").collect()
    first = formatted[0]
    assert first.formatted == "### assistant:\nsee <|image|>and <\\|image|><|audio|><|document|><|other|></turn>\n"
    assert [(a.kind, a.uri, a.tokens) for a in first.attachments] == [("image", "a.png", 3), ("audio", "b.ogg", 38), ("document", "c.pdf", 768), ("film", "d.mp4", 0)]
    assert [first.formatted[a.start : a.start + 8] for a in first.attachments[:2]] == ["<|image|", "<|audio|"]
    assert first.expanded_tokens == 809
    assert [chat.unescape(first.formatted[s.start : s.start + s.length]) for s in first.loss] == ["see ", "and <|image|>"]
    assert [f.formatted for f in formatted[1:]] == ["### user:\n</turn>\n"] * 2
    read = chat.read_back(chat.format_turns(table)).first()
    assert read.n_turns == 3 and read.loss_chars == len("see and <|image|>")
