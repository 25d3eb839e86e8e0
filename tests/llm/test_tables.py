"""Operators that compare rows with each other, against plain versions."""

from __future__ import annotations

import base64
import hashlib
import random
import textwrap

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagloom.llm import fingerprints, jaccard_join, licenses, line_dedup, queries, url_filter, warc
from tagloom.llm.components import components
from tagloom.session import stage_path


def near_copies() -> list[tuple[int, str]]:
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    rows, at = [], 0
    for group in range(6):
        base = rnd.choices(words, k=120)
        for _ in range(rnd.randint(1, 9) if group else 300):  # the first group is larger than a block
            copy = list(base)
            for _ in range(rnd.randint(0, 4)):
                copy[rnd.randrange(120)] = rnd.choice(words)
            rows.append((at, " ".join(copy)))
            at += 1
    return rows


def plain_join(rows, words=5, threshold=0.8):
    sets, blank = [], []
    for _, text in rows:
        w = (text or "").encode().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
        blank.append((text or "") if not w else None)
    n = len(rows)
    root, links = list(range(n)), [0] * n

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            alike = blank[i] == blank[j] if not sets[i] or not sets[j] else len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])
            if alike and bool(sets[i]) == bool(sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (key, _) in enumerate(rows):
        t = top(i)
        least[t] = min(least.get(t, (True, 0)), (key is None, key if key is not None else 0))
    return sorted((key is None, key, None if least[top(i)][0] else least[top(i)][1], links[i]) for i, (key, _) in enumerate(rows))


def test_jaccard_join(spark, odd, none):
    for rows in (near_copies(), [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]):
        table = spark.createDataFrame(rows, "doc_id long, text string")
        for block in (64, jaccard_join.BLOCK):
            found = jaccard_join.Join(table, block=block).documents().collect()
            assert sorted((r.id is None, r.id, r.class_id, r.n_links) for r in found) == plain_join(rows)
    odd = odd.withColumns({n: F.lit("kept") for n in ("_id", "_at", "_place", "rep", "label", "values")})
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "5", "6", "7", "8", "None"]
    assert jaccard_join.Join(none).documents().count() == 0


def test_texts_without_a_common_shingle_meet_in_no_bucket(spark):
    rnd = random.Random(11)
    rows = [(i, " ".join(f"w{rnd.getrandbits(40)}" for _ in range(12))) for i in range(3_000)]
    rows.append((3_000, rows[0][1] + " end"))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = jaccard_join.sketches(table, key="doc_id", text="text", runs=10).select("node", "tokens", "starts")
    met = jaccard_join.buckets(nodes).groupBy("path").agg(F.collect_set("node").alias("nodes"), F.max("large").alias("large")).collect()
    assert len({n for r in met for n in r.nodes}) == 2 and 0 < len(met) <= 10 and not any(r.large for r in met)


def test_only_texts_of_shared_classes_move(spark):
    rnd = random.Random(12)
    rows = near_copies() + [(1_000 + i, " ".join(f"w{rnd.getrandbits(40)}" for _ in range(30))) for i in range(200)]
    rows += rows[-3:] + [(None, rows[-1][1])]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    join = jaccard_join.Join(table)
    classes = plain_join(rows)
    assert join.shared_places().count() == sum(links > 0 for *_, links in classes)
    kept = jaccard_join.keep_one(table)
    plan = kept._jdf.queryExecution().executedPlan().toString().splitlines()
    alone = [line for line in plan[plan.index("+- Union") + 1 :] if line.startswith("   :")]
    assert any("Scan" in line for line in alone) and not any("Exchange" in line for line in alone)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({x[2] for x in classes})


def test_components_of_a_long_chain(spark):
    edges = spark.range(60).select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    assert {r.label for r in components(edges).collect()} == {0}


def test_line_dedup(odd, none):
    rows = line_dedup.dedup(odd, into="found").collect()
    assert len(rows) == odd.count() and rows[0].lines == "kept"
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, []).append((r.found.n_lines, r.found.n_dropped, r.found.text))
    assert found[1] == [(2, 0, odd.first().text)]
    assert found[2] == [(2, 2, "")] * 2  # repeated rows are treated alike
    assert found[3] == [(0, 0, None)] and found[5] == [(0, 0, " \n\t\n")]
    assert found[8][0][:2] == (2, 1)  # one word away from an earlier line
    kept = line_dedup.keep_lines(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "5", "6", "7", "8", "None"]
    assert line_dedup.dedup(none).count() == 0


def test_texts_are_cut_once(odd):
    plan = line_dedup.keep_lines(odd)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rebuilt(") == 1


def test_a_full_filter_changes_nothing(docs):
    def counts(bits):
        return sorted((r.doc_id, r.lines.n_dropped) for r in line_dedup.dedup(docs, bits=bits).collect())

    assert counts(64) == counts(line_dedup.FILTER_BITS)


def test_halves_of_lines_within_one_edit():
    rnd = random.Random(2)
    for _ in range(5000):
        words = [rnd.choice([b"a", b"bb", b"c"]) for _ in range(rnd.randint(1, 12))]
        other, at = list(words), rnd.randrange(len(words))
        kind = rnd.randrange(3)
        if kind == 0:
            other[at] = b"z"
        elif kind == 1:
            other.insert(at, b"z")
        elif len(other) > 1:
            del other[at]
        assert line_dedup.within_one(words, other)
        assert set(line_dedup.halves(words, b" ".join(words))) & set(line_dedup.halves(other, b" ".join(other)))


def test_texts_are_cut_into_lines_twice(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    texts = F.concat(F.lit("the same line of more than eight words in all texts but for "), F.col("id").cast("string"))
    found = line_dedup.repeated_lines(spark.range(50).select(F.col("id").alias("doc_id"), counted(texts).alias("text"))).collect()
    assert len(found) == 49 and seen.value == 2 * 50


@pytest.mark.parametrize("size", [1, 20, 1 << 20])
def test_lines_and_hashes_do_not_depend_on_their_chunk(monkeypatch, size):
    monkeypatch.setattr(line_dedup, "CHUNK_BYTES", size)
    monkeypatch.setattr(line_dedup, "HASH_BYTES", max(size, line_dedup.SHORT_WORD))
    texts = [None, "", " \n\t\n", "\n a  b\r\n\x0bc\x1cd\x85 e f \n\n é 漢字 🙂", f"{'x' * 3000} y a\n{'a b ' * 500}", f"y {'x' * 2999}\na b", "b a"] * 90
    want = [(i, n, b" ".join(x.split()).decode()) for i, t in enumerate(texts) for n, x in enumerate((t or "").encode().split(b"\n")) if x.split()]
    got, hashes, cut = [], {}, {}
    for lines in line_dedup.lines_of(pa.array(texts)):
        joined = lines.joined().to_pylist()
        got += zip(lines.row.tolist(), lines.number.tolist(), joined)
        for word, x in zip(lines.words.flatten().to_pylist(), line_dedup.word_hashes(lines.words.flatten()).tolist()):
            assert hashes.setdefault(word, x) == x
        keys, at, gap = lines.variants()
        assert keys[gap < 0].tolist() == lines.codes().tolist()
        for key, a, g in zip(keys.tolist(), at.tolist(), gap.tolist()):
            words = joined[a].split(" ")
            if len(words) < 20:
                rest = " ".join(words if g < 0 else words[:g] + words[g + 1 :])
                assert cut.setdefault(rest, key) == key
    assert got == want and len(set(hashes.values())) == len(hashes) and len(set(cut.values())) == len(cut)
    assert sum(len(x.n) for x in line_dedup.lines_of(pa.array(texts), 3)) == sum(len(w.split(" ")) >= 3 for _, _, w in want)


def plain_edits(rows):
    rows = sorted(((k is None, -(k or 0), t or "") for k, t in rows))
    out = []
    for i, (_, _, text) in enumerate(rows):
        other = rows[(i + 1) % len(rows)][2]
        half = len(text) // 2
        out.append((rows[i][:2], text, text[: len(text) - half] + other[:half], other))
    return out


def share(a, b):
    a, b = ({p for p in t.split("\n") if p} for t in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark, docs, none):
    rows = [(r.doc_id, r.text) for r in docs.limit(150).collect()] + [(900_001, None), (900_002, ""), (None, "last"), (900_003, "\n".join(map(str, range(900))))]
    found = fingerprints.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {(r.doc_id is None, -(r.doc_id or 0)): r for r in found}
    assert len(by) == len(rows)
    for place, text, edited, other in plain_edits(rows):
        r = by[place]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(share(text, edited)) and r.near_next == pytest.approx(share(text, other))
        assert (r.fingerprint == r.edited_fingerprint) == (share(text, edited) == 1.0)
    assert fingerprints.fingerprint_edits(none).count() == 0


def test_licences(spark, odd, none):
    notice = "This work is licensed under the GNU General Public License, version 3."
    rows = [
        ("a/b/LICENSE", notice), ("a/b/c/x", "plain words"), ("a/b/y", "some code\nReleased under the MIT License.\n" + "more words here " * 20),
        ("a/z", "plain"), (None, None), ("a/b/c/x", "plain words"), ("a/b/d/e", ""),
    ]
    table = spark.createDataFrame(rows, "path string, text string").withColumn("license_from", F.lit(1)).drop("license_from")
    found = [(r.path, r.license, r.license_by, r.license_from) for r in licenses.scan(table, path=F.col("path")).collect()]
    inherited = ("GPL-3.0", "directory", "a/b/LICENSE")
    expected = [("a/b/LICENSE", "GPL-3.0", "file", "a/b/LICENSE"), ("a/b/y", "MIT", "header", "a/b/y"), ("a/z", None, None, None), (None,) * 4]
    assert sorted(found, key=str) == sorted([*expected, *[("a/b/c/x", *inherited)] * 2, ("a/b/d/e", *inherited)], key=str)
    assert licenses.scan(odd, path=F.col("doc_id").cast("string")).count() == odd.count()
    assert licenses.scan(none, path=F.lit("x")).count() == 0


def test_wrapped_headers_and_whole_licence_texts(spark):
    headers = dict(licenses.HEADERS)  # the last and longest of each licence
    rows, expected = [], {}
    for name in ("GPL-3.0", "GPL-2.0", "LGPL-3.0", "AGPL-3.0", "Apache-2.0", "MIT", "BSD-3-Clause", "BSD-2-Clause", "ISC", "MPL-2.0"):
        for width in (48, 72, 80):
            wrapped = textwrap.wrap(headers[name], width)
            path = f"{name}/{width}.c"
            rows.append((path, "\n".join(["int x;", *[f" * {line}" for line in wrapped], *["code of its own " + "abcdefgh"[i % 8] * 40 for i in range(90)]])))
            expected[path] = (name, "header")
        rows.append((f"{name}-short/LICENSE", "Copyright (c) 2024 Some One\n\n" + "\n".join(textwrap.wrap(headers[name], 76))))
        expected[f"{name}-short/LICENSE"] = (name, "file")
    for name, text in licenses.license_texts():
        rows.append((f"{name}-text/LICENSE", "\n".join(textwrap.wrap(text, 76))))
        expected[f"{name}-text/LICENSE"] = (name, "file")
    rows += [("t/a.c", "// SPDX-License-Identifier: MIT\n" + "code\n" * 30), ("u/a.c", "MIT License\n" + "code\n" * 30), ("v/a.c", "a plain text about permission, software and the free use of a license\n" * 9)]
    expected |= {"t/a.c": ("MIT", "header"), "u/a.c": ("MIT", "header"), "v/a.c": (None, None)}
    table = spark.createDataFrame(rows + rows[:3], "path string, text string")
    found = licenses.scan(table, path=F.col("path")).collect()
    assert len(found) == len(rows) + 3
    assert {r.path: (r.license, r.license_by) for r in found} == expected


def test_url_filter(spark):
    rows = [(i, f"http://Site.net/{'spam' if i % 2 else 'news'}/{i}") for i in range(80)]
    rows += [(1000, None), (1001, "no scheme"), (1002, "https://A.B.org/x?y"), (1003, "x://org"), (1004, "x://org/" + "deep/" * 5000), (1004, "x://org/" + "deep/" * 5000)]
    table = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("kept")).withColumn("bad", F.when(F.col("page_id") < 60, F.col("page_id") % 2))
    found = {r.page_id: r for r in url_filter.judge(table, {"org/": "allow"}, label=F.col("bad")).collect()}
    assert len(found) == len(rows) - 1
    assert all(found[i].verdict == ("block" if i % 2 else "allow") for i in range(80))
    assert (found[1000].host, found[1000].path, found[1001].host) == ("", "", "")
    assert (found[1002].host, found[1002].path, found[1002].rule) == ("a.b.org", "/x", "org/")
    assert found[1003].rule is None and found[1004].verdict == "allow"
    assert url_filter.judge(table.limit(0), {"org/": "allow"}).count() == 0


def test_warc(spark):
    long = "x" * 70_000 + "\nWARC/1.0\r\nWARC-Type: response\r\n\r\n\nWARC/1.0"
    pages = [(1, "u", long), (2, None, long), (3, "a b\r\n", None), (None, "x", ""), (4, "x", "WARC/1.0\r\nWARC-Type: y\r\n"), (5, "x", "\r\n")]
    pages += [(6, "x", "é" * 66_000 + "\r\n\r\n\r"), (6, "x", "é" * 66_000 + "\r\n\r\n\r"), (7, "q", "\nWAR"), (8, "q", "a\nWARC/1.0\r\nWARC/1.0\r\nWARC-Type: ")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    first = {}
    for key, _, html in sorted(pages, key=lambda p: (p[0] is None, p[0] or 0)):
        first.setdefault(html or "", key)
    expected = []
    for key, _, html in pages:
        raw = (html or "").encode()
        refers = None if first[html or ""] == key else first[html or ""]
        expected.append((str(key), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if refers else "response", refers and str(refers)))
    for packed in ("none", "gzip"):
        path = stage_path(spark, "warc")
        warc.write_archives(warc.record_blocks(table), path, packed)
        found = [(str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(spark, path).collect()]
        assert sorted(found, key=str) == sorted(expected, key=str)
    path = stage_path(spark, "warc")
    warc.write_archives(warc.record_blocks(table.limit(0)), path)
    assert warc.read_archives(spark, path).count() == 0


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n in queries.ORACLE])
def test_queries_match_sql(name, spark, sf):
    import duckdb

    from checks.compare import TABLES, check

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    state, detail = check(name, queries.QUERIES[name](spark, sf), con, queries.ORACLE)
    assert state == "ok", detail


NATIVE = ("op1_url_template_tree", "op6_document_fingerprints", "op10_license_scan")


@pytest.mark.parametrize("name", NATIVE)
def test_native_queries_plan_no_python(name, spark, sf):
    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not [p for p in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop") if p in plan]


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, spark.createDataFrame(stage(spark, kept, sf).collect(), docs.schema)
        assert kept.columns == docs.columns and 0 < kept.count() <= before.count(), name
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert len({x[2] for x in plain_join(rows)}) == len(rows)
    pieces = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {k for k, _ in rows}


def test_a_long_source_file_with_a_header(spark):
    header = "\n".join(textwrap.wrap(dict(licenses.HEADERS)["GPL-3.0"], 76))
    code = "\n".join(f"value_{i} = free(software, {i}) or the_{i % 50}" if i % 3 else f"for item in range({i}): total += {i}" for i in range(6_000))
    rows = [("a/long.py", f"{header}\n{code}"), ("a/end.py", f"{code}\n{header}"), ("a/none.py", code)]
    table = spark.createDataFrame(rows, "path string, text string")
    names = ("_own", "_path", "_place", "_row", "_file", "_directory", "_chars", "at", "start", "lines", "license", "license_by")
    table = table.withColumns({n: F.lit("kept") for n in names})
    found = licenses.scan(table, path=F.col("path"))
    assert sorted((r.path, r.license, r.license_by) for r in found.collect()) == [("a/end.py", "GPL-3.0", "header"), ("a/long.py", "GPL-3.0", "header"), ("a/none.py", None, None)]
    assert len(set(found.columns)) == len(found.columns) and all(r[n] == "kept" for r in found.collect() for n in names[:-2])


@pytest.mark.parametrize("kind", ["string", "double", "timestamp", "boolean", "binary", "date", "decimal(20,3)", "long"])
def test_line_dedup_takes_keys_of_any_type(spark, kind):
    made = {
        "string": "concat('k', id)", "double": "id * 1e20", "timestamp": "timestamp_seconds(id)", "boolean": "id > 0", "binary": "concat(unhex('ff'), cast(cast(id AS string) AS binary))",
        "date": "date_from_unix_date(cast(id AS int))", "decimal(20,3)": "cast(id AS decimal(20,3))", "long": "id",
    }[kind]
    table = spark.range(3).selectExpr(f"{made} AS doc_id", "concat('a line that all have\\nown line of ', id) AS text", "'kept' AS _id", "'kept' AS _place", "'kept' AS _drops", "'kept' AS lines")
    found = line_dedup.dedup(table, into="found").collect()
    assert sorted(r.found.n_dropped for r in found) == [0, 1, 1] and all(r._id == r._place == r._drops == r.lines == "kept" for r in found)
    kept = line_dedup.keep_lines(table)
    assert kept.columns == table.columns and sorted(r.text.count("\n") for r in kept.collect()) == [0, 0, 1]


def test_texts_without_an_id_are_gathered_one_by_one(spark):
    table = spark.createDataFrame([(None, f"a line that all have\nown line of {i}") for i in range(20)], "doc_id long, text string")
    found = line_dedup.dedup(table).collect()
    assert sorted(r.lines.n_dropped for r in found) == [0] + [1] * 19
    assert max(len(r.drops) for r in line_dedup.repeated_lines(table).collect()) == 1
