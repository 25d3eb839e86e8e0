"""Check SQL of the queries, for DuckDB."""

from __future__ import annotations

from tagloom.llm import chat, divergence, licenses, line_dedup, quality_rules, search, url_filter

# Url rules and their verdicts.
URL_RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
# Fixed value: what both turns of the added conversation say.
CHAT_SAMPLE = r"\### Assistant: </turn> ok"


def quality_rules_sql(
    min_repeat: int = quality_rules.MIN_REPEAT, max_covered: float = quality_rules.MAX_COVERED, max_longest: int = quality_rules.MAX_LONGEST
) -> str:
    """Repeats of at least k units cover what the k-unit windows found twice cover; one is longer than m if a window of m + 1 is found twice."""
    word = r"[^\x20\x09-\x0D]+"
    return rf"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
units AS (
  SELECT r, 'w' AS kind, w AS u FROM base
  UNION ALL
  SELECT r, 'u', flatten(list_transform(w, lambda x: CASE WHEN length(x) > {quality_rules.LONG_WORD} THEN string_split(x, '') ELSE [x] END)) FROM base),
sizes AS (SELECT * FROM (VALUES ('w', {quality_rules.WINDOW}), ('u', {min_repeat}), ('u', {max_longest + 1})) v(kind, k)),
windows AS (
  SELECT r, kind, k, i, md5(array_to_string(u[i:i + k - 1], chr(9))) AS h
  FROM (SELECT r, kind, k, u, unnest(range(1, len(u) - k + 2)) AS i FROM units JOIN sizes USING (kind))),
twice AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY r, kind, k, h) AS n FROM windows) WHERE n > 1),
gaps AS (SELECT r, kind, k, least(k, lead(i) OVER (PARTITION BY r, kind, k ORDER BY i) - i) AS step FROM twice),
covered AS (SELECT r, kind, k, sum(coalesce(step, k))::BIGINT AS n FROM gaps GROUP BY ALL),
measured AS (
  SELECT doc_id, b.r, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(list_sum(list_transform(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')), lambda x: 1)), 0)::BIGINT
           - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}'))))::BIGINT AS n_dup_lines,
         coalesce(a.n, 0)::BIGINT AS n_repeat_words, coalesce(c.n, 0) / greatest(len(u.u), 1) AS covered, l.n IS NOT NULL AS too_long
  FROM base b JOIN units u ON u.r = b.r AND u.kind = 'u'
  LEFT JOIN covered a ON a.r = b.r AND a.kind = 'w'
  LEFT JOIN covered c ON c.r = b.r AND c.kind = 'u' AND c.k = {min_repeat}
  LEFT JOIN covered l ON l.r = b.r AND l.kind = 'u' AND l.k = {max_longest + 1})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed,
       NOT failed AND covered <= {max_covered} AND NOT too_long AS kept
FROM (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS failed FROM measured)"""


QUALITY_RULES = quality_rules_sql()

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
f AS (SELECT s, min(page_id) AS first FROM p GROUP BY s)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(s, (1 + 5 * (i // 4))::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p JOIN f USING (s)"""


def line_dedup_sql(near_words: int = line_dedup.NEAR_WORDS) -> str:
    """The same lines from variants written out as text."""
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
lines AS (
  SELECT r, doc_id, line, regexp_extract_all(value, '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT r, doc_id, unnest(ls) AS value, unnest(range(0, len(ls))) AS line FROM docs) WHERE regexp_matches(value, '[^\x20\x09-\x0D]')),
keyed AS (SELECT *, array_to_string(w, ' ') AS h, row_number() OVER (ORDER BY doc_id NULLS FIRST, r, line) AS place FROM lines),
firsts AS (SELECT h, min(place) AS place, any_value(w) AS w FROM keyed GROUP BY h),
long AS (SELECT place, h, w FROM firsts WHERE len(w) >= {near_words}),
cut AS (
  SELECT place, i, array_to_string(w[1:i] || w[i + 2:], ' ') AS v
  FROM (SELECT place, w, unnest(range(0, len(w))) AS i FROM long)),
same AS (SELECT place FROM (SELECT place, min(place) OVER (PARTITION BY v, i) AS first FROM cut) WHERE first < place),
more AS (SELECT c.place FROM cut c JOIN long l ON l.h = c.v WHERE l.place < c.place),
less AS (SELECT l.place FROM long l JOIN cut c ON l.h = c.v WHERE c.place < l.place),
near AS (SELECT place FROM same UNION SELECT place FROM more UNION SELECT place FROM less),
gone AS (
  SELECT k.r, k.line FROM keyed k JOIN firsts f USING (h)
  WHERE k.place <> f.place OR f.place IN (SELECT place FROM near)),
drops AS (SELECT r, list(line) AS d, count(*) AS n FROM gone GROUP BY r),
counts AS (SELECT r, count(*) AS n FROM lines GROUP BY r)
SELECT doc_id, coalesce(c.n, 0)::BIGINT AS n_lines, coalesce(x.n, 0)::BIGINT AS n_dropped,
  sha256(CASE WHEN x.d IS NULL THEN text ELSE array_to_string(list_filter(ls, lambda v, i: NOT list_contains(x.d, i - 1)), chr(10)) END) AS text_sha256
FROM docs LEFT JOIN counts c USING (r) LEFT JOIN drops x USING (r)"""


LINE_DEDUP = line_dedup_sql()


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def url_filter_sql(rules: dict[str, str] = URL_RULES) -> str:
    """The tree's levels as one statement each."""
    u = url_filter
    whens = []
    for rule in sorted(rules, key=len, reverse=True):
        host, _, prefix = rule.partition("/")
        fit = f"(host = {_text(host)} OR ends_with(host, {_text('.' + host)})) AND starts_with(path, {_text('/' + prefix)})"
        whens.append(f"WHEN {fit} THEN {_text(rule)}")
    verdicts = " ".join(f"WHEN rule = {_text(r)} THEN {_text(v)}" for r, v in rules.items())
    merge = ""
    for level in range(u.DEPTH, 0, -1):
        before = "b0" if level == u.DEPTH else f"b{u.DEPTH - level}"
        after = f"b{u.DEPTH - level + 1}"
        merge += f"""
branches{level} AS (SELECT host, branch, sum(labels) AS n1, sum(bad) AS b1 FROM {before} GROUP BY ALL),
deep{level} AS (SELECT *, list_transform(branch, lambda s, i: CASE WHEN i = {level} THEN '*' ELSE s END) AS wide FROM branches{level} WHERE len(branch) >= {level}),
tested{level} AS (
  SELECT host, branch, wide, n1, b1, sum(n1) OVER f AS n, sum(b1) OVER f AS b FROM deep{level} WINDOW f AS (PARTITION BY host, wide)),
alike{level} AS (
  SELECT host, branch, wide FROM (SELECT *, n - n1 AS n2, b - b1 AS b2 FROM tested{level})
  WHERE n1 >= {u.MIN_LABELS} AND n2 >= {u.MIN_LABELS}
    AND pow(b1::DOUBLE / n1 - b2::DOUBLE / n2, 2) <= {u.Z_BOUND * u.Z_BOUND} * (b::DOUBLE / n * (1 - b::DOUBLE / n) * (1.0 / n1 + 1.0 / n2))),
{after} AS (SELECT x.host, x.template, x.labels, x.bad, coalesce(a.wide, x.branch) AS branch FROM {before} x LEFT JOIN alike{level} a USING (host, branch)),"""
    return rf"""
WITH parsed AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS (SELECT *, CASE {" ".join(whens)} END AS rule FROM parsed),
segments AS (
  SELECT *, CASE {verdicts} END AS decided,
    list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: regexp_replace(list_reduce(
      list_prepend('', list_transform(regexp_extract_all(s, '[0-9a-f]{{8,}}|[^0-9a-f]+|[0-9a-f]{{1,7}}'),
        lambda p: CASE WHEN regexp_matches(p, '^[0-9a-f]{{8,}}$') AND regexp_matches(p, '[0-9]') THEN '<h>' ELSE p END)), lambda a, b: a || b), '[0-9]+', '<n>', 'g')) AS formed
  FROM ruled),
rows_ AS (
  SELECT *, array_to_string(formed[1:{u.DEPTH}] || CASE WHEN len(formed) > {u.DEPTH} THEN ['**'] ELSE [] END, '/') AS form,
         CASE WHEN decided IS NULL THEN NULL WHEN decided = 'block' THEN 1 ELSE 0 END AS bad FROM segments),
forms AS (SELECT host, form, count(*) AS n, count(bad) AS labels, coalesce(sum(bad), 0) AS bad FROM rows_ GROUP BY ALL),
steps AS (
  SELECT host, form, n, i, array_to_string(s[1:i], '/') AS node, array_to_string(s[1:i - 1], '/') AS parent, s[i] AS segment
  FROM (SELECT *, string_split(form, '/') AS s, unnest(range(1, len(string_split(form, '/')) + 1)) AS i FROM forms)),
nodes AS (SELECT host, i, parent, node, sum(n) AS n FROM steps GROUP BY ALL),
kept AS (
  SELECT host, i, node FROM (SELECT *, sum(n) OVER (PARTITION BY host, i, parent) AS total FROM nodes)
  WHERE n >= {u.MIN_ROWS} AND n >= {u.MIN_SHARE} * total),
named AS (
  SELECT s.host, s.form, list(CASE WHEN k.node IS NULL THEN '*' ELSE s.segment END ORDER BY s.i) AS template
  FROM steps s LEFT JOIN kept k ON k.host = s.host AND k.i = s.i AND k.node = s.node GROUP BY ALL),
b0 AS (
  SELECT host, template, sum(labels) AS labels, sum(bad) AS bad, template AS branch
  FROM forms JOIN named USING (host, form) GROUP BY host, template),{merge}
final AS (SELECT host, branch, sum(labels) AS labels, sum(bad) AS bad FROM b{u.DEPTH} GROUP BY ALL),
base AS (SELECT coalesce(sum(bad)::DOUBLE / nullif(sum(labels), 0), 0) AS base FROM final),
everywhere AS (SELECT branch, (sum(bad) + {u.PRIOR} * any_value(base)) / (sum(labels) + {u.PRIOR}) AS prior FROM final, base GROUP BY branch),
shares AS (SELECT host, branch, (bad + {u.PRIOR} * prior) / (labels + {u.PRIOR}) AS share FROM final JOIN everywhere USING (branch)),
known AS (
  SELECT n.host, n.form, '/' || array_to_string(x.branch, '/') AS template, s.share
  FROM named n JOIN b{u.DEPTH} x ON x.host = n.host AND x.template = n.template JOIN shares s ON s.host = x.host AND s.branch = x.branch)
SELECT page_id, host, path, rule, coalesce(decided, CASE WHEN share >= {u.REJECT} THEN 'block' ELSE 'allow' END) AS verdict, template
FROM rows_ JOIN known USING (host, form)"""


URL_FILTER = url_filter_sql()


def licenses_sql(threshold: float = licenses.THRESHOLD, share: float = licenses.FILE_SHARE) -> str:
    """All lines against all templates, without pruning."""
    rows = ", ".join(f"({i}, {_text(n)}, {_text(t)})" for i, (n, t) in enumerate(licenses.TEMPLATES))
    split = r"list_filter(regexp_split_to_array(lower({}), '[\x00-/:-@\[-`{{-\x7f]+'), lambda x: x <> '')"
    return rf"""
WITH templates AS (SELECT * FROM (VALUES {rows}) v(template, license, t)),
docs AS (SELECT row_number() OVER () AS r, doc_id, concat_ws('/', source, lang, doc_id::VARCHAR) AS path, concat_ws('/', source, lang) AS dir, coalesce(text, '') AS t FROM documents),
t_words AS (SELECT template, license, w, 1 + ln(count(*)) AS tf FROM (SELECT template, license, unnest({split.format("t")}) AS w FROM templates) GROUP BY ALL),
lines AS (SELECT r, line, length(value) AS chars, {split.format("value")} AS ws FROM (SELECT r, unnest(string_split(t, chr(10))) AS value, unnest(range(0, len(string_split(t, chr(10))))) AS line FROM docs)),
l_words AS (SELECT r, line, chars, w, 1 + ln(count(*)) AS tf FROM (SELECT r, line, chars, unnest(ws) AS w FROM lines) GROUP BY ALL),
n AS (SELECT count(*) AS n FROM docs),
idf AS (
  SELECT v.w, ln((1 + n)::DOUBLE / (1 + count(DISTINCT l.r))) + 1 AS idf
  FROM (SELECT DISTINCT w FROM t_words) v CROSS JOIN n LEFT JOIN l_words l ON l.w = v.w GROUP BY v.w, n),
t_norm AS (SELECT template, sqrt(sum(pow(tf * idf, 2))) AS norm FROM t_words JOIN idf USING (w) GROUP BY template),
l_norm AS (SELECT r, line, chars, sqrt(sum(pow(tf * coalesce(idf, ln((1 + n)::DOUBLE) + 1), 2))) AS norm FROM l_words CROSS JOIN n LEFT JOIN idf USING (w) GROUP BY ALL),
dots AS (
  SELECT l.r, l.line, t.template, t.license, sum(l.tf * i.idf * t.tf * i.idf) AS dot
  FROM l_words l JOIN t_words t USING (w) JOIN idf i USING (w) GROUP BY ALL),
scores AS (
  SELECT d.r, d.line, x.chars, d.license, round(d.dot / x.norm / t.norm, 9) AS score
  FROM dots d JOIN l_norm x USING (r, line) JOIN t_norm t USING (template)),
best AS (SELECT r, line, chars, license, score FROM scores WHERE score >= {threshold} QUALIFY row_number() OVER (PARTITION BY r, line ORDER BY score DESC, license) = 1),
own AS (
  SELECT r, sum(chars) AS matched, first(license ORDER BY score DESC, line, license) AS license, max(score) AS score FROM best GROUP BY r),
known AS (SELECT d.r, doc_id, path, dir, own.license, own.score, coalesce(matched >= {share} * length(t), false) AS is_file FROM docs d LEFT JOIN own USING (r)),
speaking AS (
  SELECT dir, license, path FROM known WHERE is_file QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, path, license) = 1),
above AS (
  SELECT DISTINCT dir, i, array_to_string(string_split(dir, '/')[1:i], '/') AS ancestor
  FROM (SELECT dir, unnest(range(0, len(string_split(dir, '/')) + 1)) AS i FROM (SELECT DISTINCT dir FROM known))),
inherited AS (
  SELECT a.dir, s.license, s.path FROM above a JOIN speaking s ON s.dir = a.ancestor QUALIFY row_number() OVER (PARTITION BY a.dir ORDER BY i DESC) = 1)
SELECT doc_id, coalesce(k.license, h.license) AS license,
  CASE WHEN is_file THEN 'file' WHEN k.license IS NOT NULL THEN 'header' WHEN h.license IS NOT NULL THEN 'directory' END AS license_by,
  CASE WHEN k.license IS NOT NULL THEN k.path ELSE h.path END AS license_from
FROM known k LEFT JOIN inherited h USING (dir)"""


LICENSES = licenses_sql()


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SOURCE_DIVERGENCE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
occurrences AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM occurrences GROUP BY ALL HAVING count(DISTINCT r) >= {divergence.MIN_DOCS}),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM occurrences JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
langs AS (SELECT lang, count(*) AS v, sum(total) AS size FROM kept GROUP BY lang),
sizes AS (SELECT lang, source, sum(n) AS size FROM counts GROUP BY ALL),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(s.size, 0) + l.v))::BIGINT AS p,
         (1 + 1000000000::HUGEINT * (k.total + 1) // (l.size + l.v))::BIGINT AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN sizes s USING (lang, source) LEFT JOIN counts c USING (lang, source, term)),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM dense WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM rows)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {divergence.RANKS}"""

LEXICAL_SEARCH = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
corpus AS (SELECT count(*) FILTER (len(w) > 0)::BIGINT AS docs, sum(len(w))::BIGINT AS terms FROM d),
counts AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL),
holding AS (SELECT term, count(*)::BIGINT AS df FROM counts GROUP BY term),
items AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
queries AS (SELECT i, item_id, term, count(*)::BIGINT AS times FROM (SELECT i, item_id, unnest(w) AS term FROM items) GROUP BY ALL),
scores AS (
  SELECT i, item_id, c.r, doc_id, sum(times * floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT
    * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * len(w) * docs) // terms)))))::BIGINT AS score
  FROM queries JOIN counts c USING (term) JOIN holding USING (term) JOIN d ON d.r = c.r, corpus GROUP BY ALL)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM scores WHERE score > 0)
WHERE rank <= {search.K}"""

# Two passes, since a second # of a pair may be the first of the next.
_SAFE = r"replace(replace(regexp_replace(regexp_replace(replace({0}, '\', '\\'), '##', '#\\#', 'g'), '##', '#\\#', 'g'), '</turn>', '<\/turn>'), '<|', '<\|')"

CHAT = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CHAT_SAMPLE}'
  UNION ALL SELECT -7, 1, 'assistant', '{CHAT_SAMPLE}'),
f AS (SELECT *, length({_SAFE.format("text")}) + length(replace({_SAFE.format("role")}, ':', '\:')) + {len(chat.OPEN + chat.HEAD + chat.CLOSE)} AS chars FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id"""
