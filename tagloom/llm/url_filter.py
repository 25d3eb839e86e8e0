"""URL filter by a tree of path templates, in native Spark functions.

Rules decide first: a rule names a host and a path prefix, fits the host and its
subdomains, and the longest fitting rule wins.  All other urls are judged by
templates learned from labelled urls:

1. Segments are generalised by form: runs of digits become ``<n>``, longer runs of
   hexadecimal digits ``<h>``.
2. Per host and parent, a segment with little support becomes the wildcard ``*``.
3. From the deepest level up, branches that differ in one segment are merged into
   ``*`` if their labelled shares do not differ by a two-proportion test.
4. A template is rejected if its share of bad labels, smoothed towards the same
   template on all hosts and that towards all labels, reaches a threshold.

Everything is grouped on (host, path form) before it is counted, joins are on
grouped tables, and Spark splits a hot host's partition in the last join.

Defined cases: a null url, or one without ``://``, has an empty host and path and
is judged like any other; segments beyond ``DEPTH`` are one tail ``**``; null
labels are no labels; without labels every template is allowed; rows are judged
one by one, so repeated rows repeat; an empty table gives an empty table.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.session import staged

#: Levels of the tree; support that keeps a segment, as rows and as a share of its parent's.
DEPTH, MIN_ROWS, MIN_SHARE = 6, 5, 0.01
#: Labels that a branch and its siblings need for the test, and the test's bound.
MIN_LABELS, Z_BOUND = 5, 1.96
#: Weight of the prior in labels, and the smoothed share that rejects a template.
PRIOR, REJECT = 10.0, 0.5


def host_of(url: Column | str) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A to Z in lower case."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column | str) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule: str, host: Column, path: Column) -> Column:
    name, _, prefix = rule.partition("/")
    return ((host == name) | host.endswith("." + name)) & path.startswith("/" + prefix)


def longest_rule(rules: Sequence[str], host: Column, path: Column) -> Column:
    """The longest rule that fits, the first of equally long ones, or null."""
    ordered = sorted(rules, key=len, reverse=True)
    return F.coalesce(*[F.when(fits(r, host, path), F.lit(r)) for r in ordered], F.lit(None).cast("string"))


def path_form(path: Column) -> Column:
    """The path's segments by form, joined by ``/``."""
    plain = F.filter(F.split(path, "/"), lambda s: s != "")
    marked = F.transform(plain, lambda s: F.regexp_replace(s, r"(?=[0-9a-f]*[0-9])[0-9a-f]{8,}", "<h>"))
    formed = F.transform(marked, lambda s: F.regexp_replace(s, r"[0-9]+", "<n>"))
    cut = F.concat(F.slice(formed, 1, DEPTH), F.when(F.size(formed) > DEPTH, F.array(F.lit("**"))).otherwise(F.array().cast("array<string>")))
    return F.concat_ws("/", cut)


def _prefix(form: Column, level: Column) -> Column:
    return F.substring_index(form, F.lit("/"), level)


def generalised(forms: DataFrame) -> DataFrame:
    """``forms`` (host, form, n, labels, bad) with ``template``: little supported segments as wildcards."""
    steps = F.sequence(F.lit(1), F.size(F.split("form", "/")))
    exploded = forms.withColumn("level", F.explode(steps)).withColumns({"node": F.expr("substring_index(form, '/', level)"), "parent": F.when(F.col("level") > 1, F.expr("substring_index(form, '/', level - 1)")).otherwise("")})
    nodes = exploded.groupBy("host", "level", "parent", "node").agg(F.sum("n").alias("rows"))
    totals = nodes.groupBy("host", "level", "parent").agg(F.sum("rows").alias("total"))
    kept = nodes.join(totals, ["host", "level", "parent"]).where((F.col("rows") >= MIN_ROWS) & (F.col("rows") >= MIN_SHARE * F.col("total")))
    known = kept.select("host", "level", "node", F.lit(True).alias("known"))
    segment = F.when(F.col("known"), F.expr("substring_index(node, '/', -1)")).otherwise("*")
    parts = exploded.join(known, ["host", "level", "node"], "left").groupBy("host", "form").agg(F.array_sort(F.collect_list(F.struct("level", segment.alias("segment")))).alias("parts"))
    return forms.join(parts.select("host", "form", F.col("parts.segment").alias("template")), ["host", "form"])


def _replaced(template: Column, level: int) -> Column:
    return F.transform(template, lambda s, i: F.when(i == level - 1, F.lit("*")).otherwise(s))


def merged(templates: DataFrame) -> DataFrame:
    """``templates`` (host, template, labels, bad) with ``branch``: similar branches share a wildcard."""
    now = templates.withColumn("branch", F.col("template"))
    deepest = templates.agg(F.max(F.size("template"))).first()[0] or 0
    for level in range(deepest, 0, -1):
        branches = now.groupBy("host", "branch").agg(F.sum("labels").alias("n1"), F.sum("bad").alias("b1"))
        deep = branches.where(F.size("branch") >= level).withColumn("wide", _replaced(F.col("branch"), level))
        families = deep.groupBy("host", "wide").agg(F.sum("n1").alias("family"), F.sum("b1").alias("family_bad"))
        both = deep.join(families, ["host", "wide"]).withColumns({"n2": F.col("family") - F.col("n1"), "b2": F.col("family_bad") - F.col("b1")})
        p = F.col("family_bad") / F.col("family")
        apart = F.col("b1") / F.col("n1") - F.col("b2") / F.col("n2")
        spread = p * (1 - p) * (1 / F.col("n1") + 1 / F.col("n2"))
        alike = (F.col("n1") >= MIN_LABELS) & (F.col("n2") >= MIN_LABELS) & (apart * apart <= Z_BOUND * Z_BOUND * spread)
        joins = both.where(alike).select("host", "branch", "wide")
        now = now.join(joins, ["host", "branch"], "left").withColumn("branch", F.coalesce("wide", "branch")).drop("wide")
        now = staged(now, "level")  # each level reads the one below twice
    return now


def rejected(templates: DataFrame) -> DataFrame:
    """Per branch of ``templates`` its smoothed share of bad labels and whether that rejects it."""
    branches = templates.groupBy("host", "branch").agg(F.sum("labels").alias("labels"), F.sum("bad").alias("bad"))
    everywhere = branches.groupBy("branch").agg(F.sum("labels").alias("all_labels"), F.sum("bad").alias("all_bad"))
    labels, bad = templates.agg(F.sum("labels"), F.sum("bad")).first()  # one row
    base = F.lit(bad / labels if labels else 0.0)
    wide = everywhere.select("branch", ((F.col("all_bad") + PRIOR * base) / (F.col("all_labels") + PRIOR)).alias("prior"))
    share = (F.col("bad") + PRIOR * F.col("prior")) / (F.col("labels") + PRIOR)
    return branches.join(wide, "branch").select("host", "branch", share.alias("share"), (share >= REJECT).alias("rejects"))


def judge(urls: DataFrame, rules: dict[str, str], *, key: str = "page_id", url: str = "url", label: Column | None = None) -> DataFrame:
    """Per row: key, host, path, rule, verdict (allow or block), template and its smoothed share of bad labels.

    ``rules`` maps a rule to its verdict.  ``label`` is 1 for a bad url, 0 for a
    good one and null for an unlabelled one; by default the rules' verdicts are
    the labels.
    """
    rows = urls.select(F.col(key).alias("key"), F.col(url).alias("url"), (F.lit(None) if label is None else label).cast("int").alias("given"))
    rows = rows.withColumns({"host": host_of("url"), "path": path_of("url")}).withColumn("form", path_form(F.col("path")))
    rows = rows.withColumn("rule", longest_rule(list(rules), F.col("host"), F.col("path")))
    decided = F.coalesce(*[F.when(F.col("rule") == r, F.lit(v)) for r, v in rules.items()], F.lit(None).cast("string"))
    rows = rows.withColumn("decided", decided).withColumn("bad", F.col("given") if label is not None else (F.col("decided") == "block").cast("int"))
    forms = rows.groupBy("host", "form").agg(F.count("*").alias("n"), F.count("bad").alias("labels"), F.coalesce(F.sum("bad"), F.lit(0).cast("long")).alias("bad"))
    known = staged(generalised(staged(forms, "forms")), "templates")
    counted = staged(known.groupBy("host", "template").agg(F.sum("labels").alias("labels"), F.sum("bad").alias("bad")), "counted")
    templates = merged(counted)
    verdicts = templates.select("host", "template", "branch").join(rejected(templates), ["host", "branch"])
    by_form = known.select("host", "form", "template").join(verdicts, ["host", "template"]).select("host", "form", F.concat_ws("/", F.lit(""), "branch").alias("template"), "share", "rejects")
    verdict = F.coalesce("decided", F.when(F.col("rejects"), F.lit("block")).otherwise(F.lit("allow")))
    return rows.join(by_form, ["host", "form"]).select(F.col("key").alias(key), "host", "path", "rule", verdict.alias("verdict"), "template", "share")
