"""URL filter: explicit rules, and a path-template tree where no rule fits.

All in DataFrame functions. Paths collapse to their shapes (numbers and long identifiers
become wildcards) before anything is counted, so a host with a third of all pages is a few
rows when the tree is built. Pages that a rule decides are the labels of the tree: a template
is rejected where its share of blocked pages is high, smoothed towards its parent's, and so on
up to its host's, which is smoothed towards that of the same template on other hosts.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from disputeflow.llm.frames import kept, scratch, staged

#: (verdict, host and path)
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
#: Levels of the tree; what lies deeper stays together, whole, as one segment more.
DEPTH = 8
#: A node with more children than this has its rare ones (below 1 in MANY) in one wildcard.
MANY = 16
#: Branches whose shares differ by fewer standard errors are merged.
SIMILAR = 1.96
#: Smoothing: as many labelled pages, with the share of the node above, every node is taken to have
#: besides its own. Where no page at all is labelled the share is 0.5, below REJECT.
STRENGTH = 4.0
REJECT = 0.75


def lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    whole = F.coalesce(F.col(url).cast("string"), F.lit(""))
    start = F.locate("://", whole)
    rest = F.when(start > 0, F.substring(whole, start + 3, F.length(whole))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return lower(host), F.regexp_extract(tail, r"^[^?#]*", 0)


def fitting(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    rule = verdict = None
    for what, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        of, slash, rest = text.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return (rule, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def shape(path: Column) -> Column:
    """The path's segments, variable ones generalised, in an array of at most DEPTH + 1."""
    def one(segment: Column) -> Column:
        dot = F.regexp_extract(segment, r"\.[A-Za-z][A-Za-z0-9]{0,4}$", 0)
        stem = F.substring(segment, F.lit(1), F.length(segment) - F.length(dot))
        kind = (
            F.when(stem.rlike(r"^[0-9]+$"), "{number}")
            .when(stem.rlike(r"^[0-9A-Fa-f-]{16,}$"), "{hex}")
            .when(stem.rlike(r"[0-9]{4,}"), "{mixed}")
            .otherwise(lower(stem))
        )
        return F.concat(kind, lower(dot))

    segments = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), one)
    rest = F.array_join(F.slice(segments, F.lit(DEPTH + 1), F.greatest(F.size(segments), F.lit(1))), "\\")
    deeper = F.concat(F.slice(segments, 1, DEPTH), F.array(rest))
    return F.when(F.size(segments) > DEPTH, deeper).otherwise(segments)


def _level(tree: DataFrame, level: int) -> DataFrame:
    """Generalises the segments of one level of ``(host, shape, template, n, blocked, labelled)``."""
    at = F.get("shape", F.lit(level))
    here = tree.withColumn("segment", at)
    child = here.where("segment is not null").groupBy("host", "template", "segment").agg(
        F.sum("n").alias("n"), F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled")
    )
    parent = child.groupBy("host", "template").agg(
        F.count(F.lit(1)).alias("children"), F.sum("n").alias("all_n"),
        F.sum("blocked").alias("all_blocked"), F.sum("labelled").alias("all_labelled"),
    )
    compared = child.join(parent, ["host", "template"])
    rare = (F.col("children") > MANY) & (F.col("n") * MANY < F.col("all_n"))
    share = F.try_divide(F.col("all_blocked"), F.col("all_labelled"))
    error = F.sqrt(share * (1 - share) / F.col("labelled"))
    difference = F.abs(F.try_divide(F.col("blocked"), F.col("labelled")) - share)
    alike = (F.col("labelled") > 0) & (F.col("children") > 1) & (difference <= SIMILAR * error + 1e-12)
    name = F.when(rare, "{*}").when(F.coalesce(alike, F.lit(False)), "{alike}").otherwise(F.col("segment"))
    named = compared.select("host", "template", "segment", name.alias("name"))
    joined = here.join(named, ["host", "template", "segment"], "left")
    longer = F.when(F.col("name").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "name"))
    return joined.select("host", "shape", longer.alias("template"), "n", "blocked", "labelled")


def templates(pages: DataFrame) -> DataFrame:
    """``(host, shape, template, purity, rejected)`` from pages with host, shape and verdict."""
    with scratch(pages.sparkSession):
        return kept(_templates(pages), "templates")


def _templates(pages: DataFrame) -> DataFrame:
    blocked = F.coalesce((F.col("verdict") == "block").cast("bigint"), F.lit(0))
    tree = pages.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(blocked).alias("blocked"),
        F.count("verdict").alias("labelled"),
    )
    tree = staged(tree.select("host", "shape", F.lit("").alias("template"), "n", "blocked", "labelled"), "paths")
    levels = tree.agg(F.max(F.size("shape")).alias("n")).first()["n"] or 0
    for level in range(levels):
        tree = staged(_level(tree, level), "paths")
    scored = purities(tree).withColumn("rejected", F.col("purity") >= REJECT)
    return tree.select("host", "shape", "template").join(scored, ["host", "template"])


def purities(tree: DataFrame) -> DataFrame:
    """``(host, template, purity)`` from ``(host, template, blocked, labelled)``.

    The nodes of a template are its beginnings, from the host itself to the whole template. The
    share begins with that of the template on other hosts, found from the same nodes there, and
    is smoothed once more by each node of its own host on the way down.
    """
    leaves = tree.groupBy("host", "template").agg(F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled"))
    parts = F.split("template", "/")
    beginnings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    placed = leaves.select("host", "template", "blocked", "labelled", F.posexplode(beginnings).alias("place", "node"))
    sums = [F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled")]
    own = placed.groupBy("host", "node").agg(*sums)
    every = own.groupBy("node").agg(F.sum("blocked").alias("all_blocked"), F.sum("labelled").alias("all_labelled"))
    met = placed.select("host", "template", "place", "node").join(own, ["host", "node"]).join(every, "node")
    step = F.struct(
        "place", "blocked", "labelled", (F.col("all_blocked") - F.col("blocked")).alias("other_blocked"),
        (F.col("all_labelled") - F.col("labelled")).alias("other_labelled"),
    )
    chains = met.groupBy("host", "template").agg(F.sort_array(F.collect_list(step)).alias("chain"))

    def smoothed(start: Column, blocked: str, labelled: str) -> Column:
        return F.aggregate(
            "chain", start, lambda share, node: (node[blocked] + share * STRENGTH) / (node[labelled] + F.lit(STRENGTH))
        )

    elsewhere = smoothed(F.lit(0.5), "other_blocked", "other_labelled")
    return chains.select("host", "template", smoothed(elsewhere, "blocked", "labelled").alias("purity"))


def judged(pages: DataFrame, rules: list[tuple[str, str]] = RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict, template, purity)``, a row for each page.

    A null url, or one without ``://``, has an empty host and path; no rule fits it and its
    template is the empty one of the empty host. Pages that a rule decides have no template.
    Without any label the tree allows all. Repeated rows stay; an empty table stays empty; other
    columns are not read.
    """
    host, path = host_and_path(url)
    parsed = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = fitting(rules, F.col("host"), F.col("path"))
    known = parsed.select("*", rule.alias("rule"), verdict.alias("verdict"), shape(F.col("path")).alias("shape"))
    tree = templates(known)
    joined = known.where("rule is null").join(tree, ["host", "shape"], "left")
    own = F.when(F.coalesce("rejected", F.lit(False)), "block").otherwise("allow")
    rest = joined.select("page_id", "host", "path", "rule", own.alias("verdict"), "template", "purity")
    none = F.lit(None)
    ruled = known.where("rule is not null").select(
        "page_id", "host", "path", "rule", "verdict", none.cast("string").alias("template"), none.cast("double").alias("purity")
    )
    return ruled.unionByName(rest)
