"""URL filter: explicit rules, then a tree of path templates per host with labelled purity.

Rules decide where they fit. The other urls are judged by what labelled urls of their host look like. Paths
are cut into segments, digits become ``{n}``, and level by level a segment that holds less than ``least_share``
of its parent becomes the wildcard ``*``, so that a parent has at most ``1 / least_share`` named children.
Sibling branches whose shares of bad labels don't differ from the rest of their parent (two-proportion z below
``similar_z``) are merged. The purity of a branch is its share of bad labels, drawn towards that of its parent
by ``smoothing`` labels, from the host's domain down. Where a host has fewer than ``least_labels`` labels under a template, those of
the same template on all hosts are the prior that its own ones are added to, if at least ``least_domains`` domains have
some: what one site does under a template says little about others. A template with at least ``least_labels`` labels in
either way and a purity of ``reject_purity`` or more is blocked, every other one is allowed. Levels are built as deep as
paths go, ``depth`` segments at most; what lies below shares a template.

All of it is DataFrame work over counts per distinct host and generalised path; a large host sends one row per
path and map task, and the joins that bring templates back to rows are ones that Spark splits where a host is hot.

Results, all cases included:
* a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed;
* hosts have A-Z lowered, ports and logins belong to the host; paths keep their case;
* of several rules that fit the longest wins, of equally long ones the first by code point;
* without any label nothing but the rules blocks; repeated rows are judged alike, an empty table gives an
  empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from parlor.llm.common import durable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """``rule`` is ``host/path``; it fits the host and its subdomains, and paths that start with its path."""

    rule: str
    verdict: str

    def fits(self, host: Column, path: Column) -> Column:
        name, _, rest = self.rule.partition("/")
        return ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(f"/{rest}"))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), r"\A([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"\A[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def domain_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def first_rule(rules: Sequence[UrlRule], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for one in sorted(rules, key=lambda r: (len(r.rule), [-ord(c) for c in r.rule])):
        fits = one.fits(host, path)
        rule = F.when(fits, F.lit(one.rule)).otherwise(rule)
        verdict = F.when(fits, F.lit(one.verdict)).otherwise(verdict)
    return rule, verdict


def generalised_path(path: Column, depth: int) -> Column:
    """The first ``depth`` non-empty segments with digits replaced; deeper ones become one ``**``."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    named = F.transform(F.slice(segments, 1, depth), lambda s: F.regexp_replace(s, "[0-9]+", "{n}"))
    return F.concat(F.array_join(named, "/"), F.when(F.size(segments) > depth, "/**").otherwise(""))


def path_templates(counts: DataFrame, depth: int, least_share: float) -> tuple[DataFrame, int]:
    """Add ``t0 ..`` to ``host, key, n``, the template of every level, null where a path has ended; and the last level."""
    tree = counts.withColumn("segments", F.when(F.col("key") == "", F.array().cast("array<string>")).otherwise(F.split("key", "/")))
    tree = tree.withColumn("t0", F.lit(""))
    for level in range(1, depth + 2):
        parent, child = f"t{level - 1}", f"t{level}"
        there = tree.withColumn("segment", F.get("segments", F.lit(level - 1)))
        known = there.where("segment is not null").withColumnRenamed(parent, "parent")
        children = known.groupBy("host", "parent", "segment").agg(F.sum("n").alias("rows"))
        parents = durable(known.groupBy("host", "parent").agg(F.sum("n").alias("all_rows")), "parents")
        if parents.isEmpty():
            return tree, level - 1
        frequent = (
            children.join(parents, ["host", "parent"])
            .where((F.col("rows") >= F.col("all_rows") * F.lit(least_share)) & (F.col("rows") > 1))
            .select("host", F.col("parent").alias(parent), "segment", F.lit(True).alias("named"))
        )
        step = F.concat(F.col(parent), F.lit("/"), F.when(F.col("named"), F.col("segment")).otherwise("*"))
        tree = durable(
            there.join(durable(frequent, "frequent"), ["host", parent, "segment"], "left")
            .withColumn(child, F.when(F.col("segment").isNotNull(), step)).drop("segment", "named"),
            "tree",
        )
    return tree, depth + 1


def template_purity(tree: DataFrame, levels: int, smoothing: float, similar_z: float, least_labels: int) -> DataFrame:
    """``host, template, labels, purity`` of every node, over the branch that it was merged into."""
    share = lambda bad, labels, prior: (bad + smoothing * prior) / (labels + smoothing)
    sums = [F.sum("labels").alias("labels"), F.sum("bad").alias("bad")]
    hosts = durable(tree.groupBy("host").agg(*sums), "hosts").withColumn("domain", domain_of(F.col("host")))
    total = hosts.agg(*sums).first()
    overall = ((total["bad"] or 0) + 1) / ((total["labels"] or 0) + 2)
    domains = hosts.groupBy("domain").agg(*sums)
    domains = durable(domains.select("domain", share(F.col("bad"), F.col("labels"), F.lit(overall)).alias("prior")), "domains")
    level = durable(
        hosts.join(domains, "domain").select(
            "host", F.lit("").alias("template"), "labels", "bad",
            share(F.col("bad"), F.col("labels"), F.col("prior")).alias("purity"),
        ),
        "purity",
    )
    nodes = level.select("host", "template", "labels", "purity")
    for i in range(1, levels + 1):
        own = tree.where(F.col(f"t{i}").isNotNull()).groupBy("host", F.col(f"t{i - 1}").alias("parent"), F.col(f"t{i}").alias("template"))
        above = level.select("host", F.col("template").alias("parent"), F.col("labels").alias("all"), F.col("bad").alias("all_bad"),
                             F.col("purity").alias("prior"))
        joined = own.agg(*sums).join(above, ["host", "parent"])
        rest, rate, over = F.col("all") - F.col("labels"), F.try_divide(F.col("all_bad"), F.col("all")), F.try_divide
        spread = F.sqrt(rate * (1 - rate) * (over(F.lit(1), F.col("labels")) + over(F.lit(1), rest)))
        z = over(F.abs(over(F.col("bad"), F.col("labels")) - over(F.col("all_bad") - F.col("bad"), rest)), spread)
        enough = (F.col("labels") >= least_labels) & (rest >= least_labels)
        similar = F.when(enough, F.when(spread > 0, z < similar_z).otherwise(True)).otherwise(False)
        marked = durable(joined.withColumn("branch", F.when(similar, "").otherwise(F.col("template"))), "marked")
        merged = marked.groupBy("host", "parent", "branch").agg(
            F.sum("labels").alias("branch_labels"), F.sum("bad").alias("branch_bad")
        )
        level = durable(
            marked.join(durable(merged, "merged"), ["host", "parent", "branch"]).select(
                "host", "template", "labels", "bad", "branch_labels",
                share(F.col("branch_bad"), F.col("branch_labels"), F.col("prior")).alias("purity"),
            ),
            "purity",
        )
        nodes = nodes.union(level.select("host", "template", F.col("branch_labels").alias("labels"), "purity"))
    return nodes


def judge_urls(
    pages: DataFrame,
    rules: Sequence[UrlRule],
    id_col: str = "page_id",
    url_col: str = "url",
    label: Column | None = None,
    *,
    depth: int = 32,
    least_share: float = 0.01,
    smoothing: float = 5.0,
    similar_z: float = 1.96,
    least_labels: int = 5,
    least_domains: int = 3,
    reject_purity: float = 0.8,
) -> DataFrame:
    """One row per page: ``id, host, path, rule, verdict, template, labels, purity``.

    ``label`` (a column of ``pages``: true for a bad url, false for a good one, null for unknown) is what purity
    is learned from; by default the verdicts of the rules.
    """
    host, path = F.col("host"), F.col("path")
    rows = pages.select(
        F.col(id_col).alias("id"), F.coalesce(host_of(F.col(url_col)), F.lit("")).alias("host"),
        F.coalesce(path_of(F.col(url_col)), F.lit("")).alias("path"),
        *([] if label is None else [label.cast("boolean").alias("given")]),
    )
    rule, verdict = first_rule(rules, host, path)
    rows = rows.withColumn("rule", rule).withColumn("said", verdict).withColumn("key", generalised_path(path, depth))
    bad = (F.col("said") == "block") if label is None else F.col("given")
    counts = rows.groupBy("host", "key").agg(
        F.count("*").alias("n"), F.count(bad).alias("labels"), F.count_if(bad).alias("bad")
    )
    tree, levels = path_templates(durable(counts, "paths"), depth, least_share)
    nodes = durable(template_purity(tree, levels, smoothing, similar_z, least_labels), "nodes")
    named = F.coalesce(*[f"t{i}" for i in range(levels, -1, -1)]).alias("template")
    # The labels of a template on all hosts, for hosts that have few of their own.
    sums = [F.sum("labels").alias("pool"), F.sum("bad").alias("pool_bad")]
    leaves = durable(tree.select("host", "key", named, "labels", "bad"), "leaves")
    by_domain = leaves.where("labels > 0").groupBy("template", domain_of(F.col("host")).alias("domain")).agg(F.sum("labels").alias("labels"), F.sum("bad").alias("bad"))
    pooled = by_domain.groupBy("template").agg(*sums, F.count("*").alias("domains"))
    pooled = durable(pooled.where(F.col("domains") >= least_domains).drop("domains"), "pooled")
    total = leaves.agg(F.sum("labels"), F.sum("bad")).first()
    overall = ((total[1] or 0) + 1) / ((total[0] or 0) + 2)
    own = leaves.groupBy("host", "template").agg(F.sum("labels").alias("few"), F.sum("bad").alias("few_bad"))
    prior = (F.col("pool_bad") + smoothing * overall) / (F.col("pool") + smoothing)
    drawn = F.when(F.col("pool").isNotNull(), (F.col("few_bad") + smoothing * prior) / (F.col("few") + smoothing)).otherwise(F.col("purity"))
    lacking = F.col("labels") < least_labels
    nodes = own.join(pooled, "template", "left").join(nodes, ["host", "template"], "left").select(
        "host", "template", F.when(lacking, drawn).otherwise(F.col("purity")).alias("purity"),
        F.when(lacking, F.greatest(F.col("labels"), F.coalesce("pool", F.lit(0)))).otherwise(F.col("labels")).alias("labels"),
    )
    judged = durable(leaves.select("host", "key", "template").join(durable(nodes, "judged"), ["host", "template"], "left"), "templates")
    blocks = (F.col("labels") >= least_labels) & (F.col("purity") >= reject_purity)
    return rows.join(judged, ["host", "key"], "left").select(
        "id", "host", "path", "rule",
        F.coalesce("said", F.when(blocks & (host != ""), "block").otherwise("allow")).alias("verdict"),
        "template", "labels", "purity",
    )
