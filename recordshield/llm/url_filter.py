"""Operator 1, URL filters: a path-template tree per host.

The paths of a host form a tree of segments. Level by level, a node's children become branches or the wildcard ``*``, by
evidence: a child is set apart if its labelled share of bad urls differs from that of the whole node by more than Hoeffding's
bound allows for its own number of labels, with the error shared among all labelled children of the node. How few of the
node's rows it holds does not matter. Children set apart are put into ``BINS`` bins of their share, and the bins, in order of
share, are merged as long as the next one does not differ from the pooled share of the branch so far by the bound of
their typical children; so a thinly labelled child cannot join two that differ. Of the children not set apart, those with
at least ``MIN_SHARE`` of the node's rows form one branch, the others are variable and become the wildcard: neither is told from
the node by its labels. A branch is written ``a``, ``{a|b}`` or, with more members, ``{first|..|last}``. From ``DEPTH`` segments on, a
node is only opened if it has ``MIN_LABELS`` labels; what is left below becomes ``**``. A path thus has one template, and a
template is rejected when its purity, the share of good labels, falls below a threshold. Purity is smoothed: a host's share
of bad labels leans on that of all hosts, a template's on that of its host, by ``prior`` imaginary labels each.

Given rules come first: a rule fits its host and all subdomains of it if the path starts with the rule's path; the longest
wins.

Everything is counted over all urls, on distinct (host, path) pairs, so that a url in a third of the rows is one row. Sums per
node are partial aggregates, and what is merged in one place are the bins of a node, ``BINS + 1`` at most, however many
children it has; a level's joins read both sides from files, so that the adaptive skew join can split a host with a third of
all paths.

Defined cases: children of equal share always share a branch; a url that is null or has no ``://`` has an empty host and path; the host keeps its port and user; an empty path
is a template of its own, the empty string, and no rule fits it, as every rule's path starts with ``/``; labels are counted
per url row, and rows without one only take part in the tree; without any label every template is allowed; repeated rows
count as often as they stand; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import store
from .common import lower_ascii

DEPTH = 4
MIN_SHARE = 0.02
MIN_ROWS = 5
CONFIDENCE = 0.05
BINS = 20
MIN_LABELS = 8
PRIOR = 5.0
MIN_PURITY = 0.5


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    rest = _rest(url)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)


def _rest(url: Column) -> Column:
    """What follows the first ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[str]) -> Column:
    """The longest of a short list of rules that fits, else null. A rule is written host, then path."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _child(depth: int) -> Column:
    """The segment below a template of ``depth`` segments; null where the path has ended."""
    return F.get(F.col("segments"), depth)


def _apart(depth: int, paths: DataFrame) -> DataFrame:
    """Children that become branches, with the bin of their share; without one where only their rows make them a branch."""
    children = (
        paths.where(~F.col("ended") & _child(depth).isNotNull())
        .groupBy("host", "template", _child(depth).alias("segment"))
        .agg(F.sum("rows").alias("rows"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    )
    children = store(children, "children")
    nodes = children.groupBy("host", "template").agg(
        F.sum("rows").alias("all_rows"),
        F.try_divide(F.sum("bad"), F.sum("labelled")).alias("all_share"),
        F.sqrt(F.log(F.greatest(F.count_if(F.col("labelled") > 0), F.lit(1)) * 2 / F.lit(CONFIDENCE)) / 2).alias("reach"),
    )
    known = children.join(store(nodes, "nodes"), ["host", "template"])
    share = F.try_divide("bad", "labelled")
    told = F.abs(share - F.col("all_share")) > F.col("reach") / F.sqrt("labelled")
    frequent = (F.col("rows") >= MIN_ROWS) & (F.col("rows") >= F.col("all_rows") * MIN_SHARE)
    return known.withColumn("bin", F.when(told, F.floor(share * BINS))).where(F.col("bin").isNotNull() | frequent)


def _starts(apart: DataFrame) -> DataFrame:
    """(host, template, starts): the first bin of every branch of a node."""
    bins = (
        apart.where(F.col("bin").isNotNull())
        .groupBy("host", "template", "bin")
        .agg(F.count(F.lit(1)).alias("children"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.max("reach").alias("reach"))
    )
    nodes = bins.groupBy("host", "template").agg(F.sort_array(F.collect_list(F.struct("bin", "children", "labelled", "bad", "reach"))).alias("bins"))

    def put(done: Column, b: Column) -> Column:
        last = F.element_at(done, -1)
        typical = F.sqrt(b["children"] / b["labelled"]) + F.sqrt(last["children"] / last["labelled"])
        differs = b["bad"] / b["labelled"] - last["bad"] / last["labelled"] > b["reach"] * typical
        pooled = F.struct(
            last["bin"].alias("bin"),
            (last["children"] + b["children"]).alias("children"),
            (last["labelled"] + b["labelled"]).alias("labelled"),
            (last["bad"] + b["bad"]).alias("bad"),
            b["reach"].alias("reach"),
        )
        return F.when(differs, F.concat(done, F.array(b))).otherwise(F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(pooled)))

    rest = F.slice("bins", F.lit(2), F.size("bins"))
    branches = F.aggregate(rest, F.slice("bins", 1, 1), put)
    return nodes.select("host", "template", F.transform(branches, lambda b: b["bin"]).alias("starts"))


def _branches(paths: DataFrame, depth: int) -> DataFrame:
    """(host, template, segment, branch) of the segments that stay apart from the wildcard at this level."""
    apart = store(_apart(depth, paths), "apart")
    started = apart.join(store(_starts(apart), "starts"), ["host", "template"], "left")
    first = F.array_max(F.filter("starts", lambda s: s <= F.col("bin")))
    members = store(started.select("host", "template", "segment", F.coalesce(first, F.lit(-1)).alias("start")), "members")
    named = members.groupBy("host", "template", "start").agg(
        F.min("segment").alias("least"), F.max("segment").alias("last"), F.count(F.lit(1)).alias("n")
    )
    between = F.when(F.col("n") == 2, "|").otherwise("|..|")
    branch = F.when(F.col("n") == 1, F.col("least")).otherwise(F.concat(F.lit("{"), "least", between, "last", F.lit("}")))
    named = store(named.select("host", "template", "start", branch.alias("branch")), "named")
    return members.join(named, ["host", "template", "start"]).select("host", "template", "segment", "branch")


def _end_unsupported(paths: DataFrame, depth: int) -> DataFrame:
    """Paths that go on below a node with too few labels end there in ``**``."""
    on = ~F.col("ended") & _child(depth).isNotNull()
    nodes = paths.where(on).groupBy(F.col("host").alias("n_host"), F.col("template").alias("n_template")).agg(F.sum("labelled").alias("n"))
    few = store(nodes.where(F.col("n") < MIN_LABELS), "few")
    ends = on & F.col("n").isNotNull()
    return paths.join(few, (F.col("host") == F.col("n_host")) & (F.col("template") == F.col("n_template")), "left").select(
        "host", "path", "rows", "labelled", "bad", "segments",
        F.when(ends, F.concat(F.col("template"), F.lit("/**"))).otherwise(F.col("template")).alias("template"),
        (F.col("ended") | ends).alias("ended"),
    )


def path_templates(urls: DataFrame) -> DataFrame:
    """(host, path, rows, labelled, bad, template) per distinct (host, path), from (host, path, bad); ``bad`` is null without a label."""
    segments = F.split(F.substr(F.col("path"), F.lit(2)), "/")
    paths = urls.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("rows"), F.count("bad").alias("labelled"), F.coalesce(F.sum(F.col("bad").cast("bigint")), F.lit(0)).alias("bad")
    )
    paths = paths.select(
        "*",
        F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(segments).alias("segments"),
        F.lit("").alias("template"),
        F.lit(False).alias("ended"),
    )
    paths = store(paths, "paths")
    depth = 0
    while True:
        if depth >= DEPTH:
            paths = store(_end_unsupported(paths, depth), "paths")
        if paths.where(~F.col("ended") & _child(depth).isNotNull()).isEmpty():
            return paths.drop("segments", "ended")
        b = store(_branches(paths, depth), "branches").select(
            F.col("host").alias("b_host"), F.col("template").alias("b_template"), "segment", "branch"
        )
        on = (F.col("host") == F.col("b_host")) & (F.col("template") == F.col("b_template")) & (_child(depth) == F.col("segment"))
        longer = F.concat(F.col("template"), F.lit("/"), F.coalesce(F.col("branch"), F.lit("*")))
        paths = store(
            paths.join(b, on & ~F.col("ended"), "left").select(
                "host", "path", "rows", "labelled", "bad", "segments",
                F.when(~F.col("ended") & _child(depth).isNotNull(), longer).otherwise(F.col("template")).alias("template"),
                "ended",
            ),
            "paths",
        )
        depth += 1


def template_purity(paths: DataFrame) -> DataFrame:
    """(host, template, purity, reject) per template."""
    templates = store(
        paths.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")), "templates"
    )
    total = templates.agg(F.coalesce(F.try_divide(F.sum("bad"), F.sum("labelled")), F.lit(0.0)).alias("rate")).first()["rate"]

    def smoothed(prior: Column) -> Column:
        return (F.col("bad") + F.lit(PRIOR) * prior) / (F.col("labelled") + F.lit(PRIOR))

    hosts = templates.groupBy("host").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    hosts = hosts.select(F.col("host").alias("h"), smoothed(F.lit(float(total))).alias("host_bad"))
    hosts = store(hosts, "hosts")
    out = templates.join(hosts, F.col("host") == F.col("h")).withColumn("purity", 1 - smoothed(F.col("host_bad")))
    return out.select("host", "template", "purity", (F.col("purity") < MIN_PURITY).alias("reject"))


def judge_urls(pages: DataFrame, rules: dict[str, str], bad: Column) -> DataFrame:
    """(page_id, host, path, rule, template, purity, verdict), one row per row of ``pages`` (page_id, url, and what ``bad`` reads)."""
    urls = store(
        pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), bad.alias("bad")), "urls"
    )
    paths = path_templates(urls)
    purity = store(template_purity(paths), "purity").select(F.col("host").alias("t_host"), F.col("template").alias("t"), "purity", "reject")
    judged = paths.join(purity, (F.col("host") == F.col("t_host")) & (F.col("template") == F.col("t")))
    judged = store(judged.select(F.col("host").alias("p_host"), F.col("path").alias("p"), "template", "purity", "reject"), "judged")
    found = urls.join(judged, (F.col("host") == F.col("p_host")) & (F.col("path") == F.col("p")))
    rule = rule_of(F.col("host"), F.col("path"), list(rules))
    verdicts = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])
    learned = F.when(F.col("reject"), "block").otherwise("allow")
    return (
        found.withColumn("rule", rule)
        .withColumn("verdict", F.when(F.col("rule").isNotNull(), F.element_at(verdicts, F.col("rule"))).otherwise(learned))
        .select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 6).alias("purity"))
    )


def label_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Pages with ``bad``: whether the document published there is labelled as junk or toxic, null without a label.

    The document's number is the last numeric path segment, a file ending aside.
    """
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(\.[A-Za-z]+)?/?$", 1)
    marks = labels.groupBy(F.col("doc_id").alias("l_doc")).agg(
        F.max(((F.col("quality") == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)).cast("int")).alias("bad")
    )
    numbered = pages.select("page_id", "url", F.when(number != "", number.cast("bigint")).alias("doc"))
    return numbered.join(marks, F.col("doc") == F.col("l_doc"), "left").select("page_id", "url", "bad")
