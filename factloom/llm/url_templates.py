"""URL filtering by a tree of path templates.

Listed rules decide first. A url that no rule fits is judged by its template,
a path in the tree of its host:

1. Segments that vary by their form (numbers, dates, identifiers) become
   wildcards, and the paths of a host become a tree of branches, each with its
   pages, its labelled pages and those of them that are to be blocked.
2. A rare child of a branch with many children becomes a wildcard too, unless
   its labelled rate differs from that of its siblings; such a child stays.
3. Siblings whose labelled rates are statistically alike are merged, subtrees
   included: they are one branch, named by the first of them.
4. A template's purity is the share of its labelled urls that are to be
   blocked, smoothed towards the share of its host, and that towards one half.
   A template with labelled urls whose purity reaches the threshold is
   rejected; nothing is rejected without a labelled url of its template.

All levels are found in one pass: a path is exploded to its prefixes, these
are aggregated once to branches, and one join names them.

Defined results: a null url, and one without "://", has an empty host and path
and is judged as such; empty segments are skipped; paths may be of any depth;
repeated rows are judged alike, each on its own; an empty table gives an empty
result. Columns other than the id and url are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: (host, path, verdict): a rule fits its host and all subdomains, and paths that start with its path.
Rule = tuple[str, str, str]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Segments that vary by their very form: numbers, dates, long hexadecimal or mixed identifiers.
VARIABLE = r"^(\d[\d._-]*|[0-9a-fA-F]{8,}|(?=[^/]*\d)[A-Za-z0-9_-]{12,})(\.[A-Za-z]{1,5})?$"
#: Below a branch with more children than this, children with a smaller share than RARE are one wildcard if they are alike.
MANY_CHILDREN, RARE = 16, 0.02
#: Pseudo-counts of the smoothing, the width of a class of alike rates (in standard errors), and the purity to reject at.
PRIOR, ALIKE, REJECT = 4.0, 1.0, 0.6
#: Standard errors between the rates of a child and of its siblings from which they differ.
DIFFERENT = 2.0
#: Rules are literals of the plan; more than this many are refused.
MOST_RULES = 2_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(rule_path))
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def form(path: Column) -> Column:
    """The path's segments, wildcards for those that vary by their form."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(segments, lambda s: F.when(s.rlike(VARIABLE), F.concat(F.lit("*"), F.regexp_extract(s, r"(\.[A-Za-z]{1,5})$", 1))).otherwise(s))


def _prefixes(segments: Column) -> Column:
    """A branch for each prefix: its number, that of the branch above it, and its last segment."""
    none = F.array().cast("array<struct<node: bigint, parent: bigint, segment: string>>")
    above = lambda found: F.coalesce(F.try_element_at(found, F.lit(-1))["node"], F.lit(0).cast("long"))
    return F.aggregate(segments, none, lambda found, s: F.array_append(found, F.struct(F.xxhash64(above(found), s).alias("node"), above(found).alias("parent"), s.alias("segment"))))


def smoothed(blocked: Column, labelled: Column, towards: Column) -> Column:
    return (blocked + PRIOR * towards) / (labelled + PRIOR)


def branches(steps: DataFrame) -> DataFrame:
    """(host, node, label, merged) of steps(host, node, parent, segment, n, labelled, blocked): the segment or a wildcard, and the name of the merged branch."""
    counts = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    nodes = shared.staged(steps.groupBy("host", "node", "parent", "segment").agg(*counts), "url-branches")
    around = nodes.groupBy("host", "parent").agg(*[F.sum(c).alias(f"_{c}") for c in ("n", "labelled", "blocked")], F.count("*").alias("_children"))
    at = nodes.join(around, ["host", "parent"])
    n, others = F.col("labelled"), F.col("_labelled") - F.col("labelled")
    pooled = F.try_divide("_blocked", "_labelled")
    spread = pooled * (1 - pooled) * (F.try_divide(F.lit(1), n) + F.try_divide(F.lit(1), others))
    apart = F.abs(F.try_divide(F.col("blocked"), n) - F.try_divide(F.col("_blocked") - F.col("blocked"), others)) >= DIFFERENT * F.sqrt(spread)
    differs = F.coalesce((pooled > 0) & (pooled < 1) & apart, F.lit(False))
    rare = (F.col("_children") > MANY_CHILDREN) & (F.col("n") < RARE * F.col("_n")) & ~differs
    # asin(sqrt(rate)) has a standard error of 0.5/sqrt(n) whatever the rate: siblings in one class of that scale are alike.
    rate = smoothed(F.col("blocked"), n, smoothed(F.col("_blocked"), F.col("_labelled"), F.lit(0.5)))
    width = ALIKE * 0.5 / F.sqrt(F.col("_labelled") / F.col("_children") + PRIOR)
    kind = F.when(n > 0, F.floor(F.asin(F.sqrt(F.least(rate, F.lit(1.0)))) / width))
    at = at.select("host", "node", "parent", "segment", rare.alias("rare"), kind.alias("kind"))
    first = at.filter("not rare and kind is not null").groupBy("host", "parent", "kind").agg(F.min("segment").alias("_first"))
    label = F.when(F.col("rare"), "*").otherwise(F.col("segment"))
    return at.join(first, ["host", "parent", "kind"], "left").select("host", "node", label.alias("label"), F.when(F.col("rare"), "*").otherwise(F.coalesce("_first", "segment")).alias("merged"))


def templates(urls: DataFrame) -> DataFrame:
    """(host, form, template, merged, labelled, blocked) of each distinct form of urls(host, form, n, labelled, blocked)."""
    forms = urls.groupBy("host", "form").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")])
    # Two hashes stand for a form: a path of very many segments is not repeated at each of them.
    key = ["host", "_f1", "_f2"]
    forms = shared.staged(forms.withColumns({"_f1": F.xxhash64(F.lit(1), "form"), "_f2": F.xxhash64(F.lit(2), "form")}), "url-forms")
    steps = forms.select(*key, F.posexplode(_prefixes(F.col("form"))).alias("level", "_branch"), "n", "labelled", "blocked").select(*key, "level", "_branch.*", "n", "labelled", "blocked")
    named = steps.join(branches(steps), ["host", "node"]).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("level", "label", "merged"))).alias("_at"))
    path = lambda name: F.coalesce(F.array_join(F.transform("_at", lambda x: F.concat(F.lit("/"), x[name])), ""), F.lit("")).alias({"label": "template"}.get(name, name))
    return forms.join(named, key, "left").select("host", "form", path("label"), path("merged"), "labelled", "blocked")


def judge_templates(tree: DataFrame) -> DataFrame:
    """(host, merged, purity, known) after smoothing; known is the number of labelled urls."""
    own = tree.groupBy("host", "merged").agg(F.sum("labelled").alias("known"), F.sum("blocked").alias("blocked"))
    hosts = own.groupBy("host").agg(F.sum("known").alias("_known"), F.sum("blocked").alias("_blocked"))
    purity = smoothed(F.col("blocked"), F.col("known"), smoothed(F.col("_blocked"), F.col("_known"), F.lit(0.5)))
    return own.join(hosts, "host").select("host", "merged", purity.alias("purity"), "known")


def filter_urls(pages: DataFrame, rules: list[Rule], id_column: str = "page_id", url_column: str = "url", labels: DataFrame | None = None, reject: float = REJECT) -> DataFrame:
    """One row per page: id, host, path, rule, template, purity, verdict.

    labels(id, blocked) gives labelled pages, blocked being 0 or 1; without it
    the pages that rules decide are the labelled ones.
    """
    host, path = host_and_path(F.col(url_column))
    rows = pages.select(F.col(id_column), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_match", matched_rule(F.col("host"), F.col("path"), rules)).select(id_column, "host", "path", F.col("_match.rule").alias("rule"), F.col("_match.verdict").alias("_verdict"))
    if labels is None:
        known = rows.withColumn("_label", F.when(F.col("_verdict") == "block", 1).when(F.col("_verdict") == "allow", 0))
    else:
        given = labels.groupBy(F.col(id_column)).agg(F.max("blocked").alias("_label"))
        known = rows.join(given, id_column, "left")
    counts = known.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("_label").alias("labelled"), F.coalesce(F.sum("_label"), F.lit(0)).alias("blocked"))
    paths = shared.staged(counts.withColumn("form", form(F.col("path"))), "url-paths")
    tree = shared.staged(templates(paths), "url-templates")
    judged = tree.select("host", "form", "template", "merged").join(judge_templates(tree), ["host", "merged"])
    by_path = paths.select("host", "path", "form").join(judged, ["host", "form"]).select("host", "path", "template", "purity", "known")
    out = rows.join(by_path, ["host", "path"])
    verdict = F.coalesce("_verdict", F.when((F.col("known") > 0) & (F.col("purity") >= reject), "block").otherwise("allow"))
    return out.select(id_column, "host", "path", "rule", "template", "purity", verdict.alias("verdict"))
