"""URL filter by a path-template tree, in DataFrame operations alone.

Under each host, paths are split into segments. Segments that look variable
(numbers, long hexadecimal strings, dates) become wildcards at once, which
also pre-aggregates a host of any size to its shapes. Then branches that
are alike are merged, below each parent: labelled siblings whose shares of bad
URLs don't differ by more than chance, shown as ?; siblings without labels
that have the same shapes below them, or are too many rare values of one
segment, shown as #. A shape so changed is a template.

Labelled purity is smoothed from far to near, each step with the weight of
`smoothing` units of its own evidence. It begins at the prior and at what the
host's other branches say, each once. Like shapes of other hosts come next: in
every domain above the host, from all hosts down to its own (up to
`DOMAINS` labels), the longest beginning of the path that is labelled below
another child of the domain, each child counting once however many rows or hosts
it has; so a host speaks to another in the nearest domain of both, and within
domains of `KIN` labels the far evidence weighs only `kin_smoothing`. Last come
the template's own labelled rows or, where it has none, those of the nearest
branch above it on its host. So a page of a host that has no labels is rejected
where several other hosts of its domain are bad at the like path, and
neither one large branch nor one other domain rejects what it doesn't contain.
A template is rejected when its purity reaches the threshold. URLs that rules
decide are the labelled ones.

The tree is never walked: a segment is a row with the hash of the path up to it,
a running bit_xor of (level, segment) hashes, so work is linear in segments
however deep a path is, and no level waits for another.

A null URL and one without "://" have an empty host and path; they make one
template of their own. Repeated URLs count each. Without labels nothing is
rejected. An empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.llm.common import join_spread, stage

#: Merged branches, with labels and without; no segment holds one, so they stay apart from wildcards and from each other.
MERGED, UNKNOWN = "?", "#"
#: Domains above a host that speak for it: none, and those of up to so many labels.
DOMAINS = 4
#: From so many labels on, a domain's children are of one owner and say more of each other.
KIN = 2


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return f"{self.host}{self.path}"


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def url_shape(path: Column) -> Column:
    """The segments of a path; runs of digits, long hexadecimal strings and the like give way to a wildcard, endings stay."""
    s = F.regexp_replace(F.regexp_replace(path, "^/", ""), r"(?i)\b[0-9a-f]{8,}(-[0-9a-f]{4,})*\b", "*")
    return F.split(F.regexp_replace(s, r"[0-9]+", "*"), "/")


def _shares(bad: str, labelled: str) -> Column:
    return F.coalesce(F.try_divide(F.col(bad).cast("double"), F.col(labelled)), F.lit(0.0))


def domains(host: Column) -> Column:
    """The domains that hold a host, each with its child on the way to the host (which is marked, as it may be a domain, too)."""
    labels = F.regexp_count(host, F.lit(r"\.")) + 1

    def last(k: int) -> Column:
        return F.substring_index(host, ".", -k) if k else F.lit("")

    itself = F.concat(F.lit("="), host)
    each = [F.struct(F.lit(k).alias("kind"), last(k).alias("domain"), F.when((labels == k + 1) | F.lit(k == DOMAINS), itself).otherwise(last(k + 1)).alias("child")) for k in range(DOMAINS + 1)]
    return F.slice(F.array(*each), F.lit(1), F.least(labels, F.lit(DOMAINS + 1)))


def merged_segments(edges: DataFrame, most_values: int, least_support: float, chance_z: float) -> DataFrame:
    """Every segment with what it becomes (`to`), below each parent."""
    branch = ["host", "parent", "level"]
    values = edges.groupBy(*branch, "seg").agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"), F.count("*").alias("shapes")
    )
    # branches without labels are alike if what lies below them has the same shapes
    tails = edges.select(*branch, "seg", "tail").distinct().groupBy(*branch, "seg").agg(F.bit_xor(F.xxhash64("tail")).alias("tails"), F.count("*").alias("n_tails"))
    values = stage(values.join(tails, [*branch, "seg"]), "url-values")
    unknown, known = values.where("labelled = 0"), values.where("labelled > 0")
    below = [*branch, "tails", "n_tails"]
    unknown = join_spread(unknown, unknown.groupBy(*below).agg(F.count("*").alias("same")), below, "same")
    values = unknown.select(*branch, "seg", "n", "bad", "labelled", "shapes", "same").unionByName(known.drop("tails", "n_tails").withColumn("same", F.lit(1).cast("long")))
    above = values.groupBy(*branch).agg(
        F.count("*").alias("values"), F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad"), F.sum("labelled").alias("all_labelled"),
        F.count_if(F.col("labelled") > 0).alias("labelled_values"),
    )
    values = join_spread(values, above, branch, "values")
    # a branch is like its siblings if its share is within chance of theirs
    p = _shares("all_bad", "all_labelled")
    error = F.sqrt(F.greatest(p * (1 - p), F.lit(0.01)) / F.greatest(F.col("labelled"), F.lit(1.0)))
    alike = F.abs(_shares("bad", "labelled") - p) <= chance_z * error
    # too many rare values are a variable
    variable = (F.col("values") > most_values) & (F.col("all_n") < least_support * F.col("values"))
    labelled = F.col("labelled") > 0
    to = F.when(labelled & (F.col("labelled_values") > 1) & alike, MERGED).when(~labelled & (variable | (F.col("same") > 1)), UNKNOWN).otherwise(F.col("seg"))
    return join_spread(edges, stage(values.select(*branch, "seg", "shapes", to.alias("to")), "url-merges"), [*branch, "seg"], "shapes")


def domain_evidence(edges: DataFrame) -> DataFrame:
    """(host, key, d0 to d4): what each domain above a host says of a shape, (level, shares, children).

    Of each domain, the longest beginning of the path that is labelled in a child
    other than the host's own, and the mean shares of bad URLs of those children.
    """
    hosts = edges.where("labelled > 0").groupBy("host", "prefix").agg((F.sum("bad") / F.sum("labelled")).alias("share"))
    children = hosts.select("prefix", "share", F.inline(domains(F.col("host")))).groupBy("domain", "child", "prefix").agg(F.avg("share").alias("share"))
    children = stage(children, "url-children")
    asked = stage(edges.select("host", "key", "level", "prefix", F.inline(domains(F.col("host")))), "url-asked")
    asking = asked.groupBy("domain", "child", "prefix").agg(F.count("*").alias("asked"))
    totals = children.groupBy("domain", "prefix").agg(F.sum("share").alias("shares"), F.count("*").alias("children"))
    totals = stage(totals.join(asking.groupBy("domain", "prefix").agg(F.count("*").alias("asking")), ["domain", "prefix"]), "url-domains")
    heard = join_spread(asking, totals, ["domain", "prefix"], "asking").join(children, ["domain", "child", "prefix"], "left")
    own = F.col("share").isNotNull().cast("int")
    heard = heard.select("domain", "child", "prefix", "asked", (F.col("shares") - F.coalesce("share", F.lit(0.0))).alias("shares"), (F.col("children") - own).alias("children"))
    told = join_spread(asked, stage(heard.where("children > 0"), "url-evidence"), ["domain", "child", "prefix"], "asked")
    return told.groupBy("host", "key").agg(
        *(F.max(F.when(F.col("kind") == k, F.struct("level", "shares", "children"))).alias(f"d{k}") for k in range(DOMAINS + 1))
    )


def template_verdicts(
    urls: DataFrame, most_values: int = 64, least_support: float = 3.0, chance_z: float = 1.96, smoothing: float = 4.0,
    kin_smoothing: float = 2.0, prior: float = 0.1, threshold: float = 0.5,
) -> DataFrame:
    """(host, shape_key, n, template, purity, verdict) for every shape of the (host, shape, bad) rows.

    `bad` is 1, 0, or null where there is no label; shape_key is the hash of the shape.
    """
    shapes = urls.groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.sum("bad").cast("double").alias("bad"), F.count("bad").cast("double").alias("labelled")
    ).na.fill(0.0, ["bad"])
    whole = Window.partitionBy("host", "key")
    along = whole.orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = (
        shapes.withColumn("key", F.xxhash64("shape"))
        .select("host", "key", "n", "bad", "labelled", F.posexplode("shape").alias("level", "seg"))
        .withColumn("step", F.xxhash64("level", "seg"))
        .withColumn("prefix", F.bit_xor("step").over(along))
        .withColumn("tail", F.bit_xor("step").over(whole).bitwiseXOR(F.col("prefix")))
        .withColumn("parent", F.col("prefix").bitwiseXOR(F.col("step")))
        .drop("step")
    )
    edges = merged_segments(stage(edges, "url-segments"), most_values, least_support, chance_z)
    edges = (
        edges.select("host", "key", "level", "seg", "to", "prefix", "n", "bad", "labelled")
        .withColumn("branch", F.bit_xor(F.xxhash64("level", "to")).over(along))
        .withColumn("end", F.max("level").over(whole))
        .withColumn("template_key", F.bit_xor(F.xxhash64("level", "to")).over(whole))
    )
    edges = stage(edges, "url-segments")
    # the host speaks through its other branches, each once however many rows it has; merged ones count as the branches they were
    tops = edges.where("level = 0 and labelled > 0").groupBy("host", F.col("to").alias("top"), "seg").agg((F.sum("bad") / F.sum("labelled")).alias("share"))
    tops = tops.groupBy("host", "top").agg(F.sum("share").alias("shares"), F.count("*").alias("children"))
    hosts = tops.groupBy("host").agg(F.sum("shares").alias("all_shares"), F.sum("children").alias("all_children"))
    told = domain_evidence(edges)
    # the nearest branch of the host speaks for a template without labels
    branches = edges.where("labelled > 0").groupBy("host", "branch").agg(F.sum("bad").alias("b_bad"), F.sum("labelled").alias("b_labelled"))
    of_host = edges.groupBy("host", "template_key", "level", "branch").agg(F.max("labelled").alias("labelled"))
    branches = branches.join(of_host.groupBy("host", "branch").agg(F.count("*").alias("templates")), ["host", "branch"])
    nearest = join_spread(of_host, stage(branches, "url-branches"), ["host", "branch"], "templates")
    nearest = nearest.groupBy("host", "template_key").agg(F.max(F.struct("level", "b_bad", "b_labelled")).alias("b"))

    others, n = (F.coalesce(f"all_{c}", F.lit(0.0)) - F.coalesce(c, F.lit(0.0)) for c in ("shares", "children"))
    purity = (others + smoothing * prior) / (n + smoothing)
    for k in range(DOMAINS + 1):
        weight = kin_smoothing if k >= KIN else smoothing
        purity = (F.coalesce(f"d{k}.shares", F.lit(0.0)) + weight * purity) / (F.coalesce(f"d{k}.children", F.lit(0)) + weight)
    names = edges.groupBy("host", "key").agg(
        F.first("template_key").alias("template_key"), F.first("n").alias("n"), F.first("bad").alias("bad"), F.first("labelled").alias("labelled"),
        F.max(F.when(F.col("level") == 0, F.col("to"))).alias("top"),
        F.concat(F.lit("/"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", "to"))), lambda x: x["to"]), "/")).alias("template"),
    )
    each = stage(names.join(tops, ["host", "top"], "left").join(hosts, "host", "left").join(told, ["host", "key"], "left").select(*names.columns, purity.alias("base")), "url-templates")
    own = each.groupBy("host", "template_key").agg(F.sum("bad").alias("t_bad"), F.sum("labelled").alias("t_labelled"), F.count("*").alias("of_template"))
    own = stage(own.join(nearest, ["host", "template_key"], "left"), "url-purities")
    bad, labelled = (F.when(F.col("t_labelled") > 0, F.col(f"t_{c}")).otherwise(F.coalesce(f"b.b_{c}", F.lit(0.0))) for c in ("bad", "labelled"))
    return (
        join_spread(each, own, ["host", "template_key"], "of_template")
        .select("host", F.col("key").alias("shape_key"), "n", "template", ((bad + smoothing * F.col("base")) / (labelled + smoothing)).alias("purity"))
        .withColumn("verdict", F.when(F.col("purity") >= threshold, "block").otherwise("allow"))
    )


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", **parameters: float) -> DataFrame:
    """(id, host, path, rule, verdict, template, purity) of every row."""
    host, path = url_host(F.col(url_col)), url_path(F.col(url_col))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    urls = (
        pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
        .withColumn("rule", rule)
        .withColumn("rule_verdict", verdict)
        .withColumn("shape", url_shape(F.col("path")))
    )
    bad = F.when(F.col("rule_verdict") == "block", 1).when(F.col("rule_verdict") == "allow", 0)
    judged = stage(template_verdicts(urls.select("host", "shape", bad.alias("bad")), **parameters), "url-verdicts")
    keyed = urls.withColumn("shape_key", F.xxhash64("shape")).drop("shape")
    return join_spread(keyed, judged, ["host", "shape_key"], "n").select(
        id_col, "host", "path", "rule", F.coalesce("rule_verdict", "verdict").alias("verdict"), "template", "purity"
    )
