"""URL filters: a path-template tree per host.

Segments that vary by form (numbers, long hexadecimal or mixed identifiers) become wildcards at
once; what is left is a small table of path shapes with counts, on which the tree is built level by
level.  At each level a branch becomes ``*`` where its parent has too many children for their
number of rows.  Labelled siblings merge where their shares of bad labels do not differ: those that do
not differ from all the others become ``*``, and of those that do, neighbours in the order of shares
that do not differ from each other become one branch.  Branches without labels stay as they are.  A
template is rejected when the smoothed share of bad labels passes a limit; how far shares are smoothed
is measured by how much templates differ at all, so labels that tell nothing reject nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

#: Rules of the registered query (fixed values of the contract): verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or a url without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, both null where none fits.  Rules are few and
    become one expression; longest means the length of host plus path, block before allow on a tie."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block", r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def shape(path: Column) -> Column:
    """Segments of a path, those variable by form as ``*`` (a file ending stays).

    A whole table's varying numbers meet in one shape, so what is grouped later is small.
    """
    segments = F.filter(F.split(path, "/", -1), lambda s: s != "")
    return F.transform(
        segments,
        lambda s: F.regexp_replace(F.regexp_replace(F.lower(s), r"^(?=[^.]*[0-9])[0-9a-z_~%-]+(?=\.|$)", "*"), r"^[^.]{33,}(?=\.|$)", "*"),
    )


def _merged_level(shapes: DataFrame, many: int, share: float, z: float) -> DataFrame:
    """Decide the next segment of each (host, parent): keep it or write ``*``."""
    at = F.element_at("rest", 1)
    parent = shapes.withColumn("seg", F.when(F.size("rest") > 0, at).otherwise(F.lit("")))
    child = parent.groupBy("host", "tree", "seg").agg(F.sum("n").alias("cn"), F.sum("bad").alias("cb"), F.sum("seen").alias("cs"))
    whole = child.groupBy("host", "tree").agg(
        F.sum("cn").alias("pn"), F.sum("cb").alias("pb"), F.sum("cs").alias("ps"), F.count("*").alias("kids")
    )
    def apart(s1: Column, b1: Column, s2: Column, b2: Column) -> Column:
        """The two-proportion statistic; null where a side has no labels."""
        pooled = (b1 + b2 + 1) / (s1 + s2 + 2)
        return F.when((s1 > 0) & (s2 > 0), F.abs(b1 / s1 - b2 / s2) / F.sqrt(pooled * (1 - pooled) * (1 / s1 + 1 / s2)))

    # crowded parents have many children with few rows each
    crowded = (F.col("kids") >= many) & (F.col("kids") >= share * F.col("pn"))
    near_all = F.coalesce(apart(F.col("cs"), F.col("cb"), F.col("ps") - F.col("cs"), F.col("pb") - F.col("cb")) < z, F.lit(False))
    told = child.join(whole, ["host", "tree"]).withColumn("star", (F.col("seg") != "") & (crowded | near_all))
    # labelled children that differ from the rest, in the order of their shares
    differs = materialize(told.where("NOT star AND seg <> '' AND cs > 0"), "differs")
    by = W.partitionBy("host", "tree").orderBy(F.col("cb") / F.col("cs"), "seg")
    gap = apart(F.col("cs"), F.col("cb"), F.lag("cs").over(by), F.lag("cb").over(by))
    runs = differs.withColumn("cut", (F.coalesce(gap, F.lit(z)) >= z).cast("int")).withColumn("run", F.sum("cut").over(by))
    names = runs.groupBy("host", "tree", "run").agg(F.min("seg").alias("name"), F.count("*").alias("c"))
    merged = runs.join(names, ["host", "tree", "run"]).select("host", "tree", "seg", F.when(F.col("c") > 1, F.concat("name", F.lit("|*"))).otherwise(F.col("name")).alias("like"))
    decided = told.join(merged, ["host", "tree", "seg"], "left").select("host", "tree", "seg", F.when(F.col("star"), F.lit("*")).otherwise(F.coalesce("like", "seg")).alias("to"))
    ended = F.size("rest") == 0
    return parent.join(decided, ["host", "tree", "seg"]).select(
        "host", "shape", "n", "bad", "seen",
        F.when(ended, F.col("tree")).otherwise(F.concat("tree", F.lit("/"), "to")).alias("tree"),
        F.when(ended, F.col("rest")).otherwise(F.slice("rest", 2, 1 << 20)).alias("rest"),
    )


def path_templates(pages: DataFrame, bad: Column, levels: int | None = None, many: int = 32, share: float = 0.2, z: float = 2.576) -> DataFrame:
    """(host, shape, template, n, seen, bad) of ``pages`` (host, path); ``bad`` is 1, 0 or null.

    The tree is as deep as the longest path; segments beyond ``levels``, if given, stay as their form
    wrote them.
    """
    start = pages.select("host", shape(F.col("path")).alias("shape"), bad.alias("b")).groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("bad"), F.count("b").alias("seen")
    )
    if levels is None:
        start = materialize(start, "shapes")
        levels = start.agg(F.coalesce(F.max(F.size("shape")), F.lit(0))).first()[0]
    shapes = start.withColumn("tree", F.lit("")).withColumn("rest", F.col("shape"))
    for level in range(levels):
        # each level reads the one before three times: a written table keeps the plan in proportion
        shapes = materialize(_merged_level(shapes, many, share, z), f"tree{level}")
    left = F.when(F.size("rest") > 0, F.concat(F.lit("/"), F.array_join("rest", "/"))).otherwise(F.lit(""))
    return shapes.select("host", "shape", "n", "bad", "seen", F.concat("tree", left).alias("template"))


def smoothing(templates: DataFrame, least: float) -> tuple[float, float]:
    """(share of bad labels, rows that it counts as) for templates (tb of ts labels bad).

    The spread of the templates' shares beyond chance (the moment estimate of the correlation of labels
    within a template) gives the weight; it is bounded below by ``least``, and by a million rows above.
    """
    n, b = templates.agg(F.coalesce(F.sum("ts"), F.lit(0)), F.coalesce(F.sum("tb"), F.lit(0))).first()
    base = (b + 1) / (n + 2)
    seen = templates.where("ts > 0").agg(F.count("*"), F.sum(F.col("ts") * F.pow(F.col("tb") / F.col("ts") - F.lit(base), 2)), F.sum(F.col("ts") * F.col("ts"))).first()
    if not n or seen[0] < 2 or n <= seen[0]:
        return base, 1e6
    within = (n * base * (1 - base) - seen[1]) / (n - seen[0])
    between = seen[1] / (seen[0] - 1)
    size = (n - seen[2] / n) / (seen[0] - 1)
    same = (between - within) / max(between + (size - 1) * within, 1e-12)
    return base, min(max(least, (1 - same) / same if same > 1e-6 else 1e6), 1e6)


def url_filter(
    pages: DataFrame, labels: DataFrame, rules=RULES, key: str = "page_id", url: str = "url", limit: float = 0.5, prior: float = 10.0, **tree
) -> DataFrame:
    """key, host, path, rule, verdict, template and bad_share of every page.

    ``labels`` (key, bad 0/1) marks some pages; the share of bad labels of a template is smoothed
    towards the share of all labels.  The weight of that is ``prior`` rows or, where templates differ
    less than that, as many as their differences beyond chance support (none: shares of templates
    are not believed).  Verdict: the longest rule's, else block where the smoothed share passes
    ``limit``, else allow.  Null urls have empty host and
    path and are judged as such; repeated rows are judged each; several labels of a key count as
    bad if any is.  Hosts are grouped with partial sums, and joined on (host, shape), whose table
    has a row per shape, so a host with a third of all pages is no large group.
    """
    host, path = url_parts(F.col(url))
    parts = pages.select(F.col(key).alias("__key"), host.alias("host"), path.alias("path"))
    marks = labels.select(F.col(key).alias("__key"), F.col("bad").cast("int").alias("bad")).where("__key IS NOT NULL AND bad IS NOT NULL").groupBy("__key").agg(F.max("bad").alias("bad"))
    marked = parts.join(marks, "__key", "left")
    known = path_templates(marked, F.col("bad"), **tree)
    template = known.groupBy("host", "template").agg(F.sum("bad").alias("tb"), F.sum("seen").alias("ts"))
    template = materialize(template, "purity")
    base, weight = smoothing(template, prior)
    share = (F.col("tb") + weight * F.lit(base)) / (F.col("ts") + weight)
    purity = template.select("host", "template", share.alias("bad_share"))
    by_shape = known.select("host", "shape", "template").join(purity, ["host", "template"])
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    judged = parts.withColumn("shape", shape(F.col("path"))).join(by_shape, ["host", "shape"], "left")
    return judged.select(
        F.col("__key").alias(key), "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("bad_share") > limit, "block").otherwise("allow")).alias("verdict"),
        "template", "bad_share",
    )
