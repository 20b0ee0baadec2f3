"""URL filters from a path-template tree, in DataFrame functions only.

The path of a url is a walk down the tree of its host, which is built in rounds, a branching each, until
no path has a further segment: what all paths of a node share next, however long, is one step, as an only child is
always a wildcard and its smoothed share follows in closed form. Variable segments (numbers, hexadecimal strings,
dates) become wildcards; sibling branches, however many, whose share of blocked urls cannot be told
apart from that of the others merge into the wildcard branch. Urls that an explicit rule decides are
the labels. Each node's share of blocked urls is smoothed towards its parent's (the host's towards
the whole table's); the urls that end at a node are a child of their own. A url without a rule is
blocked if the smoothed share where it ends reaches a threshold.

Defined results: a null url, or one without "://", has an empty host and path; such rows form a
host like any other. Repeated urls count as often as they occur. An empty table gives an empty
result. Extra columns are carried through (one named like the result is replaced); what is added lives in one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmill.llm.common import ascii_lower, join_hot, store

#: (rule, verdict): host up to the first slash, then the start of the path.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)


def parts(url: Column) -> Column:
    """Struct of host (A-Z lower-cased) and path."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.struct(F.coalesce(ascii_lower(host), F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null; of equally long ones the first in order of text."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        at, _, start = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + start)
        out = F.when(fits, rule).otherwise(out)
    return out


def lexical(segment: Column) -> Column:
    """A segment with its variable part as a wildcard, by its letters alone; a brace at its beginning is doubled."""
    return (
        F.when(segment.rlike(r"(?s)^[0-9]+$"), "{n}")
        .when(segment.rlike(r"(?s)^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), "{date}")
        .when(segment.rlike(r"(?s)^(?=.*[0-9])[0-9a-fA-F-]{8,}$"), "{hex}")
        .otherwise(F.regexp_replace(F.regexp_replace(segment, r"^\{", "{{"), r"[0-9]+", "{n}"))
    )


def level(nodes: DataFrame, z: float, rows: int) -> DataFrame:
    """Give each (host, parent template, segment) of a level its label in the tree: itself or the wildcard."""
    key = ["host", "t"]
    child = nodes.groupBy(*key, "s").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"), F.count("*").alias("below"))
    total = child.groupBy(*key).agg(F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"), F.count("*").alias("children"))
    both = join_hot(child, total, key, "children", rows)
    rest_n, rest_b = F.col("all_labelled") - F.col("labelled"), F.col("all_blocked") - F.col("blocked")
    p = F.col("all_blocked") / F.col("all_labelled")
    deviation = F.abs(F.try_divide(F.col("blocked"), F.col("labelled")) - F.try_divide(rest_b, rest_n))
    error = F.sqrt(p * (1 - p) * (F.try_divide(F.lit(1.0), F.col("labelled")) + F.try_divide(F.lit(1.0), rest_n)))
    apart = (F.col("labelled") > 0) & (rest_n > 0) & (F.col("all_labelled") > 0) & (deviation > z * error)
    label = F.when(F.col("s") == "", "").when(F.col("s").startswith("{") & ~F.col("s").startswith("{{"), "*").when(F.coalesce(apart, F.lit(False)), F.when(F.col("s") == "*", "%2A").otherwise(F.col("s"))).otherwise("*")
    return both.select(*key, "s", label.alias("label"), "below")


def judge(pages: DataFrame, url: str = "url", rules=RULES, z: float = 3.0, strength: float = 5.0, threshold: float = 0.5, result: str = "filter") -> DataFrame:
    """All rows and columns of pages with a struct `result`: host, path, rule, template, purity, verdict.

    Urls are first folded to distinct (host, generalised path) with counts, so the joins of the
    tree run on that table. The last join brings (host, folded path) verdicts back to the rows. Hosts,
    branches and paths with a thousandth of a table's rows or more, at most a thousand, are joined by broadcast.
    """
    verdict = dict(rules)
    blocked = F.lit(False)
    for rule, what in rules:
        if what == "block":
            blocked = blocked | (F.col("__rule") == rule)
    pages = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c != result])
    segments = F.filter(F.split(F.col("__u.path"), "/"), lambda x: x != "")
    rows = (
        pages.select(*[F.col(f"`{c}`") for c in pages.columns], parts(F.col(f"`{url}`")).alias("__u"))
        .select("*", rule_of(F.col("__u.host"), F.col("__u.path"), rules).alias("__rule"), F.array_join(F.transform(segments, lexical), "/").alias("__f"))
    )
    nodes = rows.groupBy(F.col("__u.host").alias("host"), F.col("__f").alias("f")).agg(
        F.count("*").alias("n"), F.count("__rule").alias("labelled"), F.sum(F.coalesce(blocked, F.lit(False)).cast("long")).alias("blocked")
    )
    nodes = store(nodes, "paths")
    total = nodes.agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.count("*").alias("paths"), F.sum("n").alias("rows")).first()
    count = total["paths"]
    root = ((total["b"] or 0) + 1) / ((total["l"] or 0) + 2)

    steps = F.filter(F.split("f", "/"), lambda x: x != "")

    def smoothed(tree: DataFrame, on: list[str]) -> DataFrame:
        """p, the share of the node above, replaced by that of the node `on`; then the node moved down to where its paths part, or the first one ends."""
        ahead = F.slice(steps, F.col("k") + 1, F.greatest(F.lit(0), F.size(steps) - F.col("k")))
        part = tree.groupBy(*on).agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.count("*").alias("below"), F.min(ahead).alias("lo"), F.max(ahead).alias("hi"))
        same = F.zip_with("lo", "hi", lambda x, y: x.eqNullSafe(y))
        shared = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size("lo").cast("long"))  # what all paths between the least and the greatest share
        found = join_hot(tree, part.select(*on, "l", "b", "below", shared.cast("int").alias("skip")), on, "below", count)
        here = (F.col("b") + strength * F.col("p")) / (F.col("l") + strength)
        own = F.try_divide(F.col("b"), F.col("l"))
        below = F.when((F.col("skip") > 0) & (F.col("l") > 0), own + (here - own) * F.pow(strength / (F.col("l") + strength), F.col("skip"))).otherwise(here)
        return found.withColumn("p", below).withColumn("t", F.concat("t", F.repeat(F.lit("/*"), F.col("skip")))).withColumn("k", F.col("k") + F.col("skip")).drop("l", "b", "skip")

    tree, judged = nodes.withColumn("t", F.lit("")).withColumn("p", F.lit(root)).withColumn("k", F.lit(0)), None
    tree = store(smoothed(tree, ["host"]), "tree")
    while judged is None or not tree.isEmpty():
        tree = tree.withColumn("s", F.coalesce(F.get(steps, F.col("k")), F.lit("")))
        labels = store(level(tree, z, count), "labels")
        tree = store(join_hot(tree, labels, ["host", "t", "s"], "below", count), "labelled")
        tree = tree.withColumn("t", F.when(F.col("label") == "", F.col("t")).otherwise(F.concat("t", F.lit("/"), "label"))).withColumn("k", F.col("k") + 1)
        tree = store(smoothed(tree, ["host", "t"]), "tree")
        ends = tree.where("label = ''").select(F.col("host").alias("__host"), F.col("f").alias("__n"), F.col("t").alias("__t"), F.col("p").alias("__p"), F.col("n").alias("__rows"))
        judged = ends if judged is None else judged.union(ends)
        tree = tree.where("label != ''").drop("s", "label")
    by_rule = F.lit(None).cast("string")
    for rule, what in verdict.items():
        by_rule = F.when(F.col("__rule") == rule, what).otherwise(by_rule)
    found = join_hot(rows.withColumn("__host", F.col("__u.host")), judged.withColumnRenamed("__n", "__f"), ["__host", "__f"], "__rows", total["rows"] or 0)
    return found.select(
        *[F.col(f"`{c}`") for c in pages.columns],
        F.struct(
            F.col("__u.host").alias("host"), F.col("__u.path").alias("path"), F.col("__rule").alias("rule"), F.col("__t").alias("template"), F.col("__p").alias("purity"),
            F.coalesce(by_rule, F.when(F.col("__p") >= threshold, "block").otherwise("allow")).alias("verdict"),
        ).alias(result),
    )
