"""URL filters by a tree of path templates per host.

Rules decide what they fit; their verdicts are the labels of the tree. Level by level, the branches of a node (host and
template so far) are counted, repeated urls as often as they occur. Variable segments (numbers, long hex, one of many rare siblings without
labels) become ``*``; other siblings are merged if they are clearly blocked, clearly allowed or without labels. Unclear ones are merged
only if their shares agree, and stay apart otherwise. A template is rejected if the share of
blocked pages among its labelled ones, smoothed towards a prior, reaches the threshold; without labels it is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmill.llm.common import lower_ascii
from reelmill.session import cut_lineage

# Fixed rules: host and its subdomains, path prefix, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
DEPTH = 6  # deeper segments are one ``**``
FANOUT = 20  # siblings from which a rare one is variable
RARE = 0.05
SMOOTH = 4.0
PRIOR = 0.2
REJECT = 0.6
Z = 1.96


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return lower_ascii(F.coalesce(F.regexp_extract(rest, "^[^/?#]*", 0), F.lit("")))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null; rules of equal length go by order."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, prefix, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _sign(blocked: Column, labelled: Column) -> Column:
    """Whether a share is clearly above or below one half (Wilson interval), or neither."""
    n = F.greatest(labelled, F.lit(1)).cast("double")
    p = blocked / n
    middle = (p + Z * Z / (2 * n)) / (1 + Z * Z / n)
    half = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / (1 + Z * Z / n)
    return F.when(labelled == 0, "?").when(middle - half > 0.5, "+").when(middle + half < 0.5, "-").otherwise("?")


def _weighed(label: Column, times: Column) -> Column:
    return F.coalesce(F.sum(label * times), F.lit(0))


def _branches(level: DataFrame) -> DataFrame:
    """For every branch of a level (host, prefix, segment) the template segment that stands for it.

    Unclear branches are merged if a chi-squared test over all unclear siblings finds no difference of their shares.
    """
    branch = level.groupBy("host", "prefix", "segment").agg(
        F.sum("times").alias("n"), _weighed(F.col("label").isNotNull().cast("int"), F.col("times")).alias("labelled"),
        _weighed(F.col("label"), F.col("times")).alias("blocked"))
    branch = cut_lineage(branch.withColumn("sign", _sign(F.col("blocked"), F.col("labelled"))))
    unclear = (F.col("sign") == "?") & (F.col("labelled") > 0)
    of = lambda value: F.coalesce(F.sum(F.when(unclear, value)), F.lit(0))
    node = branch.groupBy("host", "prefix").agg(
        F.sum("n").alias("total"), F.count("*").alias("siblings"), of(F.lit(1)).alias("_k"), of(F.col("labelled")).alias("_n"),
        of(F.col("blocked")).alias("_b"), of(F.col("blocked") * F.col("blocked") / F.col("labelled")).alias("_s"))
    spread = F.col("_s") - F.col("_b") * F.col("_b") / F.greatest("_n", F.lit(1))
    chance = F.col("_b") / F.greatest("_n", F.lit(1)) * (1 - F.col("_b") / F.greatest("_n", F.lit(1)))
    free = F.greatest(F.col("_k") - 1, F.lit(0))
    node = node.select("host", "prefix", "total", "siblings", (spread <= chance * (free + Z * F.sqrt(2 * free)) + 1e-9).alias("agree"))
    told = branch.join(cut_lineage(node), ["host", "prefix"])
    number = F.col("segment").rlike("^[0-9]+$|^[0-9a-fA-F-]{16,}$")
    rare = (F.col("labelled") == 0) & (F.col("siblings") >= FANOUT) & (F.col("n") < RARE * F.col("total"))
    step = (F.when(number | rare, "*").when(F.col("labelled") == 0, "~").when((F.col("sign") != "?") | F.col("agree"), F.concat(F.lit("~"), "sign"))
            .otherwise(F.concat(F.lit("="), "segment")))
    return cut_lineage(told.select("host", "prefix", "segment", step.alias("step")))


def templates(df: DataFrame, url_col: str = "url", rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """The rows' distinct urls as ``url, host, path, rule, ruled, template, purity`` (smoothed share of blocked labels).

    Urls that occur more often count as often. Null and odd urls have an empty host and path.
    """
    rules = RULES if rules is None else rules
    pages = df.groupBy(F.col(url_col).alias("url")).agg(F.count("*").alias("times"))
    pages = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    pages = pages.withColumn("fit", fitting(F.col("host"), F.col("path"), rules))
    pages = pages.withColumns({"rule": F.col("fit.rule"), "ruled": F.col("fit.verdict")}).drop("fit")
    segments = F.array_remove(F.split("path", "/"), "")
    state = pages.select("url", "times", "host", "path", "rule", "ruled", segments.alias("segments"), F.lit("").alias("prefix"),
                         F.when(F.col("ruled").isNotNull(), (F.col("ruled") == "block").cast("int")).alias("label"))
    state = cut_lineage(state)
    deepest = state.agg(F.max(F.size("segments"))).first()[0] or 0
    for at in range(min(DEPTH, deepest)):
        level = state.withColumn("segment", F.get("segments", F.lit(at)))
        steps = _branches(level.filter("segment IS NOT NULL"))
        state = cut_lineage(
            level.join(steps, ["host", "prefix", "segment"], "left")
            .withColumn("prefix", F.concat("prefix", F.when(F.col("step").isNull(), "").otherwise(F.concat(F.lit("/"), "step"))))
            .drop("segment", "step"))
    state = state.withColumn("template", F.concat("prefix", F.when(F.size("segments") > DEPTH, "/**").otherwise("")))
    leaves = state.groupBy("host", "template").agg(
        F.sum(F.when(F.col("label").isNotNull(), F.col("times")).otherwise(0)).alias("labelled"),
        F.sum(F.coalesce("label", F.lit(0)) * F.col("times")).alias("blocked"))
    purity = (F.col("blocked") + SMOOTH * PRIOR) / (F.col("labelled") + SMOOTH)
    leaves = cut_lineage(leaves.select("host", "template", purity.alias("purity")))
    return state.join(leaves, ["host", "template"]).select("url", "host", "path", "rule", "ruled", "template", "purity")


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` for every row; rules decide before the tree."""
    pages = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    found = templates(pages, "url", rules).withColumnRenamed("url", "_url")
    tree = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return pages.join(found, pages["url"].eqNullSafe(found["_url"])).select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", tree).alias("verdict"), "template", "purity")
