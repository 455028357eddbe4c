"""URL filters by a path-template tree.

Per host, path segments are generalised twice: by shape (numbers, hexadecimal ids, dates become wildcards) and by
statistics. Siblings whose labelled bad rates differ significantly from their branch stand alone; the others are merged, into
a wildcard where there are many. A template is rejected when its smoothed share of bad labels is high; the prior of each
level is the level above (all urls, host, branch), and that of all is the share of known bad urls among all, so labels of one
side only do not make it. The tree goes down as far as labels of both sides meet. Only counts by distinct
``(host, shaped path)`` go up the tree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: (rule, verdict); the rule's host is what stands before its first slash.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Host words that label a url bad where no rule does.
BAD_HOST_WORDS = ("spam", "casino", "pills", "bets", "porn", "xxx", "viagra", "warez", "ads", "track")
MAX_CHILDREN = 16
PRIOR_WEIGHT = 1.0
REJECT_SHARE = 0.5
MERGE_Z = 1.96


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; empty for NULL or no ``://``."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_fits(rule: str, host: Column, path: Column) -> Column:
    rule_host, slash, rest = rule.partition("/")
    return ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(slash + rest))


def matched_rule(rules, host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, NULL where none fits."""
    ranked = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    pick = lambda k: F.coalesce(F.lit(None).cast("string"), *[F.when(rule_fits(r[0], host, path), F.lit(r[k])) for r in ranked])
    return pick(0), pick(1)


def shaped_segments(path: Column) -> Column:
    """Path segments with variable shapes replaced: ``<num>``, ``<hex>``, ``<date>``."""
    shaped = reduce(
        lambda c, r: F.regexp_replace(c, *r),
        ((r"(?<![^/])\d{4}-\d\d-\d\d(?=[./]|$)", "<date>"), (r"(?<![^/])\d+(?=[./]|$)", "<num>"), (r"(?<![^/])(?=[0-9a-f-]*\d)[0-9a-f-]{8,}(?=[./]|$)", "<hex>")),
        path,
    )
    return F.filter(F.split(shaped, "/"), lambda x: x != "")


def template_tree(urls: DataFrame) -> DataFrame:
    """``(host, shape, n, labelled, bad)`` -> ``(host, shape, template, share)`` where share is the smoothed bad share.

    ``~`` stands for merged children, ``*`` for many of them, ``...`` for what follows a branch without labels of both sides.
    """
    total = urls.agg((F.sum("bad") / F.greatest(F.sum("n"), F.lit(1))).alias("p"))
    hosts = urls.groupBy("host").agg(F.sum("bad").alias("hb"), F.sum("labelled").alias("hl"))
    hosts = hosts.crossJoin(F.broadcast(total)).select(  # one row of one number
        "host", ((F.col("hb") + PRIOR_WEIGHT * F.coalesce("p", F.lit(0.0))) / (F.col("hl") + PRIOR_WEIGHT)).alias("share"), ((F.col("hb") > 0) & (F.col("hb") < F.col("hl"))).alias("open")
    )
    level = cut(urls.join(hosts, "host").select("*", F.lit("").alias("template"), F.split("shape", "/").alias("parts")))
    depth, done = 0, []
    names = ["host", "shape", "template", "share"]
    while True:
        more = F.coalesce(F.get("parts", F.lit(depth)), F.lit("")) != ""
        done.append(level.where(~(F.col("open") & more)).select("host", "shape", F.when(more, F.concat("template", F.lit("/..."))).otherwise(F.col("template")).alias("template"), "share"))
        here = level.where(F.col("open") & more).withColumn("child", F.get("parts", F.lit(depth)))
        if not here.limit(1).count():
            break
        branches = here.groupBy("host", "template", "child").agg(F.sum("bad").alias("b"), F.sum("labelled").alias("l"))
        parents = branches.groupBy("host", "template").agg(F.count("*").alias("children"), F.sum("b").alias("pb"), F.sum("l").alias("pl"))
        pooled = F.try_divide("pb", "pl")
        z = F.try_divide(F.abs(F.try_divide("b", "l") - pooled), F.sqrt(F.try_divide(F.greatest(pooled * (1 - pooled), F.lit(0.01)), F.col("l"))))
        alone = F.coalesce(z > MERGE_Z, F.lit(False))
        step = F.when(alone, F.concat(F.lit("/"), "child")).when(F.col("children") > MAX_CHILDREN, F.lit("/*")).otherwise(F.lit("/~"))
        placed = branches.join(parents, ["host", "template"]).select("host", "template", "child", "b", "l", F.concat("template", step).alias("next"))
        nodes = placed.groupBy("host", "next").agg(F.sum("b").alias("b"), F.sum("l").alias("l"))
        placed = placed.drop("b", "l").join(nodes, ["host", "next"])
        level = here.join(placed, ["host", "template", "child"]).withColumn("share", (F.col("b") + PRIOR_WEIGHT * F.col("share")) / (F.col("l") + PRIOR_WEIGHT))
        level = cut(level.withColumn("open", (F.col("b") > 0) & (F.col("b") < F.col("l"))).withColumn("template", F.col("next")).drop("b", "l", "next", "child"))
        depth += 1
    return reduce(DataFrame.unionByName, [d.select(*names) for d in done])


def judge_urls(pages: DataFrame, rules=RULES, url_col: str = "url", id_col: str = "page_id", labels: DataFrame | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict, template, bad_share)`` per row of pages.

    The longest fitting rule decides; other urls are judged by their template. Labelled urls are those that a rule judges,
    those whose host holds a word of BAD_HOST_WORDS, and rows of ``labels`` (page_id, bad). NULL urls and urls without
    ``://`` have empty host and path and are judged by the template of that empty host. Repeated rows stay; a rule with the
    same length as another wins by its text; a share of exactly REJECT_SHARE is allowed; very long urls cost a level of the tree
    only where labels of both sides meet in them; an empty table gives no rows; other columns are ignored.
    """
    url = F.col(url_col).cast("string")
    host, path = F.col("host"), F.col("path")
    rule, verdict = matched_rule(rules, host, path)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"))
    words = F.split(host, r"[^a-z0-9]+")
    seeded = F.arrays_overlap(words, F.array(*map(F.lit, BAD_HOST_WORDS)))
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"), F.array_join(shaped_segments(path), "/").alias("shape"))
    label = F.when(F.col("ruled").isNotNull(), (F.col("ruled") == "block").cast("int")).when(seeded, 1)
    if labels is not None:
        given = labels.groupBy("page_id").agg(F.max("bad").alias("given"))
        rows, label = rows.join(given, "page_id", "left"), F.coalesce(label, F.col("given").cast("int"))
    urls = rows.select("host", "shape", label.alias("label")).groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad")
    )
    tree = template_tree(cut(urls))
    method = F.when(F.col("share") > REJECT_SHARE, "block").otherwise("allow")
    return rows.join(tree, ["host", "shape"]).select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "template", F.col("share").alias("bad_share")
    )
