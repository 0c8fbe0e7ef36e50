"""URL filters by rules and by a path-template tree for each host, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightsieve.llm.common import staged

ANY = "*"


def host_of(url: Column) -> Column:
    """After the first `://` up to / ? # or the end, A-Z lowered; else empty."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), upper, upper.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_verdict(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """A struct (rule, verdict) of the longest rule (host, path start, verdict) that fits the host or a parent of it; else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def templates(
    pages: DataFrame, kinds: int = 20, spread: float = 0.5, distance: float = 0.25, least: int = 5,
) -> DataFrame:
    """(host, parts, template, known, bad) of rows (host, path, bad): the branch of its host's tree that each path is on.

    `bad` is 0, 1 or null where there is no label; `known` and `bad` of the result count the labelled and the bad rows of a path.
    A path has as many levels as segments.  From the root down, a segment becomes the wildcard `*` where it holds a digit, or
    where a parent has at least `kinds` different segments and these are `spread` of its pages or more.  Then siblings are merged
    into one wildcard, each level by itself, where `_alike` finds evidence for it.  Counts are grouped sums; no tree meets one task.
    """
    paths = pages.select("host", segments(F.col("path")).alias("parts"), "bad")
    counts = F.count(F.lit(1)).alias("n"), F.count("bad").alias("known"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad")
    rows = paths.groupBy("host", "parts").agg(*counts).withColumn("t", F.array().cast("array<string>"))
    rows = staged(rows, "paths")
    done = rows.where(F.size("parts") == 0)
    rows = rows.where(F.size("parts") > 0)
    level = 0
    while not rows.isEmpty():
        own = _general(F.get("parts", F.lit(level)))
        seen = rows.groupBy("host", "t", own.alias("own")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("paths"))
        busy = seen.groupBy("host", "t").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n"), F.sum("paths").alias("paths"))
        # a path without others below its parent branches no more: the rest of it is named at once
        alone = F.when(F.lit(kinds > 1), F.col("paths") == 1).otherwise(F.lit(False))
        varies = (F.col("kinds") >= kinds) & (F.col("kinds") >= F.col("n") * spread)
        marks = busy.select(F.col("host").alias("b_host"), F.col("t").alias("b_t"), varies.alias("varies"), alone.alias("alone"))
        marks = marks.where("varies or alone")
        joined = rows.join(marks, (F.col("host") == F.col("b_host")) & (F.col("t") == F.col("b_t")), "left")
        rest = F.transform(F.slice("parts", level + 1, 1 << 20), _general)
        step = F.when(F.col("alone"), rest).otherwise(F.array(F.when(F.col("varies"), ANY).otherwise(own)))
        made = staged(joined.select("host", "parts", "n", "known", "bad", F.concat("t", step).alias("t")), "level")
        done = done.unionByName(made.where(F.size("t") == F.size("parts")))
        rows = made.where(F.size("t") < F.size("parts"))
        level += 1
    tree = staged(done.groupBy("host", "t").agg(F.sum("n").alias("n"), F.sum("known").alias("known"), F.sum("bad").alias("bad")), "tree")
    nodes = tree.select("host", "t", "n", "known", "bad", F.posexplode("t").alias("i", "name"))
    nodes = nodes.select("*", F.expr("slice(t, 1, i)").alias("above"), F.get("t", F.col("i") + 1).alias("below"))
    alike = staged(_alike(nodes, distance, least), "alike").select(
        F.col("host").alias("m_host"), F.col("above").alias("m_above"), F.col("name").alias("m_name"))
    same = (F.col("host") == F.col("m_host")) & (F.col("above") == F.col("m_above")) & (F.col("name") == F.col("m_name"))
    level_name = F.when(F.col("m_host").isNotNull(), ANY).otherwise(F.col("name"))
    named = nodes.join(alike, same, "left").groupBy("host", "t").agg(
        F.sort_array(F.collect_list(F.struct("i", level_name.alias("name")))).alias("x"))
    named = named.select(F.col("host").alias("x_host"), F.col("t").alias("x_t"), F.array_join("x.name", "/").alias("x"))
    placed = done.join(named, (F.col("host") == F.col("x_host")) & (F.col("t") == F.col("x_t")), "left")
    return placed.select("host", "parts", F.concat(F.lit("/"), F.coalesce("x", F.lit(""))).alias("template"), "known", "bad")


def _general(segment: Column) -> Column:
    return F.when(segment.rlike("[0-9]"), ANY).otherwise(segment)


def _differ(branches: DataFrame, key: list[str]) -> DataFrame:
    """(h_host, h_above, members, share, differ): whether the bad shares of each parent's branches differ (chi-square, 5 %)."""
    square = F.col("bad") * F.col("bad") / F.nullif(F.col("known"), F.lit(0))
    sums = branches.groupBy(*key).agg(
        F.count(F.lit(1)).alias("members"), (F.count_if(F.col("known") > 0) - 1).alias("df"), F.sum("known").alias("known"),
        F.sum("bad").alias("bad"), F.sum(square).alias("square"))
    share = F.col("bad") / F.nullif(F.col("known"), F.lit(0))
    chi = (F.col("square") - share * F.col("bad")) / F.nullif(share * (F.lit(1.0) - share), F.lit(0.0))
    width = F.lit(2.0 / 9.0) / F.nullif(F.col("df"), F.lit(0))
    bound = F.col("df") * F.pow(F.lit(1.0) - width + F.lit(1.645) * F.sqrt(width), F.lit(3.0))
    differ = F.coalesce((F.col("df") > 0) & (chi > bound), F.lit(False))
    return sums.select(*[F.col(c).alias("h_" + c) for c in key], "members", share.alias("share"), differ.alias("differ"))


def _alike(nodes: DataFrame, distance: float, least: int) -> DataFrame:
    """(host, above, name): the branches to merge, of rows (host, above, name, below, n, known, bad).

    Ends of paths and wildcards below a branch say nothing about it.  A branch fits its siblings when named segments are below
    `least` of its pages and half of them, and its shares of what is below differ from those of its siblings by at most `distance`
    (total variation).  Where the bad shares of those that fit differ, only the side (above or up to their common share) with more
    pages is left, and branches without labels are not.  What is left is merged when it is two branches or more, their bad shares
    do not differ, and a wildcard beside them is one of them.  So branches without children and only branches stay.
    """
    key = ["host", "above"]
    of = {tag: (F.col("host") == F.col(tag + "_host")) & (F.col("above") == F.col(tag + "_above")) for tag in "rpqhvsw"}
    counts = [F.sum(c).alias(c) for c in ("n", "known", "bad")]
    each = nodes.groupBy(*key, "name", "below").agg(*counts)
    told = F.sum(F.when(F.col("below") != ANY, F.col("n")).otherwise(F.lit(0))).alias("told")
    branch = each.groupBy(*key, "name").agg(*counts, told)
    total = branch.groupBy(*key).agg(F.sum("n").alias("all")).withColumnsRenamed({c: "r_" + c for c in key})
    pool = each.groupBy(*key, "below").agg(F.sum("n").alias("pool")).withColumnsRenamed({c: "q_" + c for c in (*key, "below")})
    fits = branch.where((F.col("told") >= least) & (F.col("told") * 2 >= F.col("n"))).join(total, of["r"]).where(F.col("all") > F.col("n"))
    fits = fits.select(*[F.col(c).alias("p_" + c) for c in (*key, "name")], F.col("n").alias("own"), F.col("known").alias("own_known"),
                       F.col("bad").alias("own_bad"), "all")
    # half the sum of |own share - share of the others|, as the sum of what the own share exceeds the other one by
    mixed = each.join(fits, of["p"] & (F.col("name") == F.col("p_name")))
    mixed = mixed.join(pool, of["q"] & F.col("below").eqNullSafe(F.col("q_below")))
    over = F.greatest(F.col("n") / F.col("own") - (F.col("pool") - F.col("n")) / (F.col("all") - F.col("own")), F.lit(0.0))
    near = mixed.groupBy(*key, "name").agg(
        F.sum(over).alias("far"), F.max("own").alias("n"), F.max("own_known").alias("known"), F.max("own_bad").alias("bad"))
    near = staged(near.where(F.round("far", 9) <= distance).drop("far"), "near")
    side = F.when(F.col("differ"), F.col("bad") / F.nullif(F.col("known"), F.lit(0)) > F.col("share")).otherwise(F.lit(False))
    sided = near.join(_differ(near, key), of["h"]).select(*near.columns, side.alias("side")).where("side is not null")
    larger = sided.groupBy(*key, "side").agg(F.sum("n").alias("pages")).groupBy(*key).agg(F.max_by("side", F.struct("pages", "side")).alias("v_side"))
    larger = larger.withColumnsRenamed({c: "v_" + c for c in key})
    left = staged(sided.join(larger, of["v"] & (F.col("side") == F.col("v_side"))).select(*near.columns), "left")
    wild = nodes.where(F.col("name") == ANY).select(*key).distinct()
    bare = wild.join(left.where(F.col("name") == ANY).select(*key), key, "left_anti").withColumnsRenamed({c: "w_" + c for c in key})
    sets = _differ(left, key).where((F.col("members") > 1) & ~F.col("differ")).withColumnsRenamed({"h_" + c: "s_" + c for c in key})
    return left.join(sets, of["s"]).join(bare, of["w"], "left_anti").select(*key, "name")


def judge(
    pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], limit: float = 0.5, weight: float = 8.0,
) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row (page_id, url).

    The rule decides where one fits.  Else the row's template does: its labelled pages (page_id, bad 0/1) give a share of bad ones,
    pulled to the share of all labelled pages with the weight of `weight` pages; above `limit` the template is rejected and
    its pages are blocked.  A host or template without labels has the overall share; without any labels nothing is blocked.
    Null urls and urls without `://` have empty host and path.  Repeated page_ids are judged each by its own url; labels with
    a null mark are left out, of several the worst counts; extra columns are not read.
    """
    rows = pages.select("page_id", F.col("url")).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rows = rows.withColumn("hit", rule_verdict(F.col("host"), F.col("path"), rules)).drop("url")
    marks = labels.where("bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad")).withColumnRenamed("page_id", "labelled")
    keyed = rows.select("page_id", "host", "path").distinct().join(marks, F.col("page_id") == F.col("labelled"), "left")
    placed = staged(templates(keyed.select("host", "path", "bad")), "placed")
    known = placed.groupBy("host", "template").agg(F.sum("known").alias("known"), F.sum("bad").alias("bad"))
    known = staged(known.where("known > 0"), "purity")
    whole = known.agg(F.sum("bad").alias("bad"), F.sum("known").alias("known")).first()
    share = float(whole["bad"]) / whole["known"] if whole["known"] else 0.0
    bad = known.where((F.col("bad") + weight * share) / (F.col("known") + weight) > limit).select(
        F.col("host").alias("b_host"), F.col("template").alias("b_template"))
    blocked = placed.join(bad, (F.col("host") == F.col("b_host")) & (F.col("template") == F.col("b_template")))
    blocked = blocked.select(F.col("host").alias("k_host"), F.col("parts").alias("k_parts"))
    out = rows.join(blocked, (segments(F.col("path")) == F.col("k_parts")) & (F.col("host") == F.col("k_host")), "left")
    verdict = F.coalesce("hit.verdict", F.when(F.col("k_host").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"))
