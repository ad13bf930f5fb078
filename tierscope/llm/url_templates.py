"""URL filtering by path templates learned for each host.

The paths of a host form a tree of segments. Level by level, segments that vary (numbers,
identifiers) become wildcards, and sibling branches that do not differ in their labels or
in how often paths end there are merged. A path's template is
then judged by the smoothed share of unwanted labels among the urls that fit it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import skew_join, written

#: (host, path, verdict): a rule fits its host and all subdomains, below its path.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WILD = "*"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased) and path (to ``?``, ``#`` or the end)."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def matching_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits (host and path end to end) and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    # A later CASE arm is tried first here, so the longest rules come last.
    for own, prefix, said in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(prefix))
        rule, verdict = F.when(fits, F.lit(own + prefix)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _z(ones: Column, n: Column, all_ones: Column, all_n: Column) -> Column:
    """How far a branch's share lies from that of its siblings, in standard errors of a two-proportion test."""
    rest_n, rest, over = all_n - n, all_ones - ones, F.try_divide
    pooled = over(all_ones, all_n)
    error = F.sqrt(pooled * (1 - pooled) * (over(F.lit(1.0), n) + over(F.lit(1.0), rest_n)))
    return F.coalesce(over(over(ones, n) - over(rest, rest_n), error), F.lit(0.0))


def _shape_varies(segment: Column) -> Column:
    """Numbers and identifiers: a segment with a digit, or a long one."""
    return segment.rlike(r"[0-9]") | (F.length(segment) > 40)


def path_templates(urls: DataFrame, significance: float = 2.0) -> DataFrame:
    """``urls`` (host, path, n, n_labelled, n_bad) with ``template``.

    The tree is walked from the hosts down to its real depth. A branch keeps its name when
    its labels differ from its siblings' significantly, whatever its shape and however many
    siblings it has; one whose shape does not vary also when its share of paths that end
    there differs, or when it has no sibling. All others of a node are one wildcard. Below a
    node that a single url reaches nothing is left to compare, so its path ends the walk.
    """
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    now = urls.withColumn("parts", parts).withColumn("template", F.col("host"))
    out, level = [], 0
    while True:
        rest = F.slice("parts", level + 1, F.greatest(F.size("parts") - level, F.lit(0)))
        nodes = now.filter(F.size("parts") > level).groupBy("template").agg(F.count(F.lit(1)).alias("urls"))
        here = skew_join(now.filter(F.size("parts") > level), nodes, ["template"], "urls")
        alone = F.concat_ws("/", F.col("template"), F.array_join(F.transform(rest, lambda s: F.when(_shape_varies(s), F.lit(WILD)).otherwise(s)), "/"))
        out += [now.filter(F.size("parts") <= level).drop("parts"), here.filter("urls = 1").withColumn("template", alone).drop("parts", "urls")]
        here = here.filter("urls > 1").drop("urls").withColumn("segment", F.get("parts", F.lit(level))).withColumn("ends", F.when(F.size("parts") == level + 1, F.col("n")).otherwise(F.lit(0)))
        sums = [F.sum(c).alias(c) for c in ("n", "n_labelled", "n_bad", "ends")]
        branch = here.groupBy("template", "segment").agg(F.count(F.lit(1)).alias("urls"), *sums)
        node = branch.groupBy("template").agg(F.count(F.lit(1)).alias("branches"), *[F.sum(c).alias(f"all_{c}") for c in ("n", "n_labelled", "n_bad", "ends")])
        labels_apart = F.abs(_z(F.col("n_bad"), F.col("n_labelled"), F.col("all_n_bad"), F.col("all_n_labelled"))) > significance
        ends_apart = F.abs(_z(F.col("ends"), F.col("n"), F.col("all_ends"), F.col("all_n"))) > significance
        keeps = labels_apart | (~_shape_varies(F.col("segment")) & (ends_apart | (F.col("branches") == 1)))
        named = skew_join(branch, node, ["template"], "branches").select("template", "segment", "urls", F.when(keeps, F.col("segment")).otherwise(F.lit(WILD)).alias("step"))
        nxt = skew_join(here, named, ["template", "segment"], "urls").withColumn("template", F.concat_ws("/", "template", "step")).drop("segment", "ends", "step", "urls")
        nxt = written(nxt.select(*now.columns), "templates")
        if nxt.isEmpty():
            break
        now, level = nxt, level + 1
    done = out[0]
    for more in out[1:]:
        done = done.unionByName(more)
    return done


def template_purity(urls: DataFrame, strength: float = 4.0) -> DataFrame:
    """(template, purity): share of unwanted labels, smoothed towards that of the same template on all hosts, itself smoothed towards the overall share."""
    shape = F.regexp_replace("template", r"^[^/]*", "")
    sums = [F.sum("n_labelled").alias("n"), F.sum("n_bad").alias("bad")]
    own = urls.withColumn("shape", shape).groupBy("template", "shape").agg(*sums)
    across = own.groupBy("shape").agg(F.sum("n").alias("shape_n"), F.sum("bad").alias("shape_bad"))
    total = own.agg(F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad")).first()
    overall = F.lit(((total["all_bad"] or 0) + 1) / ((total["all_n"] or 0) + 2))
    prior = (F.col("shape_bad") + strength * overall) / (F.col("shape_n") + strength)
    return own.join(across, "shape").select("template", ((F.col("bad") + strength * prior) / (F.col("n") + strength)).alias("purity"))


def judge_urls(pages: DataFrame, rules=RULES, label: str | None = None, threshold: float = 0.5, **options) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, purity.

    ``label`` names a column of ``pages`` (1 unwanted, 0 wanted, null unknown); without it the
    rules' own verdicts label the urls they fit. A url that a rule fits gets the rule's
    verdict; any other is blocked when its template's purity of unwanted labels is over
    ``threshold``. Null urls and urls without ``://`` have an empty host and path, one
    template together. Repeated urls count as often as they occur. An empty table gives no
    rows; extra columns are ignored.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), (F.col(label).cast("int") if label else F.lit(None).cast("int")).alias("given"))
    rule, said = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("said", said)
    known = F.col("given") if label else F.when(F.col("said") == "block", 1).when(F.col("said") == "allow", 0)
    bad = F.coalesce(F.sum(known), F.lit(0))
    rows = written(rows, "rows")
    urls = written(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.count(known).alias("n_labelled"), bad.alias("n_bad")), "urls")
    templates = path_templates(urls, **options)
    templates = written(templates, "templates")
    purity = template_purity(templates).join(templates.groupBy("template").agg(F.count(F.lit(1)).alias("urls")), "template")
    judged = skew_join(templates, purity, ["template"], "urls").select("host", "path", F.col("n").alias("_n"), "template", "purity")
    verdict = F.coalesce("said", F.when(F.col("purity") > threshold, F.lit("block")).otherwise(F.lit("allow")))
    return skew_join(rows, judged, ["host", "path"], "_n").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
