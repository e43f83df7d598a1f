"""URL verdicts from rules and from a tree of path templates, in DataFrame operations only.

Tree: per host, the segments of a path are read from the left.  Runs of digits and
long hexadecimal names become wildcards at once; another segment stays as it is if
at least ``SUPPORT`` pages share it behind the same template, else it becomes a
wildcard too.  Paths deeper than ``DEPTH`` segments end in one wildcard for the rest.

Merging: templates that differ in their last fixed segment only are branches of one
parent.  A branch whose share of bad labels does not differ from the parent's by
more than ``SPREAD`` standard errors is merged into it; others stand alone.

Verdict: block if the smoothed share of bad labels of the (merged) template, pulled
to the overall share with the weight of ``STRENGTH`` pages, is one half or more,
else allow.  Templates without labels are therefore judged by the overall share.  A
rule that fits comes first: its host is the page's or a parent domain, its path
starts the page's path, and the longest rule wins.

Labels: a page belongs to the document whose number ends its path, and is bad if the
document is labelled as low quality or as toxic.  Null labels say nothing; several
labels of one document are bad if one is.

Null urls, and urls without ``://``, have an empty host and path, which are judged
like any other.  Null or repeated page ids give a row each.  An empty table gives no
rows.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rarelane.session import stage_table

SUPPORT = 20
DEPTH = 8
SPREAD = 2.0
STRENGTH = 10.0

#: (host, path, verdict)
Rules = list[tuple[str, str, str]]

#: A segment of wildcards, marks and an ending.
_NUMBER = r"^[^A-Za-z{}]*(\{[nh]\}[^A-Za-z{}]*)+([.][A-Za-z]{1,5})?$"

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; empty for null and for urls without ``://``."""
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return (
        F.translate(F.regexp_extract(text, pattern, 1), _CAPITALS, _CAPITALS.lower()),
        F.regexp_extract(text, pattern, 2),
    )


def rule_of(host: Column, path: Column, rules: Rules) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null if none does."""
    text = verdict = F.lit(None).cast("string")
    for own, start, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]))):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        text = F.when(fits, F.lit(own + start)).otherwise(text)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return text, verdict


def masked(path: Column) -> Column:
    """Path with long hexadecimal names and runs of digits as wildcards."""
    return F.regexp_replace(F.regexp_replace(path, r"\b[0-9a-fA-F]{16,}\b", "{h}"), r"[0-9]+", "{n}")


def document_number(path: Column) -> Column:
    """The number that ends a path, but for an ending without digits; null if there is none."""
    return F.regexp_extract(path, "/([0-9]{1,18})[^/0-9]*/?$", 1).try_cast("long")


def bad_documents(labels: DataFrame) -> DataFrame:
    """``doc_id, bad`` (0 or 1) of each labelled document."""
    bad = F.greatest((F.col("quality") == 0).cast("int"), (F.col("toxic") == 1).cast("int"))
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), bad.alias("bad")).where(
        "doc_id IS NOT NULL AND bad IS NOT NULL"
    ).groupBy("doc_id").agg(F.max("bad").alias("bad"))


def templates(paths: DataFrame) -> DataFrame:
    """``host, masked, template`` from ``host, masked, pages``: segments fixed or wild, level by level."""
    rest = F.split("masked", "/")
    tree = stage_table(paths.select("host", "masked", "pages", rest.alias("segments"), F.lit("").alias("template")), "tree")
    deepest = tree.agg(F.max(F.size("segments"))).first()[0] or 0
    for level in range(1, min(deepest, DEPTH + 1)):
        segment = F.get("segments", F.lit(level))
        here = tree.withColumn("segment", segment)
        fixed = stage_table(
            here.where("segment IS NOT NULL").groupBy("host", "template", "segment")
            .agg(F.sum("pages").alias("support")).where(F.col("support") >= SUPPORT)
            .select("host", "template", "segment", F.lit(True).alias("fixed")),
            "fixed",
        )
        stays = F.col("fixed") | (F.col("segment") == "") | F.col("segment").rlike(_NUMBER)
        wild = F.when(stays, F.col("segment")).otherwise(F.lit("*"))
        tree = stage_table(
            here.join(fixed, ["host", "template", "segment"], "left").select(
                "host", "masked", "pages", "segments",
                F.when(F.col("segment").isNull(), F.col("template"))
                .otherwise(F.concat("template", F.lit("/"), wild)).alias("template"),
            ),
            "tree",
        )
    tail = F.when(F.size("segments") > DEPTH + 1, F.lit("/**")).otherwise(F.lit(""))
    return tree.select("host", "masked", F.concat("template", tail).alias("template"))


def branch(template: Column) -> Column:
    """The parent of a template: its last fixed segment as a wildcard."""
    return F.regexp_replace(template, r"/[^/*{}]+(?=(/[^/]*[*{}][^/]*|/)*$)", "/*")


def template_verdicts(counts: DataFrame) -> DataFrame:
    """``host, template, purity`` from ``host, template, labelled, bad``."""
    counts = stage_table(
        counts.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
        .withColumn("branch", branch(F.col("template"))),
        "counts",
    )
    total = counts.agg(F.sum("labelled"), F.sum("bad")).first()
    share = (total[1] or 0) / total[0] if total[0] else 0.0
    parents = stage_table(
        counts.groupBy("host", "branch").agg(
            F.sum("labelled").alias("parent_labelled"), F.sum("bad").alias("parent_bad")
        ),
        "parents",
    )
    rate = F.col("parent_bad") / F.greatest("parent_labelled", F.lit(1))
    far = F.abs(F.col("bad") - F.col("labelled") * rate) > SPREAD * F.sqrt(F.col("labelled") * rate * (1 - rate))
    own_bad, own_labelled = (
        F.when(far, F.col(name)).otherwise(F.col(f"parent_{name}")) for name in ("bad", "labelled")
    )
    return counts.join(parents, ["host", "branch"]).select(
        "host", "template", F.when(far, F.col("template")).otherwise(F.col("branch")).alias("merged"),
        ((own_bad + STRENGTH * share) / (own_labelled + STRENGTH)).alias("purity"),
    )


def url_verdicts(pages: DataFrame, labels: DataFrame, rules: Rules) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` of each page."""
    host, path = parts(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("masked", masked(F.col("path")))
    numbered = rows.select("host", "masked", document_number(F.col("path")).alias("doc_id"))
    labelled = numbered.join(bad_documents(labels), "doc_id", "left")
    paths = stage_table(
        labelled.groupBy("host", "masked").agg(
            F.count("*").alias("pages"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
        ),
        "paths",
    )
    tree = stage_table(templates(paths.select("host", "masked", "pages")), "templates")
    judged = stage_table(template_verdicts(paths.join(tree, ["host", "masked"]).drop("masked", "pages")), "judged")
    by_path = stage_table(tree.join(judged, ["host", "template"]).select("host", "masked", "merged", "purity"), "by_path")
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("purity") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(by_path, ["host", "masked"], "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(says, method).alias("verdict"),
        F.col("merged").alias("template"), "purity",
    )
