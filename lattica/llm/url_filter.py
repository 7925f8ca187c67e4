"""URL filters (operator 8): explicit rules, and a path-template tree for all other urls.

Rules name a host and a beginning of the path; the longest that fits decides.  Urls that a rule decides
are the labelled rows of the tree: level by level, each host's paths are grouped by their next segment;
a segment is generalised to a wildcard of its shape if it looks like a number or a key, or if a single row
has it.  How many siblings it has doesn't matter.  At every level of the path, labelled siblings whose blocked
shares don't differ significantly are merged into one branch.

A template's purity is the blocked share of its branch, smoothed by what lies above it: down from the domains
that the host belongs to, over the host and the path's segments, each level adds the rows that it has besides
those of the next, so that nothing counts twice.  Rows without a label count as PRIOR_SHARE beside labelled ones: a host
of which a part is blocked says little about its other sections, one that is blocked nearly whole much.  A level
without any labelled row says nothing.  A template is rejected if its purity is PURITY or more.

Counts are aggregated before they are shuffled; no host's urls are gathered in one task.  Siblings are merged by
hundredths of their blocked share, so that a task orders at most 101 groups, however many siblings there are.

Defined results: a null url, or one without `://`, has an empty host and path and is judged like any other
(no rule fits it).  Repeated rows are judged alike; null ids stay null.  Other input columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

#: (verdict, rule): a rule is a host, then a beginning of the path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
MAX_RULES = 256
#: Segments beyond this depth are one wildcard.
MAX_DEPTH = 8
#: Rows from which a segment that is no number or key stays as it is.
MIN_ROWS = 2
#: Tasks that share the paths of one segment of a host where literals are looked up.
SALTS = 16
#: Siblings are merged below this difference of blocked shares in standard errors.
MERGE_Z = 1.96
#: Smoothed blocked share from which a template is rejected.
PURITY = 0.8
#: Blocked share above all domains; rows of the level above that smooth a template, and each level over it.
PRIOR_SHARE, PRIOR_ROWS, INNER_ROWS = 0.2, 4.0, 20.0
#: Domains above a host that have a level of their own, counted from the last name on.
MAX_DOMAINS = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def match_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits (ties: the first in order of text), else null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def shape(segment: Column) -> Column:
    """A wildcard for a variable segment that keeps its file ending."""
    ending = F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1)
    stem = F.regexp_replace(segment, r"\.[A-Za-z]{1,5}$", "")
    kind = F.when(stem.rlike(r"^\d+$"), "{number}").when(stem.rlike(r"^[0-9A-Fa-f-]{8,}$"), "{key}").otherwise("{word}")
    return F.concat(kind, ending)


def is_variable(segment: Column) -> Column:
    return segment.rlike(r"^\d+(\.[A-Za-z]{1,5})?$") | segment.rlike(r"^[0-9A-Fa-f-]{8,}(\.[A-Za-z]{1,5})?$")


def templates(pages: DataFrame) -> DataFrame:
    """host, path, template of each distinct (host, path); pages: host, path, n (its rows)."""
    parts = F.filter(F.split(F.col("path"), "/"), lambda x: x != "")
    rows = pages.withColumns({"parts": parts, "template": F.lit("")})
    depth = min(rows.agg(F.max(F.size("parts"))).first()[0] or 0, MAX_DEPTH)
    for level in range(depth):
        segment = F.get(F.col("parts"), F.lit(level))
        rows = rows.withColumn("child", F.when(is_variable(segment), shape(segment)).otherwise(segment))
        seen = rows.where(F.col("child").isNotNull()).groupBy("host", "template", "child").agg(F.sum("n").alias("child_n"))
        kept = seen.where(~F.col("child").startswith("{") & (F.col("child_n") >= MIN_ROWS))
        kept = kept.select("host", "template", "child", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("literal"))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int"))
        rows = rows.join(kept, ["host", "template", "child", "salt"], "left").drop("salt")
        step = F.when(F.col("child").isNull(), "").when(F.col("literal") | F.col("child").startswith("{"), F.concat(F.lit("/"), "child")).otherwise(F.concat(F.lit("/"), shape(F.col("child"))))
        rows = rows.withColumn("template", F.concat("template", step)).drop("child", "literal")
        rows = materialise(rows, f"url-level-{level}")
    deeper = F.when(F.size("parts") > MAX_DEPTH, "/**").otherwise("")
    return rows.select("host", "path", "n", "blocked", "labelled", F.concat("template", deeper, F.when(F.col("path").endswith("/"), "/").otherwise("")).alias("template"))


def chain(host: Column, template: Column) -> Column:
    """Keys of the levels from the outermost domain to the template itself."""
    names, segments = F.split(host, r"\."), F.split(template, "/")
    last = lambda k: F.array_join(F.slice(names, F.size(names) - k + 1, k), ".")
    domains = F.transform(F.sequence(F.lit(0), F.least(F.size(names) - 1, F.lit(MAX_DOMAINS))), lambda k: F.concat(F.lit("d:"), last(k)))
    paths = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda k: F.concat(F.lit("h:"), host, F.array_join(F.slice(segments, 1, k), "/")))
    return F.concat(F.slice(domains, 2, MAX_DOMAINS), paths, F.array(F.concat(F.lit("t:"), host, template)))


def branches(nodes: DataFrame) -> DataFrame:
    """key and its branch's rows, labelled and blocked: those of the node itself, or of it and the siblings it is merged
    with (inside a host).

    nodes: key, parent, n, labelled, blocked."""
    share = F.round(100 * F.col("blocked") / F.col("labelled")).cast("int")
    nodes = nodes.withColumn("bin", F.when((F.col("labelled") > 0) & F.col("parent").startswith("h:"), share))
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    bins = nodes.where("bin IS NOT NULL").groupBy("parent", "bin").agg(*sums)
    order = Window.partitionBy("parent").orderBy("bin")
    smooth = (F.col("blocked") + PRIOR_ROWS * PRIOR_SHARE) / (F.col("labelled") + PRIOR_ROWS)
    bins = bins.withColumns({"share": smooth, "weight": F.col("labelled") + PRIOR_ROWS})
    n, m = F.col("weight"), F.lag("weight").over(order)
    pooled = (F.col("share") * n + F.lag("share").over(order) * m) / (n + m)
    apart = F.abs(F.col("share") - F.lag("share").over(order)) >= MERGE_Z * F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m))
    bins = bins.withColumn("branch", F.sum(F.coalesce(apart, F.lit(False)).cast("int")).over(order))
    whole = Window.partitionBy("parent", "branch")
    bins = bins.select("parent", "bin", *[F.sum(c).over(whole).alias(f"b_{c}") for c in ("n", "labelled", "blocked")])
    return nodes.join(bins, ["parent", "bin"], "left").select("key", *[F.coalesce(f"b_{c}", c).alias(c) for c in ("n", "labelled", "blocked")])


def purities(judged: DataFrame) -> DataFrame:
    """host, template and its purity.  judged: host, template, n, labelled and blocked of each distinct path."""
    per = judged.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")])
    per = materialise(per.withColumn("chain", chain(F.col("host"), F.col("template"))), "url-templates")
    links = per.select("host", "template", "n", "labelled", "blocked", "chain", F.posexplode("chain").alias("depth", "key"))
    parent = F.when(F.col("depth") > 0, F.get("chain", F.col("depth") - 1)).otherwise("")
    nodes = links.groupBy("key", parent.alias("parent")).agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")])
    level = F.struct("depth", *[F.col(c).cast("double").alias(c) for c in ("n", "labelled", "blocked")])
    found = links.select("host", "template", "depth", "key").join(branches(nodes), "key")
    found = found.groupBy("host", "template").agg(F.array_sort(F.collect_list(level)).alias("levels"))
    last = F.size("levels") - 1

    def step(q: Column, i: Column) -> Column:
        here, below = F.get("levels", i), F.get("levels", i + 1)
        rest = {c: here[c] - F.when(i < last, below[c]).otherwise(0.0) for c in ("n", "labelled", "blocked")}
        above = (rest["blocked"] + PRIOR_SHARE * (rest["n"] - rest["labelled"]) + INNER_ROWS * q) / (rest["n"] + INNER_ROWS)
        own = (rest["blocked"] + PRIOR_ROWS * q) / (rest["labelled"] + PRIOR_ROWS)
        return F.when(i == last, own).when(rest["labelled"] > 0, above).otherwise(q)

    return found.select("host", "template", F.aggregate(F.sequence(F.lit(0), last), F.lit(PRIOR_SHARE), step).alias("purity"))


def held_out(pages: DataFrame, rules=RULES, parts: int = 4, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, ruled, purity of the rows that a rule decides, from trees that didn't know the verdicts on their paths: each
    tree hides those of one part of the paths, by hash.  PURITY is chosen on these."""
    out = None
    for k in range(parts):
        hidden = F.pmod(F.xxhash64("host", "path"), F.lit(parts)) == k
        rows = _ruled(pages, rules, id_col, url_col)
        one = _with_purity(rows, hidden).where(F.col("ruled").isNotNull() & hidden).select("page_id", "ruled", "purity")
        out = one if out is None else out.unionByName(one)
    return out


def precision_and_recall(held: DataFrame, purity: float = PURITY) -> DataFrame:
    """One row: of held-out ruled rows, the blocked part of those that the tree rejects, and the rejected part of blocked ones."""
    rejected, blocked = F.col("purity") >= purity, F.col("ruled") == "block"
    both = F.count_if(rejected & blocked)
    return held.agg(F.count("*").alias("n"), F.try_divide(both, F.count_if(rejected)).alias("precision"), F.try_divide(both, F.count_if(blocked)).alias("recall"))


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity, a row for each row."""
    out = _with_purity(_ruled(pages, rules, id_col, url_col))
    verdict = F.coalesce("ruled", F.when(F.col("purity") >= PURITY, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def _ruled(pages: DataFrame, rules, id_col: str, url_col: str) -> DataFrame:
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("by", match_rule(F.col("host"), F.col("path"), rules))
    return rows.select("page_id", "host", "path", "by.rule", F.col("by.verdict").alias("ruled"))


def _with_purity(rows: DataFrame, hidden: Column | None = None) -> DataFrame:
    """The rows with their path's template and its purity; hidden: rows whose verdict the tree isn't told."""
    known = F.col("ruled") if hidden is None else F.when(~hidden, F.col("ruled"))
    paths = rows.groupBy("host", "path").agg(
        F.count("*").alias("n"),
        F.count_if(known == "block").alias("blocked"),
        F.count(known).alias("labelled"),
    )
    found = templates(paths)
    purity = found.join(purities(found), ["host", "template"]).select("host", "path", "template", "purity")
    return rows.join(purity, ["host", "path"])
