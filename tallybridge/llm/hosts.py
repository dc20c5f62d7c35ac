"""URL filters: an allow and block list first, then empirical-Bayes host reputation.

Labelled pages are bad or not. A host's bad rate is shrunk towards its registered domain's, that
towards its suffix's, that towards the rate of all: at each level the parent's posterior mean is
the mean of a beta prior, and the prior's strength comes from how much the rates of that level
differ beyond binomial noise (a moment estimate over all groups of the level). A host is blocked
if the lower bound of its posterior bad rate lies above a limit. All of it is column
expressions, joins on the host and aggregates; counts are combined before every shuffle.

Which label a page has: the number in its path is the id of the document it was made into.

Edge cases. A null url, or one without ``://``, has an empty host and path, is one host of its
own, fits no rule and is judged like any host. Ports and user names belong to ``host`` but not to
the reputation's host. Documents labelled twice are bad if one label says so; null labels say
nothing. Hosts without labelled pages take their domain's rate. With no label at all nothing is
blocked but by rules. Rules of equal length for one page: the first by code point. Null page ids
and repeated rows are judged like any row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import settle
from .registry import query, table

RULES = (
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"),
)
LIMIT = 0.3
QUANTILE = 1.645
# Suffixes of two labels (fixed values); all others are the last label.
DOUBLE_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "com.br", "co.in", "co.za")
STRONGEST = 1000.0


def parsed(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    # Only A-Z, as lower() would also change other letters.
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _placed(hosts: DataFrame) -> DataFrame:
    """Adds the reputation's host, its registered domain and its suffix."""
    bare = F.regexp_replace("host", r"^.*@|:[0-9]*$", "")
    labels = F.split("_bare", r"\.")
    last_two = F.substring_index("_bare", ".", -2)
    double = last_two.isin(*DOUBLE_SUFFIXES)
    return (
        hosts.withColumn("_bare", bare)
        .withColumn("_suffix", F.when(double, last_two).otherwise(F.substring_index("_bare", ".", -1)))
        .withColumn("_domain", F.when(double & (F.size(labels) > 2), F.substring_index("_bare", ".", -3)).otherwise(last_two))
    )


def _strength(groups: DataFrame) -> float:
    """Prior strength of a level, from one row per group (``n`` labelled pages, ``bad`` of them).

    Moment estimate of the correlation r of outcomes within a group; strength = 1 / r - 1.
    """
    n, bad = F.col("n"), F.col("bad")
    sums = groups.filter("n > 0").agg(
        F.count(F.lit(1)).cast("double"), F.sum(n).cast("double"), F.sum(bad).cast("double"),
        F.sum((n * n).cast("double")), F.sum(bad * bad / n),
    ).first()
    k, total, hits, squares, spread = (x or 0.0 for x in sums)
    if k < 2 or hits in (0.0, total):
        return STRONGEST
    p = hits / total
    room = p * (1 - p)
    between = spread - hits * p
    width = total - squares / total
    r = (between - room * (k - 1)) / (room * (width - (k - 1))) if width > k - 1 else 0.0
    return 1 / r - 1 if r > 1 / (STRONGEST + 1) else STRONGEST


def _shrunk(groups: DataFrame, name: str, prior: Column, strength: float) -> DataFrame:
    return groups.withColumn(name, (F.lit(strength) * prior + F.col("bad")) / (F.lit(strength) + F.col("n")))


def reputation(outcomes: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``host`` and ``lowest``, the lower bound of its bad rate, from one row per host (``host``, ``n``, ``bad``).

    Only a handful of sums over all groups come to the driver.
    """
    hosts = settle(_placed(outcomes))
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    bare = hosts.groupBy("_bare", "_domain", "_suffix").agg(*sums)
    domains = bare.groupBy("_domain", "_suffix").agg(*sums)
    suffixes = domains.groupBy("_suffix").agg(*sums)
    n, bad = suffixes.agg(F.sum("n"), F.sum("bad")).first()
    overall = (bad + 1.0) / (n + 2.0) if n else 0.0
    strengths = [_strength(groups) for groups in (suffixes, domains, bare)]
    top = _shrunk(suffixes, "_p", F.lit(overall), strengths[0]).select("_suffix", F.col("_p").alias("_from_suffix"))
    middle = _shrunk(domains.join(top, "_suffix"), "_p", F.col("_from_suffix"), strengths[1]).select("_domain", "_suffix", F.col("_p").alias("_from_domain"))
    low = _shrunk(bare.join(middle, ["_domain", "_suffix"]), "_p", F.col("_from_domain"), strengths[2])
    wide = F.sqrt(F.col("_p") * (1 - F.col("_p")) / (F.lit(strengths[2]) + F.col("n") + 1))
    bound = low.select("_bare", (F.col("_p") - F.lit(quantile) * wide).alias("lowest"))
    return hosts.select("host", "_bare").join(bound, "_bare").select("host", "lowest")


def fitting(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``host`` and ``_rules``: the rules of it and the domains above it, longest first."""
    split = rules.select(
        "rule", "action", F.substring_index("rule", "/", 1).alias("_of"), F.expr("substring(rule, instr(rule, '/'))").alias("_path")
    )
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = hosts.select("host", F.explode(above).alias("_of")).join(split, "_of")
    listed = F.array_sort(F.collect_list(F.struct((-F.length("rule")).alias("order"), "rule", "action", "_path")))
    return met.groupBy("host").agg(listed.alias("_rules"))


def judged(pages: DataFrame, labels: DataFrame, rules: DataFrame, ids: str = "page_id", url: str = "url", limit: float = LIMIT) -> DataFrame:
    """``ids``, ``host``, ``path``, ``rule`` and ``verdict``, one row per page."""
    host, path = parsed(F.col(url))
    rows = pages.select(ids, host.alias("host"), path.alias("path"))
    bad = labels.groupBy(F.col("doc_id").alias("_doc")).agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("_bad"))
    numbered = rows.select("host", F.expr("try_cast(nullif(regexp_extract(path, '/([0-9]+)', 1), '') AS bigint)").alias("_doc"))
    outcomes = settle(
        numbered.join(bad, "_doc", "left").groupBy("host").agg(F.count("_bad").alias("n"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("bad"))
    )
    known = reputation(outcomes).join(fitting(outcomes.select("host"), rules), "host", "left")
    hit = F.get(F.filter("_rules", lambda r: F.startswith(F.col("path"), r["_path"])), F.lit(0))
    met = rows.join(known, "host").withColumn("_hit", hit)
    own = F.when(F.col("lowest") > limit, F.lit("block")).otherwise(F.lit("allow"))
    return met.select(ids, "host", "path", F.col("_hit.rule").alias("rule"), F.coalesce("_hit.action", own).alias("verdict"))


def _sql() -> str:
    def strength(level: str) -> str:
        return f"""
  SELECT CASE WHEN k < 2 OR hits = 0 OR hits = total OR width <= k - 1 THEN {STRONGEST}
    WHEN (between_ - room * (k - 1)) / (room * (width - (k - 1))) > 1 / ({STRONGEST} + 1)
    THEN 1 / ((between_ - room * (k - 1)) / (room * (width - (k - 1)))) - 1 ELSE {STRONGEST} END AS s
  FROM (SELECT k, hits, total, hits / total * (1 - hits / total) AS room, spread - hits * (hits / total) AS between_, total - squares / total AS width
        FROM (SELECT CAST(count(*) AS DOUBLE) AS k, CAST(sum(n) AS DOUBLE) AS total, CAST(sum(bad) AS DOUBLE) AS hits,
                CAST(sum(n * n) AS DOUBLE) AS squares, sum(bad * bad / n) AS spread FROM {level} WHERE n > 0))"""

    double = ", ".join(f"'{s}'" for s in DOUBLE_SUFFIXES)
    rules = ", ".join(f"('{r}', '{a}')" for r, a in RULES)
    two = "array_to_string(x[-2:], '.')"
    return rf"""
WITH rules(rule, action) AS (VALUES {rules}),
rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r, row_number() OVER () AS id FROM pages),
p AS (
  SELECT id, page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
bad AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NULL OR toxic IS NULL THEN NULL ELSE 0 END) AS bad
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
h AS (
  SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare, count(bad) AS n, coalesce(sum(bad), 0) AS bad
  FROM p LEFT JOIN bad ON TRY_CAST(nullif(regexp_extract(path, '/([0-9]+)', 1), '') AS BIGINT) = bad.doc_id GROUP BY host),
placed AS (
  SELECT bare, sum(n) AS n, sum(bad) AS bad, string_split(bare, '.') AS x FROM h GROUP BY bare),
hosts AS (
  SELECT bare, n, bad, CASE WHEN {two} IN ({double}) THEN {two} ELSE x[-1] END AS suffix,
    CASE WHEN {two} IN ({double}) AND len(x) > 2 THEN array_to_string(x[-3:], '.') ELSE {two} END AS domain FROM placed),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix),
s1 AS ({strength("suffixes")}), s2 AS ({strength("domains")}), s3 AS ({strength("hosts")}),
m0 AS (SELECT CASE WHEN sum(n) = 0 THEN 0.0 ELSE (sum(bad) + 1.0) / (sum(n) + 2.0) END AS m FROM suffixes),
m1 AS (SELECT suffix, (s * m + bad) / (s + n) AS m FROM suffixes, s1, m0),
m2 AS (SELECT domain, domains.suffix, (s * m + bad) / (s + n) AS m FROM s2, domains JOIN m1 USING (suffix)),
m3 AS (SELECT bare, n, s, (s * m + bad) / (s + n) AS m FROM s3, hosts JOIN m2 USING (domain, suffix)),
bound AS (SELECT bare, m - {QUANTILE} * sqrt(m * (1 - m) / (s + n + 1)) AS lowest FROM m3),
hit AS (
  SELECT id, arg_min(rule, o) AS rule, arg_min(action, o) AS action FROM (
    SELECT id, rule, action, (-length(rule), rule) AS o FROM p JOIN rules
    ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, instr(rule, '/'))))
  GROUP BY id)
SELECT page_id, p.host, path, rule, coalesce(action, CASE WHEN lowest > {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM p JOIN h ON p.host = h.host JOIN bound USING (bare) LEFT JOIN hit USING (id)"""


@query("op9_url_filters", _sql())
def op9_url_filters(spark, sf_dir):
    """Every page with its host, path, rule and verdict."""
    rules = spark.createDataFrame(list(RULES), "rule string, action string")
    return judged(table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels"), rules)
