"""URL verdicts: host rules first, else an empirical-Bayes reputation of the host.

Labelled page outcomes (bad or not) are counted by host, registered domain and suffix.  Each
level's rates get a beta prior whose mean is the posterior mean of the level above (the suffix's
is the overall rate) and whose strength is the moment estimate of that level's beta-binomial
overdispersion, so a host with few labels leans on its domain and a domain on its suffix.  A page
is blocked where even the lower bound of its host's posterior bad rate, ``mean - z * deviation``,
is above ``most_bad``.

Everything is DataFrame expressions.  Counts are combined before each shuffle; the join of pages
with hosts is an ordinary one whose hot hosts adaptive execution splits; only single rows of
totals are joined without a key.  Null urls and urls without ``://`` have empty host and path and
are judged like any host.  Labels that are null or whose page is missing count nowhere; several
label rows of a page are several outcomes.  Rows that repeat a page are each judged; an empty table
gives an empty one; of rules as long as each other the last by (verdict, host, path) wins.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.shared import written

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Public suffixes of two labels; any other suffix is the last label.
DOUBLE_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "gov.uk", "org.au", "org.uk")
#: Bounds of a level's prior strength, in pseudo-outcomes.
WEAKEST, STRONGEST = 1.0, 1000.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to /, ?, # or the end, A-Z in lower case; path: from there up to ? or #; both empty if there is no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("url"))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits (null if none): its host or a subdomain, and a path that begins with the rule's."""
    text = verdict = F.lit(None).cast("string")
    for says, of, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == of) | F.endswith(host, F.lit(f".{of}"))) & F.startswith(path, F.lit(start))
        text, verdict = F.when(fits, of + start).otherwise(text), F.when(fits, says).otherwise(verdict)
    return text, verdict


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """Registered domain (one label before the suffix) and suffix; a host of one label is its own domain."""
    parts = F.split(host, r"\.")
    last2 = F.substring_index(host, ".", -2)
    double = last2.isin(*DOUBLE_SUFFIXES) & (F.size(parts) > 2)
    return F.when(double, F.substring_index(host, ".", -3)).otherwise(last2), F.when(double, last2).otherwise(F.substring_index(host, ".", -1))


def strength(groups: DataFrame) -> DataFrame:
    """One row: a level's prior strength from the labelled groups' ``n`` and ``bad`` by the method of moments; the weakest if nothing is labelled."""
    t = groups.where("n > 0").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"), F.sum(F.col("bad").cast("double") * F.col("bad") / F.col("n")).alias("bb"))
    mean = F.col("bad") / F.col("n")
    spread = F.col("bb") - F.col("n") * mean * mean
    noise = mean * (1 - mean)
    over = (spread - noise * (F.col("k") - 1)) / (noise * (F.col("n") - F.col("nn") / F.col("n") - (F.col("k") - 1)))
    s = F.when(F.col("k") == 0, WEAKEST).when((noise > 0) & (over > 0), (1 - over) / over).otherwise(STRONGEST)
    return t.select(F.least(F.lit(STRONGEST), F.greatest(F.lit(WEAKEST), F.coalesce(s, F.lit(STRONGEST)))).alias("strength"))


def reputations(hosts: DataFrame) -> DataFrame:
    """host, n, bad -> the same with ``mean`` and ``deviation`` of the posterior bad rate."""
    d, s = domain_and_suffix(F.col("host"))
    hosts = hosts.withColumns({"domain": d, "suffix": s})
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffixes.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("above"))
    posterior = (F.col("strength") * F.col("above") + F.col("bad")) / (F.col("strength") + F.col("n"))

    def level(groups: DataFrame) -> DataFrame:
        return groups.crossJoin(F.broadcast(strength(groups.select("n", "bad")))).withColumn("mean", posterior)

    up = level(suffixes.crossJoin(F.broadcast(total))).select("suffix", F.col("mean").alias("above"))
    up = level(domains.join(up, "suffix")).select("domain", F.col("mean").alias("above"))
    own = level(hosts.join(up, "domain"))
    return own.select("host", "n", "bad", "mean", F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("strength") + F.col("n") + 1)).alias("deviation"))


def verdicts(pages: DataFrame, outcomes: DataFrame, rules=RULES, most_bad: float = 0.3, z: float = 1.645) -> DataFrame:
    """page_id, host, path, rule, verdict (and the host's labelled and bad outcomes) of ``pages`` (page_id, url) under ``outcomes`` (page_id, bad boolean)."""
    host, path = host_and_path(F.col("url"))
    cut = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    counted = outcomes.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"))
    one = cut.select("page_id", "host").dropDuplicates(["page_id", "host"]).join(counted, "page_id", "left")
    hosts = one.groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = written(hosts, "hosts")  # three levels read it
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    said = F.when(F.col("mean") - z * F.col("deviation") > most_bad, "block").otherwise("allow")
    return cut.join(reputations(hosts), "host", "left").select("page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, said).alias("verdict"), F.col("n").alias("labelled"), F.col("bad").alias("labelled_bad"))


def oracle(most_bad: float = 0.3, z: float = 1.645, rules=RULES) -> str:
    """The same over DuckDB's ``pages`` and ``labels``."""
    doubles = ", ".join(f"'{x}'" for x in DOUBLE_SUFFIXES)
    fits = [(f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))", h + p, v) for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))]
    case = lambda k: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[k]}'" for f in fits) + " END"
    strength = lambda t: (
        f"(SELECT least({STRONGEST}, greatest({WEAKEST}, coalesce(CASE WHEN k = 0 THEN {WEAKEST} WHEN m * (1 - m) > 0 AND o > 0 THEN (1 - o) / o ELSE {STRONGEST} END, {STRONGEST}))) FROM ("
        f"SELECT k, m, (bb - n * m * m - m * (1 - m) * (k - 1)) / nullif(m * (1 - m) * (n - nn / n - (k - 1)), 0) AS o FROM ("
        f"SELECT count(*) AS k, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE / sum(n) AS m, sum(n::DOUBLE * n) AS nn, sum(bad::DOUBLE * bad / n) AS bb FROM {t} WHERE n > 0)))"
    )
    posterior = "(s * above + bad) / (s + n)"
    return f"""
WITH cut AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, coalesce(CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) END, '') AS rest FROM pages)),
counted AS (SELECT doc_id AS page_id, count(*) AS n, count(*) FILTER (WHERE quality = 0 OR toxic = 1) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY ALL),
base AS (SELECT host, coalesce(sum(n), 0)::BIGINT AS n, coalesce(sum(bad), 0)::BIGINT AS bad FROM (SELECT DISTINCT page_id, host FROM cut) LEFT JOIN counted USING (page_id) GROUP BY host),
parted AS (SELECT *, string_split(host, '.') AS p, array_to_string(string_split(host, '.')[-2:], '.') AS last2 FROM base),
hosts AS (SELECT host, n, bad, CASE WHEN last2 IN ({doubles}) AND len(p) > 2 THEN array_to_string(p[-3:], '.') ELSE last2 END AS domain, CASE WHEN last2 IN ({doubles}) AND len(p) > 2 THEN last2 ELSE p[-1] END AS suffix FROM parted),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
total AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) AS above FROM suffixes),
up1 AS (SELECT suffix, {posterior} AS above FROM suffixes, total, (SELECT {strength("suffixes")} AS s)),
up2 AS (SELECT domain, {posterior} AS above FROM domains JOIN up1 USING (suffix), (SELECT {strength("domains")} AS s)),
own AS (SELECT host, n, bad, s, {posterior} AS mean FROM hosts JOIN up2 USING (domain), (SELECT {strength("hosts")} AS s))
SELECT page_id, host, path, {case(1)} AS rule, coalesce({case(2)}, CASE WHEN mean - {z} * sqrt(mean * (1 - mean) / (s + n + 1)) > {most_bad} THEN 'block' ELSE 'allow' END) AS verdict, n AS labelled, bad AS labelled_bad
FROM cut LEFT JOIN own USING (host)"""
