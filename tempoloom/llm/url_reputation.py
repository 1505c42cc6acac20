"""URL filter by empirical-Bayes host reputation.

A labelled page (label of the id that equals page_id; quality 1 is a success) is an outcome of its host. Rates are
shrunk level by level with beta-binomial priors: the suffix towards the rate of all labelled pages, the registered
domain towards its suffix, the host towards its domain. The strength of each level's prior, 1/rho - 1, is the moment
estimate of the level's overdispersion rho, kept within RHO. A page stays unless its host's posterior lies below
MIN_RATE with confidence: mean + SPREAD standard deviations (Cantelli's bound, which holds for any posterior: at least
80 % of it lies below for SPREAD 2) must reach MIN_RATE.

Defined results: pages with a null url or one without a host share the host '' of suffix ''; numeric addresses are
their own domain and suffix; labels with null or contradicting quality are dropped; a page that is repeated counts
every time, as do its outcomes; unlabelled hosts have their domain's mean; without labels every mean is 1/2. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempoloom.llm.common import checkpoint, sized_join

HOST = r"^(?i:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"
TWO_LEVEL = ("ac.jp", "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "edu.au", "gov.au", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")
RHO = (0.001, 0.5)
SPREAD = 2.0
MIN_RATE = 0.5


def host(url: Column) -> Column:
    return F.coalesce(F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(".")), F.lit(""))


def suffix(name: Column) -> Column:
    two = F.substring_index(name, ".", -2)
    return F.when(name.rlike("^[0-9.]+$"), name).when(two.isin(*TWO_LEVEL), two).otherwise(F.substring_index(name, ".", -1))


def domain(name: Column, suffix_: Column) -> Column:
    dots = F.length(suffix_) - F.length(F.replace(suffix_, F.lit("."), F.lit("")))
    return F.when(name == suffix_, name).when(dots > 0, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def _shrunk(units: DataFrame, level: str) -> DataFrame:
    """units (n, k, parent mean m) with the level's posterior mean and strength."""
    v = F.col("m") * (1 - F.col("m"))
    sums = units.agg(
        F.sum(F.when(F.col("n") > 0, F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("m"), 2))).alias("s"),
        F.sum(F.when(F.col("n") > 0, v)).alias("a"),
        F.sum(F.when(F.col("n") > 0, v * (F.col("n") - 1))).alias("b"),
    )
    rho = F.least(F.lit(RHO[1]), F.greatest(F.lit(RHO[0]), F.coalesce((F.col("s") - F.col("a")) / F.nullif("b", F.lit(0.0)), F.lit(0.1))))
    return units.crossJoin(F.broadcast(sums.select((1 / rho - 1).alias("kappa")))).withColumn(level, (F.col("k") + F.col("kappa") * F.col("m")) / (F.col("n") + F.col("kappa")))


def reputations(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host, domain, suffix, pages, labelled, good, mean, upper of every host."""
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").alias("_rep_id")).agg(F.min("quality").alias("low"), F.max("quality").alias("quality")).filter("low = quality").drop("low")
    own = pages.select("page_id", host(F.col("url")).alias("host"))
    hosts = own.join(known, own.page_id == known._rep_id, "left").groupBy("host").agg(F.count("*").alias("pages"), F.count("quality").alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).alias("k"))
    hosts = checkpoint(hosts.withColumn("suffix", suffix(F.col("host"))).withColumn("domain", domain(F.col("host"), F.col("suffix"))))
    domains = checkpoint(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    suffixes = checkpoint(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    top = suffixes.agg(((F.coalesce(F.sum("k"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("m"))
    by_suffix = checkpoint(_shrunk(suffixes.crossJoin(F.broadcast(top)), "mean").select("suffix", F.col("mean").alias("m")))
    by_domain = checkpoint(_shrunk(domains.join(by_suffix, "suffix"), "mean").select("domain", "suffix", F.col("mean").alias("m")))
    out = _shrunk(hosts.join(by_domain, ["domain", "suffix"]), "mean")
    strength = F.col("n") + F.col("kappa")
    upper = F.least(F.lit(1.0), F.col("mean") + SPREAD * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (strength + 1)))
    return out.select("host", "domain", "suffix", "pages", F.col("n").alias("labelled"), F.col("k").alias("good"), "mean", upper.alias("upper"))


def judged(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, host, domain, suffix, mean, upper, kept of every page."""
    rep = checkpoint(reputations(pages, labels).select("host", "domain", "suffix", "mean", "upper", "pages"))
    own = pages.select("page_id", host(F.col("url")).alias("host"))
    return sized_join(own, rep, ["host"], ["page_id"], "pages").select("page_id", "host", "domain", "suffix", F.round("mean", 6).alias("mean"), F.round("upper", 6).alias("upper"), (F.round("upper", 6) >= MIN_RATE).alias("kept"))


def _level(name: str, table: str, parent: str) -> str:
    return f"""{name}_rho AS (SELECT 1.0 / least({RHO[1]}, greatest({RHO[0]}, coalesce(
        (sum(CASE WHEN n > 0 THEN n * pow(k::DOUBLE / n - m, 2) END) - sum(CASE WHEN n > 0 THEN m * (1 - m) END))
        / nullif(sum(CASE WHEN n > 0 THEN m * (1 - m) * (n - 1) END), 0), 0.1))) - 1 AS kappa FROM (SELECT * FROM {table} JOIN {parent})),
      {name} AS (SELECT *, (k + kappa * m) / (n + kappa) AS mean FROM (SELECT * FROM {table} JOIN {parent}) CROSS JOIN {name}_rho)"""


SQL = f"""
WITH known AS (SELECT doc_id, min(quality) AS q FROM labels WHERE doc_id IS NOT NULL AND quality IN (0, 1) GROUP BY doc_id HAVING min(quality) = max(quality)),
own AS (SELECT page_id, coalesce(rtrim(lower(regexp_extract(url, '{HOST}', 1)), '.'), '') AS host FROM pages),
hosts0 AS (SELECT host, count(q) AS n, coalesce(sum(q), 0) AS k FROM own LEFT JOIN known ON page_id = doc_id GROUP BY host),
hosts1 AS (SELECT *, string_split(host, '.') AS p FROM hosts0),
hosts2 AS (SELECT *, CASE WHEN regexp_matches(host, '^[0-9.]+$') THEN host
  WHEN array_to_string(p[-2:], '.') IN {TWO_LEVEL} THEN array_to_string(p[-2:], '.') ELSE p[-1] END AS suffix FROM hosts1),
hosts AS (SELECT host, n, k, suffix, CASE WHEN host = suffix THEN host WHEN contains(suffix, '.') THEN array_to_string(p[-3:], '.')
  ELSE array_to_string(p[-2:], '.') END AS domain FROM hosts2),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL),
top AS (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) AS m FROM suffixes),
{_level("s", "suffixes", "top ON true")},
sm AS (SELECT suffix, mean AS m FROM s),
{_level("d", "domains", "sm USING (suffix)")},
dm AS (SELECT domain, suffix, mean AS m FROM d),
{_level("h", "hosts", "dm USING (domain, suffix)")},
b AS (SELECT *, round(least(1.0, mean + {SPREAD} * sqrt(mean * (1 - mean) / (n + kappa + 1))), 6) AS upper FROM h)
SELECT page_id, own.host, domain, suffix, round(mean, 6) AS mean, upper, upper >= {MIN_RATE} AS kept FROM own JOIN b ON own.host = b.host"""
