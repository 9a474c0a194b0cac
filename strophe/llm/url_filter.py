"""URL filters: fixed rules, and empirical-Bayes host reputation.

A rule (host, path, verdict) fits its host and all subdomains if the url's path starts with the
rule's path; of those that fit, the longest wins. The pages that a rule judges are the labelled
outcomes. Every host's rate of blocked pages is shrunk: a beta prior for the host comes from its
registered domain, the domain's from its suffix, the suffix's from all pages. A prior's strength is
estimated by the method of moments from how the rates of the level's members scatter (bounded to
1..1000 pages). A page without a rule is blocked if the lower posterior bound (mean minus ``z``
standard deviations of the beta posterior) of its host's rate is above ``limit``.

Hosts: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. The suffix is the
last label, the registered domain the last two (a parameterised list of two-label suffixes adds one).

Edge cases: a null url or one without ``://`` has an empty host and path, which is a host like any
other with no labelled outcome of its own: the prior judges it. With no labelled page at all, the
rate is one half with the weakest prior and nothing is blocked. Repeated rows count as often as they
stand there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (host, path, verdict): fixed values of the query's contract.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
Z, LIMIT = 1.6449, 0.5
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as host + path, verdict) of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def registered(host: Column, two_label_suffixes: tuple[str, ...] = ()) -> tuple[Column, Column]:
    suffix = F.substring_index(host, ".", -1)
    domain = F.substring_index(host, ".", -2)
    if two_label_suffixes:
        two = domain.isin(*two_label_suffixes)
        return F.when(two, F.substring_index(host, ".", -3)).otherwise(domain), F.when(two, domain).otherwise(suffix)
    return domain, suffix


def _strength(members: DataFrame, parent: str) -> DataFrame:
    """Per parent: pages seen, blocked ones, and the prior strength its members' scatter implies."""
    rate = F.col("bad") / F.col("n")
    found = members.where("n > 0").groupBy(parent).agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("k"),
        F.sum(F.col("n") * rate * rate).alias("square"), F.sum(F.col("n") * F.col("n")).cast("double").alias("nn"),
    )
    mean = F.col("bad") / F.col("n")
    spread = F.col("square") / F.col("n") - mean * mean  # weighted variance of the members' rates
    noise = mean * (1 - mean) * F.col("k") / F.col("n")
    true = spread - noise * (F.col("k") - 1) / F.col("k")
    strength = F.when(true > 0, mean * (1 - mean) / true - 1).otherwise(F.lit(MOST_STRENGTH))
    strength = F.least(F.greatest(F.round(strength, 6), F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH))
    return found.select(parent, "n", "bad", F.when(F.col("k") > 1, strength).otherwise(LEAST_STRENGTH).alias("strength"))


def reputation(labelled: DataFrame) -> DataFrame:
    """host, alpha, beta of each host, from rows (host, domain, suffix, n labelled pages, bad ones) per host."""
    suffixes = _strength(labelled.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "suffix")
    domains = _strength(labelled, "domain").join(labelled.select("domain", "suffix").distinct(), "domain", "right")
    # Of all pages; suffixes are few, and a row of totals is one row.
    whole = _strength(suffixes.withColumn("all", F.lit(1)).select("all", "n", "bad"), "all").select(
        F.col("n").alias("wn"), F.col("bad").alias("wbad"), F.col("strength").alias("ws")
    )
    total = whole.agg(F.coalesce(F.sum("wn"), F.lit(0)).alias("wn"), F.coalesce(F.sum("wbad"), F.lit(0)).alias("wbad"), F.coalesce(F.max("ws"), F.lit(LEAST_STRENGTH)).alias("ws"))
    base = total.select(((F.col("wbad") + 0.5) / (F.col("wn") + 1)).alias("wrate"), "ws").first()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    s = labelled.select("suffix").distinct().join(suffixes, "suffix", "left")
    s = s.select("suffix", ((zero("bad") + base["wrate"] * base["ws"]) / (zero("n") + base["ws"])).alias("srate"), F.coalesce("strength", F.lit(LEAST_STRENGTH)).alias("ss"))
    d = domains.join(s, "suffix", "left")
    d = d.select("domain", ((zero("bad") + F.col("srate") * F.col("ss")) / (zero("n") + F.col("ss"))).alias("drate"), F.coalesce("strength", F.lit(LEAST_STRENGTH)).alias("ds"))
    h = labelled.join(d, "domain")
    return h.select("host", (F.col("bad") + F.col("drate") * F.col("ds")).alias("alpha"), (F.col("n") - F.col("bad") + (1 - F.col("drate")) * F.col("ds")).alias("beta"))


def judge(pages: DataFrame, key: str = "page_id", url_col: str = "url", rules=RULES, z: float = Z, limit: float = LIMIT, two_label_suffixes: tuple[str, ...] = ()) -> DataFrame:
    """key, host, path, rule, verdict, and the posterior bound that judged pages without a rule.

    ``two_label_suffixes`` (such as co.uk) goes into the plan as a list: some thousands at most.
    """
    host, path = split_url(F.col(url_col))
    cut = pages.select(F.col(key).alias("page_key"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    cut = cut.withColumn("rule", rule).withColumn("ruled", verdict)
    domain, suffix = registered(F.col("host"), two_label_suffixes)
    # Reduced to a row per host before it is shuffled, however many pages a host has.
    per_host = cut.groupBy("host").agg(F.count("ruled").alias("n"), F.count_if(F.col("ruled") == "block").alias("bad"))
    known = reputation(per_host.withColumn("domain", domain).withColumn("suffix", suffix))
    a, b = F.col("alpha"), F.col("beta")
    bound = a / (a + b) - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    # One row per host on the right; a hot host's pages are split by the skew join.
    out = cut.join(known, "host", "left").withColumn("bound", F.round(bound, 9))
    verdict = F.coalesce("ruled", F.when(F.col("bound") > limit, "block").otherwise("allow"))
    return out.select(F.col("page_key").alias(key), "host", "path", "rule", verdict.alias("verdict"), "bound")


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).drop("bound")


OP6_SQL = """
WITH u AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
c AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/' WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM c),
v AS (SELECT *, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS ruled,
  regexp_extract(host, '([^.]*\\.)?[^.]*$') AS domain, regexp_extract(host, '[^.]*$') AS suffix FROM r),
h AS (SELECT host, any_value(domain) AS domain, any_value(suffix) AS suffix, CAST(count(ruled) AS DOUBLE) AS n, CAST(count(*) FILTER (ruled = 'block') AS DOUBLE) AS bad FROM v GROUP BY host),
dm AS (SELECT domain AS parent, n, bad FROM h WHERE n > 0), sm AS (SELECT suffix AS parent, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY suffix, domain HAVING sum(n) > 0),
da AS (SELECT parent, sum(n) AS n, sum(bad) AS bad, CAST(count(*) AS DOUBLE) AS k, sum(bad * bad / n) AS square FROM dm GROUP BY parent),
sa AS (SELECT parent, sum(n) AS n, sum(bad) AS bad, CAST(count(*) AS DOUBLE) AS k, sum(bad * bad / n) AS square FROM sm GROUP BY parent),
wa AS (SELECT sum(n) AS n, sum(bad) AS bad, CAST(count(*) AS DOUBLE) AS k, sum(bad * bad / n) AS square FROM sa),
every AS (SELECT 'd' AS level, * FROM da UNION ALL SELECT 's', * FROM sa UNION ALL SELECT 'w', '', * FROM wa WHERE n > 0),
m AS (SELECT *, bad / n AS mean, square / n - (bad / n) * (bad / n) - (bad / n) * (1 - bad / n) * k / n * (k - 1) / k AS spread FROM every),
st AS (SELECT level, parent, n, bad, CASE WHEN k > 1 THEN CASE WHEN spread > 0 THEN least(greatest(mean * (1 - mean) / spread - 1, 1), 1000) ELSE 1000 END ELSE 1 END AS strength FROM m),
w AS (SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1) AS rate, coalesce(max(strength), 1) AS strength FROM st WHERE level = 'w'),
s AS (SELECT x.suffix, (coalesce(st.bad, 0) + w.rate * w.strength) / (coalesce(st.n, 0) + w.strength) AS rate, coalesce(st.strength, 1) AS strength FROM (SELECT DISTINCT suffix FROM h) x CROSS JOIN w LEFT JOIN st ON st.level = 's' AND st.parent = x.suffix),
d AS (SELECT x.domain, (coalesce(st.bad, 0) + s.rate * s.strength) / (coalesce(st.n, 0) + s.strength) AS rate, coalesce(st.strength, 1) AS strength FROM (SELECT DISTINCT domain, suffix FROM h) x JOIN s USING (suffix) LEFT JOIN st ON st.level = 'd' AND st.parent = x.domain),
ab AS (SELECT h.host, h.bad + d.rate * d.strength AS a, h.n - h.bad + (1 - d.rate) * d.strength AS b FROM h JOIN d USING (domain))
SELECT page_id, v.host, path, rule, coalesce(ruled, CASE WHEN a / (a + b) - 1.6449 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict FROM v JOIN ab ON ab.host = v.host
"""
