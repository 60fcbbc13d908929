"""URL filters: rules of hosts and paths, and where none fits, the reputation of the host, by empirical Bayes.

Labelled pages give each host a number of outcomes and of good ones. A host's rate of good pages is drawn from a beta
distribution around the rate of its registered domain, that from one around its suffix, that from one around all pages.
How tightly the units of a level hold to their parents (the prior's weight, in pages) is estimated from all units of the
level at once, by moments; a host of few outcomes therefore reads as its domain does, one of many as itself. A page is
blocked if the upper bound of its host's posterior is under ``min_good``: only what is surely bad goes.

Expressions only. Outcomes are added up by host in each task before a shuffle, so a host with a third of all pages is one
row a task; levels are computed over hosts, one row each; one join brings reputation and rules back to the pages, as a
plain shuffle join whose hot partitions Spark splits. html is never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, staged, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: host, path, verdict.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Suffixes of two labels under which names are registered; any other suffix has one label.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "co.za", "com.br", "com.cn", "com.tr", "co.in", "co.kr")
#: A posterior's upper bound is its mean and so many standard deviations; hosts whose bound is below MIN_GOOD are blocked.
SIGMAS, MIN_GOOD = 1.645, 0.5
#: Least and greatest weight of a prior, in pages.
LEAST_PRIOR, MOST_PRIOR = 0.5, 10_000.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A to Z lower-cased) and path of a URL; both empty for null and where there is no ``://``."""
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def registered(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[Column, Column]:
    """Suffix and registered domain of a host, without user and port; of a bare suffix, both are the host itself."""
    name = F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r":[0-9]*$", "")
    last = lambda n: F.substring_index(name, ".", -n)
    two = last(2).isin(*suffixes) if suffixes else F.lit(False)
    return F.when(two, last(2)).otherwise(last(1)), F.when(two, last(3)).otherwise(last(2))


def _shrunk(units: DataFrame) -> DataFrame:
    """units (n, x: outcomes and good ones; prior: the parent's rate) with ``weight``, the prior's, and ``rate``, the posterior's."""
    spread = F.col("prior") * (1 - F.col("prior"))
    moments = units.agg(
        F.sum((F.col("x") - F.col("n") * F.col("prior")) ** 2 - F.col("n") * spread).alias("over"),
        F.sum(F.col("n") * (F.col("n") - 1) * spread).alias("pairs"),
    )
    # Beta-binomial variance: n p (1 - p) (1 + (n - 1) rho), and the prior weighs 1 / rho - 1 pages.
    over, pairs = moments.first()  # two numbers
    least, most = 1 / (MOST_PRIOR + 1), 1 / (LEAST_PRIOR + 1)
    weight = 1 / (max(least, min(most, over / pairs)) if pairs else least) - 1
    return units.withColumn("weight", F.lit(weight)).withColumn("rate", (F.col("x") + F.col("weight") * F.col("prior")) / (F.col("n") + F.col("weight")))


def reputations(hosts: DataFrame, suffixes: tuple[str, ...] = SUFFIXES, sigmas: float = SIGMAS) -> DataFrame:
    """hosts (host, n, x) with ``reputation``, the posterior rate of good pages, and ``bound``, its upper bound.

    Hosts without outcomes (n = 0) have their domain's rate, and so on up; without any outcome at all, rates are one half.
    """
    suffix, domain = registered(F.col("host"), suffixes)
    hosts = hosts.select("*", suffix.alias("suffix"), domain.alias("domain"))
    domains = staged(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("x").alias("x")), "domains")
    tops = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    n, x = tops.agg(F.sum("n"), F.sum("x")).first()  # two numbers
    tops = staged(_shrunk(tops.withColumn("prior", F.lit(x / n if n else 0.5))).select("suffix", F.col("rate").alias("prior")), "suffixes")
    domains = staged(_shrunk(domains.join(tops.hint("merge"), "suffix")).select("domain", F.col("rate").alias("prior")), "domains")
    found = _shrunk(hosts.join(domains.hint("merge"), "domain"))
    a, b = F.col("weight") * F.col("prior") + F.col("x"), F.col("weight") * (1 - F.col("prior")) + F.col("n") - F.col("x")
    deviation = F.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
    return found.withColumn("reputation", F.col("rate")).withColumn("bound", F.col("rate") + sigmas * deviation).drop("suffix", "domain", "prior", "weight", "rate")


def rules_of(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): the rules (host, path, verdict) that fit a host or one above it, for hosts that have any.

    A host is looked up under as many of its endings as rules have labels, so the work is bounded by the rules' names.
    """
    labels = F.split("host", r"\.")
    depth = rules.agg(F.max(F.size(labels))).first()[0] or 1  # a number
    endings = let(labels, lambda said: F.transform(F.sequence(F.lit(1), F.least(F.size(said), F.lit(depth))), lambda k: F.array_join(F.slice(said, -k, k), ".")))
    names = hosts.select("host", F.explode(endings).alias("under"))
    held = rules.groupBy(F.col("host").alias("under")).agg(F.collect_list(F.struct(F.concat("host", "path").alias("rule"), "path", "verdict")).alias("rules"))
    return names.join(held, "under").groupBy("host").agg(F.flatten(F.collect_list("rules")).alias("rules"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: DataFrame, min_good: float = MIN_GOOD, suffixes: tuple[str, ...] = SUFFIXES, sigmas: float = SIGMAS) -> DataFrame:
    """page_id, host, path, rule, verdict, reputation, bound for every row of pages (page_id, url).

    outcomes: page_id, good (0 or 1; null counts for nothing), any number a page. rules: host, path, verdict (allow or
    block); of those that fit, the longest in characters decides, of equally long ones that of the longer host. A page
    that no rule fits is judged by its host's posterior. Null URLs and URLs without ``://`` share the empty host, which has
    a reputation as any other. Repeated pages are judged alike, and each counts for its host.
    """
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    said = outcomes.where("page_id is not null").groupBy("page_id").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("x"))
    seen = parts.select("page_id", "host").join(said, "page_id", "left")
    hosts = staged(seen.groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("x"), F.lit(0)).alias("x")), "hosts")
    known = reputations(hosts, suffixes, sigmas).select("host", "reputation", "bound").join(rules_of(hosts, rules).hint("merge"), "host", "left")
    known = staged(known, "judged").hint("merge")

    fits = F.filter(F.coalesce("rules", F.array()), lambda r: F.startswith(F.col("path"), r["path"]))
    ranked = F.transform(fits, lambda r: F.struct(F.char_length(r["rule"]).alias("long"), -F.char_length(r["path"]).alias("host"), r["rule"].alias("rule"), r["verdict"].alias("verdict")))
    best = let(ranked, lambda some: F.when(F.size(some) > 0, F.array_max(some)))
    joined = parts.join(known, "host").select("page_id", "host", "path", best.alias("best"), "reputation", "bound")
    own = F.when(F.col("bound") < min_good, "block").otherwise("allow")
    return joined.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", own).alias("verdict"), "reputation", "bound")


def op11_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes are the labels of quality, whose ids are read as those of pages."""
    pages, labels = table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels")
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    judged = judge(pages, labels.select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good")), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("reputation", 6).alias("reputation"))


def _shrunk_sql(name: str, units: str) -> str:
    """CTEs ``name``: units (n, x, prior and more) with weight and rate."""
    rho = "sum((x - n * prior) ** 2 - n * prior * (1 - prior)) / nullif(sum(n * (n - 1) * prior * (1 - prior)), 0)"
    least, most = 1 / (MOST_PRIOR + 1), 1 / (LEAST_PRIOR + 1)
    return f"""{name}_units AS ({units}),
{name}_weight AS (SELECT 1 / coalesce(CASE WHEN {rho} IS NOT NULL THEN greatest({least!r}::DOUBLE, least({most!r}::DOUBLE, {rho})) END, {least!r}::DOUBLE) - 1 AS weight FROM {name}_units),
{name} AS (SELECT *, (x + weight * prior) / (n + weight) AS rate FROM {name}_units CROSS JOIN {name}_weight)"""


_TWO = ", ".join(f"'{s}'" for s in SUFFIXES)
_FITS = lambda host, path: f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
_RANKED = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
OP11_SQL = rf"""
WITH rest AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
said AS (SELECT doc_id AS page_id, count(quality) AS n, coalesce(sum(quality), 0) AS x FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
named AS (SELECT host, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(x), 0)::DOUBLE AS x, string_split(regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':[0-9]*$', ''), '.') AS l FROM parts LEFT JOIN said USING (page_id) GROUP BY host),
hosts AS (
  SELECT host, n, x, CASE WHEN array_to_string(l[-2:], '.') IN ({_TWO}) THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix,
         CASE WHEN array_to_string(l[-2:], '.') IN ({_TWO}) THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain FROM named),
overall AS (SELECT coalesce(sum(x) / nullif(sum(n), 0), 0.5) AS prior FROM hosts),
{_shrunk_sql("tops", "SELECT suffix, sum(n) AS n, sum(x) AS x, any_value(prior) AS prior FROM hosts CROSS JOIN overall GROUP BY suffix")},
{_shrunk_sql("domains", "SELECT hosts.suffix, domain, sum(hosts.n) AS n, sum(hosts.x) AS x, any_value(tops.rate) AS prior FROM hosts JOIN tops ON hosts.suffix = tops.suffix GROUP BY ALL")},
{_shrunk_sql("judged", "SELECT hosts.host, hosts.n, hosts.x, domains.rate AS prior FROM hosts JOIN domains ON hosts.domain = domains.domain AND hosts.suffix = domains.suffix")},
bounds AS (SELECT host, rate, weight * prior + x AS a, weight * (1 - prior) + n - x AS b FROM judged),
known AS (SELECT host, rate, rate + {SIGMAS} * sqrt(a * b / ((a + b) ** 2 * (a + b + 1))) AS bound FROM bounds)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {_FITS(h, p)} THEN '{h}{p}'" for h, p, _ in _RANKED)} END AS rule,
       CASE {" ".join(f"WHEN {_FITS(h, p)} THEN '{v}'" for h, p, v in _RANKED)} WHEN bound < {MIN_GOOD} THEN 'block' ELSE 'allow' END AS verdict, round(rate, 6) AS reputation
FROM parts JOIN known USING (host)
"""
