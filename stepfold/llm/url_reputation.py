"""Host reputation by empirical Bayes, with URL rules that overrule it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    found = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(found, F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


#: Public suffixes of two labels, below which others register domains.
SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "net.au", "org.au", "org.uk")


def suffix(name: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The public suffix of a host: its last two labels if they are one, else the last label."""
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(list(suffixes)), two).otherwise(F.substring_index(name, ".", -1))


def domain(name: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The registered domain of a host: its public suffix and the label before that, if there is one."""
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(list(suffixes)), F.substring_index(name, ".", -3)).otherwise(two)


def rule_for(name: Column, where: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does. Ties go to the rule named first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # Rules are a parameter; the longest is tried first.
    for text, says in sorted(reversed(rules), key=lambda r: len(r[0])):
        of, _, begin = text.partition("/")
        fits = ((name == of) | name.endswith("." + of)) & where.startswith("/" + begin)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _shrunk(level: DataFrame, up: DataFrame | None, key: str, parent: str | None, strength: float) -> DataFrame:
    """Posterior of each key's share of bad pages under a beta prior with its parent's mean and ``strength`` pages of weight."""
    if up is None:
        total = level.agg(F.sum("bad").alias("b"), F.sum("n").alias("m"))
        prior = level.crossJoin(total).withColumn("prior", (F.col("b") + 1) / (F.col("m") + 2)).drop("b", "m")  # a single row
    else:
        prior = level.join(up.select(F.col(parent), F.col("mean").alias("prior")), parent)
    alpha, beta = F.col("bad") + strength * F.col("prior"), F.col("n") - F.col("bad") + strength * (1 - F.col("prior"))
    mean = alpha / (alpha + beta)
    return prior.select(*[c for c in (key, parent) if c], "n", "bad", mean.alias("mean"),
                        F.sqrt(mean * (1 - mean) / (alpha + beta + 1)).alias("sd"))


def reputation(hosts: DataFrame, strength: float = 20.0) -> DataFrame:
    """Posterior mean and deviation of each host's share of bad pages.

    ``hosts``: one row per host with ``n`` labelled pages, ``bad`` ones among them (0, 0 where nothing is labelled). The prior of
    a host is the posterior mean of its registered domain, that one's prior the public suffix, and the
    suffix's prior the mean of all. An unlabelled host gets its domain's.
    """
    named = hosts.select("host", domain(F.col("host")).alias("domain"), suffix(F.col("host")).alias("suffix"), "n", "bad")
    by_domain = named.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = _shrunk(by_suffix, None, "suffix", None, strength)
    domains = _shrunk(by_domain, suffixes, "domain", "suffix", strength)
    return _shrunk(named, domains, "host", "domain", strength)


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = (), strength: float = 20.0, z: float = 1.0,
          lift: float = 1.0) -> DataFrame:
    """``pages`` with host, path, rule, verdict, and the host's posterior.

    ``outcomes``: (page_id, bad) of labelled pages; several for a page all count. A page that no rule fits is blocked if the lower
    bound of its host's posterior, ``z`` deviations below the mean, exceeds ``lift`` times the share of bad pages among all labelled ones (with one bad
    and one good page added): hosts that are probably worse than the rest are lost. At 1 deviation, that is five in six, as a
    normal distribution has it; a beta posterior of ``strength`` pages and more is near one.
    A null url, or one without ``://``, has an empty host and path, which no rule fits, and is judged as the host ``''``.
    Pages are summed by host before anything moves, and the hosts' table is joined back; Spark splits a hot host there.
    """
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "host_mean", "host_sd")]
    seen = outcomes.groupBy("page_id").agg(F.count("bad").alias("__n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("__bad"))
    keyed = pages.select("page_id", host(F.col("url")).alias("host")).join(seen, "page_id", "left")
    hosts = keyed.groupBy("host").agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n"), F.coalesce(F.sum("__bad"), F.lit(0)).alias("bad"))
    overall = hosts.agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("overall"))  # a single row
    known = reputation(hosts, strength).crossJoin(overall).select(F.col("host").alias("__host"), "mean", "sd", "overall")
    out = pages.select(*own, host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("mean") - z * F.col("sd") > lift * F.col("overall"), "block").otherwise("allow")
    return (out.join(known, F.col("host") == F.col("__host"), "left")
            .select(*own, "host", "path", rule.alias("rule"), F.coalesce(says, learned).alias("verdict"),
                    F.col("mean").alias("host_mean"), F.col("sd").alias("host_sd")))


#: Rules of the query, longest wins.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

OP5_SQL = r"""
WITH split AS (SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
outcomes AS (SELECT page_id, CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END AS bad
    FROM pages JOIN labels ON doc_id = TRY_CAST(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS BIGINT)),
seen AS (SELECT page_id, count(bad) AS n, sum(bad) AS bad FROM outcomes GROUP BY page_id),
hosts AS (SELECT host, coalesce(sum(n), 0) AS n, coalesce(sum(bad), 0) AS bad FROM split LEFT JOIN seen USING (page_id) GROUP BY host),
named AS (SELECT host, n, bad, CASE WHEN two IN ('ac.uk', 'co.in', 'co.jp', 'co.kr', 'co.nz', 'co.uk', 'co.za', 'com.au', 'com.br', 'com.cn', 'com.mx', 'com.tr',
        'gov.uk', 'net.au', 'org.au', 'org.uk') THEN regexp_extract(host, '([^.]*\.)?[^.]*\.[^.]*$') ELSE two END AS domain,
    CASE WHEN two IN ('ac.uk', 'co.in', 'co.jp', 'co.kr', 'co.nz', 'co.uk', 'co.za', 'com.au', 'com.br', 'com.cn', 'com.mx', 'com.tr',
        'gov.uk', 'net.au', 'org.au', 'org.uk') THEN two ELSE regexp_extract(host, '[^.]*$') END AS suffix
    FROM (SELECT *, regexp_extract(host, '([^.]*\.)?[^.]*$') AS two FROM hosts)),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM named GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix),
top AS (SELECT suffix, (bad + 20.0 * p) / (n + 20.0) AS mean FROM suffixes, (SELECT (sum(bad) + 1.0) / (sum(n) + 2.0) AS p FROM suffixes)),
mid AS (SELECT domain, (d.bad + 20.0 * t.mean) / (d.n + 20.0) AS mean FROM domains d JOIN top t USING (suffix)),
low AS (SELECT host, (h.bad + 20.0 * m.mean) / (h.n + 20.0) AS mean, h.n + 20.0 AS w FROM named h JOIN mid m USING (domain)),
ruled AS (SELECT s.*, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM split s)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN mean - 1.0 * sqrt(mean * (1 - mean) / (w + 1)) > (SELECT (sum(bad) + 1.0) / (sum(n) + 2.0) FROM hosts) THEN 'block' ELSE 'allow' END AS verdict, mean AS host_mean
FROM ruled JOIN low USING (host)
"""
