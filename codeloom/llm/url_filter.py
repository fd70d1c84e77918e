"""URL filters: fixed rules first, then the reputation of the host by empirical Bayes.

Labelled pages give each host a count of bad outcomes. Rates are shrunk from the top down: the suffix towards the whole
table, the registered domain towards its suffix, the host towards its domain, each through a beta-binomial prior whose strength comes from
how much rates at that level differ (method of moments). A host is blocked when the lower posterior bound of its bad rate is high.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import written

#: Verdict, host, path; a rule fits its host and all subdomains.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Standard deviations below the posterior mean at which the bound lies, and the bad rate from which it blocks.
BOUND_SD, BLOCK_RATE = 1.64, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Public suffixes of two labels, some common ones; any other suffix is the last label.
TWO_LABELS = ("ac.uk", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.hk", "com.mx", "com.sg", "com.tr", "com.tw", "edu.au", "edu.cn", "go.jp", "gov.au", "gov.br", "gov.cn", "gov.in", "gov.uk", "ne.jp", "net.au", "net.cn", "or.jp", "org.au", "org.br", "org.cn", "org.nz", "org.uk", "org.za")
#: Labelled suffixes, and hosts to block (some 60 bytes each), up to which they are broadcast; parts that the pages of a host are dealt into beyond that.
BROADCAST_SUFFIXES, BROADCAST_HOSTS, SALTS = 100_000, 500_000, 16
LEVELS = ("suffix", "domain", "host")


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host after the first ``://``, A-Z lower-cased; both empty for null or where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^([^?#]*)", 1)
    empty = F.lit("")
    return F.coalesce(F.translate(host, UPPER, LOWER), empty), F.coalesce(path, empty)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for outcome, name, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):  # a longer one overrides
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        rule, verdict = F.when(fits, name + prefix).otherwise(rule), F.when(fits, outcome).otherwise(verdict)
    return rule, verdict


def site_of(host: Column) -> Column:
    """The host without user, port and final dots: what reputations belong to."""
    return F.regexp_replace(F.regexp_replace(F.substring_index(host, "@", -1), ":[0-9]*$", ""), "\\.+$", "")


def with_levels(df: DataFrame, two_labels: tuple[str, ...] = TWO_LABELS) -> DataFrame:
    """Adds the suffix of ``host`` (one of ``two_labels``, else its last label) and the registered domain (one label more).

    A numeric address has no domain: all levels are the address itself.
    """
    address = F.col("host").rlike("^[0-9]+(\\.[0-9]+){3}$") | F.col("host").startswith("[")
    last = lambda n: F.substring_index("host", ".", -n)
    two = last(2).isin(*two_labels) if two_labels else F.lit(False)
    level = lambda n: F.when(address, F.col("host")).when(two, last(n + 1)).otherwise(last(n))
    return df.withColumn("domain", level(2)).withColumn("suffix", level(1))


def _strength(children: DataFrame, parent_rate: Column) -> DataFrame:
    """One row: the prior's strength from the spread of the children's rates around their parents', between 1 and 1000.

    Sums are of n * (rate - parent)^2 against the binomial variance; fewer differences than chance explains mean a strong prior.
    """
    m = parent_rate
    spread = F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - m, 2) - m * (1 - m)) / F.sum("n")
    binomial = F.sum(F.col("n") * m * (1 - m)) / F.sum("n")
    return children.agg(F.coalesce(F.when(spread <= 0, F.lit(1000.0)).otherwise(F.least(F.lit(1000.0), F.greatest(F.lit(1.0), binomial / spread - 1))), F.lit(1.0)).alias("k"))


def level_rates(outcomes: DataFrame) -> dict[str, DataFrame]:
    """(host, bad: 0 or 1[, n: that many such pages]) -> for each of LEVELS: (key, n, up: posterior mean of the bad rate, k: the level's strength).

    Counts are gathered by host before anything else; a hot host costs one row per task. The strengths are one-row results.
    """
    n = F.col("n") if "n" in outcomes.columns else F.lit(1)
    by_host = outcomes.where("bad is not null and host is not null").groupBy(site_of(F.col("host")).alias("host")).agg(F.sum(n).alias("n"), F.sum(F.col("bad") * n).alias("bad"))
    counts = with_levels(written(by_host, "host-counts"))
    total = counts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    above = counts.select("suffix").distinct().withColumn("up", F.lit(((total["bad"] or 0) + 1) / ((total["n"] or 0) + 2)))
    levels = {}
    for level in LEVELS:
        key = level
        parent = "suffix" if level == "suffix" else LEVELS[LEVELS.index(level) - 1]
        sums = counts.groupBy(*dict.fromkeys((parent, key))).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        children = sums.join(above.select(F.col(parent).alias("p_"), "up"), F.col(parent) == F.col("p_")).drop("p_")
        strength = _strength(children, F.col("up")).first()["k"]
        rate = (F.col("bad") + strength * F.col("up")) / (F.col("n") + strength)
        above = levels[level] = children.select(key, "n", rate.alias("up"), F.lit(strength).alias("k"))
    return levels


def _bound(rate: Column, n: Column, k: Column, bound_sd: float) -> Column:
    return rate - bound_sd * F.sqrt(rate * (1 - rate) / (n + k + 1))


def host_reputation(outcomes: DataFrame, bound_sd: float = BOUND_SD) -> DataFrame:
    """(host, bad: 0 or 1) -> (host, n, rate, bound): posterior mean of the bad rate and its lower bound, for each labelled host."""
    up, n, k = F.col("up"), F.col("n"), F.col("k")
    return level_rates(outcomes)["host"].select("host", "n", up.alias("rate"), _bound(up, n, k, bound_sd).alias("bound"))


def reputation_of(hosts: DataFrame, outcomes: DataFrame, bound_sd: float = BOUND_SD) -> DataFrame:
    """(host) -> (host, n, rate, bound), one row per distinct host.

    Hosts are sites, as ``site_of`` gives them. A host without labels has n = 0 and the rate of its domain, else of its suffix; null if that has no label either.
    """
    levels = level_rates(outcomes)
    out = with_levels(hosts.where("host <> ''").select("host").distinct())
    k = levels["host"].agg(F.coalesce(F.max("k"), F.lit(1.0))).first()[0]
    for level, rates in levels.items():
        side = written(rates.select(F.col(level).alias("key_"), F.col("up").alias(f"up_{level}"), F.col("n").alias(f"n_{level}")), f"{level}-rates")
        side = F.broadcast(side) if level == "suffix" and side.count() <= BROADCAST_SUFFIXES else side
        out = out.join(side, F.col(level) == F.col("key_"), "left").drop("key_")
    rate, n = F.coalesce("up_host", "up_domain", "up_suffix"), F.coalesce("n_host", F.lit(0))
    return out.select("host", n.alias("n"), rate.alias("rate"), _bound(rate, n, F.lit(k), bound_sd).alias("bound"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, block_rate: float = BLOCK_RATE, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """(page_id, url, ...) and labelled outcomes (host, bad) -> (page_id, host, path, rule, verdict), one row per input row.

    Without a rule, a host whose bound is at least ``block_rate`` is blocked; a host without labels is judged by its domain or else its
    suffix. A host whose suffix has no label either, an empty host and a null url are allowed. Repeated rows and rows without page_id are judged one by one; further columns are ignored.
    """
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict).withColumn("site", site_of(F.col("host")))
    unruled = rows.where("rule is null").select(F.col("site").alias("host"))
    blocked = written(reputation_of(unruled, outcomes).where(F.col("bound") >= block_rate).select(F.col("host").alias("host_")), "blocked-hosts")
    if blocked.count() <= broadcast_hosts:
        judged = rows.join(F.broadcast(blocked), (rows.site == blocked.host_) & rows.rule.isNull(), "left")
    else:  # a hot host's pages are dealt into parts
        salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
        rows, blocked = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS))), blocked.withColumn("salt_", salts)
        judged = rows.join(blocked, (rows.site == blocked.host_) & (rows.salt == blocked.salt_) & rows.rule.isNull(), "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("host_").isNotNull(), "block").otherwise("allow")).alias("verdict"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad, n): the numbers of pages whose url's path ends in the number of a labelled document; bad if that is toxic or of low quality.

    A document labelled more than once is bad if any label says so; one without quality and toxic teaches nothing.
    """
    host, path = url_parts(F.col("url"))
    number = F.expr("try_cast(nullif(regexp_extract(path, '([0-9]+)[^0-9]*$', 1), '') as bigint)")
    rows = pages.select(host.alias("host"), path.alias("path")).select("host", number.alias("doc_id")).where("doc_id is not null and host <> ''")
    bad = F.greatest((F.col("quality") == 0).cast("int"), (F.col("toxic") == 1).cast("int"))
    marks = labels.groupBy("doc_id").agg(F.max(bad).alias("bad"))
    counted = rows.groupBy(site_of(F.col("host")).alias("host"), "doc_id").agg(F.count(F.lit(1)).alias("n"))  # before the join: paths of one number
    return counted.join(marks, "doc_id").select("host", "bad", "n")


def op10(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns; outcomes come from the labels of the documents that urls name."""
    return filter_urls(pages, page_outcomes(pages, labels))
