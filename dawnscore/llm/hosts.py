"""URL filter: fixed rules first, else the empirical-Bayes reputation of the host.

Labelled page outcomes (good or bad) are counted per host, registered domain and suffix. Each level's
rate is a beta-binomial whose prior mean is the posterior mean of the level above (without the group's
own pages, which would count twice) and whose strength comes from the spread of that level's rates over the corpus (method of moments). A host is blocked if
the upper bound of its posterior rate of good pages lies under `floor`: few pages, or none, leave a
host near its domain, so that no single page condemns it.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dawnscore.llm.common import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The rules, (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]
# Suffixes of two labels under which names are registered; others have one label.
TWO_LABELS = ("co.uk", "org.uk", "ac.uk", "com.au", "net.au", "co.jp", "co.nz", "com.br", "co.in", "co.za")
FLOOR, Z = 0.5, 1.645
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0


@dataclass(frozen=True)
class Level:
    rate: float
    strength: float


def with_host_path(pages: DataFrame, url: str = "url") -> DataFrame:
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, parts, 1), UPPER, LOWER)
    return (pages.withColumn("host", F.coalesce(host, F.lit("")))
            .withColumn("path", F.coalesce(F.regexp_extract(url, parts, 2), F.lit(""))))


def suffix(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABELS), two).otherwise(F.substring_index(host, ".", -1))


def registered_domain(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABELS), F.substring_index(host, ".", -3)).otherwise(two)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Rule (host and path) and verdict of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, its_host, its_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == its_host) | host.endswith("." + its_host)) & path.startswith(its_path)
        rule = F.when(fits, its_host + its_path).otherwise(rule)
        verdict = F.when(fits, what).otherwise(verdict)
    return rule, verdict


def page_outcome(html: Column) -> Column:
    """Label from the page itself: good unless its text is short or full of symbols; null without html."""
    text = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<[^>]*>", " ")
    words = F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""))
    symbols = F.char_length(F.regexp_replace(text, r"[^#*$%|]", ""))
    return (words >= 50) & (symbols * 10 <= words * 3)


def _level(counts: DataFrame) -> Level:
    """Rate and prior strength of one level from counts (n, good) per group."""
    x = counts.agg(F.count("*").alias("j"), F.sum("n").alias("n"), F.sum("good").alias("k"),
                   F.sum(F.col("good") * F.col("good") / F.col("n")).alias("kk"),
                   F.sum(F.col("n") * F.col("n")).alias("nn")).first()
    if not x.n:
        return Level(0.5, LEAST_STRENGTH)
    rate = x.k / x.n
    within = rate * (1 - rate)
    spread = x.kk - x.n * rate * rate - (x.j - 1) * within
    room = x.n - x.nn / x.n
    between = spread / room if room > 0 else 0.0
    strength = within / between - 1 if between > 0 else MOST_STRENGTH
    return Level(rate, min(max(strength, LEAST_STRENGTH), MOST_STRENGTH))


def reputation(labelled: DataFrame) -> DataFrame:
    """host, n, rate, upper from rows (host, good); good may be null for unlabelled pages."""
    hosts = staged(labelled.groupBy("host").agg(
        F.count("good").alias("n"), F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0)).alias("good"))
        .withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", suffix(F.col("host"))),
        "host-counts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    top, middle, low = (_level(x.filter("n > 0")) for x in (suffixes, domains, hosts))

    def rest(prior: Column, strength: float) -> Column:
        """Posterior mean of the level above from its other members, so that no page counts twice."""
        return ((prior * strength + F.col("all_good") - F.col("good"))
                / (F.col("all_n") - F.col("n") + strength))

    above = suffixes.select("suffix", F.col("n").alias("all_n"), F.col("good").alias("all_good"))
    per_domain = domains.join(above, "suffix").select(
        "domain", F.col("n").alias("all_n"), F.col("good").alias("all_good"),
        rest(F.lit(top.rate), top.strength).alias("above"))
    known = hosts.join(per_domain, "domain").withColumn("prior", rest(F.col("above"), middle.strength))
    rate = (F.col("prior") * low.strength + F.col("good")) / (F.col("n") + low.strength)
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + low.strength + 1))
    return staged(known.withColumn("rate", rate)
                  .select("host", "n", "rate", (F.col("rate") + Z * deviation).alias("upper")), "host-reputation")


def filter_urls(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", good: Column | None = None,
                rules: list[tuple[str, str, str]] | None = None, floor: float = FLOOR) -> DataFrame:
    """page_id, host, path, rule, verdict, n_labelled, good_upper per row of pages.

    Null urls and urls without :// have an empty host and path; they form one host of their own.
    `good` is the outcome of a page (null: unlabelled); by default it is read from `html`. Hosts
    without outcomes get their domain's prior. Repeated rows count and are returned each. An empty
    table gives no rows. Other columns are not read.
    """
    picked = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"),
                          (page_outcome(F.col("html")) if good is None else good).alias("good"))
    judged = with_host_path(picked)
    known = reputation(judged.select("host", "good"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules)
    left = with_host_path(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")))
    return (left.join(known, "host")
            .select("page_id", "host", "path", rule.alias("rule"),
                    F.coalesce(verdict, F.when(F.col("upper") < floor, "block").otherwise("allow")).alias("verdict"),
                    F.col("n").alias("n_labelled"), F.round("upper", 6).alias("good_upper")))


_TWO = ", ".join(f"'{x}'" for x in TWO_LABELS)


def _levels_sql(name: str) -> str:
    return f"""
{name}_sum AS (
  SELECT count(*) AS j, sum(n)::DOUBLE AS n, sum(good)::DOUBLE AS k, sum(good * good / n::DOUBLE) AS kk,
         sum(n * n)::DOUBLE AS nn FROM {name} WHERE n > 0),
{name}_raw AS (
  SELECT n, k / n AS rate, k / n * (1 - k / n) AS within, j,
         (kk - n * (k / n) * (k / n) - (j - 1) * (k / n * (1 - k / n))) AS spread, n - nn / n AS room FROM {name}_sum),
{name}_level AS (
  SELECT CASE WHEN n > 0 THEN rate ELSE 0.5 END AS rate,
         CASE WHEN n IS NULL THEN {LEAST_STRENGTH} WHEN room > 0 AND spread / room > 0
              THEN least(greatest(within / (spread / room) - 1, {LEAST_STRENGTH}), {MOST_STRENGTH})
              ELSE {MOST_STRENGTH} END AS strength FROM {name}_raw)"""


def _rules_sql() -> tuple[str, str]:
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN " for _, h, p in rules]
    return (" ".join(f"{w}'{h}{p}'" for w, (_, h, p) in zip(fits, rules, strict=True)),
            " ".join(f"{w}'{v}'" for w, (v, _, _) in zip(fits, rules, strict=True)))


def oracle_sql() -> str:
    rule, verdict = _rules_sql()
    parts = r"'(?s)^.*?://([^/?#]*)([^?#]*)'"
    return f"""
WITH cut AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, {parts}, 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, {parts}, 2), '') AS path,
         regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<[^>]*>', ' ', 'g') AS body FROM pages),
facts AS (
  SELECT page_id, host, path,
         len(list_filter(string_split_regex(body, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS words,
         length(regexp_replace(body, '[^#*$%|]', '', 'g')) AS symbols FROM cut),
judged AS (SELECT page_id, host, path, (words >= 50 AND symbols * 10 <= words * 3) AS good FROM facts),
hosts AS (
  SELECT host, count(good) AS n, coalesce(sum(good::BIGINT), 0) AS good, split_part(host, '.', -1) AS last_label,
         array_to_string(string_split(host, '.')[-2:], '.') AS two,
         array_to_string(string_split(host, '.')[-3:], '.') AS three
  FROM judged GROUP BY host),
named AS (
  SELECT host, n, good, CASE WHEN two IN ({_TWO}) THEN two ELSE last_label END AS suffix,
         CASE WHEN two IN ({_TWO}) THEN three ELSE two END AS domain FROM hosts),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM named GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM domains GROUP BY ALL),
{_levels_sql("suffixes")}, {_levels_sql("domains")}, {_levels_sql("named")},
per_domain AS (
  SELECT domain, domains.n AS all_n, domains.good AS all_good,
         (rate * strength + suffixes.good - domains.good) / (suffixes.n - domains.n + strength) AS above
  FROM domains JOIN suffixes USING (suffix), suffixes_level),
primed AS (
  SELECT host, n, good, (above * strength + all_good - good) / (all_n - n + strength) AS prior
  FROM named JOIN per_domain USING (domain), domains_level),
rated AS (
  SELECT host, n, strength, (prior * strength + good) / (n + strength) AS rate FROM primed, named_level),
bounded AS (SELECT host, n, rate + {Z} * sqrt(rate * (1 - rate) / (n + strength + 1)) AS upper FROM rated)
SELECT page_id, host, path, CASE {rule} END AS rule,
       coalesce(CASE {verdict} END, CASE WHEN upper < {FLOOR} THEN 'block' ELSE 'allow' END) AS verdict,
       n AS n_labelled, round(upper, 6) AS good_upper
FROM judged JOIN bounded USING (host)"""
