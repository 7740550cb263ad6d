"""URL filters by expansion and hash prefixes.

A URL is expanded into host-suffix and path-prefix expressions, as block lists
of the safe-browsing kind do.  The expressions meet the rules in an equi-join
on the first four bytes of their SHA-256; the full digests confirm a match, and
the longest rule wins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, SALTS, ascii_lower, join_counted, settle


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


#: What a URL gets that no rule fits.
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))
    return F.coalesce(ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "host string, path string, verdict string")


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = DEFAULT) -> DataFrame:
    """The verdict on every row of ``pages``: page_id, host, path, rule, verdict.

    ``rules`` (host, path, verdict) is a DataFrame of any size.  A rule fits its
    host and all subdomains if the path starts with the rule's.  The rule with
    the longest host plus path wins; then the longer host, then ``block``.  Null
    URLs and those without ``://`` have empty host and path, which no rule with
    a host fits; their verdict is ``default`` and their rule null.  Equal URLs
    are judged once and share the verdict; each row of ``pages`` is returned.
    """
    sha = lambda c: F.unhex(F.sha2(c.cast("binary"), 256))
    prefix = lambda d: F.substring(d, 1, 4)
    ruled = (
        rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
        .dropna()
        .withColumn("r_digest", sha(F.concat("r_host", F.lit("\n"), "r_path")))
        .withColumn("short", prefix(F.col("r_digest")))
    )
    n_rules = ruled.count()
    # how long the path prefixes and host suffixes of a rule are: no others need expanding
    lengths = sorted(r[0] for r in ruled.select(F.char_length("r_path")).distinct().collect())
    counts = sorted(r[0] for r in ruled.select(F.size(F.split("r_host", r"\.", -1))).distinct().collect())
    keyed = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("_url"))
    asks = keyed.filter("_url is not null")
    total = asks.count()
    urls = asks.groupBy("_url").agg(F.count("*").alias("copies")).withColumn("host", host_of(F.col("_url"))).withColumn("path", path_of(F.col("_url")))
    labels = F.split("host", r"\.", -1)
    fits = F.filter(F.array(*[F.lit(k) for k in counts]).cast("array<int>"), lambda k: k <= F.size("labels"))
    suffixes = F.transform(fits, lambda k: F.concat_ws(".", F.slice("labels", F.size("labels") - k + 1, k)))
    starts = F.transform(F.filter(F.array(*[F.lit(k) for k in lengths]).cast("array<int>"), lambda k: k <= F.char_length("path")), lambda k: F.substring(F.col("path"), F.lit(1), k))
    asked = (
        urls.withColumn("labels", labels).withColumn("_h", F.explode(suffixes)).withColumn("_p", F.explode(starts))
        .select("_url", "copies", sha(F.concat("_h", F.lit("\n"), "_p")).alias("digest"))
        .withColumn("short", prefix(F.col("digest")))
    )
    if n_rules <= BROADCAST_ROWS:
        met = asked.join(F.broadcast(ruled), "short")
    else:  # expressions of a common host are hot; the rules are copied to meet them
        met = asked.withColumn("_salt", F.pmod(F.hash("_url"), F.lit(SALTS))).join(ruled.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["short", "_salt"])
    rank = F.struct((F.char_length("r_host") + F.char_length("r_path")).alias("n"), F.char_length("r_host").alias("h"), (F.col("r_verdict") == "block").alias("b"))
    best = met.filter(F.col("digest") == F.col("r_digest")).groupBy("_url", "copies").agg(F.max(F.struct(rank.alias("rank"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))).alias("win"))
    # most URLs may have no rule, a popular one stands in many rows, and null is no URL
    judged = join_counted(asks, settle(best), "_url", "copies", total).unionByName(keyed.filter("_url is null"), allowMissingColumns=True)
    return judged.select(
        "page_id", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"), F.col("win.rule").alias("rule"), F.coalesce(F.col("win.verdict"), F.lit(default)).alias("verdict")
    )


#: The rules of the query, as dealt.
RULES = [
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
]

ORACLE = """
with parts as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
split as (select row_number() over () as n, page_id,
    translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from parts),
rules(rh, rp, rv) as (values %s),
fits as (select n, arg_max(rh || rp, length(rh || rp)) as rule, arg_max(rv, length(rh || rp)) as verdict
    from split, rules where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by n)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from split left join fits using (n)
""" % ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)
