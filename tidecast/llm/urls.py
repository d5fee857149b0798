"""URL filter: rules of host and path prefix, joined with URLs by sorted sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecast.llm.common import small, stored, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything up to the first "://", then host and path.
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: URLs of one host that a sweep takes on; a host with more has several sweeps.
SWEEP_URLS = 500_000
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def host_of(url: Column | str) -> Column:
    """What follows the first ``://`` up to ``/``, ``?`` or ``#``, in lower case; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column | str) -> Column:
    """What follows the host up to ``?`` or ``#``; empty if there is none."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def host_key(host: Column | str) -> Column:
    """Labels from the last to the first, each with a dot after it: a host's subdomains are the keys that begin with its key."""
    return F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\.", -1))), F.lit("."))


def rule_hosts(host: Column, depth: int) -> Column:
    """Keys of a host and of the hosts around it, of ``depth`` labels at most."""

    def outer(labels: Column) -> Column:
        counts = F.sequence(F.lit(1), F.least(F.size(labels), F.lit(depth)))
        return F.transform(counts, lambda n: F.concat(F.concat_ws(".", F.slice(labels, F.lit(1), n)), F.lit(".")))

    return F.get(F.transform(F.array(F.reverse(F.split(host, r"\.", -1))), outer), F.lit(0))


def rule_stacks(rules: DataFrame) -> DataFrame:
    """``key, path, stack`` for each rule: the rules of its host that are open at its start, the longest path first.

    These are its own and those whose path is a prefix of its path. Only prefixes as long as some path of the host are tried.
    """
    rule = F.struct(F.length("path").alias("size"), "verdict", "host", "path")
    own = rules.groupBy("key", "path").agg(F.max(rule).alias("rule"))
    lengths = own.groupBy("key").agg(F.collect_set(F.length("path")).alias("sizes"))
    begins = F.transform(F.filter("sizes", lambda n: n <= F.length("path")), lambda n: F.substr("path", F.lit(1), n))
    around = own.join(lengths, "key").select("key", "path", F.explode(begins).alias("outer"))
    inside = around.join(own.select("key", F.col("path").alias("outer"), "rule"), ["key", "outer"])
    return inside.groupBy("key", "path").agg(F.sort_array(F.collect_list("rule"), asc=False).alias("stack"))


def judge_urls(df: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """The rule that decides on each URL, and its verdict.

    A rule (``verdict``, ``host``, ``path``) fits its host and all subdomains where the URL's path starts with its
    path. The longest (host and path together) wins, then the longer host, then ``block``; without a rule, ``default``
    holds.

    Hosts are keyed by their labels in reverse, so the hosts around a URL's host are the prefixes of its key. A URL goes to
    the sweep of each of them that has rules. A sweep sorts the paths of a host's rules and URLs together: a rule is an
    interval of paths, and intervals nest. It hands each URL the stack of rules open at the last start before it; the URL
    takes the first of them that has not ended. A stack holds nested rules only, never all rules of a host. A host with
    many URLs has more sweeps, one for each ``SWEEP_URLS``, and each of them reads the host's rules.

    Returns ``id_col, host, path, rule, verdict``, a row for each row of ``df``; other columns are not read. A null
    URL, or one without ``://``, has empty host and path. Rules with null host or path fit nothing; repeated rules
    count once. Without rules every verdict is ``default``.
    """
    urls = df.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")
    )
    urls = stored(urls, "urls")  # rows are joined by their number below
    host = F.translate("host", UPPER, LOWER)
    known = rules.where("host is not null and path is not null").select(
        host_key(host).alias("key"), host.alias("host"), "path", F.lower("verdict").alias("verdict")
    )
    known = stored(known.distinct(), "rules")
    depth = known.agg(F.max(F.size(F.split("host", r"\.", -1)))).first()[0] or 1

    meets = urls.select("row", "path", F.explode(rule_hosts(F.col("host"), depth)).alias("key")).join(small(known.select("key").distinct()), "key")
    sweeps = stored(meets.groupBy("key").agg(F.expr(f"count(1) DIV {SWEEP_URLS} + 1").alias("sweeps")), "sweeps")
    dealt = small(sweeps)
    turns = meets.join(dealt, "key").select("key", F.expr("pmod(xxhash64(row), sweeps)").alias("sweep"), "path", "row")
    starts = rule_stacks(known).join(dealt, "key").select("key", F.explode(F.expr("sequence(0L, sweeps - 1)")).alias("sweep"), "path", "stack")
    # a start has no row and goes before URLs of the same path
    order = Window.partitionBy("key", "sweep").orderBy("path", F.col("row").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = turns.unionByName(starts, allowMissingColumns=True).withColumn("open", F.last("stack", ignorenulls=True).over(order)).where("row IS NOT NULL")
    first = F.get(F.filter("open", lambda r: F.col("path").startswith(r["path"])), F.lit(0))
    ranked = F.struct(
        F.length(F.concat("fit.host", "fit.path")).alias("size"),
        F.length("fit.host").alias("host_size"),
        F.col("fit.verdict").alias("verdict"),
        F.concat("fit.host", "fit.path").alias("rule"),
    )
    best = swept.select("row", first.alias("fit")).where("fit IS NOT NULL").groupBy("row").agg(F.max(ranked).alias("best"))
    return urls.join(best, "row", "left").select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """Rules written in the source as a table."""
    names = ("verdict", "host", "path")
    made = [F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(names, r, strict=True)]) for r in rules]
    return spark.range(1).select(F.inline(F.array(*made)))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark))


OP10_SQL = r"""
with u as (
  select page_id,
    case when contains(url, '://') then translate(regexp_extract(url[strpos(url, '://') + 3:], '^[^/?#]*'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
    case when contains(url, '://') then regexp_extract(url[strpos(url, '://') + 3:], '^[^/?#]*([^?#]*)', 1) else '' end as path
  from pages),
r(verdict, h, p) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'),
  ('allow', 'org', '/fr/'))
select page_id, host, path,
  (select h || p from r where (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
   order by length(h || p) desc limit 1) as rule,
  coalesce((select verdict from r where (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
   order by length(h || p) desc limit 1), 'allow') as verdict
from u
"""
