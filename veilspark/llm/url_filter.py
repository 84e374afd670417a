"""URL rules by a sort-merge range join over reversed-host keys.

A host's labels reversed, each followed by a byte below all others (0x01),
make a key of which every subdomain's key is a continuation: a rule's host
with all subdomains is one interval of keys, and intervals of rules nest or
are apart. Keys and rules are sorted into one sequence. Each rule carries the
rules whose intervals enclose its own, outermost first (the stack when it
opens); a URL takes the stack of the last rule before it and drops what has
closed by its key. Of the open rules those whose path starts the URL's path
fit, and the longest wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import materialise

ALLOW, BLOCK = "allow", "block"
#: Verdict of a URL that no rule fits.
DEFAULT = ALLOW
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEP = "\x01"


def url_host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the
    end, A-Z in lower case; empty for null and without ``://``."""
    rest = F.substring_index(url, "://", 1)
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.length(rest) + 4, F.length(url))).otherwise("")
    return F.translate(F.coalesce(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), F.lit("")), _UP, _LOW)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    rest = F.substring_index(url, "://", 1)
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.length(rest) + 4, F.length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse order, each followed by SEP."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, "\\.")), SEP), F.lit(SEP)))


def rules_with_stacks(rules: DataFrame) -> DataFrame:
    """(key, stack) for each distinct rule host: the rules that are open after
    the key, outermost first. Enclosing hosts are found by the key's own
    prefixes, so the join is one on equal keys."""
    by_key = rules.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("path", "rule", "verdict"))).alias("own"))
    parts = by_key.select("key", F.posexplode(F.split("key", SEP)).alias("i", "label")).where("label <> ''").select("key", F.expr(f"concat(array_join(slice(split(key, '{SEP}'), 1, i + 1), '{SEP}'), '{SEP}')").alias("up"))
    enclosing = parts.join(by_key.withColumnRenamed("key", "up"), "up")
    return enclosing.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(F.length("up").alias("depth"), F.col("up"), F.col("own")))).alias("stack"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, url, host, path,
    rule and verdict.

    rules: (host, path, verdict); a rule fits its host and all subdomains
    where the URL's path starts with the rule's (a null path is empty). The
    longest rule (host and path) wins, then the smallest text, then block.
    Without a fitting rule rule is null and verdict is ``default``. Rules
    without host are left out.

    Null URLs and URLs without ``://`` have an empty host and path and no
    rule. Repeated rows are judged alike. An empty table of pages gives an
    empty one, one of rules only defaults; other columns are ignored.
    """
    lower = F.translate(F.col("host"), _UP, _LOW)
    listed = rules.where("host is not null and host <> ''").select(host_key(lower).alias("key"), F.coalesce("path", F.lit("")).alias("path"), F.concat(lower, F.coalesce("path", F.lit(""))).alias("rule"), F.col("verdict").alias("verdict"))
    opened = rules_with_stacks(listed)
    urls = pages.select(F.col("page_id").alias("page_id"), F.col("url").cast("string").alias("url"))
    urls = urls.withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))})
    events = urls.select(host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "page_id", "url", "host", "path", F.lit(None).cast(opened.schema["stack"].dataType).alias("stack")).unionByName(
        opened.select("key", F.lit(0).alias("kind"), "stack"), allowMissingColumns=True
    )
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = events.repartitionByRange(parts, "key", "kind", "path", "page_id").withColumn("part", F.spark_partition_id())
    dealt = materialise(dealt, "url-events")
    last = dealt.where("kind = 0").groupBy("part").agg(F.max_by("stack", "key").alias("end"))
    everywhere = dealt.select("part").distinct().join(last, "part", "left")
    carried = everywhere.select("part", F.last("end", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    sweep = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = dealt.join(F.broadcast(carried), "part").withColumn("stack", F.coalesce(F.last("stack", ignorenulls=True).over(sweep), "carry")).where("kind = 1")
    fits = F.expr("filter(flatten(transform(filter(stack, s -> startswith(key, s.up)), s -> s.own)), r -> startswith(path, r.path))")
    best = F.expr("array_min(transform(fits, r -> struct(-length(r.rule) as n, r.rule as rule, -ascii(r.verdict) as v, r.verdict as verdict)))")
    judged = swept.withColumn("fits", fits).withColumn("best", best)
    return judged.select("page_id", "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


#: Host, path and verdict of the rules of the registered query.
RULES = [("org", "/", ALLOW), ("example.org", "/es/", BLOCK), ("example.org", "/en/1", BLOCK), ("com", "/fr/", ALLOW), ("com", "/de/", BLOCK)]


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return spark.sql(f"SELECT * FROM VALUES {values} AS r(host, path, verdict)")


URL_ORACLE = r"""
WITH u AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rh, rp, rv) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
j AS (
  SELECT page_id, url, host, path,
         (SELECT max_by(struct_pack(rule := rh || rp, verdict := rv), length(rh || rp)) FROM r
          WHERE (h.host = rh OR ends_with(h.host, '.' || rh)) AND starts_with(h.path, rp)) AS best FROM h)
SELECT page_id, url, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM j
"""
