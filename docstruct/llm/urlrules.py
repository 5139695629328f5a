"""URL filters by a sort-merge range join, with DataFrame functions alone.

A host is written with its labels reversed, each followed by a point (``com.example.www.``). The hosts that a rule host
fits are then one interval, from ``com.example.`` to before ``com.example/``, since ``/`` follows the point and is in no
host. Intervals of rule hosts nest. A sorted sweep over their starts, their ends and the distinct hosts keeps the stack of
active rule hosts: a start brings its own with those around it, an end brings back those around it, and a host takes the
stack that stands last before it. A stack has no more entries than its key has labels, however many rules there are.

The rules of a rule host are rows of their own. Each distinct url meets, for each rule host of its host's stack, the lengths
of that rule host's paths, and then by equality the rule whose path is the url's path cut to that length; the longest rule is
taken by an aggregate.

The sweep is dealt by the key's first label. A label of over ``TASK_HOSTS`` hosts is dealt by salts as well, as many as its
hosts need, and each salt has all the label's starts and ends; so the work of a task is bounded at any size. Urls and hosts
are made distinct first, and the joins on hosts and rule hosts are shuffles that AQE splits where a host is hot, or
broadcasts where Spark's own check of the written tables' size allows one.

Cases: a null url, or one without ``://``, has an empty host and path and fits no rule; a rule with the same host and path
as another counts once, and block goes before allow; of rules of one length the longer host goes first; a verdict without
a rule is ``default``; repeated rows stay; a very long url is judged whole; empty tables give no rows, and no rules give
``default``; other columns of the pages are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docstruct.llm.common import cut

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
DEFAULT, TASK_HOSTS = "allow", 500_000


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def rule_rows(rules: DataFrame) -> DataFrame:
    """``rule_host, path, verdict`` of the distinct rules."""
    return rules.where("host <> '' and path is not null and verdict is not null").groupBy(F.col("host").alias("rule_host"), "path").agg(F.max("verdict").alias("verdict"))


def rule_stacks(rules: DataFrame) -> DataFrame:
    """``key, stack, around`` of each rule host: the rule hosts that its hosts fit, and those of the hosts around it.

    They are among its own leading labels, which are looked up by an equality join.
    """
    rows = rules.select("rule_host").distinct().withColumn("key", reversed_key(F.col("rule_host")))
    labels = F.split(F.expr("substring(key, 1, length(key) - 1)"), r"\.", -1)
    leads = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.array_join(F.slice(labels, 1, i), "."), F.lit(".")))
    met = rows.select("key", F.explode(leads).alias("lead")).join(rows.select(F.col("key").alias("lead"), "rule_host"), "lead")
    return met.groupBy("key").agg(F.collect_list("rule_host").alias("stack"), F.collect_list(F.when(F.col("lead") != F.col("key"), F.col("rule_host"))).alias("around"))


def _label(key: str = "key") -> Column:
    return F.regexp_extract(key, r"^[^./]*", 0)


def sweep(hosts: DataFrame, rules: DataFrame, task_hosts: int = TASK_HOSTS) -> DataFrame:
    """``host, stack`` of the distinct ``host`` values that at least one rule host's interval holds; ``rules`` as :func:`rule_rows`."""
    stacks = cut(rule_stacks(rules))
    points = hosts.select(reversed_key(F.col("host")).alias("key"), F.lit(2).alias("turn"), F.lit(None).cast("array<string>").alias("stack"), "host").withColumn("label", _label())
    hot = cut(points.groupBy("label").count().where(F.col("count") > task_hosts).select("label", F.ceil(F.col("count") / task_hosts).cast("int").alias("salts")))
    starts = stacks.select("key", F.lit(1).alias("turn"), "stack", F.lit(None).cast("string").alias("host"))
    ends = stacks.select(F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/")).alias("key"), F.lit(0).alias("turn"), F.col("around").alias("stack"), F.lit(None).cast("string").alias("host"))
    salts = F.coalesce("salts", F.lit(1))
    marks = starts.unionByName(ends).withColumn("label", _label()).join(hot, "label", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    points = points.join(hot, "label", "left").withColumn("salt", F.pmod(F.hash("host"), salts)).drop("salts")
    last = F.last("stack", ignorenulls=True).over(Window.partitionBy("label", "salt").orderBy("key", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marks.unionByName(points).withColumn("stack", last).where("turn = 2 and size(stack) > 0").select("host", "stack")


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, task_hosts: int = TASK_HOSTS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row."""
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    known = cut(rule_rows(rules))
    lengths = known.select("rule_host", F.length("path").alias("n")).distinct()
    urls = rows.where("host <> ''").select("host", F.col("path").alias("url_path")).distinct()
    met = urls.join(sweep(urls.select("host").distinct(), known, task_hosts), "host").select("host", "url_path", F.explode("stack").alias("rule_host"))
    met = met.join(lengths, "rule_host").where(F.length("url_path") >= F.col("n")).withColumn("path", F.expr("substring(url_path, 1, n)"))
    rule = F.struct((F.length("rule_host") + F.length("path")).alias("size"), F.length("rule_host").alias("host_size"), "path", F.concat("rule_host", "path").alias("rule"), "verdict")
    best = met.join(known, ["rule_host", "path"]).groupBy("host", F.col("url_path").alias("path")).agg(F.max(rule).alias("best"))
    rows = rows.join(best, ["host", "path"], "left")
    return rows.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))


def stated_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), "host string, path string, verdict string")


#: The same in DuckDB.
JUDGE_SQL = r"""
WITH r(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
p AS (SELECT page_id,
  coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
u AS (SELECT DISTINCT host, path FROM p),
m AS (SELECT u.host, u.path, arg_max(r.host || r.path, length(r.host) + length(r.path)) AS rule, arg_max(r.verdict, length(r.host) + length(r.path)) AS verdict
  FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY u.host, u.path)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.host = m.host AND p.path = m.path
"""
