"""URL rules by a sort-merge range join over reversed-host keys.

A rule (host, path) holds for the host, its subdomains and every path that starts with its own. With
the host's labels reversed, the rule is an interval of keys: all keys that begin with
`com.example/en/`. A URL asks once for each number of host labels that some rule has, with its own
host cut to that many labels. Asked keys and interval bounds are sorted together; a sweep keeps the
stack of intervals that are open, which nest, and the innermost one answers.

The sweep is spread over range partitions: each is swept for itself, and what was open at its start
comes from a table with one row per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hippolake.llm.text import ascii_lower
from hippolake.storage import materialize

#: (host, path, verdict): the rules of the production query.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lowered. Path: from there up to ? # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), "^[^?#]*", 0)
    return ascii_lower(raw), path


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.concat_ws(".", F.reverse(labels)), F.lit("/"), path).cast("binary")


def answer(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls: distinct (host, path). Returns host, path, rule, verdict of the longest rule that fits, where one does."""
    spark = urls.sparkSession
    labels = F.split("host", r"\.", -1)
    # A rule given twice counts once; block wins over allow.
    rules = rules.filter("host is not null and path is not null").groupBy(ascii_lower(F.col("host")).alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    rules = materialize(rules.select(_key(labels, F.col("path")).alias("key"), F.concat("host", "path").alias("rule"), "verdict", F.size(labels).alias("labels")), "rules")
    depths = sorted(r[0] for r in rules.select("labels").distinct().collect())  # numbers of host labels, a few dozen at most
    if not depths:
        return urls.select("host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")).limit(0)

    asked = urls.withColumn("labels", labels).withColumn("deep", F.explode(F.filter(F.array(*map(F.lit, depths)), lambda d: d <= F.size("labels"))))
    asked = asked.select(_key(F.slice("labels", -F.col("deep"), F.col("deep")), F.col("path")).alias("key"), "host", "path")
    empty = {"host": F.lit(None).cast("string"), "path": F.lit(None).cast("string"), "rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")}

    def events(df: DataFrame, key: Column, kind: int, step: int, **columns: Column) -> DataFrame:
        return df.select(key.alias("key"), F.lit(kind).alias("kind"), F.lit(step).alias("step"), *[c.alias(n) for n, c in (empty | columns).items()])

    shut = F.concat(F.col("key"), F.unhex(F.lit("FF")))  # FF is in no UTF-8 text, so this is after every key with the prefix
    line = (
        events(rules, F.col("key"), 0, 1, rule=F.col("rule"), verdict=F.col("verdict"))
        .unionByName(events(asked, F.col("key"), 1, 0, host=F.col("host"), path=F.col("path")))
        .unionByName(events(rules, shut, 2, -1))
    )
    # Host and path are part of the sort, so that a key asked for by many is dealt to several partitions.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "kind", "host", "path"]
    line = materialize(line.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "sweep")

    running = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    swept = line.withColumn("depth", F.sum("step").over(running))
    at_end = line.groupBy("part").agg(F.sum("step").alias("net"))
    ahead = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per range partition
    opened_before = at_end.select("part", F.coalesce(F.sum("net").over(ahead), F.lit(0)).alias("opened_before"))
    swept = swept.join(F.broadcast(opened_before), "part").withColumn("depth", F.col("depth") + F.col("opened_before"))
    swept = materialize(swept, "depths")
    deepest = swept.agg(F.max("depth")).first()[0] or 0  # of nested rules

    # The stack: at each depth the interval opened last. The top is the one at the depth reached.
    opens = lambda d: (F.col("kind") == 0) & (F.col("depth") == d)
    opened, levels = F.struct("rule", "verdict"), range(1, deepest + 1)
    tops = swept.select("*", *[F.last(F.when(opens(d), opened), ignorenulls=True).over(running).alias(f"open{d}") for d in levels])
    ends = swept.groupBy("part").agg(*[F.max_by(F.when(opens(d), opened), F.when(opens(d), F.col("key"))).alias(f"end{d}") for d in levels])
    carried = ends.select("part", *[F.last(f"end{d}", ignorenulls=True).over(ahead).alias(f"carried{d}") for d in levels])
    top = F.coalesce(*[F.when(F.col("depth") == d, F.coalesce(f"open{d}", f"carried{d}")) for d in levels])
    found = tops.join(F.broadcast(carried), "part").filter("kind = 1 and depth > 0").select("host", "path", top.alias("top"))
    longest = found.groupBy("host", "path").agg(F.max_by("top", F.struct(F.length("top.rule"), "top.rule")).alias("top"))
    return longest.select("host", "path", "top.rule", "top.verdict")


def judge(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule (null if none fits), verdict.

    The longest rule that fits wins. Null URLs and URLs without :// have empty host and path and get
    `default`, as does every URL that no rule fits. Repeated rows are judged each for itself; extra
    columns are not read; an empty table gives no rows, and without rules all get the default.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    answers = answer(rows.filter("host <> '' or path <> ''").select("host", "path").distinct(), rules)
    return rows.join(answers, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def production_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), "host string, path string, verdict string")
