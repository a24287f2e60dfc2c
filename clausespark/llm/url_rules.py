"""Operator 3: allow and block rules on URLs by a sort-merge range join.

A host is turned round label by label, each label ended by a zero character, so that a host and its subdomains form one
interval of keys. URLs and rules are sorted by key; a sweep keeps the stack of rules whose interval holds the current
key. URLs are range-partitioned by key and page, so a host with a third of all rows spreads over many tasks, and each
rule is sent to the partitions that its interval touches.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausespark.llm.common import shuffle_partitions, stored

RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
_AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_SWEPT = "kind int, part int, id long, host string, path string, key string, verdict string"


def url_host(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; empty where there is none."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    after = F.substring(url, F.length(rest) + 4, 2**31 - 1)
    return F.coalesce(F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), *_AZ), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty where there is no ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    after = F.substring(url, F.length(rest) + 4, 2**31 - 1)
    return F.coalesce(F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "\0"), F.lit("\0")))


def _fits(host: str, rule_host: str) -> bool:
    return host == rule_host or host.endswith("." + rule_host)


class Sweep:
    """Rows in order of key, rules before URLs of the same key; the stack holds the rules around the current key."""

    def __init__(self):
        self.stack: list[tuple[str, str, dict[str, str], list[int]]] = []

    def _unwind(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def rule(self, key: str, host: str, path: str, verdict: str) -> None:
        self._unwind(key)
        if not self.stack or self.stack[-1][1] != host:
            self.stack.append((key, host, {}, []))
        _, _, paths, lengths = self.stack[-1]
        # of rules with the same host and path, block holds
        paths[path] = "block" if "block" in (verdict, paths.get(path)) else verdict
        if len(path) not in lengths:
            lengths.append(len(path))
            lengths.sort(reverse=True)

    def url(self, key: str, host: str, path: str) -> tuple[str | None, str | None]:
        self._unwind(key)
        best, found = (-1, -1), (None, None)
        for _, rule_host, paths, lengths in self.stack:
            if _fits(host, rule_host):
                n = next((n for n in lengths if n <= len(path) and path[:n] in paths), None)
                if n is not None and (len(rule_host) + n, len(rule_host)) > best:
                    best, found = (len(rule_host) + n, len(rule_host)), (rule_host + path[:n], paths[path[:n]])
        return found


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) of every row of pages.

    rules: (host, path, verdict). A rule fits its host and all subdomains where the path starts with the rule's; the one
    with the longest host and path wins, of equally long ones that with the longer host, of the same ones block. Without
    a rule the verdict is default. Null URLs and those without :// have an empty host and fit no rule; null ids are kept;
    repeated rows are judged each. Rules with a null or empty host are ignored; a null path is empty, a null verdict
    is block. Other columns are left out. Either table may be empty.
    """
    spark = pages.sparkSession
    n = shuffle_partitions(spark)
    u = pages.select(F.col(id_col).cast("long").alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    u = u.withColumn("key", host_key(F.col("host")))
    u = u.repartitionByRange(n, "key", "path", "id").withColumn("part", F.spark_partition_id())
    u = stored(u, "url-keys")
    # one row for each partition: at most n of them come to the driver
    bounds = [(r.part, r.lo, r.hi) for r in u.groupBy("part").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy("part").collect()]
    parts, lows, highs = [b[0] for b in bounds], [b[1] for b in bounds], [b[2] for b in bounds]

    def place(batches):
        for r in batches:
            out = []
            for host, path, key, verdict in zip(r["host"], r["path"], r["key"], r["verdict"], strict=True):
                first, last = bisect_left(highs, key), bisect_left(lows, key[:-1] + "\1")
                out += [(0, parts[i], None, host, path, key, verdict) for i in range(first, last)]
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _SWEPT.split(", ")]).astype({"id": "Int64"})

    r = rules.select(F.translate("host", *_AZ).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce("verdict", F.lit("block")).alias("verdict")).where("host <> ''")
    r = r.withColumn("key", host_key(F.col("host"))).mapInPandas(place, _SWEPT)
    rows = r.union(u.select(F.lit(1), "part", "id", "host", "path", "key", F.lit(None).cast("string")))
    rows = rows.repartitionByRange(n, "part").sortWithinPartitions("part", "key", "kind")

    def sweep(batches):
        part, state = None, Sweep()
        for b in batches:
            out = []
            for kind, p, i, host, path, key, verdict in zip(*(b[c].tolist() for c in ("kind", "part", "id", "host", "path", "key", "verdict")), strict=True):
                if p != part:
                    part, state = p, Sweep()
                if kind == 0:
                    state.rule(key, host, path, verdict)
                else:
                    rule, said = state.url(key, host, path)
                    out.append((None if pd.isna(i) else int(i), host, path, rule, said or default))
            yield pd.DataFrame(out, columns=["id", "host", "path", "rule", "verdict"]).astype({"id": "Int64", "host": object, "rule": object})

    # ids as text on the way: a batch with a null id would turn the others into floats
    swept = rows.withColumn("id", F.col("id").cast("string")).mapInPandas(sweep, "id long, host string, path string, rule string, verdict string")
    return swept.withColumnRenamed("id", id_col)


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of pages judged by the five rules of the contract; without a rule: allow."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


OP3_SQL = r"""
WITH a AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages),
b AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM a),
r(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT b.page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS verdict
      FROM b JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY b.page_id)
SELECT b.page_id, host, path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM b LEFT JOIN m USING (page_id)
"""
