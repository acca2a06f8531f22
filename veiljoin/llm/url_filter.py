"""URL filters by a sort-merge range join: rules become intervals of reversed-host keys, a sorted sweep judges URLs."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path, verdict)
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Keys sampled for each range of the sort.
SAMPLE_PER_RANGE = 24
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, UPPER.lower())


def url_path(url: Column) -> Column:
    """After the host up to ``? #`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    """``www.example.com`` as ``com.example.www.``: all subdomains of a host share its key as a prefix."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def longest_rule(stack: list[tuple[str, str, dict[int, dict[str, str]]]], path: str) -> tuple[str, str, str] | None:
    """The longest open rule that the path starts with, as (host, path, verdict); one look-up for each length of path that a host's rules have."""
    best = None
    for _, host, lengths in stack:
        for n, rules in lengths.items():
            if (verdict := rules.get(path[:n])) is not None and n <= len(path):
                best = max(best or (-1,), (len(host) + n, len(host), host, path[:n], verdict))
    return best and best[2:]


def sweep(batches: Iterator[pd.DataFrame], default: str) -> Iterator[pd.DataFrame]:
    """Judge URLs in key order; the stack holds the rules whose interval the sweep is in, outermost first."""
    stack: list[tuple[str, str, dict[int, dict[str, str]]]] = []  # end, host, and verdicts by length of path and path
    bucket = None
    for batch in batches:
        ids, hosts, paths, rules, verdicts = [], [], [], [], []
        for b, key, rule, end, verdict, row, host, path in batch[
            ["bucket", "key", "rule", "end", "verdict", "row", "host", "path"]
        ].itertuples(index=False, name=None):
            if b != bucket:
                bucket, stack = b, []
            while stack and stack[-1][0] <= key:
                stack.pop()
            if rule is not None:
                if not stack or stack[-1][1] != host:
                    stack.append((end, host, {}))
                same = stack[-1][2].setdefault(len(path), {})
                same[path] = min(verdict, same.get(path, verdict))
                continue
            hit = longest_rule(stack, path)
            ids.append(row)
            hosts.append(host)
            paths.append(path)
            rules.append(hit and hit[0] + hit[1])
            verdicts.append(hit[2] if hit else default)
        yield pd.DataFrame({"row": ids, "host": hosts, "path": paths, "rule": rules, "verdict": verdicts}).astype(object)


def filter_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] | DataFrame = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    ranges: int | None = None,
) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict.

    A rule fits its host and all subdomains where the path starts with the rule's; the longest
    (host plus path, then host) wins, and of rules alike the one that sorts first. URLs and rules
    are sorted by reversed host, then path, then a hash of the row, in ranges of about equal
    numbers of URLs, so a host or a single URL that a third of the rows share is spread over
    ranges. Each rule goes to all ranges that its interval meets; in each range one sweep keeps
    the open rules on a stack. The sample that places the ranges is of bounded size and moves
    only their borders.

    Null URLs and URLs without ``://`` have an empty host and path and get the default, as do URLs
    that no rule fits. Repeated rows are judged alike; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(rules, "host string, path string, verdict string")
    urls = pages.select(
        F.struct(F.col(id_col)).alias("row"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"),
        F.hex(F.xxhash64(F.col(id_col), F.col(url_col))).alias("salt"),
    ).withColumn("key", F.concat(reversed_host(F.col("host")), F.lit("/"), "path", F.lit("\0"), "salt"))
    sample = urls.select("key", "salt").orderBy("salt").limit(ranges * SAMPLE_PER_RANGE).collect()
    keys = sorted(r.key for r in sample)
    bounds = sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []

    @F.pandas_udf("int")
    def place(key: pd.Series) -> pd.Series:
        return key.map(lambda k: bisect_right(bounds, k)).astype("int32")

    start = reversed_host(F.col("host"))
    spans = (
        rules.select("host", "path", "verdict", start.alias("key"))
        .withColumn("end", F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/")))
        .withColumn("bucket", F.explode(F.sequence(place("key"), place("end"))))
        .select("bucket", "key", F.lit("").alias("rule"), "end", "verdict", F.lit(None).cast(urls.schema["row"].dataType).alias("row"), "host", "path")
    )
    none = F.lit(None).cast("string")
    judged = urls.select(
        place("key").alias("bucket"), "key", none.alias("rule"), none.alias("end"), none.alias("verdict"), "row", "host", "path"
    )
    kind = dict(pages.select(F.col(id_col)).dtypes)[id_col]
    out = (
        spans.unionByName(judged.select(*spans.columns))
        .withColumn("row", F.col(f"row.{id_col}"))
        .repartitionByRange(ranges, "bucket")
        .sortWithinPartitions("bucket", "key", F.col("rule").isNull(), "host", "path")
        .mapInPandas(lambda it: sweep(it, default), f"row {kind}, host string, path string, rule string, verdict string")
    )
    return out.withColumnRenamed("row", id_col)
