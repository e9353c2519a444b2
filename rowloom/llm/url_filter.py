"""URL allow and block lists by hash-prefix lookup, in DataFrame functions only.

Every distinct (host, path) is expanded into expressions host-suffix + path-prefix, where a path prefix ends
at a `/`. A rule is stored under the expression made of its host and its path up to the last `/`. Expressions
meet rules in an equi-join on a 32-bit prefix of a SHA-256 digest; the full digest then confirms the pair and
`startswith` the rest of a rule's path. The longest rule wins (then the longer host, then `block`).

Defined results: a null url or one without `://` has an empty host and path, fits no rule and gets the
default verdict; repeated rows each get their own result; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import ascii_lower, fresh, scratch

PREFIX_HEX = 8  # 32 bits of the digest travel as the join key


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or holds no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr(f"substr({_sql(url)}, instr({_sql(url)}, '://') + 3)"))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _sql(column: Column) -> str:
    return column._jc.toString()


def host_suffixes(host: Column, most: int) -> Column:
    """Suffixes of up to `most` labels, of a.b.c: c, b.c, a.b.c."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most))), lambda n: F.array_join(F.slice(labels, -n, n), "."))


def path_prefixes(path: Column, most: int) -> Column:
    """Prefixes that end at one of the first `most` slashes, and the empty one: of /en/a they are '', / and /en/."""
    parts = F.split(path, "/", most + 1)
    return F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/"))),
    )


def _digest(host: Column, prefix: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), prefix), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", salts: int = 16) -> DataFrame:
    """pages with the columns host, path, rule and verdict added (replacing any of these names).

    rules: columns host, path, verdict. Rules are copied `salts` times and each expression takes one copy, so
    an expression that fits a third of all urls is spread over that many tasks. The rules' side is broadcast only
    if Spark's own size check allows it. Urls are expanded as far as the rules go: to as many labels and slashes as
    any rule has, since longer expressions fit none.
    """
    host, path = split_url(F.col(f"`{url}`"))
    rows = pages.withColumn("host", host).withColumn("path", path)
    distinct = rows.select("host", "path").filter(F.col("host") != "").distinct()
    clean = rules.select(
        ascii_lower(F.coalesce("host", F.lit(""))).alias("rule_host"),
        F.coalesce("path", F.lit("")).alias("rule_path"),
        F.col("verdict").alias("rule_verdict"),
    ).filter("rule_host <> '' and rule_verdict is not null")
    labels, slashes = clean.agg(F.max(F.size(F.split("rule_host", r"\."))), F.max(F.size(F.split("rule_path", "/")) - 1)).first()
    expanded = (
        distinct.withColumn("suffix", F.explode(host_suffixes(F.col("host"), labels or 1)))
        .withColumn("prefix", F.explode(path_prefixes(F.col("path"), slashes or 0)))
        .withColumn("digest", _digest(F.col("suffix"), F.col("prefix")))
        .select(
            "host", "path", "digest",
            F.substring("digest", 1, PREFIX_HEX).alias("key"),
            F.pmod(F.xxhash64("host", "path"), F.lit(salts)).cast("int").alias("salt"),
        )
    )
    stored = (
        clean.withColumn("rule_digest", _digest(F.col("rule_host"), F.regexp_extract("rule_path", r"^(.*/)?", 0)))
        .withColumn("key", F.substring("rule_digest", 1, PREFIX_HEX))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    hits = expanded.join(stored, ["key", "salt"]).filter(
        (F.col("digest") == F.col("rule_digest")) & F.expr("startswith(path, rule_path)")
    )
    best = hits.groupBy("host", "path").agg(
        F.max(
            F.struct(
                F.length(F.concat("rule_host", "rule_path")).alias("len"),
                F.length("rule_host").alias("host_len"),
                F.col("rule_verdict").alias("verdict"),
                F.concat("rule_host", "rule_path").alias("rule"),
            )
        ).alias("best")
    )
    # Written, so that AQE can split the last join where a third of all rows have one url: it splits joins between plain shuffles only.
    # Without the hint Spark would judge by the size of the compressed files and broadcast many times that.
    found = scratch(best.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict")), "url-found")
    kept = [c for c in rows.columns if c not in ("rule", "verdict")]
    own, at = fresh(rows, "_host"), fresh(rows, "_path")
    # Rows without a host fit no rule: they get keys that no host has, so that they don't all go to one task.
    spread = F.concat(F.lit("/"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 16)).cast("string"))
    keyed = rows.select(*[f"`{c}`" for c in kept]).withColumn(own, F.when(F.col("host") != "", F.col("host")).otherwise(spread))
    judged = found.select(F.col("host").alias(own), F.col("path").alias(at), "rule", "verdict").hint("merge")
    return (
        keyed.join(judged, (keyed[own] == judged[own]) & (keyed["path"] == judged[at]), "left")
        .select(*[keyed[f"`{c}`"] for c in kept], "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
    )
