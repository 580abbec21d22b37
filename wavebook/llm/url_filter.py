"""URL rules found by hashed host-suffix and path-prefix expressions.

Every URL is expanded into the expressions a rule could have: the suffixes of its
host with as many labels, and the prefixes of its path with as many characters,
as some rule has. Expressions are joined with the rules on four bytes of their
digest, confirmed by the whole digest, and the longest rule wins.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from wavebook.llm.common import fresh, join_counted, materialise
from wavebook.operators.joins import hot_keys

# Rules are broadcast up to this many bytes, measured; beyond it expressions are shuffled.
RULE_BYTES = 32 << 20
SALTS = 32

OUTPUTS = ["host", "path", "rule", "verdict"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), r"^[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    return F.unhex(F.sha2(F.concat(host, F.lit("\n"), path), 256))


def hashed_rules(rules: DataFrame) -> DataFrame:
    """(prefix, digest, rule, action, labels, chars) of rules (host, path, action).

    Hosts are folded. Of rules for one host and path the action that comes last in the
    alphabet holds, so ``block`` wins over ``allow``.
    """
    folded = F.translate("host", string.ascii_uppercase, string.ascii_lowercase)
    one = rules.select(folded.alias("host"), "path", "action").groupBy("host", "path").agg(F.max("action").alias("action"))
    return one.select(
        F.substring(_digest(F.col("host"), F.col("path")), 1, 4).alias("prefix"),
        _digest(F.col("host"), F.col("path")).alias("digest"),
        F.concat("host", "path").alias("rule"),
        F.col("action"),
        F.size(F.split("host", r"\.", -1)).alias("labels"),
        F.length("path").alias("chars"),
        F.length("host").alias("host_chars"),
    )


def url_filter(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row.

    ``rules`` has ``host``, ``path`` and ``action``. A rule fits its host and all
    subdomains if the path starts with the rule's path; the longest rule wins,
    then the one with the longer host. Rule hosts are taken in small letters; of two
    rules for one host and path ``block`` wins over ``allow``. Without a fitting rule the rule is null and
    the verdict is ``default``. A null URL or one without ``://`` has an empty host
    and path. Output columns replace input columns of the same name; every input
    row comes out once. An empty table gives no rows.

    The lengths that rules have are collected to expand URLs only as far as a
    rule could reach; there are as many as the longest host and path have labels
    and characters. Expansion works on distinct (host, path) pairs.
    """
    kept = [c for c in df.columns if c.lower() not in OUTPUTS]
    source, size, count = fresh(df, "_url", "_size", "_count")
    split = df.select(*[F.col(f"`{c}`") for c in kept], F.col(url).alias(source)).select(
        *kept, host_of(F.col(source)).alias("host"), path_of(F.col(source)).alias("path")
    )
    hashed = materialise(hashed_rules(rules))
    lengths = hashed.select("labels", "chars").distinct().collect()
    if not lengths:
        return split.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    labels = F.split("host", r"\.", -1)
    suffixes = [
        F.when(F.size(labels) >= n, F.substring_index("host", ".", -n))
        for n in sorted({r.labels for r in lengths})
    ]
    prefixes = [
        F.when(F.length("path") >= n, F.substring("path", 1, n))
        for n in sorted({r.chars for r in lengths})
    ]
    addresses = materialise(split.groupBy("host", "path").agg(F.count("*").alias("n")))
    expressions = (
        addresses.withColumn("suffix", F.explode(F.array_compact(F.array(*suffixes))))
        .withColumn("start", F.explode(F.array_compact(F.array(*prefixes))))
        .withColumn("full", _digest(F.col("suffix"), F.col("start")))
        .withColumn("prefix", F.substring("full", 1, 4))
        .select("host", "path", "n", "prefix", "full")
    )
    hits = _match(expressions, hashed).where(F.col("full") == F.col("digest"))
    longest = F.struct(F.length("rule").alias("n"), F.col("host_chars"), F.col("rule"), F.col("action"))
    best = (
        hits.groupBy("host", "path", "n")
        .agg(F.max(longest).alias("best"))
        .select("host", "path", "n", F.col("best.rule").alias("rule"), F.col("best.action").alias("verdict"))
    )
    rows = addresses.agg(F.sum("n")).first()[0] or 0
    judged = join_counted(
        split.withColumnsRenamed({"n": count}), best.withColumnsRenamed({"n": size}), ["host", "path"], size, rows
    ).withColumnsRenamed({count: "n"})
    return judged.select(*kept, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _match(expressions: DataFrame, hashed: DataFrame) -> DataFrame:
    """The equi-join on the short digest prefix.

    A small rule table is broadcast. A large one is shuffled, and the prefixes that
    many expressions have (``com/`` say) are salted, found by a sketch.
    """
    size = hashed.agg(F.sum(F.length("rule") + 100)).first()[0]
    if size <= RULE_BYTES:
        return expressions.join(F.broadcast(hashed), "prefix")
    hot = hot_keys(expressions, ["prefix"])
    is_hot = F.xxhash64("prefix").isin(hot)
    salt = F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int")
    salted = expressions.withColumn("salt", F.when(is_hot, salt).otherwise(0))
    all_salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(hashed.withColumn("salt", F.explode(all_salts)), ["prefix", "salt"])
