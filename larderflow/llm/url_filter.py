"""URL filter: host-suffix and path-prefix expressions, joined on short hash prefixes, confirmed by full digests.

A rule names a host and the beginning of a path. Its anchor is that path up to the last slash. Each URL is expanded into
host suffixes and path prefixes that end in a slash, only of the depths that rules have; each expression is hashed, and
the first characters of its digest are joined with those of the rules. A match is confirmed by the full digest and by
the rest of the rule's path; of all rules that fit, the longest decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Hexadecimal digits of a digest that are joined on: 32 bits.
PREFIX = 8
DEFAULT = "allow"


def rest(url: str) -> Column:
    """What follows the first ``://``; empty for null or without it."""
    at = F.instr(F.col(url), "://")
    return F.coalesce(F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))), F.lit(""))


def host(url: str) -> Column:
    return F.translate(F.regexp_extract(rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path(url: str) -> Column:
    return F.regexp_extract(rest(url), "^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) rows of a short list of rules."""
    if not rules:
        return spark.range(0).select(*[F.lit("").alias(c) for c in ("verdict", "host", "path")])
    rows = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules])
    return spark.range(1).select(F.inline(rows))


def _slashes(path: str) -> Column:
    return F.length(path) - F.length(F.replace(F.col(path), F.lit("/"), F.lit("")))


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def _hashed(rules: DataFrame) -> DataFrame:
    anchor = F.regexp_extract("path", "^.*/", 0)
    told = rules.select("verdict", "host", "path", anchor.alias("anchor")).filter("host <> '' AND anchor <> ''")
    digest = _digest(F.concat("host", "anchor"))
    return told.select(
        "verdict",
        F.col("path").alias("rule_path"),
        F.concat("host", "path").alias("rule"),
        F.size(F.split("host", r"\.")).alias("labels"),
        _slashes("anchor").alias("slashes"),
        digest.alias("digest"),
        F.substring(digest, 1, PREFIX).alias("prefix"),
    )


def _expressions(depths: Sequence[tuple[int, int]]) -> Column:
    """The host suffixes of so many labels, each followed by the path prefix of so many slashes, where a URL has both."""
    parts = F.split("host", r"\.")
    each = [
        F.when(
            (F.size(parts) >= labels) & (_slashes("path") >= slashes),
            F.concat(F.array_join(F.slice(parts, -labels, labels), "."), F.substring_index("path", "/", slashes), F.lit("/")),
        )
        for labels, slashes in depths
    ]
    return F.array_compact(F.array(*each)) if each else F.array().cast("array<string>")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", id: str = "page_id", default: str = DEFAULT) -> DataFrame:
    """One row per row of ``pages``: id, ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``.

    Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; path: what follows it up
    to ``?`` or ``#``. Both are empty for a null URL and one without ``://``; such URLs get the default verdict. A rule
    fits its host and all its subdomains where the path begins with the rule's path (which begins with a slash). The
    longest rule decides; of equal rules with both verdicts the one that blocks. Rows with null ids and repeated rows all
    come back; other columns are not read; an empty table gives no rows, an empty rule table only default verdicts.

    Different pairs of host and path are judged once, so a URL or host that many rows have is expanded once, and only
    matches are grouped. The rule table may be of any size: Spark broadcasts it only if it is small.
    """
    told = pages.select(F.col(id), host(url).alias("host"), path(url).alias("path"))
    hashed = _hashed(rules)
    depths = [(r.labels, r.slashes) for r in hashed.select("labels", "slashes").distinct().collect()]  # a few pairs of depths
    expanded = told.select("host", "path").distinct().select("host", "path", F.explode(_expressions(sorted(depths))).alias("expression"))
    digest = _digest(F.col("expression"))
    fits = (
        expanded.select("host", "path", digest.alias("full"), F.substring(digest, 1, PREFIX).alias("prefix"))
        .join(hashed, "prefix")
        .filter((F.col("full") == F.col("digest")) & F.startswith("path", "rule_path"))
    )
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "verdict", "rule")).alias("best"))
    return told.join(best, ["host", "path"], "left").select(
        id, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
