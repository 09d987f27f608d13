"""URL filters by hashed host-suffix and path-prefix expressions.

A rule is (host, path, verdict). It fits its host and all subdomains if the url's path starts with the rule's path; the
longest fitting rule decides, other urls get the default verdict.

1. The host of a url is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, ASCII capitals made small;
   its path is what follows up to ``?``, ``#`` or the end.
2. A url is cut to the host suffix and path prefix that the longest rules can reach, which loses no rule. Equal cuts
   are judged once: they combine before the shuffle, so a host with a third of all rows is one row a task.
3. Each cut is expanded into host suffixes (at the dots) times path prefixes (at the slashes; at every character only
   if a rule's path ends elsewhere). Expressions and rules are joined on the first 32 bits of their SHA-256; the full
   digest confirms, and the longest rule wins. Rules are thus found without comparing urls with every rule.
4. The decisions are joined back to the rows.

Both joins are salted: the small side stands once for every salt and rows take the salt of their partition, so neither
a common expression (``net/``) nor a common host is one task's. No side is broadcast by hint; Spark does so by itself
under its own measured threshold. Only built-in functions are used.

Defined results: a null url or one without ``://`` has an empty host and path and gets the default; rules without a
host or verdict fit nothing; null rule paths are empty; of rules with equal host and path the greater verdict counts
("block" over "allow"); repeated rows are judged alike and all stay; an empty table gives an empty result; other
columns pass through, columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantoria.llm.common import packed, salted_lookup, staged, unpacked

#: host, path, verdict
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
DEFAULT = "allow"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark, rules=RULES) -> DataFrame:
    """The rules as literals of a projection."""
    listed = [F.struct(*[F.lit(v).cast("string").alias(c) for c, v in zip(("host", "path", "verdict"), r)]) for r in rules]
    nothing = F.array().cast("array<struct<host:string,path:string,verdict:string>>")
    return spark.range(1).select(F.inline(F.array(*listed) if listed else nothing))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), CAPITALS, SMALL), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _host_cut(host: Column, longest: int) -> Column:
    """The host, or its longest suffix after a dot that a rule's host of ``longest`` characters can equal."""
    tail = F.substr(host, F.length(host) - F.lit(longest))  # longest + 1 characters
    dot = F.instr(tail, ".")
    return F.when(F.length(host) <= longest, host).when(dot > 0, F.substr(tail, dot + 1)).otherwise("")


def _suffixes(host: Column) -> Column:
    """The host and what follows each of its dots."""
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))


def _prefixes(path: Column, everywhere: bool) -> Column:
    """The empty path and every prefix of the path that ends in a slash, or every prefix."""
    if everywhere:
        return F.transform(F.sequence(F.lit(0), F.length(path)), lambda i: F.substr(path, F.lit(1), i))
    parts = F.split(path, "/", -1)
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1),
                       lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _short(digest: Column) -> Column:
    return F.substring(digest, 1, 8)


def _fitting(sites: DataFrame, rules: DataFrame, everywhere: bool) -> DataFrame:
    """host_cut, path_cut, rule, verdict of every site that a rule fits."""
    wide = sites.select("host_cut", "path_cut", F.explode(_suffixes(F.col("host_cut"))).alias("h"))
    wide = wide.select("host_cut", "path_cut", "h", F.explode(_prefixes(F.col("path_cut"), everywhere)).alias("p"))
    wide = wide.select("host_cut", "path_cut", _digest(F.col("h"), F.col("p")).alias("digest")).withColumn("short", _short(F.col("digest")))
    hit = salted_lookup(wide, rules, ["short"], how="inner").filter(F.col("digest") == F.col("rule_digest"))
    best = F.max(F.struct(F.length("rule").alias("n"), "host_n", "rule", "rule_verdict")).alias("best")
    return hit.groupBy("host_cut", "path_cut").agg(best).select("host_cut", "path_cut", "best.rule", F.col("best.rule_verdict").alias("verdict"))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """The rows with host, path, rule (host and path in one; null: none fits) and verdict."""
    known = (rules.select(F.translate("host", CAPITALS, SMALL).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
             .filter("host != '' and verdict is not null").groupBy("host", "path").agg(F.max("verdict").alias("rule_verdict")))
    known = staged(known.select(F.concat("host", "path").alias("rule"), F.length("host").alias("host_n"), F.length("path").alias("path_n"),
                                (~F.col("path").rlike("(/|^)$")).alias("open"), "rule_verdict", _digest(F.col("host"), F.col("path")).alias("rule_digest")), "rules")
    host_n, path_n, everywhere = known.agg(F.max("host_n"), F.max("path_n"), F.max("open")).first()
    rows = packed(pages).withColumn("host", host_of(F.col("_doc")[url])).withColumn("path", path_of(F.col("_doc")[url]))
    rows = rows.withColumn("host_cut", _host_cut(F.col("host"), host_n or 0)).withColumn("path_cut", F.substring("path", 1, path_n or 0))
    fitting = _fitting(rows.select("host_cut", "path_cut").distinct(), known.withColumn("short", _short(F.col("rule_digest"))), bool(everywhere))
    out = salted_lookup(rows, fitting, ["host_cut", "path_cut"], how="left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
    return unpacked(out, pages.columns, ["host", "path", "rule", "verdict"])


def sql(rules=RULES, default: str = DEFAULT) -> str:
    listed = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return f"""
WITH r(host, path, verdict) AS (VALUES {listed}),
a AS (SELECT row_number() OVER () AS row_no, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT row_no, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{CAPITALS}', '{SMALL}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
f AS (SELECT row_no, arg_max(r.host || r.path, length(r.host || r.path) * 1000 + length(r.host)) AS rule,
             arg_max(r.verdict, length(r.host || r.path) * 1000 + length(r.host)) AS verdict
      FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY row_no)
SELECT page_id, u.host, u.path, f.rule, coalesce(f.verdict, '{default}') AS verdict FROM u LEFT JOIN f USING (row_no)"""
