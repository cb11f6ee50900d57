"""URL filter rules matched by a sort-merge range join.

A host is written in reverse (`org.example.`) and its path behind it, so a rule is a
prefix: all that it fits is the interval of the keys that begin with its own. A url
takes part once for each suffix of its host, for a rule also fits all subdomains.
The keys of rules and urls are sorted together over all tasks by ranges of about SWEEP
urls, whatever hosts or paths are frequent, and each range is swept in order. The rules
that hold at a point are nested, and a stack of them is kept, one slot for each depth;
the deepest slot that still holds is the url's longest rule. What is on the stack where
a range begins are the rules whose key is a prefix of the range's first key.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm.common import materialize, small

#: Url keys in a sweep.
SWEEP = 50_000
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), *_LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """Behind the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _reversed(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _keys(host: Column) -> Column:
    """Reversed keys of the host and of each domain above it: `org.`, `org.example.`, ..."""
    labels = F.reverse(F.split(host, r"\.", -1))
    joined = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(joined)


def _prefixes(key: Column) -> Column:
    """All prefixes of a key that is not empty, itself included."""
    return F.transform(F.sequence(F.lit(1), F.length(key)), lambda n: F.substring(key, F.lit(1), n))


def longest_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, action) of the longest rule for each distinct (host, path) that any fits.

    `rules` (host, path, action): a rule fits its host and all subdomains where
    the path starts with its own. The longest host and path together wins, then
    the longer host. Equal rules are one, of the least action; nulls count as
    empty. A rule without a host fits nothing, nor does one whose path is neither empty nor begins with `/`.
    """
    clean = (
        rules.select(F.translate(F.coalesce("host", F.lit("")), *_LOWER).alias("rhost"), F.coalesce("path", F.lit("")).alias("rpath"), F.col("action"))
        .where("rhost <> '' AND action IS NOT NULL AND (rpath = '' OR startswith(rpath, '/'))").groupBy("rhost", "rpath").agg(F.min("action").alias("action"))
    )
    clean = materialize(clean.select(_reversed(F.col("rhost")).alias("key"), "rhost", "rpath", "action").withColumn("at", F.concat("key", "rpath")), "rules")
    # The depth of a rule is the number of rules that are open at its start: those whose keys are prefixes of its own.
    above = clean.select(F.col("at").alias("of"), F.explode(_prefixes(F.col("at"))).alias("at")).join(clean.select("at"), "at").groupBy("of").agg(F.count(F.lit(1)).alias("depth"))
    nested = materialize(clean.join(above.withColumnRenamed("of", "at"), "at").select("key", "at", "depth", F.struct("rhost", "rpath", "action").alias("rule")), "nested")
    depths = nested.agg(F.max("depth")).first()[0] or 0  # one number
    if not depths:
        none = F.lit(None).cast("string")
        return urls.select("host", "path", none.alias("rule"), none.alias("action")).where("false")

    pages = urls.select("host", "path").distinct()
    hosts = materialize(nested.select("key").distinct(), "hosts")
    points = pages.select("host", "path", F.explode(_keys(F.col("host"))).alias("key")).join(small(hosts, F.length("key")), "key", "left_semi")
    blank = F.lit(None).cast(nested.schema["rule"].dataType)
    asked = points.select(F.concat("key", "path").alias("at"), F.lit(1).alias("kind"), "host", "path", F.lit(0).cast("long").alias("depth"), blank.alias("rule"))
    asked = materialize(asked, "points")
    none = F.lit(None).cast("string")
    given = nested.select("at", F.lit(0).alias("kind"), none.alias("host"), none.alias("path"), "depth", "rule")
    ranges = max(1, -(-asked.count() // SWEEP))
    placed = asked.union(given).repartitionByRange(ranges, "at", "kind", "host", "path").withColumn("range", F.spark_partition_id())
    placed = materialize(placed, "sorted")
    # The first key of each range (as many rows as ranges), and the rules that are open there.
    firsts = placed.groupBy("range").agg(F.min("at").alias("first"))
    opened = firsts.select("range", "first", F.explode(_prefixes(F.col("first"))).alias("at")).join(nested, "at")
    carried = opened.select(F.col("first").alias("at"), F.lit(0).alias("kind"), none.alias("host"), none.alias("path"), "depth", "rule", "range")
    w = Window.partitionBy("range").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    slot = lambda d: F.last(F.when(F.col("depth") == d, F.col("rule")), True).over(w)
    swept = placed.union(carried).withColumns({f"slot{d}": slot(d) for d in range(1, depths + 1)}).where("kind = 1")
    holds = lambda d: F.when(F.startswith("at", F.concat(_reversed(F.col(f"slot{d}.rhost")), F.col(f"slot{d}.rpath"))), F.col(f"slot{d}"))
    top = F.coalesce(*[holds(d) for d in range(depths, 0, -1)])
    matched = swept.select("host", "path", top.alias("r")).where("r IS NOT NULL")
    order = F.struct((F.length("r.rhost") + F.length("r.rpath")).alias("all"), F.length("r.rhost").alias("of_host"), F.col("r.rhost"), F.col("r.rpath"), F.col("r.action"))
    best = matched.groupBy("host", "path").agg(F.max(order).alias("m"))
    return best.select("host", "path", F.concat("m.rhost", "m.rpath").alias("rule"), F.col("m.action").alias("action"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of `pages` (page_id, url).

    Without a rule, rule is null and the verdict `default`. Repeated rows are
    returned as often; other columns are not read.
    """
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    found = materialize(longest_rules(urls, rules), "matched")
    found = small(found, F.length(F.concat_ws("", "host", "path", "rule")) * 2)
    return urls.join(found, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict")
    )


#: The rules of the registered query: (host, path, action).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def sql(default: str = "allow") -> str:
    """The same in DuckDB's SQL by a join of all rules."""
    rules = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES)
    return (
        f"WITH r(rhost, rpath, action) AS (VALUES {rules}), "
        "u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, "
        "coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages), "
        "m AS (SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action "
        "FROM (SELECT DISTINCT host, path FROM u) JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path) "
        f"SELECT page_id, host, path, rule, coalesce(action, '{default}') AS verdict FROM u LEFT JOIN m USING (host, path)"
    )
