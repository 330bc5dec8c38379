"""URL filters as a sort-merge range join, in DataFrame functions alone.

A host's labels in reverse, each with a dot behind it, put a domain in front of all its subdomains, so a rule's host is an
interval of such keys, and the intervals of any rules nest or are apart. A sweep over the sorted ends of the intervals keeps
the stack of rules that are active; between two ends the stack does not change. Urls and these stretches are sorted together,
and each url takes the stack of the last stretch before it; of its rules those whose path begins the url's path fit, and the
longest one decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattiq.llm.common import partitions

#: Keys of rules in a range, more or less, ranges at most, and keys of the sample for each that finds their bounds: no more than
#: these are ever brought to the driver.
PER_RANGE, RANGES, SAMPLED = 64, 4096, 32


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for a null url and one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def key(host: Column) -> Column:
    """``a.example.com`` as ``com.example.a.``"""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def after(own: Column) -> Column:
    """The first key behind all that begin with ``own``: its last dot is replaced by the next character."""
    return F.concat(F.expr("left(key, length(key) - 1)"), F.lit("/"))


def stretches(rules: DataFrame) -> DataFrame:
    """(bucket, key, active): from ``key`` on, within its range of keys, the rules ``active`` hold, innermost last.

    The rules are cut into ranges by their keys; a rule that spans several ranges is in each of them. Within a range its
    sorted ends are folded into a stack. Rules with a null host, path or verdict are left out; a rule given twice counts once
    (block before allow, if the verdicts differ)."""
    given = rules.dropna(subset=["host", "path", "verdict"]).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    given = given.withColumn("key", key(F.col("host"))).withColumn("end", after(F.col("key")))
    bounds = ranges(given)
    here = bucket(F.col("key"), bounds)
    last = bucket(F.col("end"), bounds)
    spread = given.withColumn("bucket", F.explode(F.sequence(here, last)))
    low = F.element_at(F.array(F.lit(""), *map(F.lit, bounds)), F.col("bucket") + 1)
    rule = F.struct(F.concat("host", "path").alias("rule"), "path", "verdict")
    ends = spread.select("bucket", F.explode(F.array(
        F.struct(F.greatest("key", low).alias("key"), F.lit(1).alias("kind"), F.length("key").alias("depth"), F.col("path").alias("order"), rule.alias("rule")),
        F.struct(F.col("end").alias("key"), F.lit(0).alias("kind"), (-F.length("key")).alias("depth"), F.col("path").alias("order"), rule.alias("rule")),
    )).alias("e"))
    # A range holds about PER_RANGE keys, and the rules that span it.
    swept = ends.groupBy("bucket").agg(F.sort_array(F.collect_list("e")).alias("events"))
    stack = "array<struct<rule:string,path:string,verdict:string>>"
    empty = F.expr(f"cast(array() as {stack})")
    start = F.struct(empty.alias("stack"), F.expr(f"cast(array() as array<struct<key:string,active:{stack}>>)").alias("out"))

    def step(state: Column, event: Column) -> Column:
        pushed = F.when(event["kind"] == 1, F.concat(state["stack"], F.array(event["rule"]))).otherwise(F.filter(state["stack"], lambda r: r["rule"] != event["rule"]["rule"]))
        return F.struct(pushed.alias("stack"), F.concat(state["out"], F.array(F.struct(event["key"].alias("key"), pushed.alias("active")))).alias("out"))

    folded = swept.select("bucket", F.posexplode(F.aggregate("events", start, step, lambda s: s["out"])).alias("at", "s"))
    # Of several events at a key the stack after the last holds.
    return folded.groupBy("bucket", F.col("s.key").alias("key")).agg(F.max_by("s.active", "at").alias("active"))


def ranges(given: DataFrame) -> list[str]:
    """Keys that cut the rules into parts of about equal size, as many as their number asks for and RANGES at most, by a
    bounded sample of them (the first SAMPLED x RANGES keys in the order of a hash)."""
    known = given.select("key").distinct()
    n = min(RANGES, max(1, known.count() // PER_RANGE))
    if n == 1:
        return []
    keys = sorted(r["key"] for r in known.orderBy(F.xxhash64("key"), "key").limit(SAMPLED * max(n, PER_RANGE)).collect())
    return sorted({keys[len(keys) * i // n] for i in range(1, n)})


def bucket(value: Column, bounds: list[str]) -> Column:
    """How many of the ascending ``bounds`` are not above ``value``, by bisection."""

    def between(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value >= bounds[mid], between(mid + 1, hi)).otherwise(between(lo, mid))

    return between(0, len(bounds))


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", id_column: str = "page_id") -> DataFrame:
    """(id, host, path, rule, verdict) of every row of ``pages``; ``rule`` is null and the verdict ``otherwise`` if none fits.

    ``rules``: (host, path, verdict). A rule fits its host and all subdomains if the url's path begins with its path. The
    longest rule (host and path) decides, of equally long ones the one with the longer host.
    Repeated rows repeat, null ids stay null.

    The urls of a range of keys are dealt over as many tasks as their number asks for, by a hash of url and id, and each
    task gets the stretches of its range; so a host with a third of all urls is spread out.
    """
    spark = pages.sparkSession
    held = stretches(rules)
    bounds = ranges(rules.dropna(subset=["host", "path", "verdict"]).select(key(F.col("host")).alias("key")))
    host, path = parts(F.col("url"))
    urls = pages.select(F.col(id_column).alias("id"), F.col("url")).select("id", "url", host.alias("host"), path.alias("path")).withColumn("key", key(F.col("host")))
    urls = urls.withColumn("bucket", bucket(F.col("key"), bounds))
    if bounds:
        counts = {r["bucket"]: r["n"] for r in urls.groupBy("bucket").agg(F.count("*").alias("n")).collect()}  # RANGES rows at most
    else:
        counts = {0: 1}
    total, tasks = max(1, sum(counts.values())), 3 * partitions(spark)
    shares = [max(1, -(-tasks * counts.get(b, 0) // total)) for b in range(len(bounds) + 1)]
    share = F.element_at(F.array(*map(F.lit, shares)), F.col("bucket") + 1)
    urls = urls.select("bucket", F.pmod(F.xxhash64("id", "url"), share).cast("int").alias("deal"), "key", F.lit(1).alias("kind"), "id", "host", "path")
    marks = held.select("bucket", F.explode(F.sequence(F.lit(0), share - 1)).alias("deal"), "key", F.lit(0).alias("kind"), "active")
    both = urls.unionByName(marks, allowMissingColumns=True)
    sweep = Window.partitionBy("bucket", "deal").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = both.withColumn("active", F.last("active", ignorenulls=True).over(sweep)).where("kind = 1")
    fits = F.filter(F.col("active"), lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("n"), (F.length(r["rule"]) - F.length(r["path"])).alias("h"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return swept.select(F.col("id").alias(id_column), "host", "path", best.alias("best")).select(id_column, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))
