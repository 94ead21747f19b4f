"""URL filters by a sort-merge range join of reversed-host keys (operator 12).

A rule (host, path) has the canonical key ``reversed labels/path``: ``example.net`` with
``/en/`` is ``net.example//en/``. All keys it fits begin with it, so it is the interval
from its key on. A url has one such key for each of its host's endings (no more labels than
the longest rule host has), since a rule also fits subdomains.

Keys are dealt into slices by sampled bounds; a bound also holds a hash of the row, so that one
very common key or host is split over slices. A rule goes to every slice that its interval
meets. Each slice is sorted and swept once with a stack of the rules that are still
active: intervals of prefixes are nested or apart, so the top of the stack is the longest
rule of a key. The longest over the keys of a url wins.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from panelrisk.llm.tables import shuffle_width

ALLOW, BLOCK = "allow", "block"

#: Keys sampled per slice to find the bounds.
SAMPLE_PER_SLICE = 64
#: A row that is repeated more often than this is written out in several steps.
REPEATS = 4096

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url):
    """Columns host (A-Z lower-cased) and path of a url column; both empty without ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    parts = "(?s)^.*?://([^/?#]*)([^?#]*)"
    return (F.translate(F.regexp_extract(url, parts, 1), _UPPER, _LOWER).alias("host"),
            F.regexp_extract(url, parts, 2).alias("path"))


def _labels(host):
    return F.reverse(F.split(host, "\\."))


def _key(labels, path):
    return F.concat(F.array_join(labels, "."), F.lit("/"), path)


def rule_keys(rules: DataFrame) -> DataFrame:
    """(key, host, path, verdict) of the rules that can fit a url."""
    host = F.translate(F.col("host").cast("string"), _UPPER, _LOWER)
    return rules.select(host.alias("host"),
                        F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"),
                        F.col("verdict").cast("string").alias("verdict")) \
        .filter((F.col("host") != "") & F.col("verdict").isin(ALLOW, BLOCK)) \
        .distinct().select(_key(_labels(F.col("host")), F.col("path")).alias("key"),
                           "host", "path", "verdict")


def _url_keys(urls: DataFrame, most_labels: int) -> DataFrame:
    """One row per url and host ending: key, hash of the row, which ending it is."""
    labels = _labels(F.col("host"))
    ends = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(most_labels, 1)))),
                       lambda n: F.slice(labels, 1, n))
    return urls.filter(F.col("host") != "").select(
        "*", F.xxhash64("keep", "host", "path").alias("h"),
        F.posexplode(ends).alias("ending", "labels")) \
        .select("keep", "host", "path", "h", "ending",
                _key(F.col("labels"), F.col("path")).alias("key"))


def _bounds(keys: DataFrame, slices: int):
    """(key, hash) at which slices 1, 2, ... begin, from a bounded sample of the rows."""
    spread = F.xxhash64("h", "ending", F.lit("sample"))
    sample = sorted((r.key, r.h) for r in keys.select("key", "h").orderBy(spread)
                    .limit(slices * SAMPLE_PER_SLICE).collect())
    step = max(1, len(sample) // slices)
    return sample[step::step][:slices - 1]


def _with_slice(keys: DataFrame, bounds) -> DataFrame:
    def run(batches):
        for batch in batches:
            at = [bisect_right(bounds, pair) for pair in
                  zip(batch.column("key").to_pylist(), batch.column("h").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())],
                                             [*batch.schema.names, "slice"])

    return keys.mapInArrow(run, StructType([*keys.schema, StructField("slice", IntegerType())]))


def _to_slices(rules: DataFrame, bounds) -> DataFrame:
    """Each rule once for every slice that its interval meets."""
    names = [*rules.columns, "slice"]
    schema = pa.schema([*((c, pa.string()) for c in rules.columns), ("slice", pa.int32())])

    def run(batches):
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                first = last = bisect_left(bounds, (row[0],))
                while last < len(bounds) and bounds[last][0].startswith(row[0]):
                    last += 1
                out += [(*row, at) for at in range(first, last + 1)]
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*out))), schema=schema)

    return rules.mapInArrow(run, StructType([*rules.schema, StructField("slice", IntegerType())]))


def _sweep(batches):
    """Rows sorted by slice and key, a rule (no ending) ahead of the urls with its key."""
    now, stack = None, []
    for batch in batches:
        column = dict(zip(batch.schema.names, batch.columns))
        found = []
        for at, key, rule, size, verdict in zip(
                *(column[c].to_pylist() for c in ("slice", "key", "rule", "host_size", "verdict"))):
            if at != now:
                now, stack = at, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if rule is not None:
                stack.append((key, rule, size, verdict))
            found.append(stack[-1][1:] if stack else (None, None, None))
        rule, size, verdict = zip(*found) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [*(column[c] for c in ("keep", "host", "path", "ending")), pa.array(rule, pa.string()),
             pa.array(size, pa.int32()), pa.array(verdict, pa.string())],
            ["keep", "host", "path", "ending", "rule", "host_size", "verdict"]) \
            .filter(pc.is_valid(column["ending"]))


def judge(pages: DataFrame, rules: DataFrame, keep=("page_id",), url_col="url",
          otherwise: str = ALLOW, slices: int | None = None) -> DataFrame:
    """The ``keep`` columns with host, path, rule and verdict, one row per row of ``pages``.

    A rule (host, path, verdict) fits its host and all subdomains where the url's path begins
    with the rule's; the longest rule wins (of equally long ones that with the longer host, of
    equal ones the blocking one), ``otherwise`` holds where none fits. ``rule`` is the
    rule's host and path, or NULL.

    A NULL url, or one without ``://``, has an empty host and path and fits no rule; neither does an
    empty host. A url without a path fits only rules without one. Rules without a host or with
    another verdict than allow and block are left out; a NULL path is empty. Repeated rows
    and NULLs in ``keep`` columns are returned as they are. Urls of any length are taken
    whole. Other columns, of whatever name, are ignored. An empty table gives no rows.
    """
    slices = slices or shuffle_width(pages.sparkSession)
    urls = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("keep"),
                        *host_and_path(F.col(f"`{url_col}`")))
    prepared = rule_keys(rules)
    most = prepared.agg(F.max(F.size(F.split("host", "\\.")))).first()[0] or 0
    keys = _url_keys(urls, most)
    bounds = _bounds(keys, slices)
    own = _to_slices(prepared, bounds).select(
        "slice", "key", F.concat("host", "path").alias("rule"),
        F.char_length("host").alias("host_size"), "verdict")
    both = _with_slice(keys, bounds).drop("h").unionByName(own, allowMissingColumns=True)
    fits = StructType([*urls.schema, StructField("ending", IntegerType()),
                       StructField("rule", StringType()), StructField("host_size", IntegerType()),
                       StructField("verdict", StringType())])
    # of equal rules the blocking one comes last, so it lies on top
    swept = both.repartition(slices, "slice").sortWithinPartitions(
        "slice", "key", F.col("ending").asc_nulls_first(), "verdict").mapInArrow(_sweep, fits)
    # the longest rule of all endings; a url stands for itself once, by its first ending
    best = swept.select("keep", "host", "path", F.when(F.col("rule").isNotNull(), F.struct(
        F.char_length("rule").alias("size"), "host_size", "verdict", "rule")).alias("best"),
        (F.col("ending") == 0).cast("long").alias("n"))
    hostless = urls.filter(F.col("host") == "").select(
        "*", F.lit(None).cast(best.schema["best"].dataType).alias("best"),
        F.lit(1).cast("long").alias("n"))
    judged = best.unionByName(hostless).groupBy("keep", "host", "path").agg(
        F.max("best").alias("best"), F.sum("n").alias("n"))
    # repeated rows come back as often as they were there
    steps = F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {REPEATS}")))
    copies = F.expr(f"explode(array_repeat(0, cast(least({REPEATS}, n - step * {REPEATS}) as int)))")
    return judged.select("*", steps.alias("step")).select("*", copies.alias("copy")).select(
        "keep.*", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))


RULES = [("net", "/", BLOCK), ("example.net", "/en/", ALLOW), ("example.com", "/de/", BLOCK),
         ("org", "/fr/", ALLOW)]

ORACLE = f"""WITH parts AS (
  SELECT page_id, strpos(coalesce(url, ''), '://') AS mark, coalesce(url, '') AS url FROM pages),
rests AS (
  SELECT page_id, CASE WHEN mark > 0 THEN substr(url, mark + 3) ELSE '' END AS rest FROM parts),
named AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
rules(rhost, rpath, verdict) AS (VALUES {', '.join(map(str, RULES))}),
fits AS (
  SELECT page_id, host, path, rhost || rpath AS rule, verdict, row_number() OVER (
    PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS place
  FROM named JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost))
    AND starts_with(path, rpath))
SELECT n.page_id, n.host, n.path, f.rule, coalesce(f.verdict, '{ALLOW}') AS verdict
FROM named n LEFT JOIN fits f ON n.page_id = f.page_id AND f.place = 1"""
