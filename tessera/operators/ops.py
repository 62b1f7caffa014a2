"""Logs, metrics and diagnosis: summaries, thresholds, searches, cached tool results."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.functions import text as X
from tessera.functions.patterns import Patterns
from tessera.operators.retrieval import arrow_rows, blockwise

# Alert bounds, name parts of the series that explain a root cause.
CPU_PERCENT, MEMORY_PERCENT, MAX_SERIES, CLIP, MAX_OBSERVATIONS = 80, 70, 12, 2500, 6
SERIES_PARTS = {
    "cpu": ["-cpu", "-cpu_cfs", "latency", "success_rate", "-rps"],
    "memory": ["-mem", "latency", "success_rate", "-rps"],
    "network": ["network_receive", "network_transmit", "latency", "success_rate", "-rps"],
}


def metric_summary(series: DataFrame) -> DataFrame:
    """Per series first, last, least, greatest, mean and count; rows (series, ordinal, value)."""
    number = F.col("value").try_cast("double") if dict(series.dtypes)["value"] == "string" else F.col("value").cast("double")
    rows = series.withColumn("value", number).filter("value IS NOT NULL AND NOT isnan(value)")
    r = lambda c, name: F.round(c, 4).alias(name)
    return rows.groupBy("series").agg(
        r(F.min_by("value", "ordinal"), "first"), r(F.max_by("value", "ordinal"), "last"), r(F.min("value"), "min"), r(F.max("value"), "max"), r(F.avg("value"), "mean"), F.count("*").alias("samples")
    )


def unpivoted(wide: DataFrame, time_col: str = "time") -> DataFrame:
    """A wide metrics table as (ordinal, time, series, position, value)."""
    names = [c for c in wide.columns if c != time_col]
    pairs = F.array(*(F.struct(F.lit(c).alias("series"), F.lit(i).alias("position"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(names)))
    return wide.select(F.col(time_col).alias("ordinal"), F.explode(pairs).alias("s")).select("ordinal", "s.series", "s.position", "s.value")


def chosen_series(series: DataFrame, target: str, root_cause: str, limit: int = MAX_SERIES) -> DataFrame:
    """series whose name holds the target and a part that the root cause asks for, the first 12."""
    parts = next((p for k, p in SERIES_PARTS.items() if k in root_cause), None)
    test = F.col("series").contains(target)
    if parts:
        test = test & F.exists(X.strings(parts), lambda p: F.col("series").contains(p))
    names = series.filter(test).groupBy("series").agg(F.min("position").alias("position"))
    return names.orderBy("position", "series").limit(limit)


def log_search(logs: DataFrame, start: Column, end: Column, phrase: str = "*", limit: int = 100) -> DataFrame:
    """Rows from start to before end that hold the phrase, newest first, at most ``limit`` of 1 to 1000."""
    if not 1 <= limit <= 1000:
        raise ValueError("the limit of a log search lies from 1 to 1000")
    rows = logs.filter((F.col("ts") >= start) & (F.col("ts") < end))
    if phrase.strip() not in ("", "*"):
        rows = rows.filter(F.col("message").contains(phrase.strip()))
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(limit)


def fuzzy_lookup(catalog: DataFrame, wanted: DataFrame, name: str, ask: str) -> DataFrame:
    """Catalog rows whose name holds the asked text or lies in it, without regard to case.

    Asked texts are a stated set and go in blocks; a task looks for them in its
    catalog names, and for the names in them, by automata.  The pairs of
    strings then meet the rows of both sides by equality.  A null or empty
    asked text finds nothing, an empty name is found by every other one.
    """
    low = lambda c: F.lower(F.trim(F.col(c)))
    texts, names = wanted.select(low(ask).alias("a")).filter("a <> ''").distinct(), catalog.select(low(name).alias("b")).filter("b IS NOT NULL").distinct()
    types = StructType([StructField("_asked", StringType()), StructField("_name", StringType())])

    def pairs(block: list) -> DataFrame:
        asked = [r[0] for r in block]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            inside = Patterns(asked)
            for batch in batches:
                held = set(batch.column(0).to_pylist())
                found = {(a, b) for b in held for a in inside.within(b)}
                around = Patterns(held)
                found |= {(a, b) for a in asked for b in around.within(a) | ({""} & held)}
                yield from arrow_rows(sorted(found), types)

        return names.mapInArrow(run, types)

    found = blockwise(texts, pairs)
    out = wanted.withColumn("_asked", low(ask)).join(found, "_asked").join(catalog.withColumn("_name", low(name)), "_name")
    return out.drop("_asked", "_name")


# Regions of the log service and their codes.
REGIONS = {"北京": "ap-beijing", "上海": "ap-shanghai", "广州": "ap-guangzhou", "中国香港": "ap-hongkong"}
# Tools whose results are replayed, and the most characters of a replayed result.
REPLAY_TOOLS = ("GetAlerts", "GetClusterConfiguration", "GetResources", "DescribeResource", "CheckNodeServiceStatus", "GetErrorLogs", "GetServiceDependencies", "CheckServiceConnectivity", "GetAppYAML", "ListCodeFiles")


def region_lookup(names: DataFrame, column: str = "region_name") -> DataFrame:
    """Each name with its region code and whether there is one; the table is four rows of constants."""
    codes = F.create_map(*(F.lit(v) for pair in REGIONS.items() for v in pair))
    code = F.try_element_at(codes, F.col(column))
    return names.withColumn("region_code", code).withColumn("available", F.col("region_code").isNotNull())


def replayed(calls: DataFrame, cached: DataFrame, most: int = 20_000) -> DataFrame:
    """Each call of a known tool with the best cached result (J16), cut at ``most`` characters, or a note that there is none.

    ``calls`` has call_id, tool and args, ``cached`` key, tool, args and output.
    """
    asked = calls.filter(F.col("tool").isin(*REPLAY_TOOLS)).withColumn("want", _pairs(F.col("args")))
    best = best_of_wants(asked.select("tool", "want").distinct(), cached)
    outputs = cached.join(best.select("key").distinct(), "key", "left_semi").select("key", "output")
    rows = asked.join(best.join(outputs, "key").select("tool", "want", "key", "output"), ["tool", "want"], "left")
    cut = F.when(F.length("output") > most, F.concat(F.substring("output", 1, most), F.lit("\n[output truncated]"))).otherwise(F.col("output"))
    missing = F.concat(F.lit("No cached result for "), "tool", F.lit(" with arguments "), F.to_json("args"))
    return rows.select("call_id", "tool", F.col("key").alias("matched_key"), F.coalesce(cut, missing).alias("result"))


def above_thresholds(samples: DataFrame) -> DataFrame:
    """Values rounded to one place that are strictly above their bound."""
    value = F.round("value", 1)
    bound = F.when(F.col("metric") == "cpu", CPU_PERCENT).when(F.col("metric") == "memory", MEMORY_PERCENT)
    return samples.withColumns({"value": value, "alert": F.coalesce(value > bound, F.lit(False))})


def _pairs(args: Column) -> Column:
    """Arguments that ask something, as ``name=value``; a resource type counts without case and plural s."""
    kept = F.map_filter(args, lambda k, v: v.isNotNull() & ~F.lower(v).isin("", "0", "false", "none"))
    plain = lambda k, v: F.when(k == "resource_type", F.regexp_replace(F.lower(v), "s+$", "")).otherwise(v)
    return F.array_sort(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), plain(e["key"], e["value"]))))


def best_arguments(calls: DataFrame, cached: DataFrame) -> DataFrame:
    """For each call the cached call of the same tool whose arguments hold all asked ones.

    ``calls`` has (call_id, tool, args), ``cached`` (key, tool, args), args being
    maps of strings; empty values ask nothing.  The fewest extra arguments win,
    then the key.  Calls that ask the same are answered once.
    """
    asked = calls.select("call_id", "tool", _pairs(F.col("args")).alias("want"))
    best = best_of_wants(asked.select("tool", "want").distinct(), cached)
    return asked.join(best, ["tool", "want"]).select("call_id", "key", "extra")


def best_of_wants(wants: DataFrame, cached: DataFrame) -> DataFrame:
    """J16 for distinct (tool, want): the same with the key of the best cached call and its number of extra arguments.

    Of cached calls with the same arguments only the one of least key can win,
    so rows are argument sets, however many calls have one.  A want meets the
    sets that hold its rarest argument; one that asks nothing takes the best
    of its tool.
    """
    have = cached.select("tool", "key", _pairs(F.col("args")).alias("has")).groupBy("tool", "has").agg(F.min("key").alias("key"))
    listed = have.select("tool", "key", "has", F.explode("has").alias("pair"))
    counts = listed.groupBy("tool", "pair").agg(F.count("*").alias("n"))
    rarest = wants.select("tool", "want", F.explode("want").alias("pair")).join(counts, ["tool", "pair"], "left")
    rarest = rarest.groupBy("tool", "want").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "pair")).alias("least")).filter("least.n > 0")
    met = rarest.select("tool", "want", F.col("least.pair").alias("pair")).join(listed, ["tool", "pair"])
    fits = met.filter(F.size(F.array_except("want", "has")) == 0).select("tool", "want", (F.size("has") - F.size("want")).alias("extra"), "key")
    best = fits.groupBy("tool", "want").agg(F.min(F.struct("extra", "key")).alias("best"))
    first = have.groupBy("tool").agg(F.min(F.struct(F.size("has").alias("extra"), "key")).alias("best"))
    free = wants.filter("size(want) = 0").join(first, "tool").select("tool", "want", "best")
    return best.unionAll(free).select("tool", "want", "best.key", "best.extra")


def observations(cached: DataFrame, parts: list[str], limit: int = MAX_OBSERVATIONS) -> DataFrame:
    """the first cached results of a case whose key holds one of the parts, clipped."""
    held = cached.filter(F.exists(X.strings(parts), lambda p: F.col("key").contains(p)))
    order = W.partitionBy("case_id").orderBy("position", "key")
    return held.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= limit).select("case_id", "key", F.substring("output", 1, CLIP).alias("output"))


def diagnosis_scores(results: DataFrame) -> DataFrame:
    """A result's flags: any normalised accepted name lies in the normalised prediction.

    Rows (case_id, completed, causes, objects, said_cause, said_object, latency).
    """
    hit = lambda names, said: F.exists(names, lambda n: (X.alnum(n) != "") & X.alnum(F.coalesce(said, F.lit(""))).contains(X.alnum(n)))
    cause, thing = hit(F.col("causes"), F.col("said_cause")), hit(F.col("objects"), F.col("said_object"))
    return results.withColumns({"cause_ok": F.col("completed") & cause, "object_ok": F.col("completed") & thing, "joint_ok": F.col("completed") & cause & thing})


def diagnosis_report(scored: DataFrame) -> DataFrame:
    """Rates over completed results only, null if there is none; the mean of non-zero latencies."""
    rate = lambda c, name: F.round(F.avg(F.when(F.col("completed"), F.col(c).cast("double"))), 4).alias(name)
    return scored.agg(
        F.count("*").alias("n"), F.count_if("completed").alias("completed"), rate("cause_ok", "cause_accuracy"), rate("object_ok", "object_accuracy"), rate("joint_ok", "joint_accuracy"),
        F.round(F.avg(F.when(F.col("latency") > 0, F.col("latency"))), 3).alias("mean_latency"),
    )


def batch_stats(runs: DataFrame) -> DataFrame:
    """Runs, total and mean time by status."""
    return runs.groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum("elapsed"), 3).alias("total"), F.round(F.avg("elapsed"), 3).alias("mean"))


def error_rollup(rows: DataFrame) -> DataFrame:
    """Counts of three classes of ingest errors; a fallback alone is no error."""
    n = lambda k: F.count_if(F.col("kind") == k).alias(k)
    return rows.agg(n("parse_error"), n("insert_error"), n("embed_fallback")).withColumn("has_errors", (F.col("parse_error") + F.col("insert_error")) > 0)
