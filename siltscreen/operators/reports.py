"""Roll-ups of sanitised rows and of the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from siltscreen.schema import COMMAND_TOOL, COUNTERS, FILE_TOOL, LABELS, LOG_KEYS, PAGE_TOOL, SESSION_COUNTERS
from siltscreen.sources.scratch import scratch_dir


def threat_labels(stats: Column) -> Column:
    """`["3 hidden elements", ...]` for the labelled counters above zero, in display order."""
    labels = [
        F.when(stats[c] > 0, F.concat(stats[c].cast("string"), F.lit(f" {label}"))) for c, label in LABELS
    ]
    return F.array_compact(F.array(*labels))


def is_clean(stats: Column) -> Column:
    """No labelled counter is above zero; the six others do not matter."""
    dirty = F.lit(False)
    for c, _ in LABELS:
        dirty = dirty | (stats[c] > 0)
    return ~dirty


def reduction_percent(input_size: Column, output_size: Column) -> Column:
    """One decimal, halves rounded up; 0 for empty input; negative when the row grew."""
    share = (1 - output_size / input_size) * 1000
    return F.when(input_size > 0, F.floor(share + 0.5) / 10).otherwise(F.lit(0.0))


def session_totals(df: DataFrame, *keys: str) -> DataFrame:
    """Processed rows and counter sums per key: partial sums before one exchange on the key."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("total_requests"),
        *[F.sum(f"stats.{c}").alias(c) for c in COUNTERS],
    )


def observed_totals(df: DataFrame) -> tuple[DataFrame, Observation]:
    """The rows as they are, and totals that come with the query that writes them: no second scan.

    The job is the session.  Put it last, right before the write, so that the totals are taken in the
    writing tasks: Spark counts such a task once, even when it runs again or twice, but not a task before
    an exchange.  `totals_of` waits for the write.  NULL statistics and sizes count as nothing.
    """
    observation = Observation()
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in [*[(f"stats.{c}", c) for c in COUNTERS], ("input_size", "total_input"), ("output_size", "total_output")]]
    return df.observe(observation, F.count(F.lit(1)).alias("total_requests"), *sums), observation


def totals_of(spark: SparkSession, observation: Observation) -> DataFrame:
    """One row: requests, counters, sizes and their reduction, after the observed query has run."""
    names = ["total_requests", *COUNTERS, "total_input", "total_output"]
    found = observation.get
    row = spark.createDataFrame([tuple(found[n] for n in names)], ", ".join(f"{n} bigint" for n in names))
    ratio = (1 - F.col("total_output") / F.col("total_input")) * 100
    return row.withColumn("avg_reduction", F.when(F.col("total_input") > 0, _half_up(ratio)).otherwise(F.lit(0).cast("bigint")))


def session_report(df: DataFrame, session: str) -> DataFrame:
    """The nine reported totals per session, one row per `(session, counter)`."""
    totals = session_totals(df, session)
    return totals.select(session, "total_requests", *SESSION_COUNTERS).unpivot(
        [session, "total_requests"], SESSION_COUNTERS, "counter", "total"
    )


def session_sources(df: DataFrame, session: str, order: str, bucket: Column | None = None) -> DataFrame:
    """What a session processed, in order: one row per source with its `kind` and `position`.

    `order` may be of any type that sorts; equal places are ordered by the source, a NULL comes first.  A
    session may hold a third of all rows, so it is neither collected into one array nor ranked in one
    task: rows are ranked inside a bucket, and the counts of the earlier buckets, one row per (session,
    kind, bucket), are added.  Without a `bucket`, the buckets are the partitions of a range exchange
    (see `ranged_sources`); a `bucket` given must not decrease with `order` and saves that exchange.  A
    row of another tool has the kind "other".  A NULL session is a session; no rows give no rows.
    """
    kind = (
        F.when(F.col("tool") == PAGE_TOOL, "urls")
        .when(F.col("tool") == FILE_TOOL, "files")
        .when(F.col("tool") == COMMAND_TOOL, "commands")
        .otherwise("other")
    )
    names = {"_session": F.col(session), "_kind": kind, "_order": F.col(order), "_source": F.col("source")}
    listed = df.select(*[c.alias(name) for name, c in names.items()], *([] if bucket is None else [bucket.alias("_bucket")]))
    if bucket is None:
        listed = ranged_sources(listed)
    else:
        listed = listed.withColumn("_n", F.lit(1).cast("bigint"))
    keys = ["_session", "_kind"]
    in_bucket = Window.partitionBy(*keys, "_bucket").orderBy("_order", "_source").rowsBetween(Window.unboundedPreceding, -1)
    ranked = listed.withColumn("_rank", F.coalesce(F.sum("_n").over(in_bucket), F.lit(0)))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        listed.groupBy(*keys, "_bucket")
        .agg(F.sum("_n").alias("_all"))
        .withColumn("_before", F.coalesce(F.sum("_all").over(earlier), F.lit(0)))
        .drop("_all")
    )
    # A session, or a place in it, may be NULL: such rows are a session of their own.
    a, b = ranked.alias("a"), before.alias("b")
    same = F.lit(True)
    for name in (*keys, "_bucket"):
        same = same & F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}"))
    start = F.col("a._rank") + F.col("b._before")
    placed = a.join(b, same).select(*[F.col(f"a.{k}") for k in (*keys, "_source", "_n")], start.alias("_start"))
    position = _repeated(placed) if bucket is None else placed.withColumn("_position", F.col("_start") + 1)
    return position.select(
        F.col("_session").alias(session), F.col("_kind").alias("kind"), F.col("_position").cast("bigint").alias("position"), F.col("_source").alias("source")
    )


#: Copies of one row that are written out by one row of the step before.
COPIES = 10_000


def ranged_sources(listed: DataFrame) -> DataFrame:
    """Different rows of `listed` with their number `_n` and `_bucket`, the place of their range.

    Equal rows are counted first, so a million copies are one row.  Ranges go by session, kind, order and
    source, and are written before they are numbered: a task that runs again after an executor is lost
    reads the same ranges, which sampled bounds alone do not promise.
    """
    spark = listed.sparkSession
    folder = scratch_dir(spark, "ranges")
    counted = listed.groupBy(*listed.columns).agg(F.count("*").alias("_n"))
    ranges = counted.repartitionByRange(*listed.columns).withColumn("_bucket", F.spark_partition_id())
    ranges.write.parquet(folder)
    return spark.read.schema(ranges.schema).parquet(folder)


def _repeated(placed: DataFrame) -> DataFrame:
    """A row per position; many copies of a row are written out by several tasks."""
    last = F.floor((F.col("_n") - 1) / COPIES)
    parts = placed.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    many = parts.filter(F.col("_n") > COPIES).repartition("_start", "_part")
    first = F.col("_start") + F.col("_part") * COPIES + 1
    stop = F.least(F.col("_start") + F.col("_n"), first + (COPIES - 1))
    spread = parts.filter(F.col("_n") <= COPIES).unionByName(many)
    return spread.withColumn("_position", F.explode(F.sequence(first, stop)))


def order_buckets(df: DataFrame, order: str, most: int = 64) -> Column:
    """A bucket number that does not decrease with `order`, with about as many rows in each.

    For an order that is a number.  There are as many buckets as the root of the number of rows, up to
    `most`; `session_sources` without buckets has neither limit.
    """
    wanted = max(1, min(most, int(df.count() ** 0.5)))
    shares = [i / wanted for i in range(1, wanted)]
    bounds = sorted(set(df.stat.approxQuantile(order, shares, 0.25 / wanted))) if shares else []
    return F.size(F.filter(F.array(*[F.lit(x) for x in bounds]), lambda x: x < F.col(order))) if bounds else F.lit(0)


# --- the log ---------------------------------------------------------------------


def log_entries(
    df: DataFrame,
    tool: Column,
    source: Column,
    at: Column | None = None,
    duration_ms: Column | None = None,
    description: Column | None = None,
) -> DataFrame:
    """Sanitised rows in the log's shape; counters that the log writer expects as a map."""
    pairs = [x for c in COUNTERS for x in (F.lit(LOG_KEYS[c]), F.col(f"stats.{c}"))]
    none = F.lit(None).cast("string")
    return df.select(
        (F.current_timestamp() if at is None else at).alias("timestamp"),
        tool.alias("tool"),
        source.alias("source"),
        (none if description is None else F.nullif(description, F.lit(""))).alias("description"),
        F.create_map(*pairs).alias("stripped"),
        F.col("input_size").alias("inputSize"),
        F.col("output_size").alias("outputSize"),
        reduction_percent(F.col("input_size"), F.col("output_size")).alias("reductionPercent"),
        (F.lit(None) if duration_ms is None else duration_ms).cast("bigint").alias("durationMs"),
    )


def _half_up(value: Column) -> Column:
    return F.floor(value + 0.5).cast("bigint")


def log_summary(log: DataFrame) -> DataFrame:
    """Requests, sizes, reduction (of the sums, not a mean of ratios) and mean duration."""
    sums = log.agg(
        F.count("*").alias("requests"),
        F.coalesce(F.sum("inputSize"), F.lit(0)).alias("total_input"),
        F.coalesce(F.sum("outputSize"), F.lit(0)).alias("total_output"),
        F.sum("durationMs").alias("_ms"),
    )
    ratio = (1 - F.col("total_output") / F.col("total_input")) * 100
    return sums.select(
        "requests",
        "total_input",
        "total_output",
        F.when(F.col("total_input") > 0, _half_up(ratio)).otherwise(F.lit(0).cast("bigint")).alias("avg_reduction"),
        F.when(F.col("requests") > 0, _half_up(F.col("_ms") / F.col("requests"))).alias("avg_duration_ms"),
    )


def stripped_by_key(log: DataFrame) -> DataFrame:
    """Sum per counter key over whatever keys the log carries; zero sums are left out."""
    return (
        log.select(F.explode("stripped").alias("key", "n"))
        .groupBy("key")
        .agg(F.sum("n").alias("total"))
        .filter("total > 0")
    )


def recent(log: DataFrame, n: int = 5, tie_break: tuple[str, ...] = ("source",)) -> DataFrame:
    """The last `n` rows by time, with the time cut to seconds."""
    order = [F.desc("timestamp"), *[F.desc(c) for c in tie_break]]
    return log.orderBy(*order).limit(n).select(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("logged_at"), "tool", "source"
    )
