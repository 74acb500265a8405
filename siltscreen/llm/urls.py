"""URL filters by a temporal list join: was a capture's address listed when it was fetched?

Dated list entries (added, removed) become validity intervals; each capture's address gives the keys that
an entry could have (the address, its host, its domains, its path prefixes), and an as-of join gives every
capture the last interval of each key and list that began before it; it counts if it has not ended.
The join is one window over starts and captures in order of time, cut into hours, with the state at an
hour's begin carried over from earlier hours.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltscreen.llm.common import col, join_checked, stored, without

#: Captures of a key in one hour, from which on they are dealt over several tasks, each with the hour's starts.
PART_ROWS = 200_000
#: Entries, gaps and captures of a key are ordered hour by hour, so no task holds all of a key.
SLOT = "hour"
KINDS = ("url", "host", "domain", "prefix")

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*://"


def url_host(url: Column) -> Column:
    """Host in lower case, without user, port and a last dot; empty where the text is no address."""
    host = F.regexp_extract(url, _SCHEME + r"(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(F.lower(host), r"\.$", "")


def url_path(url: Column) -> Column:
    """Path without query and fragment, without its first slash."""
    return F.regexp_extract(url, _SCHEME + r"[^/?#]*/([^?#]*)", 1)


def whole_url(url: Column) -> Column:
    """Address without scheme and fragment; the host in lower case."""
    rest = F.regexp_extract(url, _SCHEME + r"[^/?#]*([^#]*)", 1)
    return F.concat(url_host(url), rest)


def _neighbour(df: DataFrame, keys: list[str], time: str, value: Column, back: bool, name: str) -> DataFrame:
    """Add the value of the row before (or after) each row of its keys in time; times are different.

    Rows are ordered within an hour; over hours, one row each is.  So a key with any number of rows is
    split by hours, and what is ordered as a whole has at most a row an hour.
    """
    df = df.withColumn("_slot", F.date_trunc(SLOT, time)).withColumn("_value", value)
    inner = Window.partitionBy(*keys, "_slot").orderBy(time)
    edge = F.max_by("_value", time) if back else F.min_by("_value", time)
    slots = df.groupBy(*keys, "_slot").agg(edge.alias("_edge"))
    outer = Window.partitionBy(*keys).orderBy("_slot")
    step = F.lag if back else F.lead
    slots = slots.withColumn("_other", step("_edge").over(outer)).drop("_edge")
    return df.withColumn("_near", step("_value").over(inner)).join(slots, [*keys, "_slot"]).withColumn(name, F.coalesce("_near", "_other")).drop("_near", "_other", "_value", "_slot")


def intervals(entries: DataFrame) -> DataFrame:
    """`list, kind, value, since, until` from `list, kind, value, dated, listed`; until is null while it lasts.

    An entry holds from its date on.  Of entries of one date the one that lists wins.  Entries that do not
    change the state are joined to the interval they are in.  Rows with a null in any column are no entries.
    """
    keys = ["list", "kind", "value"]
    known = entries.select(*keys, "dated", "listed").dropna()
    once = known.groupBy(*keys, "dated").agg(F.max("listed").alias("listed"))
    changed = _neighbour(once, keys, "dated", F.col("listed"), True, "_was").filter(F.col("listed") != F.coalesce("_was", F.lit(False)))
    ended = _neighbour(changed, keys, "dated", F.col("dated"), False, "until")
    return ended.filter("listed").select(*keys, F.col("dated").alias("since"), "until")


def candidate_keys(url: Column, labels: int, segments: int) -> Column:
    """Every (kind, value) that an entry about this address may have.

    Only domains of up to `labels` labels and prefixes of up to `segments` segments, the most that any
    entry has: longer ones cannot match.
    """
    host, path = url_host(url), url_path(url)
    parts = F.split(host, r"\.")
    pieces = F.filter(F.split(path, "/"), lambda s: s != "")
    make = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    upto = lambda n, size: F.when(F.least(F.lit(n), size) > 0, F.sequence(F.lit(1), F.least(F.lit(n), size))).otherwise(F.array().cast("array<int>"))
    domains = F.transform(upto(labels, F.size(parts)), lambda k: make("domain", F.array_join(F.slice(parts, -k, k), ".")))
    prefixes = F.transform(upto(segments, F.size(pieces)), lambda k: make("prefix", F.concat(host, F.lit("/"), F.array_join(F.slice(pieces, 1, k), "/"))))
    every = F.concat(F.array(make("url", whole_url(url)), make("host", host)), domains, prefixes)
    return F.when(host != "", every).otherwise(F.array().cast("array<struct<kind:string,value:string>>"))


def as_of(asked: DataFrame, spans: DataFrame) -> DataFrame:
    """`asked` (`list, kind, value, _url, _at`) with the `since` of the interval that holds `_at`; others go.

    Starts and captures of a key are walked together in order of time within an hour.  The last start of
    earlier hours goes in front, found on one row a key and hour.  An hour with many captures of one key
    is dealt over tasks by the captures' hash, with the starts in each.  So work is that of a sort,
    whatever the number of intervals of a key.
    """
    keys = ["list", "kind", "value"]
    by_hour = [*keys, "_slot"]
    asked = asked.withColumn("_slot", F.date_trunc(SLOT, "_at"))
    starts = spans.select(*keys, F.struct("since", "until").alias("_state"), F.date_trunc(SLOT, "since").alias("_slot"))
    counts = asked.groupBy(*by_hour).agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("_parts"), F.lit(None).cast(starts.schema["_state"].dataType).alias("_last"))
    lasts = starts.groupBy(*by_hour).agg(F.lit(None).cast("int").alias("_parts"), F.max("_state").alias("_last"))
    hours = counts.unionByName(lasts).groupBy(*by_hour).agg(F.max("_parts").alias("_parts"), F.max("_last").alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    needed = stored(hours.withColumn("_state", F.last("_last", ignorenulls=True).over(earlier)).filter("_parts is not null").drop("_last"))
    busy = stored(needed.filter("_parts > 1").drop("_state"))
    part = F.pmod(F.xxhash64("_url", "_at"), F.coalesce("_parts", F.lit(1))).cast("int")
    captures = join_checked(asked, busy, by_hour, "left").select(*by_hour, part.alias("_part"), F.col("_at").alias("_time"), "_url", "_at", F.lit(None).cast(starts.schema["_state"].dataType).alias("_state"))
    states = needed.filter("_state is not null").unionByName(starts.join(needed.drop("_state"), by_hour))
    copies = states.select(*by_hour, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.col("_state.since").alias("_time"), "_state")
    both = captures.unionByName(copies, allowMissingColumns=True)
    walk = Window.partitionBy(*by_hour, "_part").orderBy("_time", F.col("_state").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = both.withColumn("_now", F.last("_state", ignorenulls=True).over(walk)).filter("_url is not null and _now is not null and (_now.until is null or _at < _now.until)")
    return held.select(*keys, "_url", "_at", F.col("_now.since").alias("since"))


def listed_captures(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """Add `n_entries`, `lists`, `listed_since` and `blocked` to each capture.

    `entries` has `list, kind, value, dated, listed`; kind is url (without scheme and fragment), host,
    domain (the host or any domain above it) or prefix (host/segment...).  `n_entries` counts the intervals
    that hold the fetch time, `lists` are their lists in order, `listed_since` the earliest start,
    `blocked` whether there is any.  Null or malformed addresses and null times match nothing; repeated
    captures keep their rows.  Columns named like the results give way to them.
    """
    made = ("n_entries", "lists", "listed_since", "blocked")
    keep = without(captures, *made)
    names = {c: f"_d{i}" for i, c in enumerate(keep)}
    place = {c.lower(): F.col(n) for c, n in names.items()}
    rows = captures.select(*[col(c).alias(n) for c, n in names.items()]).withColumns({"_url": place[url.lower()], "_at": place[fetched.lower()].cast("timestamp")})
    spans = stored(intervals(entries.withColumn("dated", F.col("dated").cast("timestamp"))))
    size = spans.agg(
        F.max(F.when(F.col("kind") == "domain", F.size(F.split("value", r"\.")))).alias("labels"),
        F.max(F.when(F.col("kind") == "prefix", F.size(F.split("value", "/")) - 1)).alias("segments"),
    ).first()
    # A verdict depends on the address and the time only; partial sums leave one row of each a task.
    asked = rows.filter("_url is not null and _at is not null").select("_url", "_at").distinct()
    keyed = asked.select("_url", "_at", F.inline(candidate_keys(F.col("_url"), size.labels or 0, size.segments or 0)))
    # Only keys that are in a list, once for each list that ever had them.
    heads = stored(spans.select("list", "kind", "value").distinct())
    active = as_of(join_checked(keyed, heads, ["kind", "value"]).select("list", "kind", "value", "_url", "_at"), spans)
    found = active.groupBy("_url", "_at").agg(F.count("*").alias("n_entries"), F.array_sort(F.collect_set("list")).alias("lists"), F.min("since").alias("listed_since"))
    out = rows.join(found, ["_url", "_at"], "left")
    count = F.coalesce("n_entries", F.lit(0))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], count.alias("n_entries"), F.coalesce("lists", F.array().cast("array<string>")).alias("lists"), "listed_since", (count > 0).alias("blocked"))
