"""Clock times in free text, the timeline of events, and temporal conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.store import materialize, small_enough
from graphloom.model import Graph
from graphloom.operators.match import cycles, oriented, without_hop
from graphloom.operators.write import first_by, merge_edges

# Hours said in words; other words count as 0.
HOUR_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "noon": 12, "midnight": 0}
TIME_TYPES = ("AT_TIME", "OCCURRED_AT_TIME", "HAS_TIME")


def parse_time(text: Column) -> Column:
    """Minutes since midnight: h:m:s, then h:m with am or pm, then h:m, then quarter or half past a word; null otherwise. Hours are not checked."""
    group = lambda p, i: F.regexp_extract(text, p, i).try_cast("double")
    second = r"(\d{1,2}):(\d{2}):(\d{2})"
    half = r"(\d{1,2}):(\d{2})\s*(AM|PM|am|pm)"
    plain = r"(\d{1,2}):(\d{2})\b"
    word = lambda p: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in HOUR_WORDS.items() for x in kv]), F.lower(F.regexp_extract(text, p, 1))), F.lit(0)) * 60.0
    return (
        F.when(text.rlike(second), group(second, 1) * 60 + group(second, 2) + group(second, 3) / 60)
        .when(text.rlike(half), (group(half, 1) % 12 + F.when(F.upper(F.regexp_extract(text, half, 3)) == "PM", 12.0).otherwise(0.0)) * 60 + group(half, 2))
        .when(text.rlike(plain), group(plain, 1) * 60 + group(plain, 2))
        .when(text.rlike(r"quarter past (\w+)"), word(r"quarter past (\w+)") + 15)
        .when(text.rlike(r"half past (\w+)"), word(r"half past (\w+)") + 30)
    )


def clock(minutes: Column) -> Column:
    """HH:MM of minutes since midnight, within a day."""
    whole = F.floor(minutes).cast("int")
    return F.format_string("%02d:%02d", (F.floor(whole / 60) % 24).cast("int"), whole % 60)


def timeline(graph: Graph) -> DataFrame:
    """(description, time, time_minutes, source, label, seq): events with time relationships, events with time properties, then other timed nodes; the first of each description.

    Within a branch the order is by node id, then by the id of the time node.
    """
    events = graph.labelled("Event")
    times = graph.labelled("Time").select(F.col("id").alias("dst"), F.col("props")["value"].alias("value"))
    linked = graph.typed(*TIME_TYPES).select("src", "dst").join(events.select(F.col("id").alias("src"), "props", "source", "labels"), "src").join(times, "dst")
    one = linked.select(F.lit(1).alias("branch"), F.col("src").alias("n"), F.col("dst").alias("m"), F.col("props")["description"].alias("description"), "value", "source", F.get("labels", F.lit(0)).alias("label"))
    has_time = F.col("props")["time"].isNotNull()
    free = without_hop(graph, events.where(F.col("props")["timestamp"].isNotNull() & ~has_time), TIME_TYPES, "out", graph.labelled("Time"))
    own = events.where(has_time).unionByName(free)
    two = own.select(F.lit(2).alias("branch"), F.col("id").alias("n"), F.lit(0).cast("bigint").alias("m"), F.col("props")["description"].alias("description"), F.coalesce(F.col("props")["time"], F.col("props")["timestamp"]).alias("value"), "source", F.get("labels", F.lit(0)).alias("label"))
    other = graph.nodes.where(~F.array_contains("labels", "Event") & F.col("props")["timestamp"].isNotNull())
    three = other.select(F.lit(3).alias("branch"), F.col("id").alias("n"), F.lit(0).cast("bigint").alias("m"), F.coalesce(F.col("props")["description"], F.col("props")["name_or_description"]).alias("description"), F.col("props")["timestamp"].alias("value"), "source", F.get("labels", F.lit(0)).alias("label"))
    rows = one.unionByName(two).unionByName(three).withColumn("time_minutes", parse_time(F.nullif("value", F.lit(""))))
    rows = rows.where("branch < 3 or time_minutes is not null").withColumn("time", F.coalesce(F.nullif("value", F.lit("")), F.lit("unknown")))
    return first_by(rows, ["description"], ["branch", "n", "m"]).select("description", "time", "time_minutes", "source", "label", "branch", "n")


def neighbours_in_time(rows: DataFrame, key: str, minutes: str, seq: str, group: str | None = None) -> DataFrame:
    """(key, next_key) of entries next to each other in time; ``group`` keeps timelines apart.

    One timeline over all rows is parted by ranges of time: neighbours within a range are found there, and the first
    entry of each range is handed to the range before it.
    """
    rows = rows.where(F.col(minutes).isNotNull())
    if group:
        w = Window.partitionBy(group).orderBy(minutes, seq)
        return rows.withColumn(f"next_{key}", F.lead(key).over(w)).where(F.col(f"next_{key}").isNotNull())
    spread = materialize(rows.repartitionByRange(minutes, seq).withColumn("_p", F.spark_partition_id()), "times")
    first = spread.groupBy("_p").agg(F.min_by(key, F.struct(minutes, seq)).alias("_k")).orderBy("_p").collect()  # a row a range
    after = {a["_p"]: b["_k"] for a, b in zip(first, first[1:])}
    w = Window.partitionBy("_p").orderBy(minutes, seq)
    kind = dict(rows.dtypes)[key]
    border = F.try_element_at(F.create_map(*[F.lit(x) for kv in after.items() for x in kv]), F.col("_p")).cast(kind) if after else F.lit(None).cast(kind)
    out = spread.withColumn(f"next_{key}", F.coalesce(F.lead(key).over(w), border))
    return out.where(F.col(f"next_{key}").isNotNull()).drop("_p")


def precede(graph: Graph) -> tuple[Graph, DataFrame]:
    """The graph with PRECEDED_BY from each timeline entry to the next one, between all events of the two descriptions; the created relationships.

    The type's name reads the other way round than its direction: the earlier event is its start.
    """
    line = timeline(graph).where("time_minutes is not null and description is not null").withColumn("seq", F.struct("branch", "n"))
    steps = neighbours_in_time(line, "description", "time_minutes", "seq")
    events = graph.labelled("Event").select("id", F.col("props")["description"].alias("d")).where("d is not null")
    a, b = events.select(F.col("id").alias("src"), F.col("d").alias("description")), events.select(F.col("id").alias("dst"), F.col("d").alias("next_description"))
    links = steps.select("description", "next_description").where("description <> next_description").distinct().join(a, "description").join(b, "next_description")
    return merge_edges(graph, links.select("src", F.lit("PRECEDED_BY").alias("type"), "dst", F.create_map().cast("map<string,string>").alias("props"), F.lit(0).alias("seq")))


def two_times(graph: Graph) -> DataFrame:
    """(id, time_a, time_b): nodes with two different time nodes, both orders."""
    steps = oriented(graph.typed(*TIME_TYPES)).join(graph.labelled("Time").select(F.col("id").alias("v")), "v", "left_semi").select("u", "v", "edge_id")
    a, b = steps.select(F.col("u").alias("id"), F.col("v").alias("time_a"), F.col("edge_id").alias("ea")), steps.select(F.col("u").alias("id"), F.col("v").alias("time_b"), F.col("edge_id").alias("eb"))
    return a.join(b, "id").where("time_a <> time_b").select("id", "time_a", "time_b")


def conflicts(graph: Graph, order_type: str = "PRECEDED_BY", each: int | None = 10) -> DataFrame:
    """(issue, id): cycles of the order, events with two times, time contradictions and events without a time; at most ``each`` per kind as a report (None for all)."""
    top = lambda df: df.orderBy("id").limit(each) if each else df
    kind = lambda df, name: df.select(F.lit(name).alias("issue"), "id")
    parts = [
        (cycles(graph, (order_type,)).select(F.col("start_id").alias("id")), "cycle"),
        (two_times(graph).select("id"), "two times"),
        (graph.typed("CONTRADICTS").where("props['field'] like '%time%' or props['field'] like '%timestamp%'").select("id"), "time contradiction"),
        (without_hop(graph, graph.labelled("Event").where("props['time'] is null and props['timestamp'] is null"), TIME_TYPES, "out", graph.labelled("Time")).select("id"), "no time"),
    ]
    out = None
    for df, name in parts:
        rows = kind(top(df), name)
        out = rows if out is None else out.unionByName(rows)
    return out


def allen(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """The relation of interval a to interval b, one of Allen's thirteen; null where an end is missing or before its start."""
    good = (a_start <= a_end) & (b_start <= b_end)
    relation = (
        F.when(a_end < b_start, "before").when(b_end < a_start, "after").when((a_start == b_start) & (a_end == b_end), "equals").when(a_end == b_start, "meets").when(b_end == a_start, "met by")
        .when((a_start == b_start) & (a_end < b_end), "starts").when(a_start == b_start, "started by").when((a_end == b_end) & (a_start > b_start), "finishes").when(a_end == b_end, "finished by")
        .when((a_start > b_start) & (a_end < b_end), "during").when((a_start < b_start) & (a_end > b_end), "contains").when(a_start < b_start, "overlaps").otherwise("overlapped by"))
    return F.when(good, relation)


def ascii_timeline(rows: DataFrame) -> str:
    """A timeline short enough to print (10,000 entries at most): timed entries by minutes, then the others in their order."""
    if not small_enough(rows, 10_000):
        raise ValueError("too many entries to print")
    out = [f"{r['c'] or '  ?  '} | {r['description']} [{r['source']}]" for r in rows.withColumn("c", clock(F.col("time_minutes"))).orderBy(F.asc_nulls_last("time_minutes"), "branch", "n").toLocalIterator()]
    return "\n".join(out)
