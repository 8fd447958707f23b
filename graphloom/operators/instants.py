"""One UTC instant from timestamps of mixed format, precision and zone.

Each text becomes an array of all its valid readings (day-month and month-day order, both passes of
a local time that a clock change repeats), each with a cost from what is known of its source. Then,
along each source's record order, the cheapest chain of readings is chosen (Viterbi): a step costs
``switch_cost`` where the format changes and ``back_cost`` where time jumps back.

The chain is exact and yet cheap. A reading whose cost exceeds the least one by more than all that
two steps can cost is never chosen, so it is cut before; what has one reading left is an anchor, and what lies beyond an anchor
says nothing about the records before it. So a source's records fall into segments between two anchors, which are solved apart, wherever they are; a source with
a third of all rows is many segments. All readings of all records are stated and cut, whatever is known of their source; what is left with one
reading is an anchor of its chain and settled, with no more than one shuffle of ids and instants, and only open records and their anchors are moved to be searched.
Parsing is done by regular expressions and date functions in the JVM.

Defined cases: outer blanks do not count; null, empty, vague, relative and impossible content gives
no reading; a zone or offset in the text decides; else the source's zone, and without one no reading;
10, 13 and 16 digits are epoch seconds, milli- and microseconds, 14 digits a local reading; numeric
dates with the year last follow the source's locale, and both orders are open where it is null;
a repeated local time means its earlier instant, a skipped one takes the offset before the change;
a date alone is no instant; digits beyond microseconds are dropped; of differing rows of one id the earliest instant counts.
"""

from __future__ import annotations

import zoneinfo

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.store import materialize

# Month names of English, German, French, Spanish and Italian dates, by month.
MONTHS = (
    ("january", "jan", "januar", "jänner", "janvier", "janv", "enero", "ene", "gennaio", "gen"),
    ("february", "feb", "februar", "février", "févr", "fevrier", "febrero", "febbraio"),
    ("march", "mar", "märz", "mär", "mars", "marzo"),
    ("april", "apr", "avril", "avr", "abril", "abr", "aprile"),
    ("may", "mai", "mayo", "maggio", "mag"),
    ("june", "jun", "juni", "juin", "junio", "giugno", "giu"),
    ("july", "jul", "juli", "juillet", "juil", "julio", "luglio", "lug"),
    ("august", "aug", "août", "aout", "agosto", "ago"),
    ("september", "sep", "sept", "septembre", "septiembre", "settembre", "set"),
    ("october", "oct", "oktober", "okt", "octobre", "octubre", "ottobre", "ott"),
    ("november", "nov", "novembre", "noviembre"),
    ("december", "dec", "dezember", "dez", "décembre", "déc", "diciembre", "dic", "dicembre"),
)
# Zone abbreviations in use in incident records, with their offset in minutes.
ZONES = {
    "UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "BST": 60, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}
#: Locales that write the month first; the others write the day first.
MONTH_FIRST = ("en-US", "en-PH", "en-CA")

#: Outer characters that do not count: white space of Unicode, zero-width space and byte order mark.
_OUTER = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
_TIME = r"(\d{1,2})[:.](\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?:\s*([AaPp])\.?\s?[Mm]\b\.?)?(?:\s*(?:hrs?\.?|Uhr|h|o'clock))?"
_ZONE = r"\s*(Z|z|(?:UTC|GMT)?\s?[+-]\d{1,2}(?::?\d{2})?|[A-Z]{1,5}|[A-Za-z_]+/[A-Za-z_/+-]+\d*)?\s*(?:\[[^\]]*\])?"
_DAY = r"(?:\p{L}{2,12}\.?,?\s+)?"
_MONTH = r"(\p{L}{3,10})\.?"
#: Format name, pattern, and the groups that hold the year and the first and second number of the date;
#: the groups from 4 on are hour, minute, second, fraction, half of the day and zone.
FORMATS = (
    ("iso", rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:[Tt]|,?\s+){_TIME}{_ZONE}$", (1, 2, 3)),
    ("named", rf"^{_DAY}(\d{{1,2}})(?:st|nd|rd|th|\.)?\s+{_MONTH},?\s+(\d{{4}}),?\s+(?:at\s+)?{_TIME}{_ZONE}$", (3, 2, 1)),
    ("numeric", rf"^{_DAY}(\d{{1,2}})[/.-](\d{{1,2}})[/.-](\d{{4}}),?\s+{_TIME}{_ZONE}$", (3, 1, 2)),
    ("named_us", rf"^{_DAY}{_MONTH}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}}),?\s+(?:at\s+)?{_TIME}{_ZONE}$", (3, 1, 2)),
    ("compact", rf"^(\d{{4}})(\d{{2}})(\d{{2}})T?(\d{{2}})(\d{{2}})(\d{{2}})()(){_ZONE}$", (1, 2, 3)),
    ("year_first", rf"^(\d{{4}})[/.](\d{{1,2}})[/.](\d{{1,2}}),?\s+{_TIME}{_ZONE}$", (1, 2, 3)),
)
#: A clock time without a date.
CLOCK = rf"^{_TIME}{_ZONE}$"
_SEP = "\u0001"


def _known_zones() -> list[str]:
    return sorted(z for z in zoneinfo.available_timezones() if "/" in z and not z.startswith(("posix/", "right/"))) + ["UTC"]


def _parts(c: Column, *names: str) -> Column:
    """The text in parts where one of the named formats matches; what one has rewritten no other one matches."""
    for name, pattern, (y, a, b) in FORMATS:
        if name in names:
            c = F.regexp_replace(c, pattern, name + _SEP + _SEP.join(f"${i}" for i in (y, a, b, 4, 5, 6, 7, 8, 9)))
    return c


def _dispatched(text: str) -> Column:
    """As all formats, but a text meets only those that its first characters allow."""
    s, mark = F.col(text), lambda i: F.substring(text, i, 1)
    digit = lambda i: mark(i).between("0", "9")
    year = F.when(mark(5) == "-", _parts(s, "iso")).when(mark(5).isin("/", "."), _parts(s, "year_first")).otherwise(_parts(s, "compact"))
    # no day has three digits; only a dot can stand after the day of both a numeric and a named date
    day = F.when(mark(2).isin("/", "-") | mark(3).isin("/", "-"), _parts(s, "numeric")).when((mark(2) == ".") | (mark(3) == "."), _parts(s, "named", "numeric")).otherwise(_parts(s, "named"))
    return F.when(digit(1) & digit(2) & digit(3), year).when(digit(1), day).otherwise(_parts(s, "named", "named_us", "numeric"))


def with_first_reading(rows: DataFrame, text: str, tz: str, locale: str) -> DataFrame:
    """``rows`` with ``micros``, the first reading of ``with_readings``, which is the one of least cost; null where there is none. Cheaper than all readings."""
    return _parsed(rows, text, tz, locale).select(*rows.columns, F.coalesce("_m0", "_m2").alias("micros"))


def with_readings(rows: DataFrame, text: str, tz: str, locale: str, later_pass: float = 50.0) -> DataFrame:
    """``rows`` with ``readings`` array<struct<format,micros,cost>>, empty where the text states no instant."""
    local = F.col("_min").isNull() & F.col("_zone").isNotNull()
    r = _parsed(rows, text, tz, locale)
    hour_on = lambda i: F.col(f"_u{i}") + F.expr("interval 1 hour")
    r = r.withColumns({f"_w{i}": F.when(local, F.from_utc_timestamp(hour_on(i), F.col("_zone")) == F.col(f"_l{i}")) for i in (1, 2)})
    r = r.withColumns({"_m1": F.when(F.col("_w1"), F.unix_micros("_u1") + 3_600_000_000), "_m3": F.when(F.col("_w2"), F.unix_micros("_u2") + 3_600_000_000)})
    made = lambda i, name, cost: F.struct(name.alias("format"), F.col(f"_m{i}").alias("micros"), F.lit(float(cost)).alias("cost"))
    all_ = F.array(*[F.when(F.col(f"_m{i}").isNotNull(), made(i, F.col("_f") if i < 2 else F.lit("numeric_swapped"), later_pass * (i % 2))) for i in range(4)])
    one = F.coalesce("_m1", "_m2", "_m3").isNull()
    return r.select(*rows.columns, F.when(one & F.col("_m0").isNotNull(), F.array(made(0, F.col("_f"), 0))).when(one, F.array().cast("array<struct<format:string,micros:bigint,cost:double>>")).otherwise(F.array_compact(all_)).alias("readings"))


def _parsed(rows: DataFrame, text: str, tz: str, locale: str) -> DataFrame:
    """``rows`` with format, local and UTC times of the first order (1) and, where the locale is not known, the other one (2), and their instants _m0 and _m2."""
    months = F.create_map(*[F.lit(x) for i, names in enumerate(MONTHS) for n in names for x in (n, i + 1)])
    zones = F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv])
    r = rows.withColumn("_s", F.btrim(F.col(text), F.lit(_OUTER)))
    c = _dispatched("_s")
    # projections with a lambda stay out of whole-stage code, whose one method would be too long for the JVM to compile
    epoch = F.transform(F.array("_s"), lambda _: F.lit("epoch"))
    r = r.withColumn("_c", F.when(F.col("_s").rlike(r"^(\d{10}|\d{13}|\d{16})$"), epoch).otherwise(F.split(c, _SEP)))
    part = lambda i: F.nullif(F.get("_c", F.lit(i)), F.lit(""))
    num = lambda x: x.try_cast("int")
    month = lambda x: F.coalesce(num(x), F.try_element_at(months, F.lower(x)))
    half = F.upper(part(8))
    hour = F.when(half.isNull(), num(part(4))).when(num(part(4)).between(1, 12), num(part(4)) % 12 + F.when(half == "P", 12).otherwise(0))
    second = F.expr("try_cast(concat(coalesce(nullif(get(_c, 6), ''), '0'), '.', substr(concat(coalesce(get(_c, 7), ''), '000000'), 1, 6)) as decimal(16,6))")
    zone = F.upper(part(9))
    minutes = F.when(F.col("_z").rlike(r"[+-]\d"), F.expr(
        "if(_z like '%-%', -1, 1) * (60 * try_cast(regexp_extract(_z, '[+-](\\\\d{1,2})', 1) as int) + coalesce(try_cast(regexp_extract(_z, '[+-]\\\\d{1,2}:?(\\\\d{2})', 1) as int), 0))"
    )).otherwise(F.try_element_at(zones, F.col("_z")))
    dated = F.size("_c") == 10
    r = r.withColumns({"_f": F.when(dated, F.get("_c", F.lit(0))).when(F.size("_c") == 1, F.when(F.col("_c")[0] == "epoch", F.lit("epoch"))), "_h": hour, "_sec": second, "_z": zone, "_region": part(9)})
    known = _known_zones()
    numeric, us = F.col("_f") == "numeric", F.col(locale).isin(*MONTH_FIRST)
    # the first number is the month for month-first locales; where the locale is null both orders are read
    swap = F.when(numeric, ~F.coalesce(us, F.lit(False))).when(F.col("_f") == "named_us", F.lit(False)).otherwise(F.lit(False))
    first, second_n = part(2), part(3)
    at = lambda mo, d: F.expr(f"try_make_timestamp(try_cast(get(_c, 1) as int), {mo}, {d}, _h, try_cast(get(_c, 5) as int), _sec, 'UTC')")
    r = r.withColumns({"_mo": F.when(swap, num(second_n)).otherwise(month(first)), "_d": F.when(swap, num(first)).otherwise(num(second_n)), "_min": minutes})
    r = r.withColumns({
        "_zone": F.when(F.col("_z").isNull(), F.when(F.col(tz).isin(known), F.col(tz))).when(F.col("_min").isNull() & F.col("_region").isin(known), F.col("_region")),
        "_l1": at("_mo", "_d"), "_l2": F.when(numeric & F.col(locale).isNull() & (F.col("_mo") != F.col("_d")), at("_d", "_mo")),
    })
    # a projection for each step, so that no date function runs twice for a row
    local = F.col("_min").isNull() & F.col("_zone").isNotNull()
    r = r.withColumns({f"_u{i}": F.when(local, F.to_utc_timestamp(f"_l{i}", F.col("_zone"))) for i in (1, 2)})
    plain = F.col("_s").try_cast("bigint") * F.when(F.length("_s") == 10, 1_000_000).when(F.length("_s") == 13, 1_000).otherwise(1)
    offset = F.when(F.col("_min").between(-1080, 1080), F.col("_min").cast("bigint") * 60_000_000)
    first = F.when(F.col("_f") == "epoch", plain).when(local, F.unix_micros("_u1")).otherwise(F.unix_micros("_l1") - offset)
    swapped = F.when(local, F.unix_micros("_u2")).otherwise(F.unix_micros("_l2") - offset)
    return r.withColumns({"_m0": first, "_m2": swapped})


def _chain(frame: pd.DataFrame, switch_cost: float, back_cost: float) -> pd.DataFrame:
    """The cheapest readings of one chain of records."""
    frame = frame.sort_values("id", kind="stable")
    steps = [[(r["format"], r["micros"], r["cost"]) for r in x] for x in frame["readings"]]
    best, back = [], []
    for t, options in enumerate(steps):
        row, ptr = [], []
        for f, m, cost in options:
            if t == 0:
                row.append(cost)
                ptr.append(-1)
                continue
            ways = [b + switch_cost * (f != pf) + back_cost * (m < pm) for b, (pf, pm, _) in zip(best[-1], steps[t - 1])]
            k = min(range(len(ways)), key=lambda i: (ways[i], i))
            row.append(cost + ways[k])
            ptr.append(k)
        best.append(row)
        back.append(ptr)
    out = [0] * len(steps)
    k = min(range(len(best[-1])), key=lambda i: (best[-1][i], i)) if best else 0
    for t in range(len(steps) - 1, -1, -1):
        out[t] = steps[t][k][1]
        k = back[t][k]
    return frame[["id", "field", "open"]].assign(utc_micros=out)


def choose_readings(read: DataFrame, switch_cost: float = 1.0, back_cost: float = 4.0, block_ids: int = 4096) -> DataFrame:
    """(id, field, utc_micros) from rows (id, field, source, readings): Viterbi along each source's ids.

    Differing rows of one id are records of their own in the chain of their source, and the earliest of their instants counts.
    ``block_ids`` says how many ids are numbered at once; it does not change the result.
    """
    slack = 2 * (switch_cost + back_cost)
    least = F.array_min(F.transform("readings", lambda x: x["cost"]))
    within = read.select("id", "field", F.coalesce("source", F.lit("")).alias("chain"), F.filter("readings", lambda x: x["cost"] <= least + slack).alias("readings"))
    # written first: a filter on readings would be pushed below their parsing, and state it again and again
    cut = materialize(within.withColumn("open", F.size("readings") > 1), "readings")
    earliest = lambda found: found.groupBy("id", "field").agg(F.min("utc_micros").alias("utc_micros")).where("utc_micros is not null")
    found = cut.where("size(readings) = 1").select("id", "field", F.get("readings", F.lit(0))["micros"].alias("utc_micros"))
    if cut.where("open").isEmpty():
        return earliest(found)
    # anchors are numbered along the chain: within blocks of ids, and over the blocks by their totals
    chained = cut.where(F.size("readings") > 0).join(cut.where("open").select("chain", "field").distinct(), ["chain", "field"], "left_semi")
    blocks = chained.distinct().withColumns({"block": F.floor(F.col("id") / block_ids), "turn": F.xxhash64("readings")})
    anchor = (~F.col("open")).cast("bigint")
    totals = blocks.groupBy("chain", "field", "block").agg(F.sum(anchor).alias("n"))
    before = totals.withColumn("base", F.sum("n").over(Window.partitionBy("chain", "field").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    numbered = blocks.withColumn("k", F.sum(anchor).over(Window.partitionBy("chain", "field", "block").orderBy("id", "turn").rowsBetween(Window.unboundedPreceding, 0))).join(before.drop("n"), ["chain", "field", "block"])
    k = F.coalesce("base", F.lit(0)) + F.col("k")
    # a segment is the open records behind an anchor, with that anchor and the next one
    parts = numbered.withColumn("segment", F.explode(F.when(F.col("open"), F.array(k)).otherwise(F.array(k, k - 1))))
    parts = parts.join(parts.where("open").select("chain", "field", "segment").distinct(), ["chain", "field", "segment"], "left_semi").select("chain", "field", "segment", "id", "turn", "open", "readings")

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        return _chain(frame.sort_values("turn"), switch_cost, back_cost)

    chosen = parts.groupBy("chain", "field", "segment").applyInPandas(solve, "id bigint, field string, open boolean, utc_micros bigint").where("open")
    return earliest(found.unionByName(chosen.select("id", "field", "utc_micros")))


def node_times(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows (id, field, source, text) of every node's extracted_at and every Time node's value."""
    value = F.btrim(F.when(F.array_contains("labels", "Time") | (F.col("label") == "Time"), F.col("props")["value"]), F.lit(_OUTER))
    date = F.btrim(F.col("props")["date"], F.lit(_OUTER))
    value = F.when(value.rlike(CLOCK), F.concat(date, F.lit(" "), value)).otherwise(value)
    pairs = F.array(F.struct(F.lit("extracted_at").alias("field"), F.col("extracted_at").alias("text")), F.struct(F.lit("value").alias("field"), value.alias("text")))
    rows = nodes.where("id is not null").select("id", "source", F.explode(pairs).alias("p")).select("id", "source", "p.*").where("text is not null")
    zones = sources.groupBy(F.col("source_id").alias("source")).agg(F.min(F.struct("tz", "locale")).alias("z")).select("source", "z.*")
    return rows.join(zones, "source", "left")


def node_instants(nodes: DataFrame, sources: DataFrame, switch_cost: float = 1.0, back_cost: float = 4.0, later_pass: float = 50.0) -> DataFrame:
    """(id, field, utc_micros): one row for each node id and field that states one definite instant."""
    read = with_readings(node_times(nodes, sources), "text", "tz", "locale", later_pass)
    return choose_readings(read.select("id", "field", "source", "readings"), switch_cost, back_cost)
