"""Records of CSV files whose quoted cells hold line breaks, found by many tasks per file.

A file is read as lines, by byte ranges. Whether a line ends within quotes depends on whether it began
within quotes, so each line is a step between two states (outside, inside), and so is each range. The
steps of a range are composed by windows over its lines, for either state at its start; the ranges of a
file, which are few, are composed the same way, and that gives every range its true state at the start.
A line that begins and ends outside is a record. The others are pieces; they meet at the line that
opened them, so what is grouped is never more than one record.

A quotation that is never closed would take the rest of its file. It makes no record: each of its lines
is handed on as `unclosed`, for the quarantine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from payscope.session import stored

# Possessive throughout: a line is looked through once, without backtracking or recursion.
_REST = r'[^"]*+(?:""[^"]*+)*+'  # a quoted cell up to its closing quote
_CELL = rf'(?:"{_REST}"[^,]*+|[^",][^,]*+)?+'
_OPEN = rf'(?:{_CELL},)*+"{_REST}\z'  # whole cells, then one that goes on

#: A line that begins outside quotes ends within them.
OPENS = rf"\A{_OPEN}"
#: A line that begins within quotes ends within them.
STAYS = rf'\A{_REST}(?:"[^,]*+,{_OPEN}|\z)'


def _before(steps: DataFrame, outside: str, inside: str, keys: Sequence[str], order: str) -> DataFrame:
    """The state before each step: `fixed` (NULL: that at the start of its group) and `turned`, whether
    that is to be turned round. `outside` and `inside` name a step's result for either state before it.

    A step with one result for both states sets the state; of the others, those that turn it round count.
    """
    earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    turns = F.col(outside) & ~F.col(inside)
    sets = F.col(outside) == F.col(inside)
    counted = steps.withColumn("turns", F.coalesce(F.count_if(turns).over(earlier), F.lit(0)))
    state = F.struct(F.col(outside).alias("state"), F.col("turns").alias("turns"))
    last = counted.withColumn("last", F.last(F.when(sets, state), ignorenulls=True).over(earlier))
    since = F.col("turns") - F.coalesce(F.col("last.turns"), F.lit(0))
    return last.withColumns({"fixed": F.col("last.state"), "turned": since % 2 == 1}).drop("turns", "last")


def _state(start: Column) -> Column:
    return F.coalesce(F.col("fixed"), start) != F.col("turned")


def _lines(spark: SparkSession, files: Sequence[str], order: Column) -> DataFrame:
    """All lines with what is known within their range: for either state at the range's start, the state
    before and after the line and the last line that opened a quotation."""
    text = spark.read.text(list(files), lineSep="\n").select(order.alias("seq"), "value")
    steps = text.select(
        "*",
        F.col("seq.file").alias("file"),
        F.col("seq.block").alias("block"),
        F.col("seq.row").alias("row"),
        F.col("value").rlike(OPENS).alias("outside"),
        F.col("value").rlike(STAYS).alias("inside"),
    )
    keys = ["file", "block"]
    placed = _before(steps, "outside", "inside", keys, "row")
    so_far = Window.partitionBy(*keys).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    columns = {"first": (F.col("block") == 0) & (F.row_number().over(so_far) == 1)}
    for name, start in (("o", False), ("i", True)):
        before = _state(F.lit(start))
        after = F.when(before, F.col("inside")).otherwise(F.col("outside"))
        opening = F.last(F.when(~before & after, F.col("row")), ignorenulls=True).over(so_far)
        columns[name] = F.struct(before.alias("before"), after.alias("after"), opening.alias("opening"))
    return placed.select("seq", "value", *keys, "row", *[c.alias(n) for n, c in columns.items()])


def _ranges(lines: DataFrame) -> DataFrame:
    """One row per range: its state at the start, the quotation that is open there, and the one that
    the file never closes."""
    steps = lines.groupBy("file", "block").agg(F.max_by("o", "row").alias("o"), F.max_by("i", "row").alias("i"))
    steps = steps.withColumns({"outside": F.col("o.after"), "inside": F.col("i.after")})
    placed = _before(steps, "outside", "inside", ["file"], "block").withColumn("start", _state(F.lit(False)))
    by_file = Window.partitionBy("file").orderBy("block")
    end = F.when(F.col("start"), F.col("i")).otherwise(F.col("o"))
    known = placed.withColumn(
        "opened", F.last(end["opening"], ignorenulls=True).over(by_file.rowsBetween(Window.unboundedPreceding, 0))
    )
    whole = by_file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return known.select(
        "file",
        "block",
        "start",
        F.lag("opened").over(by_file).alias("carried"),
        F.when(F.last(end["after"]).over(whole), F.last("opened").over(whole)).alias("never_closed"),
    )


def quoted_records(spark: SparkSession, files: Sequence[str], order: Column) -> DataFrame:
    """The records of CSV files without their headers: (seq, record, unclosed).

    `order` is the place of a row (`filings.write_order`); a record has that of its first line. Line
    breaks within quotes stay as they are, the one at a record's end goes. Empty lines are no records.
    The lines are stored once, as everything after depends on the same cut into ranges.
    """
    lines = stored(_lines(spark, files, order), "lines")
    ranges = stored(_ranges(lines), "ranges")  # a row per range, so its size decides on a broadcast
    at = F.when(F.col("start"), F.col("i")).otherwise(F.col("o"))
    opening = F.coalesce(at["opening"], F.col("carried"))
    placed = lines.join(ranges, ["file", "block"]).select(
        "seq",
        "value",
        "first",
        (at["before"] | at["after"]).alias("piece"),
        opening.alias("opening"),
        F.coalesce(opening == F.col("never_closed"), F.lit(False)).alias("unclosed"),
    )
    no_piece = ~F.col("piece")
    alone = placed.filter(no_piece | F.col("unclosed")).select(
        "seq", F.col("value").alias("record"), "first", (F.col("piece") & F.col("unclosed")).alias("unclosed")
    )
    pieces = F.array_sort(F.collect_list(F.struct("seq", "value")))
    joined = (
        placed.filter(F.col("piece") & ~F.col("unclosed"))
        .groupBy("opening")
        .agg(pieces.alias("pieces"), F.max("first").alias("first"))
        .select(
            F.col("pieces")[0]["seq"].alias("seq"),
            F.array_join(F.transform("pieces", lambda p: p["value"]), "\n").alias("record"),
            "first",
            F.lit(False).alias("unclosed"),
        )
    )
    every = alone.unionByName(joined).filter(~F.col("first"))
    return every.select("seq", F.regexp_replace("record", r"\r\z", "").alias("record"), "unclosed").filter("record != ''")
