"""Line dedup: a suffix array over line-ID sequences; later copies of repeated runs are deleted.

Lines that hold words are a document's sequence; a line's ID is a hash pair (96 bits). A run of lines
of at least `min_words` words that occurs at more than one place is a repeated run; every occurrence
but the first one (by doc_id, then line) is deleted. Other lines stay, in their order.

Suffixes are ranked by prefix doubling: from the ranks by the first k lines, those by the first 2k
follow from the pair (own rank, rank of the suffix k lines on). Suffixes that are already alone in
their rank are out, so the work shrinks with what is repeated. Suffixes of one rank are an interval
of the suffix array whose longest common prefix is at least that long. A run of `min_words` words has
at most so many lines, hence doubling ends when it reaches the last power of two below, whatever the
data: the prefix of m lines is named by its first and its last power of two. At each place
the shortest run that starts there with enough words, and the shortest that ends there, are looked up
in their intervals: a maximal repeated run is the union of such runs, so exactly the lines of maximal
repeated runs are found.

A text that occurs under several doc_ids is ranked once, at its first place; the other copies
repeat all of it. Ranks and minima are aggregated before they are shuffled and joined back, so a line
or run that very many places share is a skewed join, never one group; windows go over the lines of one
document or over cells of bounded size.

Null texts stay null. Texts without words stay. Rows with the same doc_id and text are one document
and get the same result; a null doc_id counts as the last. An empty table gives an empty result. All
columns of the documents are returned, whatever their names, with the shorter text (and n_chars, if it is
there).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from payscope.llm.common import LAST_ID, staged

DOC = ["_id", "_ha", "_hb"]  # a document: where its first copy stands, and its text
CELL = 16  # bits of a rank that lie in one cell


def _key(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.hash(text)


def _word_count(line: Column) -> Column:
    spaced = F.split(F.translate(line, "\t\x0b\x0c\r", "    "), " ")
    return F.size(F.filter(spaced, lambda w: w != ""))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """One row per text: its first doc_id, its number of copies, its lines (no, a, b, w) with words."""
    lines = F.transform(
        F.split("text", "\n"),
        lambda line, no: F.struct(
            no.alias("no"), F.xxhash64(line).alias("a"), F.hash(line).alias("b"), _word_count(line).alias("w")
        ),
    )
    ha, hb = _key(F.col("text"))
    return (
        docs.filter(F.col("text").isNotNull())
        .select(
            F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("_id"),
            ha.alias("_ha"),
            hb.alias("_hb"),
            F.filter(lines, lambda x: x["w"] > 0).alias("lines"),
        )
        .groupBy("_ha", "_hb")
        .agg(F.min("_id").alias("_id"), F.max("_id").alias("last_id"), F.first("lines").alias("lines"))
    )


def sequence(reps: DataFrame) -> DataFrame:
    """One row per line with words: document, place n in its sequence, line number, ID and words."""
    return reps.select(*DOC, F.posexplode("lines").alias("n", "line")).select(*DOC, "n", "line.*")


def runs(lines: DataFrame, min_words: int) -> DataFrame:
    """(document, n, m): for each place, the shortest run of enough words from it and up to it."""
    by_place = Window.partitionBy(*DOC).orderBy("n")
    every = Window.partitionBy(*DOC)
    counted = lines.select(
        *DOC,
        "n",
        F.sum("w").over(by_place.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.col("w"),
        F.sum("w").over(every).alias("all_words"),
        F.count("*").over(every).alias("all_lines"),
    ).filter(F.col("all_words") >= min_words)
    counted = counted.withColumn("before", F.col("upto") - F.col("w"))
    # Both frames only grow from row to row (a falling order turns the sign), so each row is added once.
    later = Window.partitionBy(*DOC).orderBy(F.desc("before")).rangeBetween(Window.unboundedPreceding, -min_words)
    earlier = Window.partitionBy(*DOC).orderBy("upto").rangeBetween(Window.unboundedPreceding, -min_words)
    stop = F.coalesce(
        F.min("n").over(later), F.when(F.col("all_words") - F.col("before") >= min_words, F.col("all_lines"))
    )
    start = F.coalesce(
        F.max("n").over(earlier) + 1, F.when(F.col("upto") >= min_words, F.lit(0))
    )
    both = counted.select(*DOC, "n", stop.alias("stop"), start.alias("start"))
    ends = F.array(
        F.struct(F.col("n").alias("n"), (F.col("stop") - F.col("n")).cast("int").alias("m")),
        F.struct(F.col("start").alias("n"), (F.col("n") + 1 - F.col("start")).cast("int").alias("m")),
    )
    return both.select(*DOC, F.inline(ends)).filter("n IS NOT NULL AND m IS NOT NULL").distinct()


def first_ranks(lines: DataFrame) -> DataFrame:
    """Places whose line occurs again, ranked by its ID: how many such places have a lower ID."""
    counts = lines.groupBy("a", "b").agg(F.count("*").alias("c")).filter("c > 1")
    # Cells by the leading bits of the ID, which is evenly spread.
    celled = staged(counts.withColumn("cell", F.shiftright("a", 64 - CELL)), "lines")
    cells = celled.groupBy("cell").agg(F.sum("c").alias("c"))
    ahead = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("cell", F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("base"))  # 2^CELL rows
    within = Window.partitionBy("cell").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    ranked = celled.join(starts, "cell").select(
        "a", "b", (F.col("base") + F.coalesce(F.sum("c").over(within), F.lit(0))).alias("rank")
    )
    return lines.select(*DOC, "n", "a", "b").join(ranked, ["a", "b"]).select(*DOC, "n", "rank")


def doubled(ranks: DataFrame, length: int) -> DataFrame:
    """Ranks by the first 2 * length lines from ranks by the first `length`, of repeated prefixes."""
    on = Window.partitionBy(*DOC).orderBy("n").rangeBetween(length, length)
    pairs = ranks.withColumn("next", F.first("rank").over(on)).filter(F.col("next").isNotNull())
    pairs = staged(pairs, "suffix-pairs")
    counts = pairs.groupBy("rank", "next").agg(F.count("*").alias("c")).filter("c > 1")
    counts = counts.withColumn("cell", F.shiftright("next", CELL))
    cells = counts.groupBy("rank", "cell").agg(F.sum("c").alias("c"))
    ahead = Window.partitionBy("rank").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("rank", "cell", F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("base"))
    within = Window.partitionBy("rank", "cell").orderBy("next").rowsBetween(Window.unboundedPreceding, -1)
    refined = counts.join(starts, ["rank", "cell"]).select(
        "rank",
        "next",
        (F.col("rank") + F.col("base") + F.coalesce(F.sum("c").over(within), F.lit(0))).alias("refined"),
    )
    return pairs.join(refined, ["rank", "next"]).select(*DOC, "n", F.col("refined").alias("rank"))


def suffix_ranks(lines: DataFrame, longest: int) -> DataFrame:
    """(document, n, level, rank): order of the repeated suffixes by their first 2^level lines,
    for all powers of two up to `longest`. Equal ranks are one interval of the suffix array."""
    level, ranks = 0, staged(first_ranks(lines), "suffix-ranks")
    levels = [ranks.withColumn("level", F.lit(0))]
    while 2 << level <= longest:
        ranks = staged(doubled(ranks, 1 << level), "suffix-ranks")
        level += 1
        levels.append(ranks.withColumn("level", F.lit(level)))
    found = levels[0]
    for more in levels[1:]:
        found = found.unionByName(more)
    return found


def repeated_later(lines: DataFrame, min_words: int) -> DataFrame:
    """(document, n, m): runs of enough words whose interval has an earlier place."""
    ranks = suffix_ranks(lines, min_words)
    level = (F.length(F.bin("m")) - 1).cast("int")
    wanted = runs(lines, min_words).withColumn("level", level)
    at_tail = F.col("n") + F.col("m") - F.expr("shiftleft(1, level)")
    head = ranks.withColumnRenamed("rank", "head")
    tail = ranks.select(*DOC, F.col("n").alias("at"), "level", F.col("rank").alias("tail"))
    named = wanted.join(head, [*DOC, "n", "level"]).withColumn("at", at_tail).join(tail, [*DOC, "at", "level"])
    named = staged(named.select(*DOC, "n", "m", "head", "tail"), "runs")
    place = F.struct(*DOC, "n")
    first = named.groupBy("m", "head", "tail").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    first = first.filter("first < last").drop("last")
    return named.join(first, ["m", "head", "tail"]).filter(F.col("first") < place).select(*DOC, "n", "m")


def deletions(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """One row per text that loses lines: its key, its first doc_id, whether all later copies go
    (`copies`), and the spans (first, last) of line numbers that go from the first copy."""
    reps = staged(distinct_texts(docs), "texts")
    lines = staged(sequence(reps), "line-ids")
    later = repeated_later(lines, min_words)
    places = F.sequence("n", (F.col("n") + F.col("m") - 1).cast("int"))
    gone = later.select(*DOC, F.explode(places).alias("n")).distinct()
    numbered = gone.join(lines.select(*DOC, "n", "no"), [*DOC, "n"])
    by_place = Window.partitionBy(*DOC).orderBy("n")
    spans = (
        numbered.withColumn("island", F.col("n") - F.row_number().over(by_place))
        .groupBy(*DOC, "island")
        .agg(F.struct(F.min("no").alias("first"), F.max("no").alias("last")).alias("span"))
        .groupBy(*DOC)
        .agg(F.collect_list("span").alias("spans"))
    )
    words = F.aggregate("lines", F.lit(0), lambda n, x: n + x["w"])
    copied = (F.col("last_id") > F.col("_id")) & (words >= min_words)
    return reps.select(*DOC, copied.alias("copies")).join(spans, DOC, "left").filter(
        F.col("copies") | F.col("spans").isNotNull()
    )


def dedup(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """`row` (a document as it was), `text` without the later copies of repeated runs, and `n_deleted`.

    The documents travel as one struct each, so they may have columns of any name.
    """
    plan = deletions(docs.select("doc_id", "text"), min_words).select(
        F.col("_ha").alias("_pa"), F.col("_hb").alias("_pb"), F.col("_id").alias("_first"),
        F.col("copies").alias("_copies"), F.col("spans").alias("_spans")
    )
    text = F.col("row").getField("text")
    ha, hb = _key(text)
    whole = docs.select(F.struct("*").alias("row"))
    joined = whole.join(plan, (ha == F.col("_pa")) & (hb == F.col("_pb")), "left")
    lines = F.split(text, "\n")
    doc_id = F.coalesce(F.col("row").getField("doc_id").cast("long"), F.lit(LAST_ID))
    is_copy = F.col("_copies") & (doc_id > F.col("_first"))
    kept = F.when(is_copy, F.filter(lines, lambda x: _word_count(x) == 0)).when(
        F.col("_spans").isNotNull(),
        F.filter(
            lines,
            lambda x, no: ~F.exists("_spans", lambda s: no.between(s["first"], s["last"])) | (_word_count(x) == 0),
        ),
    )
    return joined.withColumn("_kept", kept).select(
        "row",
        F.coalesce(F.array_join("_kept", "\n"), text).alias("text"),
        F.when(F.col("_kept").isNull(), 0).otherwise(F.size(lines) - F.size("_kept")).cast("long").alias("n_deleted"),
    )


def deduplicated(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """The documents, same columns, with the shorter texts (and n_chars, if it is there)."""
    changed = {"text": F.col("text")} | {c: F.length("text").cast(t) for c, t in docs.dtypes if c == "n_chars"}
    return dedup(docs, min_words).select(
        *[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns]
    )


def digest(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """doc_id, n_deleted (lines) and the text that is left."""
    return dedup(docs.select("doc_id", "text"), min_words).select("row.doc_id", "n_deleted", "text")
