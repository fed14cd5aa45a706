"""Line deduplication over overlapping three-line windows, DataFrame functions only.

Every run of three consecutive lines is hashed (128 bits).  Windows that occur
more than once anywhere have a first occurrence, by (document, place); all later
ones are removed: the lines they cover are merged and taken out of the text.

The windows are aggregated with map-side combining, so a passage that a third of
all documents repeat reaches its reducer once per task.  Only repeated hashes are
kept, and they alone meet the windows again, very frequent ones dealt over several
tasks; what comes back to the documents is
one small array of places per document with anything to remove.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 3
HOT = 4096  # occurrences of a window that meet in one task
MOST_HOT = 100_000  # windows with more of them at most, as all occurrences are so many times ``HOT`` or fewer


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _windows(rows: DataFrame) -> DataFrame:
    """(id, th, at, w1, w2): each window's place and hash; places count from 0."""
    lines = _lines(F.col("text"))
    each = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("lines") - WINDOW, F.lit(0))),
        lambda i: F.array_join(F.slice(F.col("lines"), i + 1, WINDOW), "\n"),
    )
    cut = rows.select("id", "th", lines.alias("lines")).where(F.size("lines") >= WINDOW)
    out = cut.select("id", "th", F.posexplode(each).alias("at", "w"))
    digest = F.md5("w")
    half = lambda i: F.conv(F.substring(digest, i, 16), 16, -10).cast("bigint")
    return out.select("id", "th", "at", F.xxhash64("w").alias("w1"), half(1).alias("w2"))


def _kept(lines: Column, gone: Column) -> Column:
    """Lines outside the windows that start at the sorted places ``gone``: what stands
    before the first, and what is left between each window and the next."""

    def between(ls: Column) -> Column:
        def after(p: Column, i: Column) -> Column:
            following = F.coalesce(F.get(gone, i + 1), F.size(ls))
            return F.slice(ls, p + WINDOW + 1, F.greatest(following - p - WINDOW, F.lit(0)))

        return F.concat(F.slice(ls, F.lit(1), F.get(gone, F.lit(0))), F.flatten(F.transform(gone, after)))

    return F.element_at(F.transform(F.array(lines), between), 1)  # the lines are split once


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col, n_lines, n_removed, kept_text``.

    Lines end at "\\n"; a text of k line ends has k + 1 lines.  A window of three
    lines that also starts at an earlier (id, place) loses all its lines, in
    whatever document it stands; the first occurrence stays, unless a later
    occurrence of another window covers it.

    * null text: one empty line, nothing removed, empty kept_text.
    * texts under three lines keep everything; blank lines are lines.
    * null ids come first in order; rows that repeat an id with another text are
      ordered by a hash of the text; rows that repeat id and text are one document
      listed twice: they don't remove from each other and get equal results.
    * other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    windows = _windows(rows)
    place = F.struct("id", "th", "at")
    found = windows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n"))
    repeated = C.cut(found.where("first < last").select("w1", "w2", "first", "n"), C.few(docs))
    # windows with more occurrences than a task should get are dealt by a salt; there are at most ``MOST_HOT``
    part = max(HOT, -(-int(repeated.agg(F.sum("n")).first()[0] or 0) // MOST_HOT))
    salts = F.ceil(F.col("n") / part).cast("int")
    hot = F.broadcast(repeated.where(F.col("n") > part).select("w1", "w2", salts.alias("salts")))
    own = F.pmod(F.xxhash64("id", "th", "at"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt")
    dealt = windows.join(hot, ["w1", "w2"], "left").select("id", "th", "at", "w1", "w2", own)
    salted = repeated.select("w1", "w2", "first", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    later = dealt.join(salted, ["w1", "w2", "salt"]).where(place > F.col("first"))
    gone = later.groupBy("id", "th").agg(F.array_sort(F.collect_set("at")).alias("gone"))
    gone = gone.select(F.col("id").alias("gid"), F.col("th").alias("gth"), "gone")
    joined = rows.join(gone, F.col("id").eqNullSafe(F.col("gid")) & (F.col("th") == F.col("gth")), "left")
    kept = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(_kept(_lines(F.col("text")), F.col("gone")), "\n"))
    n = F.size(_lines(F.col("text"))).cast("bigint")
    left = F.size(_kept(_lines(F.col("text")), F.col("gone")))
    return joined.select(
        F.col("id").alias(id_col), n.alias("n_lines"), F.when(F.col("gone").isNull(), F.lit(0).cast("bigint")).otherwise(n - left).alias("n_removed"), kept.alias("kept_text"),
    )
