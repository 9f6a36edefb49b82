"""Line dedup by overlapping three-line windows.

A text's lines are trimmed for comparing and blank ones skipped; each run of
three consecutive lines is hashed to 128 bits (two chained 64-bit hashes of the
three lines). A window that occurs more than once is kept where it comes first,
by (doc_id, place in the text); the lines of all its later occurrences go, with
the blank lines inside them, after covered positions are merged.

No line content is lost: a removed line stands at the same place of an earlier
occurrence, and the earliest of such a chain is never covered.

Defined cases: a text of fewer than three lines that are not blank is one window
of all of them; blank and empty texts have no window and stay; a null text stays
null with 0 lines; repeated rows (same id, same text) count as one document and
get the same result; equal ids with different texts are ordered by text hash; an
empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carrying, identity, shuffled, stored, text_of


def _windows(size: int) -> Column:
    """Array of (start, end, h1, h2) of a row's windows; start and end are line numbers."""
    filled = F.filter(F.transform("_lines", lambda s, i: F.struct(i.alias("at"), F.trim(s).alias("s"))),
                      lambda x: x["s"] != "")

    def window(e: Column, i: Column) -> Column:
        parts = [F.get(e, i + k)["s"] for k in range(size)]
        last = F.least(i + (size - 1), F.size(e) - 1)
        return F.struct(F.get(e, i)["at"].alias("start"), F.get(e, last)["at"].alias("end"),
                        F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit("second"), *parts).alias("h2"))

    starts = F.sequence(F.lit(0), F.greatest(F.size("_filled") - size, F.lit(0)))
    return filled, F.when(F.size("_filled") > 0, F.transform(starts, lambda i: window(F.col("_filled"), i)))


def line_windows(docs: DataFrame, size: int = 3) -> DataFrame:
    """One row per window: ``_id, _th, start, end, h1, h2``."""
    filled, windows = _windows(size)
    return (docs.select(*identity(), F.split(text_of(), "\n").alias("_lines"))
            .select("_id", "_th", filled.alias("_filled"))
            .select("_id", "_th", F.explode(windows).alias("w")).select("_id", "_th", "w.*"))


@carrying("doc_id", "text")
def dedup_lines(docs: DataFrame, size: int = 3) -> DataFrame:
    """``docs`` with the remaining ``text``, and ``n_lines, n_removed`` (long)."""
    windows = line_windows(docs, size)
    place = F.struct("_id", "_th", "start")
    first = (windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n"))
             .filter("n > 1").drop("n"))
    covered = (windows.join(shuffled(first), ["h1", "h2"]).filter(place > F.col("first"))
               .groupBy("_id", "_th").agg(F.collect_set(F.struct("start", "end")).alias("_spans")))
    lines = F.split(text_of(), "\n")
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    gone = F.array_distinct(F.flatten(F.transform("_spans", lambda x: F.sequence(x["start"], x["end"]))))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    out = (docs.select("*", *identity()).join(covered, ["_id", "_th"], "left")
           .withColumn("_gone", gone)
           .withColumns({"n_lines": n.cast("long"),
                         "n_removed": F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long"),
                         "text": F.when(F.col("_gone").isNull(), F.col("text")).otherwise(
                             F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))}))
    return out.drop("_id", "_th", "_spans", "_gone")


#: Words with what white space follows them; the first one also has what precedes it.
WORD = r"\s*+\S++\s*+"
#: A piece ends after a word whose hash is 0 modulo ``CUT_ONE_IN``, after ``PIECE_WORDS`` words, or at a line
#: end. So pieces follow content in any language, wherever a passage stands in a text.
CUT_ONE_IN, PIECE_WORDS = 3, 6
#: Consecutive pieces of a window.
PIECES = 4
BLANK = " \n\t\r\x0b\x0c"
#: A repeated run of pieces goes if it has this many words, or three whole lines.
LEAST_WORDS = 20


def _with_pieces(rows: DataFrame) -> DataFrame:
    """Adds ``_raw``, the consecutive pieces of ``_text`` with their white space."""
    nothing = F.array().cast("array<int>")

    def ends(w: Column, i: Column) -> Column:
        cut = w.contains("\n") | (F.pmod(F.xxhash64(F.trim(w, F.lit(BLANK))), F.lit(CUT_ONE_IN)) == 0)
        return F.when(cut | (i == F.size("_words") - 1), i)

    def chopped(a: Column, z: Column) -> Column:  # a long stretch without a cut, from its start on
        return F.concat(F.when(z - a >= PIECE_WORDS, F.sequence(a + (PIECE_WORDS - 1), z - 1, F.lit(PIECE_WORDS))).otherwise(nothing), F.array(z))

    rows = rows.withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), 0))
    rows = rows.withColumn("_ends", F.array_compact(F.transform("_words", ends)))
    after = F.concat(F.array(F.lit(0)), F.transform(F.slice("_ends", F.lit(1), F.greatest(F.size("_ends") - 1, F.lit(0))), lambda e: e + 1))
    rows = rows.withColumn("_ends", F.when(F.size("_ends") > 0, F.flatten(F.zip_with(after, F.col("_ends"), chopped))).otherwise(nothing))
    starts = F.concat(F.array(F.lit(0)), F.transform(F.slice("_ends", F.lit(1), F.greatest(F.size("_ends") - 1, F.lit(0))), lambda e: e + 1))
    raw = F.zip_with(starts, F.col("_ends"), lambda a, z: F.array_join(F.slice(F.col("_words"), a + 1, z - a + 1), ""))
    return rows.withColumn("_raw", F.when(F.size("_ends") > 0, raw).otherwise(F.array().cast("array<string>"))).drop("_words", "_ends")


def piece_windows(docs: DataFrame) -> DataFrame:
    """One row per ``PIECES`` consecutive pieces: ``_id, _th, start, h1, h2``. A text of one
    or two filled lines has a window of the whole of it, too (start -1)."""
    def window(i: Column) -> Column:
        parts = [F.get("_p", i + k) for k in range(PIECES)]
        return F.struct(i.alias("start"), F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit("second"), *parts).alias("h2"))

    lines = F.filter(F.transform(F.split("_text", "\n"), lambda s: F.trim(s)), lambda s: s != "")
    whole = F.struct(F.lit(-1).alias("start"), F.xxhash64(F.lit("whole"), F.array_join("_l", "\n")).alias("h1"),
                     F.xxhash64(F.lit("second"), F.lit("whole"), F.array_join("_l", "\n")).alias("h2"))
    none = F.array().cast("array<struct<start:int,h1:bigint,h2:bigint>>")
    inner = F.when(F.size("_p") >= PIECES, F.transform(F.sequence(F.lit(0), F.size("_p") - PIECES), window)).otherwise(none)
    short = F.when(F.size("_l").between(1, 2), F.array(whole)).otherwise(none)
    rows = _with_pieces(docs.select(*identity(), text_of().alias("_text")))
    rows = rows.select("_id", "_th", F.transform("_raw", lambda p: F.trim(p, F.lit(BLANK))).alias("_p"), lines.alias("_l"))
    return rows.select("_id", "_th", F.explode(F.concat(short, inner)).alias("w")).select("_id", "_th", "w.*")


@carrying("doc_id", "text")
def dedup_passages(docs: DataFrame) -> DataFrame:
    """``docs`` without the later occurrences of passages: the window rule of ``dedup_lines`` on
    pieces of lines, ``PIECES`` a window. Repeated runs of ``LEAST_WORDS`` words go wherever they stand, and runs of three whole
    lines. What goes stands at an earlier place, as there."""
    windows = piece_windows(docs)
    place = F.struct("_id", "_th", "start")
    # half the hash finds what may be repeated; the whole of it decides below
    many = windows.select("h1").groupBy("h1").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    again = stored(windows.join(shuffled(many), "h1"), "repeated-windows")
    # both sides stored: plain exchanges, over which a very common window can be split
    first = stored(again.groupBy("h1", "h2").agg(F.min(place).alias("first")), "first-windows")
    covered = (again.join(first, ["h1", "h2"]).filter(place > F.col("first"))
               .groupBy("_id", "_th").agg(F.array_sort(F.collect_set("start")).alias("_starts")))
    s, raw = F.col("_inner"), F.col("_raw")
    begins = F.filter(s, lambda x, i: (i == 0) | (x - F.get(s, i - 1) > PIECES))
    ends = F.transform(F.filter(s, lambda x, i: (i == F.size(s) - 1) | (F.get(s, i + 1) - x > PIECES)), lambda x: x + (PIECES - 1))

    def run(r: Column) -> Column:
        text = F.array_join(F.slice(raw, r["b"] + 1, r["e"] - r["b"] + 1), "")
        bare = F.trim(text, F.lit(BLANK))
        opens = (r["b"] == 0) | F.get(raw, r["b"] - 1).contains("\n")
        closes = (r["e"] == F.size(raw) - 1) | F.get(raw, r["e"]).contains("\n")
        lines = F.size(F.split(bare, r"\s*\n\s*")) - F.when(opens, 0).otherwise(1) - F.when(closes, 0).otherwise(1)
        return F.struct(r["b"].alias("b"), r["e"].alias("e"), text.contains("\n").alias("broken"),
                        ((F.size(F.split(bare, r"\s+")) >= LEAST_WORDS) | (lines >= 3)).alias("goes"))

    spans = F.transform(F.arrays_zip(F.col("_begins").alias("b"), F.col("_ends").alias("e")), run)
    runs = F.col("_runs")

    def part(k: Column) -> Column:  # what stays before run k; a line end that went with the run stays
        start = F.when(k == 0, 0).otherwise(F.get(runs, k - 1)["e"] + 1)
        stop = F.when(k == F.size(runs), F.size(raw)).otherwise(F.get(runs, k)["b"])
        text = F.array_join(F.slice(raw, start + 1, stop - start), "")
        lost = F.coalesce(F.get(runs, k)["broken"], F.lit(False)) & (text != "") & ~text.endswith("\n")
        return F.concat(text, F.when(lost, "\n").otherwise(""))

    met = docs.select("*", *identity()).join(covered, ["_id", "_th"], "left")
    # pieces of texts that hold a repeated window only
    out = (_with_pieces(met.withColumn("_text", F.when(F.col("_starts").isNotNull(), text_of())))
           .withColumn("_inner", F.filter("_starts", lambda x: x >= 0))
           .withColumns({"_begins": begins, "_ends": ends})
           .withColumn("_runs", F.filter(spans, lambda r: r["goes"]))
           .withColumn("text", F.when(F.col("_starts").isNull(), F.col("text"))
                       .when(F.array_contains("_starts", -1), F.lit(""))
                       .when(F.size("_runs") == 0, F.col("text"))
                       .otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.size("_runs")), part), ""))))
    return out.select(*docs.columns)
