"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of 13 consecutive words (an item of fewer
is one window) and each window into word shingles. Shingles are ordered by
rarity over all documents. A window that a document holds whole must share every
shingle, so a prefix of one token, its rarest shingle, is enough to find it: the
documents' shingles join that index only. The shingle's place in the window gives
the only start the window can have in the document (positional bound), which must
leave room for the whole window (length bound); the words are then compared one
by one.

Defined cases: a null or wordless text has no words; a wordless item has no
window; repeated items and items that share windows are all counted; a null
item_id counts as the empty string; equal ids with different texts are told
apart by text hash and repeated rows get the same result; an empty benchmark or
documents table gives no hits; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, identity, stored, text_of

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A token that stands for a document and not for a shingle of it.
MARK = 0
#: A benchmark of up to this many distinct shingles (8 bytes each) is broadcast;
#: a larger one meets the documents' shingles in a shuffled join.
BROADCAST_SHINGLES = 2_000_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def _hash(words: Column, at: Column, length: int) -> Column:
    return F.xxhash64(F.lit(length), *[F.get(words, at + k) for k in range(length)])


def _shingles(words: Column, length: int) -> Column:
    """Hashes of all shingles of ``length`` words, in order; empty for fewer words."""
    return F.when(F.size(words) >= length,
                  F.transform(F.sequence(F.lit(0), F.size(words) - length), lambda i: _hash(words, i, length)))


def item_windows(benchmark: DataFrame, window: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(windows, items): each distinct window ``wid, win, n`` with its shingles'
    ``length`` and ``tokens``; and the items that hold it."""
    w = F.col("_w")
    cut = (benchmark.select("item_id", words_of(text_of()).alias("_w")).filter(F.size("_w") > 0)
           .select("item_id", F.explode(F.transform(
               F.sequence(F.lit(0), F.greatest(F.size(w) - window, F.lit(0))),
               lambda i: F.slice(w, i + 1, window))).alias("win")))
    cut = cut.withColumn("wid", F.array_join("win", " "))
    items = cut.select("wid", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")).distinct()
    windows = cut.dropDuplicates(["wid"]).select("wid", "win", F.size("win").alias("n"),
                                                 F.least(F.size("win"), F.lit(shingle)).alias("length"))
    tokens = F.coalesce(*[F.when(F.col("length") == k, _shingles(F.col("win"), k)) for k in range(1, shingle + 1)])
    return windows.withColumn("tokens", tokens), items


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = 13, shingle: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits, items, sizes): every place ``_id, _th, start, n`` where a window ``wid``
    stands in a document; the items by window; and ``doc_id, _id, _th, n_words`` of every row.

    Texts are cut into words once: a row's shingles of all lengths, and one mark that every
    row has, are one array, which meets the benchmark's shingles (and the mark) in one join."""
    windows, items = item_windows(benchmark, window, shingle)
    windows, items = stored(windows, "windows"), stored(items, "items")
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # at most `shingle` numbers
    shared = windows.select(F.explode("tokens").alias("token")).union(docs.sparkSession.range(1).select(F.lit(MARK).cast("long")))
    known = stored(shared.distinct(), "shingles")
    hint = F.broadcast if known.count() <= BROADCAST_SHINGLES else (lambda df: df)
    none = F.array().cast("array<bigint>")
    every = F.concat(F.array(F.lit(MARK).cast("long")), *[F.coalesce(_shingles(F.col("_w"), k), none) for k in lengths])
    # where a shingle's place in the array puts it: after the mark, lengths follow each other
    length, at, before = F.lit(0), F.lit(0), F.lit(1)
    for k in lengths:
        places = F.greatest(F.size("_w") - (k - 1), F.lit(0))
        here = (F.col("place") >= before) & (F.col("place") < before + places)
        length, at, before = F.when(here, k).otherwise(length), F.when(here, F.col("place") - before).otherwise(at), before + places
    found = (docs.select("doc_id", *identity(), words_of(text_of()).alias("_w"))
             .select("doc_id", "_id", "_th", "_w", F.posexplode(every).alias("place", "token"))
             .join(hint(known), "token").withColumns({"length": length, "at": at}))
    start = F.greatest(F.col("at") - (window - F.col("length")), F.lit(0))
    around = F.when(F.col("length") > 0, F.slice("_w", start + 1, 2 * window))
    found = stored(found.select("doc_id", "_id", "_th", F.size("_w").alias("n_words"), "at", "token", "length", start.alias("from"),
                                around.alias("around")), "shared-shingles")
    sizes, found = found.filter("length = 0 AND token = " + str(MARK)).select("doc_id", "_id", "_th", "n_words"), found.filter("length > 0")
    count = found.groupBy("length", "token").agg(F.count("*").alias("seen"))
    # a window's prefix is its rarest shingle; a window with a shingle that no document has drops out here
    prefix = (windows.select("wid", "length", F.posexplode("tokens").alias("offset", "token"))
              .join(count, ["length", "token"], "left")
              .groupBy("wid").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "token", "offset")).alias("p"))
              .filter("p.seen > 0").select("wid", "p.token", "p.offset")
              .join(windows.select("wid", "win", "n", "length"), "wid"))
    prefix = stored(prefix, "prefix")
    start = F.col("at") - F.col("offset")
    hits = (found.join(prefix, ["length", "token"])
            .filter((start >= 0) & (start + F.col("n") <= F.col("n_words")))
            .filter(F.slice("around", start - F.col("from") + 1, F.col("n")) == F.col("win"))
            .select("_id", "_th", "wid", start.alias("start"), "n"))
    return stored(hits, "hits"), items, sizes


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, shingle: int = 5, one_in: int = 20) -> DataFrame:
    """One row per document: ``doc_id, _id, _th, n_words, n_hit, n_items,
    item_ids`` (sorted array) and ``contaminated``: at least one word in
    ``one_in`` lies inside a window."""
    hits, items, sizes = occurrences(docs, benchmark, window, shingle)
    merged = F.aggregate(
        F.array_sort("_at"), F.struct(F.lit(0).alias("hit"), F.lit(0).alias("reach")),
        lambda acc, x: F.struct((acc["hit"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], acc["reach"]))).alias("hit"),
                                F.greatest(acc["reach"], x["end"]).alias("reach")))
    spans = (hits.groupBy("_id", "_th").agg(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end"))).alias("_at"))
             .select("_id", "_th", merged["hit"].cast("long").alias("n_hit")))
    held = (hits.select("_id", "_th", "wid").distinct().join(items, "wid")
            .groupBy("_id", "_th").agg(F.array_sort(F.collect_set("item")).alias("item_ids")))
    out = (sizes.withColumn("n_words", F.col("n_words").cast("long"))
           .join(spans.join(held, ["_id", "_th"]), ["_id", "_th"], "left"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "_id", "_th", "n_words", n_hit.alias("n_hit"),
                      F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
                      ((n_hit > 0) & (one_in * n_hit >= F.col("n_words"))).alias("contaminated")
                      ).withColumn("n_items", F.size("item_ids").cast("long"))
