"""SimHash near-duplicates by segment popcounts and a grid join.

A text's fingerprint sets a bit where more than half of its shingle hashes do.
Fingerprints are embedded by the number of ones in each 2-bit segment; the counts
are kept in unary, so that the Manhattan distance of two embeddings is the number
of differing bits of two longs. It never exceeds the number of bits in which the
fingerprints differ, so it bounds that from below.

The grid: the 32 coordinates form ``max_bits + AGREE`` blocks. A Manhattan distance
of ``max_bits`` touches at most that many blocks, so at least ``AGREE`` blocks agree
and the pair shares a cell of the grid over those; every choice of ``AGREE`` blocks
is one grid. In a cell, members within reach of its leader (the
fingerprint of most documents) are linked to it and need no links among
themselves; only the others are compared with the cell. Pairs pass the Manhattan
bound first and then the exact bit count. Exact copies are one fingerprint and
never meet. No cell or group is capped.

Defined cases: a null, empty or blank text has fingerprint zero, which links like
any other; a text of fewer words than a shingle is one shingle; a null doc_id
takes part, is never the smallest, and names no component; repeated rows each get
a row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import identity, shuffled, stored, text_of
from .components import components

PAIRS_LOW = 0x5555555555555555  # the low bit of each 2-bit segment
AGREE = 4  # blocks that span a grid: more make finer cells (fewer chance meetings) and more grids


def fingerprint(text: bytes, shingle: int) -> int:
    """Signed 64-bit fingerprint of one UTF-8 text."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[:n - 1]))
    stops = ends[-n:] - 1
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 16384):  # bounded memory for a text of any length
        block = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at:at + 16384].tolist(), stops[at:at + 16384].tolist())], np.uint64)
        ones += np.unpackbits(block.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``doc_id, _id, _th, fp`` for each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in b.column("body")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_id"), b.column("_th"), pa.array(fps, pa.int64())],
                                             names=["doc_id", "_id", "_th", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *identity(), text_of().cast("binary").alias("body"))
    return rows.mapInArrow(run, "doc_id long, _id long, _th long, fp long")


def _unary(fp: Column) -> Column:
    """Per 2-bit segment the count of ones, in unary: 00, 01 or 11."""
    up, low = F.shiftrightunsigned(fp, 1), F.lit(PAIRS_LOW)
    return fp.bitwiseOR(up).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(up).bitwiseAND(low), 1))


def _differ(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(classes: DataFrame, max_bits: int = 4) -> DataFrame:
    """Edges ``a, b`` that connect all fingerprints within ``max_bits`` of each
    other. classes: distinct ``fp`` with its number of rows ``n``."""
    bounds = np.linspace(0, 32, max_bits + AGREE + 1).round().astype(int)
    blocks = [sum(3 << (2 * i) for i in range(a, b)) for a, b in itertools.pairwise(bounds.tolist())]
    grids = [_signed(sum(c)) for c in itertools.combinations(blocks, AGREE)]
    code = _unary(F.col("fp"))
    # a cell goes by a hash of grid and coordinates: two cells of one hash only add pairs to verify
    tasks = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few rows now, many after the explode
    cells = (classes.repartition(tasks, "fp").select("fp", "n", code.alias("code"))
             .select("fp", "n", F.explode(F.array(*[
                 F.xxhash64(F.lit(i), F.col("code").bitwiseAND(F.lit(m))) for i, m in enumerate(grids)])).alias("cell")))
    leaders = (cells.groupBy("cell").agg(F.max(F.struct("n", "fp"))["fp"].alias("leader"), F.count("*").alias("size"))
               .filter("size > 1").drop("size"))
    members = stored(cells.drop("n").join(shuffled(leaders), "cell")
                     .withColumn("near", (_differ(code, _unary(F.col("leader"))) <= max_bits)
                                 & (_differ(F.col("fp"), F.col("leader")) <= max_bits)), "cells")
    to_leader = members.filter("near AND fp <> leader").select(F.col("leader").alias("a"), F.col("fp").alias("b"))
    stray = members.filter("NOT near").select("cell", F.col("fp").alias("a"))
    other = members.select(F.col("cell").alias("c"), F.col("fp").alias("b"), "near")
    across = stray.join(shuffled(other), (F.col("cell") == F.col("c")) & (F.col("near") | (F.col("a") < F.col("b")))
                        & (_differ(_unary(F.col("a")), _unary(F.col("b"))) <= max_bits)
                        & (_differ(F.col("a"), F.col("b")) <= max_bits)).select("a", "b")
    return to_leader.unionByName(across)


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row per document: ``doc_id, _id, _th, fp, component_id``, the smallest
    doc_id that links of at most ``max_bits`` differing bits reach."""
    prints = stored(fingerprints(docs, shingle), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes, max_bits))
    # both sides of the last joins are stored: plain exchanges, which a component of any size can be split over
    rooted = stored(classes.join(shuffled(roots), classes.fp == roots.node, "left")
                    .select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    least = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = stored(rooted.join(shuffled(least), "root").select("fp", "component_id"), "named")
    return prints.join(shuffled(named), "fp").select("doc_id", "_id", "_th", "fp", "component_id")
