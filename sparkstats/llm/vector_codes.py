"""Vector code compression with norm-of-sum bounds.

Components become integers, ``floor(256 * c)``; vectors are cut into equal parts, and
every part position has a codebook that some rounds of assignment and replacement
improve. All distances are squared, integer and exact; ties go to the lower index.

Rounds after the first avoid most of the distances. Each vector part keeps one lower
bound, its distance to the second nearest entry, stamped with the round in which it was
measured, and the whole history of codebooks (rounds x parts x entries, a fixed size)
is at hand. Since a stamp, no entry other than the assigned one can have come
nearer than the bound less the greatest net displacement of those entries between the
stamp's codebook and the present one: the norm of the summed moves, which the
triangle inequality puts at or below the sum of the rounds' moves. Only parts whose own
distance does not stay strictly below that are scanned again, in full, and stamped anew.

Vectors travel in packed blocks with their codes, bounds and stamps. A round is one
pass that writes blocks, and one that sums parts by entry: per-task sums, added up by
Spark; only the codebooks reach the driver.

Defined cases: vectors that are null, empty, or hold null or non-finite components
are dropped; vectors of several lengths, of a length that the parts do not divide, or with
components beyond 2^20 raise ValueError; the first entries are of the smallest ids
(null ids last, equal ids by vector); fewer vectors than entries make a codebook of as
many; entries that no part uses stay; repeated rows get equal codes; a null label is
a label of its own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SCALE = 256.0
REACH = 1 << 28          # greatest integer component: squared distances stay far inside the longs
BLOCK = 2048             # vectors in one packed row
SLACK = 1e-9             # relative, for the roots of exact integers
STATE = "n long, dim long, ids binary, body binary, codes binary, bounds binary, stamps binary, labels array<string>, scans long"

Books = list[np.ndarray]  # of each round: parts x entries x length, integers


def _doubles() -> Column:
    return F.col("embedding").cast("array<double>")


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, x`` of the rows that hold a whole finite vector; x: its integers."""
    fine = F.forall(_doubles(), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & (F.size("embedding") > 0)
    near = F.forall(_doubles(), lambda c: F.abs(c * SCALE) <= REACH)
    x = F.transform(_doubles(), lambda c: F.floor(c * SCALE).cast("long"))
    return vectors.filter(F.coalesce(fine, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
        F.when(near, x).otherwise(F.raise_error(F.lit("an embedding component is beyond 2^20"))).alias("x"))


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances, exact, of rows to the entries of one part's codebook."""
    reach = int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    if 4 * x.shape[1] * reach * reach < 1 << 52:  # doubles hold these integers exactly
        a, b = x.astype(float), book.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.zeros((len(x), len(book)), np.int64)
    for i in range(x.shape[1]):
        out += np.square(x[:, i, None] - book[None, :, i])
    return out


def net_moves(history: Books) -> np.ndarray:
    """Net displacement of every entry from each earlier round's codebook to the latest:
    stamps x parts x entries."""
    return np.array([np.sqrt(np.square((history[-1] - then).astype(float)).sum(2)) for then in history])


def reassigned(x: np.ndarray, history: Books, codes: np.ndarray, bounds: np.ndarray, stamps: np.ndarray, part: int) -> int:
    """Assign one part of the rows ``x`` to the latest codebook, in place; how many rows were scanned.

    codes, bounds, stamps: of this part, one a row; a code of 255 with a negative bound has never been assigned."""
    book, now = history[-1][part], len(history) - 1
    rows = np.arange(len(x))
    if now and len(book) > 1:
        own = np.sqrt(np.square(x - book[codes]).sum(1).astype(float))
        moves = net_moves(history)[:, part]
        order = np.argsort(moves, axis=1)
        most, top, next_most = order[:, -1], np.take_along_axis(moves, order[:, -1:], 1)[:, 0], np.take_along_axis(moves, order[:, -2:-1], 1)[:, 0]
        drift = np.where(most[stamps] == codes, next_most[stamps], top[stamps])  # of the other entries
        rows = rows[~(own * (1 + SLACK) < bounds * (1 - SLACK) - drift * (1 + SLACK))]
    elif now:
        return 0
    if len(rows):
        d = distances(x[rows], book)
        codes[rows] = d.argmin(1)
        if len(book) > 1:
            d[np.arange(len(rows)), codes[rows]] = np.iinfo(np.int64).max
            bounds[rows] = np.sqrt(d.min(1).astype(float))
        stamps[rows] = now
    return len(rows)


def _packed(parts: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                lengths = part.column("x").value_lengths().to_numpy()
                dim = int(lengths[0])
                if (lengths != dim).any() or dim % parts:
                    raise ValueError(f"embeddings of lengths {sorted(set(lengths.tolist()))} for {parts} parts")
                n = part.num_rows
                yield pa.RecordBatch.from_pydict({
                    "n": pa.array([n], pa.int64()), "dim": pa.array([dim], pa.int64()),
                    "ids": pa.array([_ids(part.column("vec_id"))], pa.binary()),
                    "body": pa.array([part.column("x").flatten().to_numpy().astype(np.int32).tobytes()], pa.binary()),
                    "codes": pa.array([np.full((parts, n), 255, np.uint8).tobytes()], pa.binary()),
                    "bounds": pa.array([np.full((parts, n), -1.0).tobytes()], pa.binary()),
                    "stamps": pa.array([np.zeros((parts, n), np.uint8).tobytes()], pa.binary()),
                    "labels": pa.array([part.column("label").to_pylist()], pa.list_(pa.string())), "scans": pa.array([0], pa.int64())})
    return run


def _ids(ids: pa.Array) -> bytes:
    """The ids and, before each, whether it is null."""
    return ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64).tobytes() + ids.fill_null(0).to_numpy().tobytes()


class _Block:
    """A packed row, read; codes, bounds and stamps can be written to."""

    def __init__(self, b: pa.RecordBatch, row: int, parts: int) -> None:
        self.n, self.dim = b.column("n")[row].as_py(), b.column("dim")[row].as_py()
        read = lambda name, kind: np.frombuffer(b.column(name)[row].as_buffer(), kind)
        self.x = read("body", np.int32).reshape(self.n, parts, self.dim // parts).astype(np.int64)
        self.codes, self.bounds, self.stamps = (read(c, k).reshape(parts, self.n).copy() for c, k in (("codes", np.uint8), ("bounds", np.float64), ("stamps", np.uint8)))

    def assign(self, history: Books) -> int:
        return sum(reassigned(self.x[:, p], history, self.codes[p], self.bounds[p], self.stamps[p], p) for p in range(len(self.codes)))


def _round(history: Books, parts: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                block = _Block(b, row, parts)
                scans = block.assign(history)
                new = {"codes": block.codes, "bounds": block.bounds, "stamps": block.stamps}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([new[c].tobytes()], pa.binary()) if c in new else pa.array([scans], pa.int64()) if c == "scans" else b.column(c).slice(row, 1)
                     for c in b.schema.names], names=b.schema.names)
    return run


def _entry_sums(blocks: DataFrame, parts: int, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Component sums (parts x entries x length) and counts (parts x entries) of the assigned parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = counts = None
        for b in batches:
            for row in range(b.num_rows):
                block = _Block(b, row, parts)
                if sums is None:
                    sums, counts = np.zeros((parts, entries, block.dim // parts), np.int64), np.zeros((parts, entries), np.int64)
                for p in range(parts):
                    np.add.at(sums[p], block.codes[p], block.x[:, p])
                    counts[p] += np.bincount(block.codes[p], minlength=entries)
        if sums is not None:
            both = np.concatenate([sums, counts[:, :, None]], axis=2).ravel()
            used = np.flatnonzero(both)
            yield pa.RecordBatch.from_pydict({"at": pa.array(used), "v": pa.array(both[used])})

    dim = blocks.agg(F.max("dim")).first()[0]
    out = np.zeros(parts * entries * (dim // parts + 1), object)
    for r in blocks.mapInArrow(run, "at long, v long").groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
        out[r["at"]] = int(r["v"])
    out = out.reshape(parts, entries, -1)
    return out[:, :, :-1], out[:, :, -1]


def replaced(book: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each used entry becomes the componentwise floor of its parts' mean."""
    used = counts > 0
    out = book.copy()
    out[used] = (sums[used] // counts[used][:, None]).astype(np.int64)
    return out


def first_books(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    lengths = {len(r["x"]) for r in first}
    if len(lengths) > 1 or lengths.pop() % parts:
        raise ValueError(f"embeddings of lengths {sorted({len(r['x']) for r in first})} for {parts} parts")
    return np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()


def fitted(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, Books] | None:
    """The packed blocks as the last round left them and the codebooks of all rounds;
    None without any vector."""
    if not 0 < entries < 256 or rounds > 254:
        raise ValueError("1 to 255 entries, at most 254 rounds")
    rows = usable(vectors)
    if not rows.head(1):
        return None
    history = [first_books(rows, parts, entries)]
    blocks = rows.mapInArrow(_packed(parts), STATE)
    for _ in range(rounds):
        blocks = stored(blocks.mapInArrow(_round(history, parts), STATE), "vector-codes")
        history = [*history, replaced(history[-1], *_entry_sums(blocks, parts, history[0].shape[1]))]
    if blocks.agg(F.count_distinct("dim")).first()[0] > 1:
        raise ValueError("embeddings of several lengths")
    return blocks, history


def _final(history: Books, parts: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                block = _Block(b, row, parts)
                block.assign(history)
                near = history[-1][np.arange(parts)[:, None], block.codes]
                error = np.square(block.x.transpose(1, 0, 2) - near).sum((0, 2))
                none, ids = np.frombuffer(b.column("ids")[row].as_buffer(), np.int64).reshape(2, block.n)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": pa.array(ids, mask=none.astype(bool)), "label": pa.array(b.column("labels")[row].as_py(), pa.string()),
                    "code": pa.array([c.tobytes().hex() for c in np.ascontiguousarray(block.codes.T)]), "error": pa.array(error)})
    return run


def spelled(book: np.ndarray) -> str:
    return ",".join(map(str, book.ravel().tolist()))


def encoded(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """A row for each vector: ``vec_id, label, code`` (two hex digits a part), ``error`` (its squared
    distances from the final entries), ``label_error`` and ``codebooks_sha256``."""
    fit = fitted(vectors, parts, entries, rounds)
    columns = "vec_id long, label string, code string, error long"
    if fit is None:
        return vectors.sparkSession.createDataFrame([], columns + ", label_error long, codebooks_sha256 string")
    blocks, history = fit
    rows = stored(blocks.mapInArrow(_final(history, parts), columns), "codes")
    # both sides stored: plain exchanges, over which a hot label can be split
    by_label = stored(rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_of"), "label-errors")
    digest = hashlib.sha256(spelled(history[-1]).encode()).hexdigest()
    return (rows.join(by_label, F.col("label").eqNullSafe(F.col("_of"))).drop("_of")
            .withColumn("codebooks_sha256", F.lit(digest)))
