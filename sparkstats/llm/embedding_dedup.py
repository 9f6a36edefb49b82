"""Embedding near-duplicates by sorted projection passes.

Equal vectors of a label are one class. A pass orders the classes of every (label,
length) by concatenated random hashes, the signs of 62 random projections, and compares
each with the ``window`` classes after it, over the borders of the range partitions
too; pairs whose cosine reaches the threshold, in double precision, are links. Passes
with fresh projections go on until ``QUIET`` of them in a row connect nothing new (at most
``passes``); the links of all passes are united to components. Inside a component all
classes are compared in full, in blocks, which gives the exact number of links.

Crowded labels, whose vectors all stand close together, keep near pairs apart in any such
order. So an exact check follows in every label, whatever its size: all pairs of its classes that the
passes left in different components are compared, in blocks, and the links found there
are added. No link is lost. The check is quadratic by nature: K classes of a label cost
K^2 / ``BLOCK`` rows and K^2 / 2 comparisons, dealt out by pairs of blocks; a task holds two blocks at a time.

Defined cases: vectors that are null, zero or hold null or non-finite components,
and vectors without a label, link with nothing; vectors of unequal length are not
compared; a null vec_id takes part, is never the smallest and is not ``kept``; repeated ids are
separate vectors; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

BLOCK = 1024           # classes in one block of a full comparison
BITS = 62              # projections in a key
QUIET = 2              # passes without a new connection after which the passes end
QUERY_ONE_IN = 100     # of the ids: the query set on which the recall of the passes alone is stated; the result does not use it


def _matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    """Rows of unit length, in double precision."""
    x = np.frombuffer(b"".join(vectors), np.float64).reshape(-1, dim)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _doubles() -> Column:
    return F.col("embedding").cast("array<double>")


def _can_link() -> Column:
    fine = F.forall(_doubles(), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col("label").isNotNull() & fine & F.exists(_doubles(), lambda x: x != 0), F.lit(False))


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, vec`` (doubles) of the rows that can link at all."""
    return vectors.filter(_can_link()).select("vec_id", F.col("label").cast("string").alias("label"), _doubles().alias("vec"))


COLUMNS = ["cid", "links", "a", "b"]


def _stars(hit: np.ndarray, one: bool) -> tuple[np.ndarray, np.ndarray]:
    """For the rows and the columns of ``hit`` the first row that links lead to, -1
    without links; one: rows and columns are the same places."""
    rows = np.full(hit.shape[0], -1)
    cols = rows if one else np.full(hit.shape[1], -1)
    for first in np.flatnonzero(hit.any(axis=1)):
        if rows[first] >= 0:
            continue
        rows[first], front = first, np.array([first])
        while len(front):
            reached = np.flatnonzero(hit[front].any(axis=0) & (cols < 0))
            cols[reached] = first
            front = reached if one else np.flatnonzero(hit[:, reached].any(axis=1) & (rows < 0))
            rows[front] = first
    return rows, cols


def _by_block_pair(compare: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable:
    """Apply ``compare`` to the rows of every (label, dim, i, j), which come sorted; one group is held at a time."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the parts of the block pair that is not complete yet
        for b in batches:
            key = b[["label", "dim", "i", "j"]]
            edges = [0, *(np.flatnonzero(key.ne(key.shift()).any(axis=1).to_numpy()[1:]) + 1).tolist(), len(b)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                part = b.iloc[lo:hi]
                if held and (held[-1][key.columns].iloc[-1] != part[key.columns].iloc[0]).any():
                    yield compare(pd.concat(held, ignore_index=True))
                    held = []
                if len(part):
                    held.append(part)
        if held:
            yield compare(pd.concat(held, ignore_index=True))
    return run


def _compared(threshold: float, apart: bool) -> Callable:
    """Per member and block pair, the copies that the linked members stand for
    (``cid, links``), and per block pair edges that connect what links connect (``a, b``); apart: of
    members with different roots only."""
    def compare(g: pd.DataFrame) -> pd.DataFrame:
        one = g["i"].iloc[0] == g["j"].iloc[0]
        left, right = (g, g) if one else (g[g["side"] == 0], g[g["side"] == 1])
        if not len(left) or not len(right):
            return pd.DataFrame(columns=COLUMNS, dtype="Int64")
        dim = int(g["dim"].iloc[0])
        hit = _matrix(left["vec"], dim) @ _matrix(right["vec"], dim).T >= threshold
        if one:
            np.fill_diagonal(hit, False)
        if apart:
            hit &= left["root"].to_numpy()[:, None] != right["root"].to_numpy()
        if not hit.any():
            return pd.DataFrame(columns=COLUMNS, dtype="Int64")
        mine, other = left["cid"].to_numpy(), right["cid"].to_numpy()
        cid, links = mine, hit @ right["n"].to_numpy()
        first, _ = firsts = _stars(hit, one)
        if not one:
            cid, links, first = np.concatenate([mine, other]), np.concatenate([links, hit.T @ left["n"].to_numpy()]), np.concatenate(firsts)
        counts = pd.DataFrame({"cid": cid[links > 0], "links": links[links > 0]})
        edges = pd.DataFrame({"a": mine[first[first >= 0]], "b": cid[first >= 0]})
        edges = edges[edges["a"] != edges["b"]]
        return pd.concat([counts.astype("Int64"), edges.astype("Int64")]).reindex(columns=COLUMNS).astype("Int64")
    return _by_block_pair(compare)


def compared(classes: DataFrame, threshold: float, apart: bool = False) -> DataFrame:
    """Rows ``cid, links`` (copies outside the class that a class links to, by block
    pair) and rows ``a, b`` (edges that connect what links connect); apart: links between different
    roots only. classes: ``label, dim, cid, n, vec`` (binary), ``root``."""
    sizes = stored(classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks")), "blocks")
    placed = classes.join(sizes, ["label", "dim"]).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = (placed.select("label", "dim", "cid", "n", "vec", "root", "own", other)
             .select("label", "dim", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                     F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "cid", "n", "vec", "root"))
    ordered = pairs.repartition("label", "dim", "i", "j").sortWithinPartitions("label", "dim", "i", "j", "side", "cid")
    return ordered.mapInPandas(_compared(threshold, apart), "cid long, links long, a long, b long")


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.assign(vec=[(lambda x: (x / np.abs(x).max()).tobytes())(np.array(v, np.float64)) for v in b["vec"]])


# --- sorted passes ----------------------------------------------------------------

ORDERED = "label string, dim int, key long, cid long, vec binary"
FOUND = "a long, b long, part int, last boolean, place int, label string, dim int, cid long, vec binary"


def _keyed(seed: int, turn: int) -> Callable:
    """Adds ``key``: the signs of random projections, the first one highest."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            key = np.zeros(len(b), np.int64)
            for dim in b["dim"].unique().tolist():
                at = np.flatnonzero(b["dim"].to_numpy() == dim)
                planes = np.random.default_rng([seed, turn, dim]).standard_normal((dim, BITS))
                signs = _matrix(b["vec"].iloc[at], dim) @ planes > 0
                key[at] = signs @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))
            yield b.assign(key=key)[["label", "dim", "key", "cid", "vec"]]
    return run


def _linked(rows: pd.DataFrame, window: int, fresh: int, threshold: float) -> pd.DataFrame:
    """Links between ordered rows at most ``window`` places apart, the later one at ``fresh`` or after: as
    many as connect what all of them connect, about one a row at most."""
    run = rows["label"].ne(rows["label"].shift()) | rows["dim"].ne(rows["dim"].shift())
    starts = [*np.flatnonzero(run.to_numpy()).tolist(), len(rows)]
    cid, a, b = rows["cid"].to_numpy(), [], []
    for lo, hi in zip(starts[:-1], starts[1:]):
        if hi - lo < 2 or hi <= fresh:
            continue
        lo = max(lo, fresh - window)
        x = _matrix(rows["vec"].iloc[lo:hi], int(rows["dim"].iloc[lo]))
        chain = np.zeros(len(x), np.int64)  # neighbours that are linked in a row share a number
        up: dict[int, int] = {}

        def top(n: int) -> int:
            while n in up:
                n = up[n]
            return n
        for off in range(1, min(window, len(x) - 1) + 1):
            begin = max(0, fresh - lo - off)
            near = np.flatnonzero(np.einsum("ij,ij->i", x[begin:len(x) - off], x[begin + off:]) >= threshold) + begin
            if off == 1:
                chain[1:] = 1
                chain[near + 1] = 0
                chain = np.cumsum(chain)
            else:
                near = near[chain[near] != chain[near + off]]
                joins = []
                for i, p, q in zip(near.tolist(), chain[near].tolist(), chain[near + off].tolist()):
                    p, q = top(p), top(q)
                    if p != q:
                        up[max(p, q)] = min(p, q)
                        joins.append(i)
                near = np.array(joins, np.int64)
            a.append(cid[lo + near])
            b.append(cid[lo + near + off])
    a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _swept(window: int, threshold: float) -> Callable:
    """Links within a sorted partition, and its first and last ``window`` rows for the borders."""
    names = [c.split()[0] for c in FOUND.split(", ")]

    def shaped(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(**{c: None for c in names if c not in rows})[names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, tail, place = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not len(b):
                continue
            rows = b if tail is None else pd.concat([tail, b], ignore_index=True)
            links = _linked(rows, window, len(rows) - len(b), threshold)
            if len(links):
                yield shaped(links)
            if place < window:
                head = b.head(window - place)
                yield shaped(head.assign(part=part, last=False, place=np.arange(place, place + len(head))))
            place, tail = place + len(b), rows.tail(window)
        if tail is not None:
            yield shaped(tail.assign(part=part, last=True, place=np.arange(len(tail))))
    return run


def sorted_pass(packed: DataFrame, threshold: float, window: int, seed: int, turn: int) -> DataFrame:
    """Links ``a, b`` (a < b) that one pass finds, stored."""
    keyed = packed.select("label", "dim", "cid", "vec").mapInPandas(_keyed(seed, turn), ORDERED)
    order = ["label", "dim", "key", "cid"]
    found = stored(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_swept(window, threshold), FOUND), "sorted-pass")
    edge = found.filter("part IS NOT NULL")
    parts = sorted(r[0] for r in edge.select("part").distinct().collect())  # one number a partition
    borders = [(p, True, p) for p in parts[:-1]] + [(q, False, p) for p, q in zip(parts, parts[1:])]
    if not borders:
        return found.filter("a IS NOT NULL").select("a", "b")
    at = packed.sparkSession.createDataFrame(borders, "part int, last boolean, border int")  # two rows a partition

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["last", "place"], ascending=[False, True], ignore_index=True)
        return _linked(rows, window, int(rows["last"].sum()), threshold)

    across = edge.join(F.broadcast(at), ["part", "last"]).groupBy("border").applyInPandas(meet, "a long, b long")
    return stored(found.filter("a IS NOT NULL").select("a", "b").unionByName(across), "pass-links")


def swept(packed: DataFrame, threshold: float, passes: int, window: int, seed: int) -> DataFrame:
    """``node, root`` of what the links of all passes connect, stored. A pass counts as quiet if all its links
    stay within components."""
    reached, quiet = None, 0
    for turn in range(passes):
        found = sorted_pass(packed, threshold, window, seed, turn)
        if reached is not None:
            a, b = reached.select(F.col("node").alias("a"), F.col("root").alias("ra")), reached.select(F.col("node").alias("b"), F.col("root").alias("rb"))
            named = found.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
            found = stored(named.filter("a <> b").distinct(), "new-links")
            if not found.head(1):
                quiet += 1
                if quiet >= QUIET:
                    break
                continue
            found = found.unionByName(reached.select(F.col("node").alias("a"), F.col("root").alias("b")))
        quiet = 0
        reached = stored(components(found), "reached")
    return reached


def near_vectors(vectors: DataFrame, threshold: float = 0.98, passes: int = 24, window: int = 24, seed: int = 7) -> DataFrame:
    """One row per vector: ``vec_id, n_links`` (other vectors linked directly),
    ``component_id`` (smallest vec_id reachable by links) and ``kept``."""
    classes = stored(usable(vectors).groupBy("label", "vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
                     .withColumn("cid", F.monotonically_increasing_id()), "classes")
    packed = stored(classes.select("label", F.size("vec").alias("dim"), "cid", "n", "vec", "least")
                    .mapInPandas(_packed, "label string, dim int, cid long, n long, vec binary, least long"), "packed")
    reached = swept(packed, threshold, passes, window, seed)
    placed = stored(packed.join(reached, packed.cid == reached.node, "left")
                    .select("label", "dim", "cid", "n", "vec", F.coalesce("root", "cid").alias("root"), F.col("root").isNotNull().alias("met")), "placed")
    inside = placed.filter("met").withColumn("label", F.col("root").cast("string"))
    # the links inside the components of the passes, then those between them
    found = stored(compared(inside, threshold).unionByName(compared(placed, threshold, apart=True)), "compared")
    roots = stored(components(found.filter("a IS NOT NULL").select("a", "b")), "roots")
    counts = found.filter("cid IS NOT NULL").groupBy("cid").agg(F.sum("links").alias("links"))
    # both sides of the joins by root are stored: plain exchanges, over which a component of any size can be split
    rooted = stored(classes.join(roots, classes.cid == roots.node, "left").join(counts, "cid", "left")
                    .select("label", "vec", "n", "least", F.coalesce("root", "cid").alias("root"), "links"), "rooted")
    least = stored(rooted.groupBy("root").agg(F.min("least").alias("first")), "least")
    known = stored(rooted.join(least, "root").select("label", "vec", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("_links"),
                                                     F.col("first").alias("_first")), "known")
    links = usable(vectors).join(known, ["label", "vec"]).select("vec_id", "_links", "_first")
    alone = vectors.filter(~_can_link()).select("vec_id", F.lit(0).cast("long").alias("_links"), F.col("vec_id").alias("_first"))
    return links.unionByName(alone).select("vec_id", F.col("_links").cast("long").alias("n_links"), F.col("_first").alias("component_id"),
                                           F.coalesce(F.col("vec_id") == F.col("_first"), F.lit(False)).alias("kept"))
