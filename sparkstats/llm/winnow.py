"""Document fingerprints by winnowing.

Every run of ``k`` code points has a rolling hash (a polynomial modulo 2^64 from prefix
sums, then mixed); of each ``window`` consecutive hashes the least is selected, the
rightmost of equal ones, and selected hashes are kept with their positions. So two
texts that share a passage of ``window + k - 1`` code points share a selected hash,
whose positions lie in that passage, and nothing shorter than ``k`` matches. The
likeness of two fingerprints is the share of their hashes (as sets) that both have.

``edited_prints`` also needs the next document's text. Rows are dealt into ranges of (id,
text hash) whose bounds come from a sample of keys (it only decides how even the ranges
are), each range is one sorted task, and the first row after a range is sent to it as
well: whole texts are shuffled once and nothing else is.

Defined cases: a null text is empty; an empty text has an empty fingerprint, and two
empty fingerprints are alike (1); a text shorter than ``k`` is one run; a text of fewer
runs than a window is one window; a null id comes before all others; texts of one id follow
each other by hash; repeated rows (same id and text) are one document in this order, and
each gets its row; the only document is its own next one; an empty table gives an
empty result; extra columns are ignored. Texts are read in pieces of bounded length.
"""

from __future__ import annotations

import bisect
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import identity, stored, text_of

GRAM, WINDOW = 16, 48
PIECE = 1 << 19          # code points hashed at a time
BASE = 0x9E3779B97F4A7C15
SAMPLED = 64             # keys for each range in the sample behind the bounds
FLUSH_ROWS, FLUSH_CHARS = 256, 1 << 21


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


UP, DOWN = _powers(BASE, 1 << 12), _powers(pow(BASE, -1, 1 << 64), 1 << 12)


def _scales(n: int) -> tuple[np.ndarray, np.ndarray]:
    global UP, DOWN
    if len(UP) < n:
        UP, DOWN = _powers(BASE, 2 * n), _powers(pow(BASE, -1, 1 << 64), 2 * n)
    return UP[:n], DOWN[:n]


def gram_hashes(text: str, k: int) -> np.ndarray:
    """Hash of every run of ``k`` code points (of the whole text, if it is shorter)."""
    if not text:
        return np.zeros(0, np.uint64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    k = min(k, len(codes))
    up, down = _scales(len(codes))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * up, dtype=np.uint64)])
    h = (sums[k:] - sums[:-k]) * down[:len(codes) - k + 1]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)  # the low bits of the polynomial are poor
    return h ^ (h >> np.uint64(29))


def _least(h: np.ndarray, window: int) -> np.ndarray:
    """For each window the place of its least hash, the rightmost of equal ones."""
    at, span = np.arange(len(h)), 1
    while 2 * span <= window:
        left, right = at[:-span], at[span:]
        at = np.where(h[right] <= h[left], right, left)
        span *= 2
    if span < window:
        left, right = at[:len(h) - window + 1], at[window - span:]
        at = np.where(h[right] <= h[left], right, left)
    return at


def winnowed(text: str, k: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes that winnowing selects from a text."""
    places, hashes, last = [], [], -1
    for start in range(0, max(1, len(text) - k - window + 2), PIECE):
        h = gram_hashes(text[start:start + PIECE + window + k - 2], k)
        if not len(h):
            break
        at = _least(h, min(window, len(h)))
        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
        at = at[at + start > last]
        if len(at):
            places.append(at + start)
            hashes.append(h[at])
            last = int(at[-1]) + start
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(places), np.concatenate(hashes)


def spelled(places: np.ndarray, hashes: np.ndarray) -> str:
    """``hash:position`` pairs, comma-joined; the hash in 16 hex digits."""
    return ",".join([f"{h:016x}:{p}" for h, p in zip(hashes.tolist(), places.tolist())])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    x, y = set(a.tolist()), set(b.tolist())
    return len(x & y) / len(x | y) if x or y else 1.0


def edited(text: str, following: str) -> str:
    """The last quarter of ``text`` replaced by as many code points of the start of ``following``."""
    m = len(text) // 4
    return text[:len(text) - m] + following[:m]


def fingerprints(docs: DataFrame, k: int = GRAM, window: int = WINDOW) -> DataFrame:
    """A row for each selected hash: ``doc_id, position, hash``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, body in zip(b.column("doc_id"), b.column("body")):
                places, hashes = winnowed(body.as_py(), k, window)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc.as_py()] * len(places), pa.int64()), "position": pa.array(places),
                                                  "hash": pa.array(hashes.view(np.int64))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("body"))
    return rows.mapInArrow(run, "doc_id long, position long, hash long")


# --- the next document ----------------------------------------------------------

Key = tuple[int, int]


def _bounds(keys: DataFrame, ranges: int) -> list[Key]:
    """Upper bounds (inclusive) of all ranges but the last, in order; a key that fills
    several ranges is repeated."""
    total = keys.count()
    share = min(1.0, SAMPLED * ranges / max(total, 1))
    seen = sorted((r["_id"], r["_th"]) for r in (keys.sample(fraction=share, seed=5) if share < 1 else keys).collect())
    return [seen[i * len(seen) // ranges] for i in range(1, ranges)] if seen else []


def _successors(keys: DataFrame, bounds: list[Key]) -> dict[Key, list[tuple[int, bool]]]:
    """For each key the ranges to which it must be sent as well: those whose bound it
    follows (true: as the first key after the last one), and those that share it as their bound."""
    @F.pandas_udf("int")
    def place(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_left(bounds, key) for key in zip(ids.tolist(), hashes.tolist())])

    rows = keys.groupBy(place("_id", "_th").alias("at")).agg(F.min(F.struct("_id", "_th")).alias("least")).collect()
    least = {r["at"]: (r["least"]["_id"], r["least"]["_th"]) for r in rows}
    filled, times = sorted(least), Counter(bounds)
    sent: dict[Key, list[tuple[int, bool]]] = {}
    for j, bound in enumerate([*bounds, None]):
        after = bisect.bisect_left(filled, len(bounds) + 1 if bound is None else bisect.bisect_right(bounds, bound))
        sent.setdefault(least[filled[after % len(filled)]], []).append((j, after == len(filled)))
        if times[bound] > 1:
            sent.setdefault(bound, []).append((j, False))
    return sent


def _dealt(docs: DataFrame, bounds: list[Key], sent: dict[Key, list[tuple[int, bool]]]) -> DataFrame:
    """Rows sorted in their range (``to``), and copies (``edge``) of those that another range
    needs; the first document follows the last one (``wrap``)."""
    @F.pandas_udf("array<struct<to:int,edge:boolean,wrap:boolean>>")
    def deal(series: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        copies: dict[Key, int] = {}
        out_of: set[Key] = set()  # keys whose copies this task has sent: one of each is enough
        for ids, hashes in series:
            rows = []
            for key in zip(ids.tolist(), hashes.tolist()):
                to = bisect.bisect_left(bounds, key)
                same = bisect.bisect_right(bounds, key) - to
                if same > 1:  # it fills several ranges
                    copies[key] = copies.get(key, -1) + 1
                    to += copies[key] % same
                row = [{"to": to, "edge": False, "wrap": False}]
                if key in sent and key not in out_of:
                    out_of.add(key)
                    row += [{"to": j, "edge": True, "wrap": wrap} for j, wrap in sent[key]]
                rows.append(row)
            yield pd.Series(rows)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *identity(), text_of().alias("body"))
    each = rows.withColumn("_at", F.explode(deal("_id", "_th"))).select("*", "_at.*").drop("_at")
    return (each.repartitionById(len(bounds) + 1, F.col("to"))
            .sortWithinPartitions("to", "wrap", "_id", "_th", "edge"))


COLUMNS = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


def edited_prints(docs: DataFrame, k: int = GRAM, window: int = WINDOW) -> DataFrame:
    """A row for each document: its size, the digest of its edited text, both fingerprints, and
    the likeness of its fingerprint to the edited text's and to the next document's."""
    spark = docs.sparkSession
    keys = stored(docs.select(*identity()), "keys")
    if not keys.head(1):
        return spark.createDataFrame([], COLUMNS)
    bounds = _bounds(keys, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sent = _successors(keys, bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the document whose next one has not come: key, id, text, hashes, print, rows
        rows: list[tuple] = []
        size = 0

        def taken() -> pa.RecordBatch:
            nonlocal rows, size
            out = pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate([
                ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])})
            rows, size = [], 0
            return out

        for b in batches:
            for i in range(b.num_rows):
                key = tuple(b.column(c)[i].as_py() for c in ("to", "wrap", "_id", "_th"))
                own = not b.column("edge")[i].as_py()
                if held and held[0] == key:
                    held[-1][0] += own
                    continue
                text = b.column("body")[i].as_py()
                places, hashes = winnowed(text, k, window)
                if held and held[-1][0]:
                    _, doc, before, before_hashes, written, copies = held
                    changed = edited(before, text)
                    new_places, new_hashes = winnowed(changed, k, window)
                    row = (doc, len(before), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), written,
                           spelled(new_places, new_hashes), likeness(before_hashes, new_hashes), likeness(before_hashes, hashes))
                    for _ in range(copies[0]):
                        rows.append(row)
                        size += len(before)
                        if len(rows) >= FLUSH_ROWS or size >= FLUSH_CHARS:
                            yield taken()
                held = (key, b.column("doc_id")[i].as_py(), text, hashes, spelled(places, hashes) if own else "", [int(own)])
        if held and held[-1][0]:
            raise RuntimeError("a range lacks the document that follows it")
        if rows:
            yield taken()

    return _dealt(docs, bounds, sent).mapInArrow(run, COLUMNS)
