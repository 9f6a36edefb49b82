"""Whitening, vector codes and winnowing against brute force, and their odd cases."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from fixtures import ODD, docs, sha, tables
from pyspark.sql import types as T

from sparkstats.llm import queries, vector_codes, whiten, winnow
from sparkstats.llm.common import read

SMALL = "/root/testdata/sf0.01"
VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                        T.StructField("label", T.IntegerType()), T.StructField("x", T.StringType()), T.StructField("code", T.IntegerType())])
NAN, INF = float("nan"), float("inf")


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, l, "extra", 1) for i, v, l in rows], VECTORS)


def odd_vectors(dim=32, n=150, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=dim) * (1 + (np.arange(dim) < 5) * np.arange(dim))], i % 3 or None) for i in range(n)]
    rows += [(7, rows[7][1], 1), (7, rows[7][1], 1), (None, rows[8][1], None), (500, rows[9][1], 2), (501, [0.0] * dim, 1)]
    return rows + [(600, None, 1), (601, [], 1), (602, [NAN] + [1.0] * (dim - 1), 1), (603, [INF] + [1.0] * (dim - 1), None),
                   (604, [None] + [1.0] * (dim - 1), 1)]


def kept(rows):
    return [(i, np.floor(256 * np.array(v, float)).astype(np.int64), l) for i, v, l in rows
            if v and all(c is not None and np.isfinite(c) for c in v)]


# --- whitening ------------------------------------------------------------------

def check_whitened(out, rows, wanted=4):
    """out: collected rows; rows: (vec_id, integer vector, label)."""
    fit = np.unique(np.array([x for _, x, _ in rows]), axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:wanted], axes[:, ::-1][:, :wanted]
    assert len(out) == len(rows) * len(values)
    found = {}
    for r in out:
        found.setdefault((r.component, r.vec_id, r.deviation), []).append(r)
    for c in range(len(values)):
        sign = 0.0
        for i, x, _ in rows:
            far = int(((n * x - sums) ** 2).sum())
            r = found[c + 1, i, far].pop()
            assert r.n == n and r.explained == pytest.approx(values[c] / (centred ** 2).sum() * n, rel=1e-9)
            assert r.identity_error < 1e-9
            want = (x - sums / n) @ axes[:, c] / np.sqrt(values[c])
            sign = sign or (np.sign(want * r.whitened) if abs(want) > 1e-3 else 0.0)
            assert abs(r.whitened * (sign or 1.0) - want) < 1e-7


def test_whitening_query(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in read(spark, SMALL, "embeddings").collect()]
    out = queries.QUERIES["op11_whitening"](spark, SMALL)
    assert out.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    found = out.collect()
    check_whitened(found, kept(rows))
    assert max(r.residual for r in found) < 1e-14


def test_whitening_odd(spark):
    rows = odd_vectors()
    for parts in (1, 5):
        check_whitened(whiten.whitened(vectors(spark, rows).repartition(parts)).collect(), kept(rows))
    assert whiten.whitened(vectors(spark, []), 4).count() == 0
    assert whiten.whitened(vectors(spark, [(1, None, 1), (2, [], 1)])).count() == 0
    assert whiten.whitened(vectors(spark, [(1, [1.0, 2.0], 1)] * 3)).count() == 0  # one distinct vector: no variance
    few = [(1, [1.0, 2.0, 3.0], 1), (2, [2.0, 2.0, 1.0], 1), (3, [0.0, 2.5, 1.0], 1)]
    out = whiten.whitened(vectors(spark, few)).collect()
    assert len(out) == 6 and max(r.identity_error for r in out) < 1e-9  # rank two
    with pytest.raises(Exception, match="several lengths|components"):
        whiten.whitened(vectors(spark, [(1, [1.0, 2.0], 1), (2, [1.0], 1)])).count()
    with pytest.raises(Exception, match="beyond"):
        whiten.whitened(vectors(spark, [(1, [1e30, 2.0], 1), (2, [1.0, 1.0], 1)])).count()


def test_large_integers_stay_exact(spark):
    rows = [(i, [float(np.float32(2.0 ** 20 + 97 * i * i)), float(i)], 1) for i in range(40)]
    check_whitened(whiten.whitened(vectors(spark, rows), 2).collect(), kept(rows), 2)


@pytest.mark.parametrize("spectrum", [np.ones(20), np.r_[np.ones(6) * 5, np.ones(30)], 10.0 ** -np.arange(40), np.r_[1, 1 - 1e-9, np.zeros(30)]])
def test_solver(spectrum):
    """Repeated, clustered, graded and deficient spectra."""
    dim = len(spectrum)
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((dim, dim)))[0]
    matrix = q * spectrum @ q.T
    values, axes, residuals = whiten.leading(lambda b: matrix @ b, dim, 4)
    assert np.allclose(values, np.sort(spectrum)[::-1][:4], rtol=0, atol=1e-13 * spectrum.max())
    assert np.allclose(axes.T @ axes, np.eye(4), atol=1e-12)
    assert residuals.max() < 1e-13


# --- vector codes ---------------------------------------------------------------

def brute_codes(rows, parts=16, entries=64, rounds=2):
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0, rows[r][1].tolist()))
    x = np.array([v for _, v, _ in rows]).reshape(len(rows), parts, -1)
    book = x[order[:entries]].transpose(1, 0, 2).copy()

    def near():
        d = np.square(x.transpose(1, 0, 2)[:, :, None, :] - book[:, None]).sum(3)
        return d.argmin(2), d.min(2)
    for _ in range(rounds):
        codes, _ = near()
        for p in range(parts):
            for j in set(codes[p].tolist()):
                mine = x[codes[p] == j, p]
                book[p, j] = mine.sum(0) // len(mine)
    codes, d = near()
    error, total = d.sum(0), {}
    for (_, _, l), e in zip(rows, error):
        total[l] = total.get(l, 0) + int(e)
    digest = hashlib.sha256(",".join(map(str, book.ravel())).encode()).hexdigest()
    return sorted((str(i), "".join(f"{c:02x}" for c in codes[:, r]), int(error[r]), total[l], digest) for r, (i, _, l) in enumerate(rows))


def spelled(df):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


def test_vector_codes_odd(spark):
    rows = odd_vectors()
    for parts in (1, 6):
        assert spelled(vector_codes.encoded(vectors(spark, rows).repartition(parts))) == brute_codes(kept(rows))
    assert spelled(vector_codes.encoded(vectors(spark, rows), 4, 10, 6)) == brute_codes(kept(rows), 4, 10, 6)
    assert spelled(vector_codes.encoded(vectors(spark, rows[:3]), 8, 64, 2)) == brute_codes(kept(rows[:3]), 8, 64, 2)
    ties = [(i, [float(i % 2)] * 16, None) for i in range(100)]
    assert spelled(vector_codes.encoded(vectors(spark, ties))) == brute_codes(kept(ties))
    assert vector_codes.encoded(vectors(spark, [])).count() == 0
    assert vector_codes.encoded(vectors(spark, rows[-5:])).count() == 0
    with pytest.raises(Exception, match="parts"):
        vector_codes.encoded(vectors(spark, [(1, [1.0] * 15, 1)])).count()


def test_bounds_save_scans(spark):
    """Later rounds scan fewer parts, and net displacement saves more than summed drifts would."""
    fit, history = vector_codes.fitted(read(spark, "/root/testdata/sf0.1", "embeddings"), 16, 64, 4)
    scans = fit.agg({"scans": "sum"}).first()[0]
    rows = fit.agg({"n": "sum"}).first()[0]
    assert scans < 0.9 * 16 * rows
    net = vector_codes.net_moves(history)
    steps = [np.sqrt(np.square((b - a).astype(float)).sum(2)) for a, b in zip(history, history[1:])]
    assert (net[0] <= sum(steps) + 1e-9).all() and (net[0] < sum(steps) - 1e-9).any()


# --- winnowing ------------------------------------------------------------------

def brute_print(text, k=winnow.GRAM, window=winnow.WINDOW):
    k = min(k, len(text))
    h = []
    for i in range(len(text) - k + 1 if text else 0):
        v = sum((ord(c) + 1) * pow(winnow.BASE, j, 1 << 64) for j, c in enumerate(text[i:i + k])) % (1 << 64)
        v = (v ^ (v >> 31)) * 0xBF58476D1CE4E5B9 % (1 << 64)
        h.append(v ^ (v >> 29))
    found = {}
    for a in range(max(1, len(h) - window + 1) if h else 0):
        at = min(range(a, min(a + window, len(h))), key=lambda i: (h[i], -i))
        found[at] = h[at]
    return found


def brute_rows(rows):
    """rows: (doc_id, text); what edited_prints returns."""
    key = {r: (r[0] is not None, r[0] or 0, winnow_hash(r)) for r in set(rows)}
    order = sorted(key, key=key.get)
    out = []
    for r in rows:
        text, following = r[1] or "", order[(order.index(r) + 1) % len(order)][1] or ""
        m = len(text) // 4
        changed = text[:len(text) - m] + following[:m]
        prints = [brute_print(t) for t in (text, changed, following)]
        likeness = [1.0 if not prints[0] and not p else len({*prints[0].values()} & {*p.values()}) / len({*prints[0].values()} | {*p.values()})
                    for p in prints[1:]]
        written = [",".join(f"{h:016x}:{p}" for p, h in sorted(q.items())) for q in prints[:2]]
        out.append((str(r[0]), len(text), sha(changed), *written, *likeness))
    return sorted(out)


HASHES = {}


def winnow_hash(row):
    return HASHES[row]


def learn_hashes(frame):
    for r in frame.selectExpr("doc_id", "text", "xxhash64(coalesce(text, ''), doc_id IS NULL) AS h").collect():
        HASHES[r.doc_id, r.text] = r.h


def as_rows(df):
    return sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in df.collect())


SHORT = [r for r in ODD if r[0] not in (7, 11)] + [(20 + i, " ".join(random.Random(i).choices("sun moon star sky sea".split(), k=30 * i)), "en", "a", 1) for i in range(6)]


def test_winnowing_odd(spark):
    frame = docs(spark, SHORT)
    learn_hashes(frame)
    want = brute_rows([(r[0], r[1]) for r in SHORT])
    for parts in (1, 3, 8):
        assert as_rows(winnow.edited_prints(docs(spark, SHORT, extra=True).repartition(parts))) == want
    for n in (1, 2):
        few = docs(spark, SHORT[:n])
        assert as_rows(winnow.edited_prints(few)) == brute_rows([(r[0], r[1]) for r in SHORT[:n]])
    assert winnow.edited_prints(docs(spark, [])).count() == 0


def test_hot_document(spark):
    """One row repeated through a third of the table fills several ranges."""
    rows = [(i, f"text of document {i} " * 4, "en", "a", 1) for i in range(60)] + [(30, "the hot one " * 9, "en", "a", 1)] * 40
    frame = docs(spark, rows).repartition(7)
    learn_hashes(frame)
    assert as_rows(winnow.edited_prints(frame)) == brute_rows([(r[0], r[1]) for r in rows])


def test_winnowing_query_and_long_texts(spark, tmp_path):
    long = "".join(random.Random(1).choices("abc deä\U0001F600", k=1_300_000))
    places, hashes = winnow.winnowed(long)
    whole = winnow.gram_hashes(long, winnow.GRAM)
    assert (whole[places] == hashes).all() and np.diff(places).max() <= winnow.WINDOW and (np.diff(places) > 0).all()
    piece = winnow.PIECE
    winnow.PIECE = 1000
    try:
        again = winnow.winnowed(long[:50_000])
    finally:
        winnow.PIECE = piece
    assert all((a == b).all() for a, b in zip(again, winnow.winnowed(long[:50_000])))
    out = queries.QUERIES["op12_winnowing"](spark, SMALL)
    assert out.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    texts = {r.doc_id: r.text for r in read(spark, SMALL, "documents").collect()}
    ids = sorted(texts)
    after = dict(zip(ids, ids[1:] + ids[:1]))
    for r in out.collect():
        text, following = texts[r.doc_id], texts[after[r.doc_id]]
        assert r.n_chars == len(text)
        changed = winnow.edited(text, following)
        assert r.edited_sha256 == sha(changed)
        assert r.fingerprint == winnow.spelled(*winnow.winnowed(text))
        if len(text) < 3000:
            assert {int(p.split(":")[1]): int(p.split(":")[0], 16) for p in r.edited_fingerprint.split(",")} == brute_print(changed)


def test_match_guarantee():
    """A shared passage of WINDOW + GRAM - 1 code points shares a hash inside it."""
    rng = random.Random(4)
    for _ in range(50):
        shared, a, b = ("".join(rng.choices("abcdefgh ", k=n)) for n in (winnow.WINDOW + winnow.GRAM - 1, 200, 300))
        one, other = (dict(zip(*reversed([x.tolist() for x in winnow.winnowed(t + shared + t[::-1])]))) for t in (a, b))
        assert any(200 <= one[h] <= 200 + winnow.WINDOW and 300 <= other[h] <= 300 + winnow.WINDOW for h in one.keys() & other.keys())


def test_fingerprints_table(spark):
    out = winnow.fingerprints(docs(spark, SHORT)).collect()
    assert len(out) == sum(len(brute_print(r[1] or "")) for r in SHORT)


def test_registered_on_a_folder(spark, tmp_path):
    d = tables(spark, tmp_path, embeddings=vectors(spark, odd_vectors()).drop("code", "x"))
    assert queries.QUERIES["op13_vector_codes"](spark, d).count() == len(kept(odd_vectors()))
    assert queries.QUERIES["op11_whitening"](spark, d).count() == 4 * len(kept(odd_vectors()))
