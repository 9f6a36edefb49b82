"""Small documents with every odd case, and brute-force forms of the operators."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import xxhash
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

LINE = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
PASSAGE = "\n".join(f"{LINE} {i}" for i in range(4))

#: null texts and ids, empty, blank and very long texts, ties, repeated rows, one id with two texts
ODD = [
    (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t ", None, "a", 4), (4, PASSAGE, "en", "a", 200),
    (5, PASSAGE, "en", "a", 200), (5, PASSAGE, "en", "a", 200), (6, "one\n" + PASSAGE + "\ntwo", "en", None, 210),
    (None, PASSAGE + "\nthree", "en", "b", 220), (None, None, None, None, None), (7, "x" * 200_000, "de", "b", 200_000),
    (8, "same\nsame\nsame\nsame\nsame", "en", "c", 24), (9, "ÄÖ Über ÉCOLE garçon", "fr", "c", 20),
    (10, "first text of ten", "en", "c", 17), (10, "second text of ten, which is another", "en", "c", 36),
    (11, " ".join(f"w{i % 977}" for i in range(60_000)), "en", "d", 300_000), (12, "\x00\x0b ctrl \x1f", "en", "d", 9),
]


def docs(spark, rows=ODD, extra=False):
    df = spark.createDataFrame([tuple(r) for r in rows], DOCS)
    return df.selectExpr("*", "'x' AS copy", "1 AS size", "'y' AS label", "0.5D AS score") if extra else df


def tables(spark, tmp_path, **frames):
    """A folder in the layout of the test tables."""
    for name, df in frames.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def components(nodes, links):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n
    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = [int(c) for c in m[0] if c in "0123456789"]
            luhn = sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0
            fine = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                    "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]
            if fine:
                out.append((m.start(), k, m.end()))
    return [(list(BASE)[k], a, b) for a, k, b in sorted(out)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def vector_links(vectors, threshold):
    """vectors: (vec_id, label, list). Pairs of row numbers that link."""
    ok = [(i, l, np.array(v, float)) for i, (_, l, v) in enumerate(vectors)
          if l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)]
    return [(i, j) for a, (i, l, v) in enumerate(ok) for j, m, w in ok[a + 1:]
            if l == m and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= threshold]
