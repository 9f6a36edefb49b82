"""Language identification by compression.

Each language has a zstandard dictionary of raw content: pieces of texts that are
labelled with it. A text is compressed once with every dictionary, both reduced to
their letters in lower case (so that symbols and markup tell nothing), and the
language whose dictionary makes it smallest is predicted; ``score`` is the share that the
best saves against the second best, and margins below ``REJECT`` are rejected.

The dictionaries are a bounded sample, ``PIECES`` pieces of ``PIECE`` characters
per language (from texts of least id hash, one per slot); predictions read whole
texts and nothing but the text.

Defined cases: a null text or one without a letter is ``und`` with score 0 and
rejected; with no labelled text everything is; with one language its score is 0
and nothing is rejected; ties go to the language that sorts first; labelled rows
without an id do not train; more than ``LANGUAGES`` labels raise ValueError; an empty table gives an empty result; extra columns pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carrying

PIECES, PIECE = 128, 3000
OVERSAMPLE = 8     # texts per slot that are looked at, on average
REJECT = 0.01
LEVEL = 3
LANGUAGES = 200    # learned at most: each costs PIECES * PIECE characters and one compression of every text


def letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")


def dictionaries(docs: DataFrame, training: Column) -> dict[str, bytes]:
    """Raw content per language, at most ``PIECES * PIECE`` characters each."""
    rows = docs.filter(training & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    h = F.xxhash64(F.lit("piece"), "doc_id")
    counts = rows.groupBy("lang").agg(F.count("*").alias("_of"))
    if counts.limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages to learn: clean the labels first")
    # a slot keeps the least hash; texts of hashes that are surely not the least are left out before the aggregate
    near = F.pmod(h, F.lit(1 << 30)) < F.greatest(F.lit(PIECES * OVERSAMPLE * float(1 << 30)) / F.col("_of"), F.lit(0.0))
    start = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - PIECE + 1, F.lit(1))) + 1
    pieces = (rows.join(F.broadcast(counts), "lang").filter(near)
              .groupBy("lang", F.pmod(F.xxhash64(F.lit("slot"), "doc_id"), F.lit(PIECES)).alias("slot"))
              .agg(F.min(F.struct(h.alias("h"), letters(F.substring(F.col("text"), start.cast("int"), F.lit(PIECE))).alias("piece")))["piece"].alias("piece")))
    out: dict[str, list[str]] = {}
    for lang, _, piece in sorted(map(tuple, pieces.collect())):  # bounded: PIECES rows a language
        out.setdefault(lang, []).append(piece)
    return {lang: " ".join(p).encode() for lang, p in sorted(out.items())}


@carrying("doc_id", "text")
def identified(docs: DataFrame, contents: dict[str, bytes]) -> DataFrame:
    """``docs`` with ``lang_pred, score, rejected``."""
    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def identify(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        by_lang = []
        for lang, content in contents.items():
            kept = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            kept.precompute_compress(level=LEVEL)
            by_lang.append((lang, zstandard.ZstdCompressor(dict_data=kept, write_content_size=False, write_dict_id=False)))

        def one(text: bytes | None) -> tuple[str, float, bool]:
            if text is None or not by_lang:
                return "und", 0.0, True
            sizes = sorted((len(c.compress(text)), i) for i, (_, c) in enumerate(by_lang))
            margin = 1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 0.0
            return by_lang[sizes[0][1]][0], margin, len(sizes) > 1 and margin < REJECT

        for s in texts:
            yield pd.DataFrame([one(t) for t in s], columns=["lang_pred", "score", "rejected"])

    lettered = F.when(F.col("text").rlike(r"\p{L}"), letters(F.col("text")).cast("binary"))
    found = F.col("_found")
    return (docs.withColumn("_found", identify(lettered))
            .withColumns({c: found[c] for c in ("lang_pred", "score", "rejected")}).drop("_found"))
