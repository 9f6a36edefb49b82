"""Chat formatting by token-level assembly.

Role and text of a turn are escaped and encoded separately as ordinary text, then
spliced with reserved ids that no text can produce:

    <|im_start|> role <|im_sep|> text <|im_end|>

Segment boundaries give +1 and -1 marks, and their prefix sums are the loss mask:
1 on the text of the trained role, 0 elsewhere. Control strings in a role or text
get a backslash after their ``<`` (``<|`` becomes ``<\\|``, ``<\\|`` becomes
``<\\\\|``, and so on), so that the formatted string can be cut apart again as well.

Turns are range-partitioned by conversation and turn, so that a conversation of
any length spreads over tasks; a task assembles bounded pieces of it.

Defined cases: a null role or text is empty; a null conv_id is one conversation;
a null turn comes first; turns that tie are ordered by role and text; repeated rows
are repeated turns; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
PIECE_CHARS = 1 << 20   # a piece is closed once it holds this much text
DIRECT_CHARS = 1 << 17  # texts up to this length are encoded in one call


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


@lru_cache(maxsize=4)
def tokenizer(path: str, pattern: str) -> tuple[tiktoken.Encoding, dict[str, int]]:
    """The encoding of a rank file, and the reserved ids after its last rank."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    first = max(ranks.values()) + 1
    return (tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}),
            {START: first, SEP: first + 1, END: first + 2})


@lru_cache(maxsize=4)
def _splitter(pattern: str) -> regex.Pattern:
    """The tokenizer's pattern with white space as Unicode defines it, as its own engine has it."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def encode(enc: tiktoken.Encoding, text: str) -> list[int]:
    """The tokenizer's encoding of a text. Very long ones, on whose runs its engine may overflow, go
    in groups of whole matches of its pattern, between which nothing is merged anyway."""
    if len(text) <= DIRECT_CHARS:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    start = end = 0
    for m in _splitter(enc._pat_str).finditer(text):
        if m.end() - start > DIRECT_CHARS and end > start:
            ids += enc.encode_ordinary(text[start:end])
            start = end
        end = m.end()
        if end - start > DIRECT_CHARS:  # one match
            ids += enc._encode_single_piece(text[start:end])
            start = end
    return ids + enc.encode_ordinary(text[start:])


def assemble(turns: list[tuple[str, str]], path: str, pattern: str, trained: str) -> tuple[list[int], list[int], str]:
    """(ids, loss mask, formatted string) of consecutive turns."""
    enc, reserved = tokenizer(path, pattern)
    ids: list[int] = []
    opens, closes, out = [], [], []
    for role, text in turns:
        r, t = escape(role), escape(text)
        ids.append(reserved[START])
        ids += encode(enc, r)
        ids.append(reserved[SEP])
        if role == trained:
            opens.append(len(ids))
        ids += encode(enc, t)
        if role == trained:
            closes.append(len(ids))
        ids.append(reserved[END])
        out += (START, r, SEP, t, END)
    marks = np.zeros(len(ids) + 1, np.int32)
    np.add.at(marks, opens, 1)
    np.subtract.at(marks, closes, 1)
    return ids, np.cumsum(marks)[:-1].tolist(), "".join(out)


def read_back(ids: np.ndarray, mask: np.ndarray, path: str, pattern: str) -> tuple[list[tuple[str, str]], list[str]]:
    """(turns, texts under the mask) from ids alone, unescaped."""
    enc, reserved = tokenizer(path, pattern)
    starts, seps, ends = (np.flatnonzero(ids == reserved[k]).tolist() for k in (START, SEP, END))

    def text(a: int, b: int) -> str:
        return unescape(enc.decode_bytes(ids[a:b].tolist()).decode())

    turns = [(text(a + 1, b), text(b + 1, c)) for a, b, c in zip(starts, seps, ends, strict=True)]
    edge = np.flatnonzero(np.diff(mask, prepend=0, append=0))
    return turns, [text(a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]


PIECES = "conv_id long, piece long, n_turns long, ids array<int>, loss_mask array<int>, text string"


def format_chats(turns: DataFrame, path: str, pattern: str, trained: str = "assistant") -> DataFrame:
    """Pieces of formatted conversations: ``conv_id, piece, n_turns, ids,
    loss_mask, text``. A conversation is its pieces in ascending order."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[str, str]] = []
        key, at, size = None, 0, 0

        def piece() -> pd.DataFrame:
            ids, mask, text = assemble(held, path, pattern, trained)
            return pd.DataFrame({"conv_id": pd.array([key], "Int64"), "piece": [at], "n_turns": [len(held)],
                                 "ids": [ids], "loss_mask": [mask], "text": [text]})

        for b in batches:
            done = []
            for conv, place, role, text in zip(b["conv_id"], b["_at"], b["role"], b["text"]):
                conv = None if pd.isna(conv) else int(conv)
                if held and (conv != key or size >= PIECE_CHARS):
                    done.append(piece())
                    held, size = [], 0
                if not held:
                    key, at = conv, place
                held.append((role, text))
                size += len(role) + len(text)
            if done:
                yield pd.concat(done)
        if held:
            yield piece()

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        text_of("role").alias("role"), text_of().alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    placed = (rows.repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn("_at", F.monotonically_increasing_id()))
    return placed.select("conv_id", "_at", "role", "text").mapInPandas(run, PIECES)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"


def digests(pieces: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per conversation with digests of what its pieces read back as.
    Pieces are decoded where they are; a conversation's hash state then runs over
    its decoded pieces in order, one batch in memory at a time."""
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for ids, mask in zip(b["ids"], b["loss_mask"]):
                turns, loss = read_back(np.asarray(ids, np.int32), np.asarray(mask, np.int32), path, pattern)
                said, learnt = "".join(f"{r}\n{t}\n" for r, t in turns), "".join(loss)
                rows.append((len(turns), said.encode(), learnt.encode(), len(learnt), len(ids), int(np.sum(mask))))
            n, said, learnt, chars, tokens, under = zip(*rows) if rows else ((),) * 6
            yield pd.DataFrame({"conv_id": b["conv_id"].astype("Int64").reset_index(drop=True), "piece": b["piece"].reset_index(drop=True),
                                "n": n, "said": said, "learnt": learnt, "chars": chars,
                                "formatted": [len(t) for t in b["text"]], "tokens": tokens, "under": under})

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None

        def row() -> tuple:
            n, said, chars, learnt, formatted, tokens, under = state
            return key, n, said.hexdigest(), chars, learnt.hexdigest(), formatted, tokens, under

        def frame(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in DIGEST.split(", ")])
            return out.assign(conv_id=out["conv_id"].astype("Int64"))

        for b in batches:
            done = []
            for conv, n, said, learnt, chars, formatted, tokens, under in zip(
                    b["conv_id"], b["n"], b["said"], b["learnt"], b["chars"], b["formatted"], b["tokens"], b["under"]):
                conv = None if pd.isna(conv) else int(conv)
                if state is None or conv != key:
                    if state is not None:
                        done.append(row())
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                state[1].update(said)
                state[3].update(learnt)
                for i, x in ((0, n), (2, chars), (4, formatted), (5, tokens), (6, under)):
                    state[i] += int(x)
            if done:
                yield frame(done)
        if state is not None:
            yield frame([row()])

    decoded = pieces.mapInPandas(decode, "conv_id long, piece long, n long, said binary, learnt binary, chars long, formatted long, tokens long, under long")
    ordered = decoded.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return ordered.mapInPandas(digest, DIGEST)
