"""The operators on small fixtures of odd cases, against brute force."""

from __future__ import annotations

import collections
import re

import numpy as np
import pytest
from fixtures import (BASE, LINE, ODD, PASSAGE, base_spans, components, crc_held_out, docs, fingerprint, sha, tables,
                      vector_links)
from pyspark.sql import functions as F

from sparkstats.llm import chat, decontaminate, embedding_dedup, langid, line_dedup, mixing, pii, quality, queries, simhash, url_rules
from sparkstats.llm.common import read
from sparkstats.llm.components import components as spark_components

SMALL = "/root/testdata/sf0.01"


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (9, 8), (8, 3), (3, 9)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 501 + i) for i in range(50)]
    got = {r.node: r.root for r in spark_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert got == components(nodes, [e for e in edges if e[0] != e[1]])
    assert spark_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- chat

def test_escape_round_trip():
    for s in ["", "<|", "<\\|", "<<|im_end|>", "a<\\\\|b", "<|im_start|>assistant<|im_sep|>x<|im_end|>", "|<|>\\<|"]:
        assert "<|" not in chat.escape(s) and chat.unescape(chat.escape(s)) == s


def test_chat_odd_cases(spark):
    import public_tokenizers as P
    path, pattern = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    rows = [(1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "<|im_sep|>ok\nßé"), (1, 1, "assistant", "<|im_sep|>ok\nßé"), (1, 2, "assistant", ""),
            (None, None, None, None), (None, 0, "assistant", "x" * 100_000), (2, 1, "a<|im_sep|>\nb", "t"), (3, 0, "assistant", None),
            *[(4, i, "assistant" if i % 2 else "user", "word " * 3000) for i in range(150)]]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1)).repartition(5)
    pieces = chat.format_chats(turns, path, pattern)
    got = {r.conv_id: r for r in chat.digests(pieces, path, pattern).collect()}
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(by)
    for c, ts in by.items():
        ts.sort()
        loss = "".join(x for _, r, x in ts if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (
            len(ts), sha("".join(f"{r}\n{x}\n" for _, r, x in ts)), len(loss), sha(loss))
        assert got[c].formatted_chars == sum(len("<|im_start|><|im_sep|><|im_end|>" + chat.escape(r) + chat.escape(x)) for _, r, x in ts)
    enc, reserved = chat.tokenizer(path, pattern)
    for p in pieces.filter("conv_id = 1").collect():
        assert collections.Counter(i for i in p.ids if i in reserved.values()) == dict.fromkeys(reserved.values(), p.n_turns)
        assert len(p.ids) == len(p.loss_mask)
    assert pieces.filter("conv_id = 4").count() > 1
    assert chat.digests(chat.format_chats(turns.limit(0), path, pattern), path, pattern).count() == 0


# --- PII

PII_TEXTS = [
    None, "", "a@b.c@d.e x_@y-z.org. tail@nodot @x.y a@b..c", "a@b.c_d@e.f-g", "1.2.3.4.5.6.7.8 300.1.1.1 0255.00.1.010 1.2.3",
    "4111 1111 1111 1111 4111111111111112 4111-1111-1111-1111-9 0000000000000000000 12345678901234567890", "+1 (514) 555-8389 +49.30.1234567 +1 2 +123456789012345678 +(1)",
    "ß é +1 (514) 555-8389 and über a@b.de 10.0.0.1", "9" * 40_000, "a" * 60_000 + "@x.y", "1." * 20_000 + "1", "+" * 5000 + "1" * 20, "x" * 100_000,
    'token = "0641917ea4e9feb9cda83477b57ac2654884f485" password=dd605f4e45f5f1b466 call 514-555-8389 ssn 123-45-6789',
    *[f"the password=dd605f4e45f5f1b4{i:02d} mail a{i}@b.org" for i in range(30)],
]


def test_pii_base_spans(spark, tmp_path):
    rows = [(i, t, None, None, None) for i, t in enumerate(PII_TEXTS)] + [(None, "a@b.cd", None, None, None), (2, "x@y.zz", None, None, None), (2, "x@y.zz", None, None, None)]
    got = [tuple(r) for r in queries.op2_pii(spark, tables(spark, tmp_path, documents=docs(spark, rows, extra=True))).collect()]
    want = []
    for i, t, *_ in rows:
        spans = base_spans(t)
        n = collections.Counter(k for k, _, _ in spans)
        want.append((i, *[n[k] for k in BASE], sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))))
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    assert sorted((r[:6] for r in got), key=key) == sorted(want, key=key)
    for r in got:  # the base spans are among all spans
        if r[0] not in (None, 2):
            said = [s.split(":") for s in r[6].split(",") if s]
            assert [tuple([k, int(a), int(b)]) for k, a, b in said if k in BASE] == base_spans(PII_TEXTS[r[0]])
    secret = next(r[6] for r in got if r[0] == 20)
    assert "secret:13:31" in secret


def test_pii_whole_table(spark):
    got = {r.doc_id: r for r in queries.op2_pii(spark, SMALL).collect()}
    for r in read(spark, SMALL, "documents").collect():
        assert got[r.doc_id].base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(r.text)))


def test_pii_empty(spark):
    assert pii.span_report(docs(spark).limit(0)).count() == 0
    assert pii.span_report(docs(spark, [(1, "nothing here", None, None, None)])).collect()[0].spans == []


# --- mixing

def test_mixing_odd_cases(spark):
    plan = mixing.mix_plan(docs(spark, extra=False)).toPandas()
    assert len(plan) == len(ODD) and (plan.copies <= 2).all() and (plan.copies >= 0).all()
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in ODD]
    assert abs(plan.drop_duplicates("source").target.sum() - 1.5 * sum(words)) < 1e-6 * sum(words)
    assert (plan.target <= 2 * plan.source_size + 1e-9).all()
    again = mixing.mix_plan(docs(spark).repartition(7)).toPandas()
    order = ["_id", "_th", "copies"]
    assert plan.sort_values(order)[order].values.tolist() == again.sort_values(order)[order].values.tolist()
    assert mixing.mix_plan(docs(spark).limit(0)).count() == 0 and mixing.emitted(docs(spark).limit(0)).count() == 0


def test_mixing_follows_targets(spark):
    rows = [(i, "w " * (1 + i * 37 % 300), "en", "big" if i % 3 else f"s{i % 4}", 0) for i in range(1500)]
    plan = mixing.mix_plan(docs(spark, rows)).toPandas()
    taken = (plan.copies * plan["size"]).groupby(plan.source).sum()
    for s, t in plan.drop_duplicates("source").set_index("source").target.items():
        assert abs(taken[s] - t) <= max(600, 0.02 * t)
    mix = mixing.emitted(docs(spark, rows)).toPandas()
    assert len(mix) == plan.copies.sum() and set(mix.columns) == {"doc_id", "text", "lang", "source", "n_chars", "copy"}
    assert mix.groupby("doc_id").size().to_dict() == plan[plan.copies > 0].set_index("doc_id").copies.to_dict()


# --- line dedup

def brute_lines(rows):
    """rows: (doc_id, text) in order; identical rows are one document."""
    seen, out = {}, {}
    for d, t in rows:
        lines = (t or "").split("\n")
        filled = [(i, s.strip(" ")) for i, s in enumerate(lines) if s.strip(" ")]
        gone = set()
        for at in range(max(1, len(filled) - 2) if filled else 0):
            w = filled[at:at + 3]
            if seen.setdefault(tuple(s for _, s in w), (d, t, at)) != (d, t, at):
                gone |= set(range(w[0][0], w[-1][0] + 1))
        out[d, t] = (0 if t is None else len(lines), len(gone), t if not gone else "\n".join(s for i, s in enumerate(lines) if i not in gone))
    return out


def test_line_dedup_odd_cases(spark):
    got = line_dedup.dedup_lines(docs(spark, extra=True).withColumn("was", F.col("text"))).collect()
    assert len(got) == len(ODD)
    unique = {}
    for d, t, *_ in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0)):
        unique[d, t] = None
    want = brute_lines(sorted(unique, key=lambda r: (r[0] is not None, r[0] or 0)))
    for r in got:
        if r.doc_id is None or r.doc_id == 10:  # ordered by text hash
            continue
        if r.doc_id in (4, 5, 6):  # a document without an id is first
            assert LINE not in r.text
        assert (r.n_lines, r.n_removed, r.text) == want[r.doc_id, r.was], r.doc_id
    assert line_dedup.dedup_lines(docs(spark).limit(0)).count() == 0


def test_passages_of_one_line_and_inside_lines(spark):
    """Passages of over 50 words in one line, inside a line and over a line break go
    from later documents; what dedup_lines removes, goes as well."""
    rng = np.random.default_rng(23)
    vocabulary = ["".join(rng.choice(list("abcdefghiklmnoprstu"), rng.integers(2, 9))) for _ in range(3000)]
    words = lambda k: " ".join(rng.choice(vocabulary, k))
    p = [words(60) for _ in range(3)]
    own = [words(30) for _ in range(30)]
    rows = [(1, "\n".join([own[0], p[0], own[1], own[2] + " " + p[1] + " " + own[3], own[4] + " " + p[2] + " " + own[5]])),
            (2, "\n".join([own[6], p[0], own[7], own[8]])), (3, "\n".join([own[9], own[10] + " " + p[1] + " " + own[11], own[12]])),
            (4, own[13] + " " + p[2] + " " + own[14]), (5, "\n".join(own[15:19])), (6, "\n".join(["a", "b b", "c", own[19]])),
            (7, "\n".join([own[20], "a", "b b", "c"])), (8, "a\nb b")]
    rows = [(d, t, "en", "a", 0) for d, t in rows] + [(20 + r[0], *r[1:]) for r in ODD if r[0]]
    got = {r.doc_id: r.text for r in line_dedup.dedup_passages(docs(spark, rows)).collect() if r.doc_id < 20}
    assert got[1] == rows[0][1] and got[5] == rows[4][1] and got[8] == rows[7][1]
    assert got[2] == "\n".join([own[6], own[7], own[8]]) and got[7] == own[20] + "\n"
    for d, mine, there in ((3, own[9:13], p[1]), (4, own[13:15], p[2])):
        left = got[d].split()
        assert len(left) < sum(len(o.split()) for o in mine) + 30 and all(o[:20] in got[d] or o[-20:] in got[d] for o in mine)
    assert line_dedup.dedup_passages(docs(spark).limit(0)).count() == 0


# --- SimHash

def near_copies(n, base=400):
    rng = np.random.default_rng(5)
    words = [f"v{x}" for x in rng.integers(0, 900, base)]
    out = []
    for i in range(n):
        w = list(words)
        for _ in range(i % 7):
            w[rng.integers(0, base)] = f"n{rng.integers(0, 99)}"
        out.append((1000 + i, " ".join(w), "en", "h", 0))
    return out


def test_simhash_brute_force(spark):
    rows = ODD + near_copies(120) + [(r.doc_id + 5000, r.text, r.lang, r.source, r.n_chars) for r in read(spark, SMALL, "documents").limit(300).collect()]
    rows = [r for r in rows if not (r[1] or "").startswith("w0 w1")]
    got = simhash.near_duplicates(docs(spark, rows, extra=True)).collect()
    assert len(got) == len(rows)
    fps = sorted({fingerprint(r[1]) for r in rows})
    root = components(fps, [(a, b) for i, a in enumerate(fps) for b in fps[i + 1:] if (a ^ b).bit_count() <= 4])
    least = {}
    for d, t, *_ in rows:
        k = root[fingerprint(t)]
        least[k] = min(x for x in (least.get(k), d, 1 << 62) if x is not None)
    least = {k: None if v == 1 << 62 else v for k, v in least.items()}
    want = [(d, fingerprint(t), least[root[fingerprint(t)]]) for d, t, *_ in rows]
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=str) == sorted(want, key=str)
    assert simhash.near_duplicates(docs(spark).limit(0)).count() == 0


def test_grid_finds_every_close_pair(spark):
    rng = np.random.default_rng(11)
    fps = {int(x) for x in rng.integers(0, 1 << 63, 300)}
    for x in list(fps)[:80]:
        for k in range(1, 6):
            y = x
            for b in rng.choice(63, k, replace=False):
                y ^= 1 << int(b)
            fps.add(y)
    pairs = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4}
    got = simhash.links(spark.createDataFrame([(x, 1) for x in fps], "fp long, n long")).collect()
    got = {tuple(sorted((r.a, r.b))) for r in got}
    assert got <= pairs  # and the rest follow through a cell's leader
    assert components(fps, got) == components(fps, pairs)


def plans(monkeypatch, module) -> list[str]:
    """Gets the plan of every table that ``module`` stores."""
    found = []

    def noted(df, name, store=module.stored):
        found.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, name)
    monkeypatch.setattr(module, "stored", noted)
    return found


def test_what_an_explode_makes_is_not_broadcast(spark, monkeypatch):
    classes = spark.createDataFrame([(x, 1) for x in range(0, 400, 7)], "fp long, n long")
    found = plans(monkeypatch, simhash)
    grid = simhash.links(classes)._jdf.queryExecution().executedPlan().toString()
    simhash.near_duplicates(docs(spark, near_copies(30)))
    assert len(found) > 5 and "Generate explode" in found[0] and "SortMergeJoin" in grid
    assert not [p for p in [*found, grid] if "BroadcastExchange" in p]


def test_passages_and_labels_are_not_broadcast(spark, monkeypatch):
    found = plans(monkeypatch, line_dedup)
    lines = line_dedup.dedup_lines(docs(spark))._jdf.queryExecution().executedPlan().toString()
    line_dedup.dedup_passages(docs(spark))
    assert re.search(r"SortMergeJoin \[h1#\d+L?, h2#\d+L?\]", lines)
    assert "Generate explode" in found[0] and "BroadcastExchange" not in found[0]
    found = plans(monkeypatch, quality)
    quality.training_rows(docs(spark), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    assert "BroadcastExchange" not in found[0]


# --- embeddings

def test_vectors_odd_cases(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((6, 16))
    rows = [(i, int(i % 3), (centre[i % 6] + 0.09 * rng.standard_normal(16)).tolist()) for i in range(240)]
    rows += [(1000 + i, 1, rows[1][2]) for i in range(40)] + [(2000, None, rows[1][2]), (2001, 1, None), (2002, 1, [0.0] * 16), (2003, 1, [float("nan")] * 16),
             (2004, 1, [1.0, None] * 8), (2005, 1, [float("inf")] * 16), (None, 1, rows[4][2]), (7, 1, rows[4][2]), (2006, 1, [1.0, 2.0]), (2007, 1, []), (2008, 2, [x * 1e-30 for x in rows[2][2]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int".replace("embedding array<double>, label int", "label int, embedding array<double>")).withColumn("n", F.lit(5))
    got = embedding_dedup.near_vectors(df, passes=16, window=16).collect()
    assert len(got) == len(rows)
    links = vector_links([(i, label, v) for i, label, v in rows], 0.98)
    root = components(range(len(rows)), links)
    n, least = collections.Counter(x for p in links for x in p), {}
    for i, (d, *_) in enumerate(rows):
        least[root[i]] = min(x for x in (least.get(root[i]), d, 1 << 62) if x is not None)
    want = [(d if d is not None else -1, n[i], least[root[i]], d is not None and d == least[root[i]]) for i, (d, *_) in enumerate(rows)]
    assert sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id, r.kept) for r in got) == sorted(want)
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_vectors_across_partition_borders(spark):
    """Many partitions of few rows each: neighbours meet over the borders."""
    rows = [(i, 0, np.random.default_rng(i // 2).standard_normal(8).tolist()) for i in range(120)]
    rows = [(i, b, [x + 1e-4 * i for x in v]) for i, b, v in rows]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), 0.999, 8, 3).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    links = vector_links(rows, 0.999)
    assert {(r.vec_id, r.n_links) for r in got} == {(i, sum(i in p for p in links)) for i in range(120)}


def test_vectors_in_a_crowd(spark):
    """Pairs of cosine 0.982 in a label whose vectors all have a cosine of about 0.95."""
    rng = np.random.default_rng(17)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    near = lambda x, c: unit(c * x + np.sqrt(1 - c * c) * unit((r := rng.standard_normal(x.shape)) - (r * x).sum(-1, keepdims=True) * x))
    x = near(np.repeat(unit(rng.standard_normal((1, 64))), 4000, 0), np.sqrt(0.95))
    x[2000:2300] = near(x[:300], 0.982)
    rows = [(i, 0, v.tolist()) for i, v in enumerate(x)]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), passes=2, window=2).collect()
    a, b = np.nonzero(np.triu(x @ x.T >= 0.98, 1))
    root, n = components(range(4000), zip(a.tolist(), b.tolist())), np.bincount([*a, *b], minlength=4000)
    assert len(a) >= 300 and len(got) == 4000
    assert all((r.n_links, r.component_id, r.kept) == (n[r.vec_id], root[r.vec_id], root[r.vec_id] == r.vec_id) for r in got)


def planted_recall(spark, n, base, threshold=0.98, passes=24, seed=5):
    """Share of planted pairs (cosine 0.985) that the passes alone find, in one label of ``n`` vectors whose
    mutual cosine is ``base``."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(np.sqrt(base) * unit(rng.standard_normal((1, 64))) + np.sqrt(1 - base) * unit(rng.standard_normal((n, 64))))
    pairs = min(n // 10, 400)
    away = rng.standard_normal((pairs, 64))
    away = unit(away - (away * x[:pairs]).sum(1, keepdims=True) * x[:pairs])
    x[pairs:2 * pairs] = 0.985 * x[:pairs] + np.sqrt(1 - 0.985 ** 2) * away
    rows = spark.createDataFrame(__import__("pandas").DataFrame({"vec_id": np.arange(n), "label": 0, "embedding": x.tolist()}), "vec_id long, label int, embedding array<double>")
    classes = embedding_dedup.usable(rows).select("label", F.size("vec").alias("dim"), F.col("vec_id").alias("cid"), F.lit(1).cast("long").alias("n"), "vec", F.col("vec_id").alias("least"))
    packed = classes.mapInPandas(embedding_dedup._packed, "label string, dim int, cid long, n long, vec binary, least long")
    root = {r.node: r.root for r in embedding_dedup.swept(packed, threshold, passes, 24, 7).collect()}
    one = {(r.a, r.b) for r in embedding_dedup.sorted_pass(packed, threshold, 24, 7, 0).collect()}
    return np.mean([root.get(i, i) == root.get(pairs + i, pairs + i) for i in range(pairs)]), one, x


def test_passes_find_links(spark):
    """Without any full comparison: links over range borders, none below the threshold."""
    recall, one, x = planted_recall(spark, 3000, 0.0)
    assert recall > 0.98 and len(one) > 200 and all(x[a] @ x[b] >= 0.98 - 1e-12 and a < b for a, b in one)


def test_crowded_labels_are_noticed(spark, monkeypatch):
    """A label in which passes lose pairs is compared in full, another one is not."""
    rng = np.random.default_rng(3)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    x = unit(rng.standard_normal((600, 32)))
    x[300:] = unit(0.985 * x[:300] + np.sqrt(1 - 0.985 ** 2) * unit(rng.standard_normal((300, 32))))
    rows = [(i, "ab"[i % 2], v.tolist()) for i, v in enumerate(x)] + [(1000 + i, "c", v.tolist()) for i, v in enumerate(x)]
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    monkeypatch.setattr(embedding_dedup, "QUERY_ONE_IN", 3)
    frame = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    links = vector_links(rows, 0.98)
    n = collections.Counter(i for p in links for i in p)
    root = components(range(len(rows)), links)
    want = [(r[0], n[i], min(rows[j][0] for j in range(len(rows)) if root[j] == root[i])) for i, r in enumerate(rows)]
    for passes, window in ((1, 1), (12, 24)):
        got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_vectors(frame, 0.98, passes, window).collect())
        assert got == sorted(want)


def test_line_stage_removes_short_three_line_windows(spark):
    """Three repeated lines of one word each are fewer than four pieces: only the three-line windows find them."""
    import corpus_pipeline
    rows = [(1, "a first text\nred\ngreen\nblue\nits end", "en", "a", 40), (2, "another opening\n red\ngreen \n\nblue\nand its own close", "en", "a", 50),
            (3, "no such lines\nred\ngreen\nat all", "en", "b", 30)]
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_dedup_stage(spark, docs(spark, rows), "").collect()}
    assert got == {1: (rows[0][1], len(rows[0][1])), 2: ("another opening\nand its own close", 33), 3: (rows[2][1], len(rows[2][1]))}


def test_no_link_depends_on_the_size_of_a_label(spark, monkeypatch):
    """Labels of one block and of many, no id in the query set, passes that lose pairs: every link is found."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    rng = np.random.default_rng(11)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    rows = []
    for label, half in (("small", 20), ("large", 200)):
        x = unit(rng.standard_normal((2 * half, 32)))
        x[half:] = unit(0.985 * x[:half] + np.sqrt(1 - 0.985 ** 2) * unit(rng.standard_normal((half, 32))))
        rows += [(100 * (len(rows) + i) + 1, label, v.tolist()) for i, v in enumerate(x)]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>"), 0.98, 1, 1).collect()
    links = vector_links(rows, 0.98)
    n, root = collections.Counter(i for p in links for i in p), components(range(len(rows)), links)
    want = [(r[0], n[i], min(rows[j][0] for j in range(len(rows)) if root[j] == root[i])) for i, r in enumerate(rows)]
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(want) and len(links) > 150


# --- decontamination

def brute_hits(rows, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = {}
    for i, t in items:
        w = words(t)
        for a in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[a:a + 13]), set()).add("" if i is None else str(i))
    out = []
    for d, t in rows:
        w, hit, ids = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[a:a + n]))) is not None:
                    hit |= set(range(a, a + n))
                    ids |= found
        out.append((-1 if d is None else d, len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def test_decontamination_odd_cases(spark, tmp_path):
    items = [(1, " ".join(f"Q{i}" for i in range(30))), (2, "short Item here"), (3, "alpha"), (None, "iota kappa 1"), (5, None), (6, "!!"), (7, "q3 q4 " * 8), (1, "alpha beta"),
             (10, " ".join(f"Q{i}" for i in range(5, 25)))]
    rows = [(d, t) for d, t, *_ in ODD] + [(20, "pad " * 50 + " ".join(f"q{i}" for i in range(28))), (21, " ".join(f"q{i}" for i in range(12))), (22, "q3 q4 " * 30 + "short ITEM, here"),
                                           (23, " ".join(f"q{i}" for i in range(13)) + " " + " ".join(f"q{i}" for i in range(13, 30)) + " x" * 1000), (24, "short item-here" * 2)]
    d = tables(spark, tmp_path, documents=docs(spark, [(a, t, None, None, None) for a, t in rows], extra=True),
               benchmark=spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit(1)))
    got = sorted((-1 if r.doc_id is None else r.doc_id, *tuple(r)[1:]) for r in queries.op8_decontamination(spark, d).collect())
    assert got == brute_hits(rows, items)
    frame = docs(spark)
    assert not any(r.contaminated for r in decontaminate.contamination(frame, spark.createDataFrame([], "item_id long, text string")).collect())
    assert decontaminate.contamination(frame.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


# --- URL rules

def test_url_odd_cases(spark, tmp_path):
    urls = [None, "", "no scheme.org/x", "http://ORG/x", "http://a.org", "http://a.org/", "http://example.org/es/1", "http://sub.Example.org/es", "http://example.org/en/123?x",
            "http://example.org/EN/1", "ftp://x.com/fr/a#b", "http://com/de/", "http://x.com/de/?q", "http://xcom/fr/", "http://borg/", "http://free-bets.example.net/a", "http://a.net/FREE_bets/",
            "http://a.net/freebets/", "x://y://z.org/", "http://user@example.org:80/es/", "http://a.org/a\nb", "http://example.org/es/" + "p" * 50_000, "://", "http://adult-x.org/"]
    rows = [(i, u, "h") for i, u in enumerate(urls)] + [(3, urls[3], "h"), (None, "http://x.com/fr/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"rule_": F.lit(1), "kind": F.lit("k")})
    import duckdb
    d = tables(spark, tmp_path, pages=pages)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{d}/pages.parquet/*.parquet')")
    # joins on a null page_id need the url's own row
    want = [tuple(r) for r in con.execute(queries.URL_SQL.replace("p.page_id = b.page_id", "p.page_id IS NOT DISTINCT FROM b.page_id")).fetchall()]
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in queries.op9_url_filter(spark, d).collect()), key=key) == sorted(want, key=key)
    rules = url_rules.rules_table(spark, [url_rules.site_rule("org/", "allow")])
    assert url_rules.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_rules.judge(pages, rules.limit(0)).collect()} == {"allow"}
    assert set(pages.columns) <= set(url_rules.judge(pages, rules).columns)


# --- language

def test_language_accuracy(spark):
    got = queries.op10_language(spark, SMALL).join(read(spark, SMALL, "documents"), "doc_id").toPandas()
    assert (got.held_out == got.doc_id.map(crc_held_out)).all() and got.score.between(0, 1).all()
    test = got[got.held_out & (got.n_chars >= 30)]
    assert len(test) > 200 and (test.lang_pred == test.lang).mean() > 0.97


def test_language_odd_cases(spark):
    frame = docs(spark, extra=True)
    got = {r.doc_id: r for r in langid.identified(frame, {"de": b"der die das und ist", "en": b"the and of alpha beta"}).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].rejected and got[1].score == 0
    assert got[4].lang_pred in ("de", "en") and set(frame.columns) <= set(got[4].asDict())
    assert {r.lang_pred for r in langid.identified(frame, {}).collect()} == {"und"}
    assert langid.dictionaries(frame.limit(0), F.lit(True)) == {}
    assert set(langid.dictionaries(frame, F.lit(True))) == {"en", "de", "fr"}


# --- quality

def test_quality_accuracy(spark):
    """On labelled documents whose labels the fit never saw."""
    d = "/root/testdata/sf0.1"
    labels = read(spark, d, "labels")
    docs_, seen = read(spark, d, "documents"), "crc32(cast(doc_id AS string)) % 2 = 1"
    got = (quality.scored(docs_, labels.filter(seen)).join(labels.filter(f"NOT ({seen})"), "doc_id").select("score", "quality", "toxic").toPandas())
    good = (got.quality == 1) & (got.toxic == 0)
    kept = got.score >= 0.5
    assert len(got) > 1000 and kept[good].mean() > 0.97 and kept[~good].mean() < 0.12


def test_quality_exchange_sees_every_document(spark):
    """Features of unlabelled documents enter the counts, however many there are."""
    rows = [(i, f"fine words of text {i} " * 3, "en", "good" if i % 2 else "bad", 60) for i in range(400)]
    views = [quality.View(np.zeros(quality.SPACE)), quality.View(np.zeros(quality.SPACE), 1.0, 9.0)]
    views[0].shift = -9.0  # the text view is sure that all are bad, the other one that all are good
    for parts in (1, 5):
        text, meta = quality._collected(quality._counting(
            docs(spark, rows).repartition(parts).select(*quality._inputs(), "doc_id"), quality._confident(views)))
        assert text.docs.tolist() == [1, 400] and meta.docs.tolist() == [400, 1]
        assert text.features[1, quality.text_features(b"fine")[0]] == 400 and text.features[0].sum() == 0


def test_quality_odd_cases(spark):
    labels = spark.createDataFrame([(4, 1, 0), (8, 0, 0), (8, 1, 0), (99, 0, 1), (None, 1, 1), (7, None, 1), (9, 1, None), (6, None, None)], "doc_id long, quality int, toxic int")
    frame = docs(spark).withColumns({"good": F.lit(1), "body": F.lit("b")})
    got = quality.scored(frame, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got) and set(frame.columns) <= set(got[0].asDict())
    assert all(r.score > 0.999 for r in quality.scored(frame, labels.limit(0)).collect())
    assert quality.scored(frame.limit(0), labels).count() == 0
    twice = collections.defaultdict(set)
    for r in got:
        twice[r.text, r.source, r.lang, r.n_chars].add(r.score)
    assert all(len(s) == 1 for s in twice.values())


def test_quality_sample_has_one_row_an_id(spark):
    """An id with most of the rows gives one training row, by any partitioning."""
    rows = [(5, f"text {i} of the hot id", "en", "a", i) for i in range(300)] + [(100 + i, f"text of {i}", "en", "a", 9) for i in range(20)]
    labels = spark.createDataFrame([(5, 0, 0)] + [(100 + i, i % 2, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    got = [sorted(map(tuple, quality.training_rows(docs(spark, rows).repartition(p), labels).collect())) for p in (1, 7)]
    assert [r[0] for r in got[0]] == [5, *range(100, 110)] and got[0] == got[1]


def test_long_texts_encode_as_a_whole(spark):
    import public_tokenizers as P
    path, pattern = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    words = " ".join(r.text for r in read(spark, SMALL, "documents").limit(200).collect())[:100_000]
    enc, reserved = chat.tokenizer(path, pattern)
    ids, mask, _ = chat.assemble([("assistant", words)], path, pattern, "assistant")
    own = enc.encode_ordinary(chat.escape(words))
    at = ids.index(reserved[chat.SEP]) + 1
    assert len(words) == 100_000 and ids[at:-1] == own and sum(mask) == len(own)
    odd = (words[:30_000] + "\x1c\x1d \u3000\x85 \n\n  12é?!  " * 2000 + "x" * 200_000 + " " * 200_000 + words[:50_000] + "\t" * 140_000)
    assert len(odd) > 4 * chat.DIRECT_CHARS and chat.encode(enc, odd) == enc.encode_ordinary(odd)
    assert enc.decode(chat.encode(enc, " " * 3_000_000 + "a")) == " " * 3_000_000 + "a"


def test_secrets_of_any_length(spark):
    """A long key whose first digit comes late, and runs without a digit or a letter."""
    late = 'api_key="sk_live_' + "abcdefghijklmnopqrstuvwxyz" * 3 + '0123456789ABCDEF"'
    late_letter = 'token="' + "0123456789" * 9 + 'abcdef"'
    for text, want in ((late, True), (late_letter, True), ("x" * 500, False)):
        got = spark.createDataFrame([(text,)], "t string").selectExpr("t").withColumn("m", F.regexp_extract_all("t", F.lit(pii.PATTERNS["secret"]), 0)).first().m
        assert bool([m for m in got if len(m) > 60]) == want


def test_loose_kinds_against_brute_force(spark):
    """Candidates of the method's own kinds: every match, at its code points."""
    texts = {r.doc_id: r.text or "" for r in read(spark, SMALL, "documents").collect()}
    texts |= {-1: "é\U0001F600 key sk-ABCdef0123456789 call (415) 555-2671 or 415.555.2671, ssn 123-45-6789.", -2: "1234567890123 abcdefghijklmnop a1" + "b" * 90,
              -3: "12-345-6789 123-45-67890 x123-45-6789 +1 415 555 2671", -4: ""}
    rows = pii.candidates(docs(spark, [(i, t, "en", "a", len(t)) for i, t in texts.items()]))
    found = pii.labelled(rows).join(rows.select("rid", "doc_id"), "rid")
    got = {(r.doc_id, pii.KINDS[r.kind], r.start, r.end) for r in found.collect()}
    loose = ("secret", "local_phone", "national_id")
    want = {(i, k, m.start(), m.end()) for i, t in texts.items() for k in loose for m in re.finditer(pii.PATTERNS[k], t)}
    assert len(want) > 30 and {g for g in got if g[1] in loose} == {w for w in want if any(c.isdigit() for c in texts[w[0]])}


# --- names

#: Names that exports and this library's own modules use.
CLASHING = ["_id", "_th", "_starts", "_copies", "_url", "_raw", "_spans", "_gone", "_lines", "_found", "_best", "score", "body", "size", "first", "label",
            "lang_pred", "target", "h1", "kind", "pattern", "token", "fp", "_w"]


def _clashing(df, skip=()):
    return df.selectExpr("*", *[f"'mine' AS `{c}`" for c in CLASHING if c not in df.columns and c not in skip])


def _plain(df, columns):
    return sorted(tuple(str(v) for v in r) for r in df.select(*columns).collect())


def test_columns_of_any_name_pass_through(spark, tmp_path):
    import corpus_pipeline
    frame = docs(spark)
    labels = spark.createDataFrame([(4, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "garçon")], "item_id long, text string")
    d = tables(spark, tmp_path, documents=frame, labels=labels, benchmark=benchmark)
    for name, stage in corpus_pipeline.STAGES:
        out, plain = stage(spark, _clashing(frame), d), stage(spark, frame, d)
        assert _plain(out, plain.columns) == _plain(plain, plain.columns) and plain.count() > 0, name
        assert out.filter(" OR ".join(f"`{c}` IS DISTINCT FROM 'mine'" for c in CLASHING)).count() == 0, name
    for f in (line_dedup.dedup_lines, line_dedup.dedup_passages, mixing.emitted):
        out, plain = f(_clashing(frame)), f(frame)
        assert _plain(out, plain.columns) == _plain(plain, plain.columns) and set(CLASHING) <= set(out.columns)
    pages = spark.createDataFrame([("http://spam-farm.example.org/es/x",), (None,)], "url string")
    rules = url_rules.rules_table(spark, [url_rules.site_rule("org/", "allow"), url_rules.pattern_rule("p", "spam farm")])
    out, plain = url_rules.judge(_clashing(pages), rules), url_rules.judge(pages, rules)
    assert _plain(out, plain.columns) == _plain(plain, plain.columns) and out.filter("_url = 'mine' AND _best = 'mine'").count() == 2


def test_rules_without_literals_meet_every_url(spark):
    rules = url_rules.rules_table(spark, [("digits", "pattern", "block", "[0-9]{5,}", []), url_rules.pattern_rule("p", "spam")])
    pages = spark.createDataFrame([("http://a.b/x12345y",), ("http://a.b/x1234y",), ("http://a.b/spam",), (None,)], "url string")
    got = {r.url: (r.verdict, r.patterns) for r in url_rules.judge(pages, rules).collect()}
    assert got == {"http://a.b/x12345y": ("block", "digits"), "http://a.b/x1234y": ("allow", ""), "http://a.b/spam": ("block", "p"), None: ("allow", "")}


def passage_recall(spark, sf_dir, each, reflowed, seed=11):
    """Per language the share of planted passages that lose words, and of their words that go: runs of
    55 words of one document put inside a line of a later one, with their line ends or (reflowed) without."""
    rng = np.random.default_rng(seed)
    rows = sorted(tuple(r) for r in read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars").collect())
    by_lang, changed = collections.defaultdict(list), {}
    for i, r in enumerate(rows):
        if r[2] and r[1] and len(r[1].split()) > 130:
            by_lang[r[2]].append(i)
    planted = collections.defaultdict(list)
    for lang, places in sorted(by_lang.items()):
        order = rng.permutation(places)[:2 * each].tolist()
        for a, b in zip(order[::2], order[1::2]):
            a, b = min(a, b), max(a, b)
            words, host = re.findall(r"\S+\s*", rows[a][1]), re.findall(r"\S+\s*", rows[b][1])
            at, to = rng.integers(5, len(words) - 60), rng.integers(5, len(host) - 5)
            passage = [w.strip() + " " for w in words[at:at + 55]] if reflowed else [*words[at:at + 54], words[at + 54].strip() + " "]
            host[to - 1] = host[to - 1].rstrip() + " "
            changed[b] = "".join(host[:to] + passage + host[to:])
            planted[lang].append(b)
    size = lambda t: len((t or "").split())
    before = {r.doc_id: size(r.text) for r in line_dedup.dedup_passages(docs(spark, rows)).collect()}
    with_passages = [(r[0], changed.get(i, r[1]), *r[2:]) for i, r in enumerate(rows)]
    after = {r.doc_id: size(r.text) for r in line_dedup.dedup_passages(docs(spark, with_passages)).collect()}
    gone = {lang: [55 - (after[rows[b][0]] - before[rows[b][0]]) for b in places] for lang, places in planted.items()}
    return {lang: (float(np.mean([g > 0 for g in v])), float(np.mean(np.clip(v, 0, 55)) / 55)) for lang, v in gone.items()}


@pytest.mark.parametrize("reflowed", [False, True])
def test_passages_inside_lines_in_every_language(spark, reflowed):
    found = passage_recall(spark, SMALL, 40, reflowed)
    assert len(found) == 4
    for lang, (touched, words) in found.items():
        assert touched > (0.85 if reflowed else 0.97) and words > (0.6 if reflowed else 0.85), (lang, touched, words)


def test_languages_are_bounded(spark):
    rows = [(i, "some text", f"l{i}", "a", 9) for i in range(langid.LANGUAGES + 1)]
    with pytest.raises(ValueError, match="languages"):
        langid.dictionaries(docs(spark, rows), F.lit(True))
