"""Personal data by weak supervision: labelers vote, expectation-maximisation
weighs them, and a classifier trained on the result decides.

Candidates are the matches of seven patterns. Four are base kinds (email, ip,
card, phone): a match that passes its kind's check is a span whatever the votes.
Three looser kinds (secret, local_phone, national_id) become spans if the
classifier says so and they touch no base span.

Five labelers vote 1, 0 or -1 on a candidate: its strict form, a gazetteer (top
level domains, calling codes, issuer prefixes, reserved networks, key words), the
words before it, whether it stands alone, and whether it looks made up. Candidates
with equal votes and features are counted, and the counts, a table whose size is
bounded by the votes and features there are, feed both fits: EM with a prior per
kind and a reliability per labeler and vote, then a logistic regression on votes
and form features against EM's posteriors.

Positions are code points, end exclusive. They come from splitting a text at a
pattern's matches: the lengths of the pieces and matches add up to the starts.
Patterns use possessive quantifiers and start only where a run starts or a match
ended, so that each is linear in the text and finds what a plain leftmost search
finds.

Defined cases: a null or empty text has no span; candidates that fail a base
check are dropped without a retry; repeated rows and equal ids get a row each; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "local_phone", "national_id")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![0-9A-Za-z+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[0-9A-Za-z+/_-]{12,}+",
    "local_phone": r"(?<![0-9+(])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A text without this has no match.
NEEDS = {"email": "@", "phone": "+"}

# The labelers' word lists.
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "it", "uk", "eu", "ch", "at", "nl", "us", "ca")
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "82", "86", "91")
ISSUER_PREFIXES = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)"
RESERVED_NETWORKS = r"^(?:0|10|127|169\.254|172\.(?:1[6-9]|2[0-9]|3[01])|192\.168|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
KEY_WORDS = r"(?i)(?:password|passwd|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key)[\"'\x20]*[:=]?[\"'\x20]*$"
CONTEXT_WORDS = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|kontakt|correo|courriel)",
    "ip": r"(?i)(?:\bip\b|host|server|address|adresse|login|logged)",
    "card": r"(?i)(?:card|visa|master|amex|payment|karte|carte|tarjeta)",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|cell|handy|anruf|appel)",
    "secret": r"(?i)(?:password|passwd|pwd|secret|token|key|credential)",
    "local_phone": r"(?i)(?:phone|tel|call|fax|mobile|cell|handy|anruf|appel)",
    "national_id": r"(?i)(?:ssn|social|\bid\b|identity|ausweis)",
}
AGAINST_WORDS = r"(?i)(?:version|isbn|issn|figure|fig\.|page|section|chapter|commit|sha-?1|md5|http)[^\n]{0,8}$"

VOTES = ("v_form", "v_list", "v_context", "v_alone", "v_made_up")
FORMS = ("f_length", "f_digits", "f_line", "f_quoted")
CONTEXT = 40


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def base_check(kind: str, m: Column) -> Column:
    """Whether a base match counts."""
    n = F.length(_digits(m))
    if kind == "ip":  # parts at most 255, leading zeros or not
        return m.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)(?:\.|$)){4}$")
    if kind == "card":
        return n.between(12, 19) & F.call_function("luhn_check", F.when(n <= 19, _digits(m)).otherwise(F.lit("")))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def candidates(docs: DataFrame) -> DataFrame:
    """A row per document, ``rid, doc_id, found``: its matches of all kinds with
    the length of the text since the match before and what stands around."""
    t = F.col("_t")

    def matches(kind: str) -> Column:
        needed = t.contains(NEEDS[kind]) if kind in NEEDS else F.col("_digit")
        return F.when(needed, F.regexp_extract_all(t, F.lit(PATTERNS[kind]), F.lit(0))).otherwise(F.array().cast("array<string>"))

    def entries(kind: str) -> Column:
        ms, gaps = F.col(f"_{kind}"), F.col(f"_g_{kind}")
        return F.transform(ms, lambda m, i: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), i.alias("i"), F.length(F.get(gaps, i)).cast("long").alias("gap"), m.alias("m"),
            F.substring(F.get(gaps, i), -CONTEXT, CONTEXT).alias("before"), F.substring(F.get(gaps, i + 1), 1, CONTEXT).alias("after")))

    rows = docs.select("doc_id", text_of().alias("_t")).withColumn("_digit", t.rlike("[0-9]"))
    rows = rows.select("doc_id", "_t", *[matches(k).alias(f"_{k}") for k in KINDS])
    rows = rows.select("doc_id", *[f"_{k}" for k in KINDS],
                       *[F.when(F.size(f"_{k}") > 0, F.split(t, PATTERNS[k], -1)).alias(f"_g_{k}") for k in KINDS])
    return stored(rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id",
                              F.concat(*[entries(k) for k in KINDS]).alias("found")), "matches")


def _by_kind(of: dict[str, Column], otherwise: Column) -> Column:
    out = None
    for kind, c in of.items():
        is_kind = F.col("kind") == KINDS.index(kind)
        out = F.when(is_kind, c) if out is None else out.when(is_kind, c)
    return out.otherwise(otherwise)


def _vote(yes: Column, no: Column | None = None) -> Column:
    vote = F.when(yes, 1)
    return (vote if no is None else vote.when(no, -1)).otherwise(0)


def labelled(found: DataFrame) -> DataFrame:
    """A row per candidate: ``rid, kind, start, end, base``, votes and features."""
    m, before, after = F.col("m"), F.col("before"), F.col("after")
    upto = Window.partitionBy("rid", "kind").orderBy("i")
    rows = found.select("rid", F.explode("found").alias("c")).select("rid", "c.*").withColumn("_n", F.length("m").cast("long"))
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("_n")).over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("start", F.col("end") - F.col("_n")).withColumn("base", _by_kind({k: base_check(k, m) for k in BASE}, F.lit(False)))
    domain, digits = F.substring_index(m, ".", -1), _digits(m)
    form = {**{k: _vote(base_check(k, m), ~base_check(k, m)) for k in ("ip", "card", "phone")},
            "email": _vote(m.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@.*\.[A-Za-z]{2,}$"), ~m.rlike(r"\.[A-Za-z]{2,}$")),
            "secret": _vote(m.rlike(r"^(?:[0-9a-f]{16,}|[0-9A-F]{16,}|(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z+/_-]{16,})$"), m.rlike(r"[/_-]{2}|^[A-Za-z]+[0-9]{1,4}$")),
            "local_phone": _vote(m.rlike(r"^\(?[2-9]"), m.rlike(r"^\(?[01]")),
            "national_id": _vote(~m.rlike(r"^(?:000|666|9)"), m.rlike(r"^(?:000|666|9)"))}
    listed = {"email": _vote(F.lower(domain).isin(*TOP_DOMAINS), ~F.lower(domain).isin(*TOP_DOMAINS)),
              "ip": _vote(~m.rlike(RESERVED_NETWORKS), m.rlike(RESERVED_NETWORKS)),
              "card": _vote(m.rlike(ISSUER_PREFIXES), ~m.rlike(ISSUER_PREFIXES)),
              "phone": _vote(F.substring(m, 2, 1).isin(*CALLING_CODES) | F.substring(m, 2, 2).isin(*CALLING_CODES)),
              "secret": _vote(before.rlike(KEY_WORDS))}
    context = {k: _vote(before.rlike(w), before.rlike(AGAINST_WORDS)) for k, w in CONTEXT_WORDS.items()}
    glued = before.rlike(r"[\p{L}0-9_]$") | after.rlike(r"^[\p{L}0-9_]")
    alone = _vote((before.rlike(r"[\s\"'(=:,;]$") | (before == "")) & (after.rlike(r"^[\s\"').,;:]") | (after == "")), glued)
    made_up = _vote(F.lit(False), digits.rlike(r"^([0-9])\1*$") | digits.rlike(r"^0?123456") | F.lower(m).rlike(r"(?:test|sample|xxxx)"))
    share = F.when(F.col("_n") > 0, F.length(digits) / F.col("_n")).otherwise(0.0)
    return rows.select(
        "rid", "kind", "start", "end", "base", _by_kind(form, F.lit(0)).alias("v_form"), _by_kind(listed, F.lit(0)).alias("v_list"),
        _by_kind(context, F.lit(0)).alias("v_context"), alone.alias("v_alone"), made_up.alias("v_made_up"),
        F.least(F.floor(F.col("_n") / 8), F.lit(6)).cast("int").alias("f_length"), F.floor(share * 4).cast("int").alias("f_digits"),
        (before.rlike(r"\n$") | (F.col("start") == 0)).cast("int").alias("f_line"), before.rlike(r"[\"'=:]$").cast("int").alias("f_quoted"))


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def reliabilities(counts: DataFrame, rounds: int = 12) -> Column:
    """EM over the counted patterns: the fitted posterior as a column. Each
    round is one aggregate to one row of sums."""
    odds = sum((F.col(v) for v in VOTES[1:]), F.col(VOTES[0])).cast("double")  # at first, the sum of the votes
    for _ in range(rounds):
        weighed = counts.select("kind", *VOTES, "n", (1 / (1 + F.exp(-odds))).alias("p"))
        p = F.col("p")
        sums = [F.sum(F.when(F.col("kind") == k, F.col("n") * y)) for k in range(len(KINDS)) for y in (p, 1 - p)]
        sums += [F.sum(F.when(F.col(v) == x, F.col("n") * y)) for v in VOTES for x in (-1, 0, 1) for y in (p, 1 - p)]
        got = [x or 0.0 for x in weighed.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]
        prior = [min(max((a + 1) / (a + b + 2), 0.05), 0.95) for a, b in zip(got[:2 * len(KINDS):2], got[1:2 * len(KINDS):2])]
        odds = F.element_at(F.array(*[F.lit(_logit(x)) for x in prior]), F.col("kind") + 1)
        at = 2 * len(KINDS)
        for v in VOTES:
            yes, no = got[at:at + 6:2], got[at + 1:at + 7:2]
            yes, no = [x + s for x, s in zip(yes, (1, 2, 3))], [x + s for x, s in zip(no, (3, 2, 1))]
            against, _, pro = [math.log(y / sum(yes)) - math.log(n / sum(no)) for y, n in zip(yes, no)]
            # an abstention says nothing, and a vote never speaks against itself: one huge group of like
            # candidates could otherwise turn a labeler round for all the others
            ratio = (min(against, 0.0), 0.0, max(pro, 0.0))
            odds = odds + F.element_at(F.array(*[F.lit(r) for r in ratio]), F.col(v) + 2)
            at += 6
    return 1 / (1 + F.exp(-odds))


def span_classifier(counts: DataFrame) -> Column:
    """Logistic regression on votes, kind and form against EM's posteriors, each
    pattern weighing as often as it occurs; the score as a column."""
    inputs = {v: F.col(v).cast("double") for v in (*VOTES, *FORMS)}
    inputs |= {f"k_{k}": (F.col("kind") == i).cast("double") for i, k in enumerate(KINDS)}
    p = reliabilities(counts)
    weighed = counts.select(*[c.alias(n) for n, c in inputs.items()], "n", p.alias("p"))
    rows = weighed.select(*inputs, F.explode(F.array(F.struct(F.lit(1.0).alias("y"), (F.col("n") * F.col("p")).alias("w")),
                                                     F.struct(F.lit(0.0).alias("y"), (F.col("n") * (1 - F.col("p"))).alias("w")))).alias("s")).select(*inputs, "s.*")
    rows = VectorAssembler(inputCols=list(inputs), outputCol="x").transform(stored(rows, "span-training"))
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=1e-4, maxIter=50).fit(rows)
    score = F.lit(float(model.intercept))
    for c, w in zip(inputs.values(), model.coefficients):
        score = score + c * F.lit(float(w))
    return 1 / (1 + F.exp(-score))


def spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): a row ``rid, doc_id`` per document; and its spans ``rid,
    kind`` (a name), ``start, end, base, score``."""
    found = candidates(docs)
    marked = stored(labelled(found), "candidates")
    counts = stored(marked.groupBy("kind", *VOTES, *FORMS).agg(F.count("*").alias("n")), "patterns")
    score = span_classifier(counts) if counts.limit(1).count() else F.lit(0.0)
    before = Window.partitionBy("rid").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("rid").orderBy(F.desc("end"), F.desc("start")).rowsBetween(Window.unboundedPreceding, 0)
    told = (marked.withColumn("score", score).filter(F.col("base") | ((F.col("kind") >= len(BASE)) & (F.col("score") >= 0.5)))
            .withColumn("_reach", F.max(F.when(F.col("base"), F.col("end"))).over(before))
            .withColumn("_next", F.min(F.when(F.col("base"), F.col("start"))).over(after)))
    touches = (F.coalesce(F.col("_reach") > F.col("start"), F.lit(False)) | F.coalesce(F.col("_next") < F.col("end"), F.lit(False)))
    return found.select("rid", "doc_id"), told.filter(F.col("base") | ~touches).select("rid", "kind", "start", "end", "base", "score")


def span_report(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, counts by base kind, ``base_spans`` and
    ``spans`` (arrays of ``start, kind, end`` in order)."""
    rows, told = spans(docs)
    one = F.struct("start", "kind", "end")
    by_doc = told.groupBy("rid").agg(
        *[F.count(F.when(F.col("base") & (F.col("kind") == i), 1)).alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.array_sort(F.collect_list(F.when(F.col("base"), one))).alias("base_spans"), F.array_sort(F.collect_list(one)).alias("spans"))
    out = rows.join(by_doc, "rid", "left")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in BASE],
                      F.coalesce("base_spans", none).alias("base_spans"), F.coalesce("spans", none).alias("spans"))


def spelled(spans_col: str) -> Column:
    """``kind:start:end`` joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans_col, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])))
