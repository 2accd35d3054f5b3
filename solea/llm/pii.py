"""Personal data by weak supervision, with DataFrame functions only.

Base spans come from fixed patterns and always stay. Looser candidates (written-out addresses, national numbers, grouped
card numbers) are judged by five labelers: pattern, gazetteer, context, format and border, each voting yes, no or nothing.
Expectation-maximisation over the counts of vote patterns of all documents estimates how reliable each labeler is, without
any labelled data; a logistic span classifier is then trained on those soft labels and decides on each candidate.

Two passes without a shuffle of texts: the first sends only counts per vote pattern (at most 4 kinds x 3^5 patterns x
4 sizes, so they may be collected whatever the corpus holds); the second finds spans row by row.

The patterns are written so that long runs cost linear time: a match can start only at the start of a run or where the match before
ended (``\\G``), and inner runs never give back characters.

Defined cases: a null text counts as empty and has no spans; repeated rows are judged alike; ties in the sort of spans go by
kind in the order of KINDS, then by end. Only the id and the text are read; ``redact`` keeps all other columns.
"""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "gazetteer", "context", "format", "border")
_NAME = r"[A-Za-z0-9._%+-]"
BASE_PATTERNS = {
    "email": rf"(?:\G|(?<!{_NAME})){_NAME}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # runs of 14 to 19 digits with single separators; shorter and longer runs fail whole
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE_PATTERNS = {
    "email": rf"(?<!{_NAME}){_NAME}{{1,64}}+ ?(?:\(at\)|\[at\]|\{{at\}}| at ) ?[A-Za-z0-9-]{{1,63}}+ ?(?:\(dot\)|\[dot\]|\{{dot\}}| dot |\.) ?[A-Za-z]{{2,12}}(?![A-Za-z])",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![\x20-]?[0-9])",
    "phone": r"(?<![0-9A-Za-z+.()-])(?:\([0-9]{2,5}\) ?|0[0-9]{1,4}[\x20/.-]|[0-9]{3}[\x20.-])[0-9]{3,4}(?:[\x20.-][0-9]{2,4}){1,3}(?![0-9A-Za-z])",
}
# Common top-level domains, issuer prefixes of cards, country calling codes
DOMAINS = "com org net edu gov info biz io de fr es it uk eu us ca ch at nl be pl se no dk fi pt jp cn in br au mx ru"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|3[0689]|35|6011|65)"
CALLING = r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
# Words that announce each kind, and words that announce other numbers, in English, German, French and Spanish
CUES = {
    "email": "mail e-mail email correo courriel adresse address contact kontakt contacto",
    "ip": "ip host server address adresse dirección serveur",
    "card": "card karte carte tarjeta visa mastercard amex kreditkarte",
    "phone": "phone tel telefon téléphone teléfono call mobile mobil móvil fax rufnummer contact",
}
COUNTER_CUES = "version isbn issn order bestellung commande pedido id nr no ref doi page seite invoice"


def _places(text: Column, pattern: str, guard: Column) -> Column:
    """Matches with their code-point places: leftmost, not overlapping. The pieces between matches give the places."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    sized = F.filter(F.zip_with(pieces, matches, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("size"), m.alias("found"))), lambda x: x["found"].isNotNull())
    nothing = F.array().cast("array<struct<s:int,e:int,found:string>>")
    placed = F.aggregate(
        sized, F.struct(F.lit(0).alias("at"), nothing.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["size"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("s"), (acc["at"] + x["gap"] + x["size"]).alias("e"), x["found"].alias("found")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(guard, placed).otherwise(nothing)


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(found: Column) -> Column:
    values = F.transform(F.split(F.reverse(_digits(found)), ""), lambda c: c.cast("int"))
    doubled = F.transform(values, lambda v, i: F.when(i % 2 == 0, v).when(v > 4, 2 * v - 9).otherwise(2 * v))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10 == 0


def _passes(kind: str, x: Column) -> Column:
    found = x["found"]
    if kind == "ip":
        # a part over 255: more than three digits after leading zeros, or 256 and more
        return F.forall(F.split(found, r"\."), lambda part: F.length(F.regexp_replace(part, "^0+", "")).between(0, 3) & (part.cast("decimal(38,0)") <= 255))
    if kind == "card":
        return F.length(_digits(found)).between(14, 19) & _luhn(found)
    if kind == "phone":
        return F.length(_digits(found)).between(10, 15)
    return F.lit(True)


def _guard(text: Column, kind: str) -> Column:
    needs = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9][0-9\\x20-]{12}[0-9\\x20-]*[0-9]"), "phone": F.contains(text, F.lit("+"))}
    return F.coalesce(needs[kind], F.lit(False))


def _of_kind(found: Column, k: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), x["found"].alias("found")))


def base_spans(text: Column) -> Column:
    """array<struct<s, k, e, found>> by start, then kind: ``k`` is the place of the kind in KINDS."""
    parts = []
    for k, kind in enumerate(KINDS):
        parts.append(_of_kind(F.filter(_places(text, BASE_PATTERNS[kind], _guard(text, kind)), partial(_passes, kind)), k))
    return F.array_sort(F.concat(*parts))


def _loose_spans(text: Column, base: Column) -> Column:
    parts = []
    for kind, pattern in LOOSE_PATTERNS.items():
        k = KINDS.index(kind)
        guard = text.rlike(r"[\(\[\{ ]at[\)\]\} ]") if kind == "email" else text.rlike(r"[0-9][)\x20/.-]+[0-9]")
        found = _places(text, pattern, F.coalesce(guard, F.lit(False)))
        parts.append(_of_kind(found, k))
    return F.filter(F.array_sort(F.concat(*parts)), lambda c: ~F.exists(base, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))


def _by_kind(k: Column, choices: dict[str, Column]) -> Column:
    out = F.lit(0)
    for kind, choice in choices.items():
        out = F.when(k == KINDS.index(kind), choice).otherwise(out)
    return out


def _vote(yes: Column, no: Column) -> Column:
    return F.when(F.coalesce(yes, F.lit(False)), 1).when(F.coalesce(no, F.lit(False)), -1).otherwise(0)


def _words(text: str) -> str:
    return r"(?<![\p{L}])(?:" + "|".join(text.split()) + r")(?![\p{L}])"


def _votes(text: Column, x: Column, is_base: Column) -> list[Column]:
    """The labelers' votes on one span, and the size class of its digits; all small numbers."""
    found, k = x["found"], x["k"]
    digits = F.length(_digits(found))
    before = F.lower(F.substring(text, F.greatest(x["s"] - 40, F.lit(0)) + 1, F.least(x["s"], F.lit(40))))
    border = F.concat(F.substring(text, x["s"], F.when(x["s"] > 0, 1).otherwise(0)), F.lit("|"), F.substring(text, x["e"] + 1, F.lit(1)))
    ending = F.lower(F.regexp_extract(found, r"([A-Za-z]+)$", 1))
    known = F.array_contains(F.lit(DOMAINS.split()), ending)
    issuer, calling = _digits(found).rlike(ISSUERS), found.rlike(CALLING)
    cue = _by_kind(k, {kind: _vote(before.rlike(_words(words)), before.rlike(_words(COUNTER_CUES))) for kind, words in CUES.items()})
    shape = _by_kind(k, {
        "email": _vote(found.rlike(r"[({\[]at|@"), found.rlike(r" at | dot ")),
        "ip": _vote(~found.rlike(r"(?:^|\.)0[0-9]"), found.rlike(r"(?:^|\.)0[0-9]")),
        "card": _vote(_luhn(found), ~_luhn(found)),
        "phone": _vote(digits.between(9, 15) & found.rlike(r"[(+]|^0"), ~digits.between(7, 15)),
    })
    return [
        F.when(is_base, 1).otherwise(0),
        _by_kind(k, {"email": _vote(known, ~known), "ip": _vote(~found.rlike(r"^(?:0|127|22[4-9]|2[3-5][0-9])\."), F.lit(False)), "card": _vote(issuer, ~issuer), "phone": _vote(calling, F.lit(False))}),
        cue,
        shape,
        _vote(F.lit(False), border.rlike(r"[\p{L}0-9_/=#]")),
        F.when(digits < 8, 0).when(digits < 11, 1).when(digits < 14, 2).otherwise(3),
    ]


def _judged(text: Column, spans: Column, is_base: bool) -> Column:
    def judge(x: Column) -> Column:
        votes = _votes(text, x, F.lit(is_base))
        return F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), *[v.alias(n) for v, n in zip(votes, (*LABELERS, "digits"))])

    return F.transform(spans, judge)


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 30) -> list[float]:
    """Probability that spans with each vote pattern are personal data, from (votes, count) alone.

    Starts from labelers that are right more often than wrong; counts are smoothed by one of each vote.
    """
    width = len(LABELERS)
    rate = [[{-1: 0.25, 0: 0.35, 1: 0.4}, {-1: 0.05, 0: 0.35, 1: 0.6}] for _ in range(width)]
    prior, belief = 0.5, [0.5] * len(patterns)
    for _ in range(rounds):
        for i, (votes, _count) in enumerate(patterns):
            log_odds = math.log(prior / (1 - prior)) + sum(math.log(rate[j][1][v] / rate[j][0][v]) for j, v in enumerate(votes))
            belief[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, log_odds))))
        total = sum(c for _, c in patterns)
        prior = min(0.99, max(0.01, (1 + sum(b * c for b, (_, c) in zip(belief, patterns))) / (2 + total)))
        for j in range(width):
            for y in (0, 1):
                weight = {v: 1.0 for v in (-1, 0, 1)}
                for b, (votes, c) in zip(belief, patterns):
                    weight[votes[j]] += c * (b if y else 1 - b)
                rate[j][y] = {v: w / sum(weight.values()) for v, w in weight.items()}
    return belief


def _features(votes: tuple[int, ...], digits: int) -> list[float]:
    return [1.0] + [float(v == s) for v in votes for s in (-1, 1)] + [float(digits == d) for d in (1, 2, 3)]


def train_classifier(rows: list[tuple[tuple[int, ...], int, float, int]], steps: int = 300, ridge: float = 1e-3) -> list[float]:
    """Logistic weights for (votes, digit class, soft label, count) rows, by gradient descent with a fixed step."""
    x = [_features(votes, digits) for votes, digits, _, _ in rows]
    total = sum(c for *_, c in rows) or 1
    weights = [0.0] * len(_features((0,) * len(LABELERS), 0))
    for _ in range(steps):
        slope = [ridge * w for w in weights]
        for features, (_, _, label, count) in zip(x, rows):
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w * f for w, f in zip(weights, features))))))
            for j, f in enumerate(features):
                if f:
                    slope[j] += (p - label) * count / total
        weights = [w - 2.0 * s for w, s in zip(weights, slope)]
    return weights


def fit_span_classifier(documents: DataFrame) -> dict[int, list[float]]:
    """Classifier weights for each kind, from the votes on all spans of all documents."""
    text = F.col("body")
    found = documents.select(F.col("text").alias("body")).select("body", base_spans(text).alias("base")).select(
        "body", "base", _loose_spans(text, F.col("base")).alias("loose"))
    judged = found.select(F.explode(F.concat(_judged(text, F.col("base"), True), _judged(text, F.col("loose"), False))).alias("x"))
    keys = ["k", *LABELERS, "digits"]
    counted = judged.select("x.*").groupBy(*keys).count().orderBy(*keys).collect()  # at most 4 * 3^5 * 4 rows
    weights = {}
    for k in range(len(KINDS)):
        rows = [(tuple(r[n] for n in LABELERS), r["digits"], r["count"]) for r in counted if r["k"] == k]
        if rows:
            belief = expectation_maximisation([(votes, count) for votes, _, count in rows])
            weights[k] = train_classifier([(votes, digits, b, count) for (votes, digits, count), b in zip(rows, belief)])
    return weights


def _probability(x: Column, weights: dict[int, list[float]]) -> Column:
    out = F.lit(0.0)
    for k, w in weights.items():
        terms, at = F.lit(w[0]), 1
        for name in LABELERS:
            terms = terms + F.when(x[name] == -1, w[at]).when(x[name] == 1, w[at + 1]).otherwise(0.0)
            at += 2
        terms = terms + F.when(x["digits"] == 1, w[at]).when(x["digits"] == 2, w[at + 1]).when(x["digits"] == 3, w[at + 2]).otherwise(0.0)
        out = F.when(x["k"] == k, 1 / (1 + F.exp(-terms))).otherwise(out)
    return out


def add_spans(documents: DataFrame, weights: dict[int, list[float]], threshold: float = 0.9, base: str = "_base", spans: str = "_spans") -> DataFrame:
    """All columns, the base spans, and all spans: base ones and the candidates whose probability reaches the threshold."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = documents.withColumn(base, base_spans(text))
    loose = F.filter(_judged(text, _loose_spans(text, F.col(base)), False), lambda x: _probability(x, weights) >= threshold)
    plain = lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))
    return out.withColumn(base, F.transform(base, plain)).withColumn(spans, loose).withColumn(
        spans, F.array_sort(F.concat(F.col(base), F.transform(spans, plain))))


def _told(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat(F.element_at(F.lit(list(KINDS)), x["k"] + 1), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))))


def _count(spans: Column, k: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["k"] == k)).cast("long")


def find_personal_data(documents: DataFrame, threshold: float = 0.9) -> DataFrame:
    """doc_id, the number of spans of each kind, the digest of the base spans, and all spans as text."""
    weights = fit_span_classifier(documents)
    found = add_spans(documents.select("doc_id", "text"), weights, threshold)
    counts = [_count(F.col("_spans"), k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_told(F.col("_base")), 256).alias("base_sha256"), _told(F.col("_spans")).alias("spans"))


def redact(documents: DataFrame, threshold: float = 0.9) -> DataFrame:
    """The documents with each span replaced by its kind in brackets; overlapping spans become one. ``n_chars`` follows where present."""
    weights = fit_span_classifier(documents)
    base, spans = "__pii_base", "__pii_spans"
    found = add_spans(documents, weights, threshold, base, spans)
    text = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        tag = F.concat(F.lit("["), F.upper(F.element_at(F.lit(list(KINDS)), x["k"] + 1)), F.lit("]"))
        added = F.when(x["s"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), tag)).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), added.alias("out"))

    hidden = F.aggregate(F.col(spans), start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    out = found.withColumn("text", F.when(F.size(spans) > 0, hidden).otherwise(text))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(documents.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop(base, spans)
