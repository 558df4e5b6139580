"""Operator 4: personal data by candidate spans and gradient-boosted trees.

Strict patterns with their checks (octets, Luhn, digit counts) give spans that always stay.
Generators with high recall propose more, overlapping ones too; only proposals that overlap no strict
span are in question.  Nothing labels those, so the labels are made where they are missing: every
strict span has a twin that the strict patterns would miss (a mistyped card number, an address with
"(at)", a telephone number without its plus), in its own context, with label 1; the proposals
outside strict spans are label 0, some of them wrongly.  Boosted trees over format and context
features, which see no check digit, learn from both.  Each generator's threshold is calibrated on
twins and proposals kept out of the fit, which are what it then selects from, and the proposals
above it are added and redacted.

Only DataFrame functions.  Features are a few bins packed into one number, so what a fit needs is
the count of every feature vector, a few thousand rows whatever the corpus; boosting over those is
driver arithmetic.  No text that may be personal is written: only places and packed features.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.shared import bind, fresh, written
from dossier.llm.spans import apart, digest, matches, named, none, redact, stretch

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
OCTETS = r"^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"
CARD = "[0-9][0-9\u0001]+"  # after single separators between digits became U+0001
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: High-recall proposals: anything with an at sign; runs of digits with separators.
LOOSE_ADDRESS = r"(?<![^\s@<>()\[\],;])[^\s@<>()\[\],;]++\x20?(?:@|\(at\)|\[at\])\x20?[^\s@<>()\[\],;]{2,}+"
LOOSE_NUMBER = r"(?<![0-9A-Za-z])\+?\(?[0-9][0-9\x20().-]{5,}[0-9](?![0-9A-Za-z])"
CUES = r"(?i)(phone|tel|call|fax|mobile|card|visa|credit|account|iban|ssn|social|passport|mail|e-mail|contact|address|ip|host|server)"
CONTEXT = 24
ROUNDS = 12
RATE = 0.3
#: A generator's threshold is the least score down to which, at every level of scores, this share of the kept-out twins
#: and proposals are twins; recall comes first in redaction and some proposals are personal too, so two in five are enough.
PRECISION = 0.4
LEVEL = 20  # kept-out candidates of a level, at least


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)

    def total(chars: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            d = F.get(chars, i).cast("int")
            twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
            return acc + F.when((n - i) % 2 == 0, twice).otherwise(d)

        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step)

    return bind(F.split(digits, ""), total) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def base_spans(text: Column) -> dict[str, Column]:
    """Named spans that pass the strict checks, by kind; kinds in the order of ranks."""
    some_digits = text.rlike("[0-9]")
    email = F.when(F.contains(text, F.lit("@")), matches(text, EMAIL)).otherwise(none())
    ip = F.when(some_digits, F.filter(matches(text, IP), lambda s: s["value"].rlike(OCTETS))).otherwise(none())
    joined = F.regexp_replace(F.translate(text, "\u0001", "\u0002"), r"(?<=[0-9])[\x20-](?=[0-9])", "\u0001")
    card = F.filter(matches(joined, CARD), lambda s: bind(_digits(s["value"]), lambda d: F.when(F.char_length(d).between(14, 19), _luhn(d)).otherwise(False)))
    phone = F.filter(matches(text, PHONE), lambda s: F.char_length(_digits(s["value"])).between(10, 15))
    return {
        "email": named(email, "email", 0), "ip": named(ip, "ip", 1),
        "card": named(F.when(some_digits, card).otherwise(none()), "card", 2),
        "phone": named(F.when(F.contains(text, F.lit("+")), phone).otherwise(none()), "phone", 3),
    }


def _in_context(text: Column, spans: Column) -> Column:
    """Named spans with the characters before them."""
    before = lambda s: stretch(text, F.greatest(s["start"] - CONTEXT, F.lit(0)), s["start"])
    return F.transform(spans, lambda s: F.struct(*(s[c].alias(c) for c in ("start", "rank", "end", "kind", "value")), before(s).alias("before")))


def candidates(text: Column) -> Column:
    """Named spans that both generators propose."""
    address = F.when(F.contains(text, F.lit("@")) | text.rlike(r"[(\[]at[)\]]"), matches(text, LOOSE_ADDRESS)).otherwise(none())
    number = F.when(text.rlike("[0-9]"), matches(text, LOOSE_NUMBER)).otherwise(none())
    return F.concat(named(address, "address", 4), named(number, "number", 5))


def twins(base: dict[str, Column]) -> Column:
    """For each strict span what it would look like if the strict patterns missed it, under its generator's name."""
    other = lambda spans, value, kind: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), value(s["value"]).alias("value")))
    return F.concat(
        other(base["email"], lambda v: F.regexp_replace(v, "@", "(at)"), "address"),
        other(base["card"], lambda v: v, "number"),  # mistyped: no feature sees its digits
        other(base["phone"], lambda v: F.regexp_replace(v, r"^\+[0-9]{0,3}[\x20.-]?(?=[0-9(])", ""), "number"),
    )


#: Features of a candidate as small integers, each with the number of its bins.
BINS = {"digits": 6, "longest": 6, "groups": 6, "plus": 2, "bracket": 2, "dots": 5, "domain": 2, "date": 2, "cue": 2, "joined": 2}


def features(c: Column) -> dict[str, Column]:
    """The features of a candidate with its context; also the trees' columns."""
    value, digits = c["value"], F.char_length(_digits(c["value"]))
    flag = lambda x: F.when(x, 1).otherwise(0)
    longest = F.array_max(F.transform(F.split(value, "[^0-9]+"), lambda g: F.char_length(g)))
    return {
        "digits": F.when(digits == 0, 0).when(digits < 7, 1).when(digits < 10, 2).when(digits < 14, 3).when(digits < 20, 4).otherwise(5),
        "longest": F.when(longest < 3, 0).when(longest < 4, 1).when(longest < 5, 2).when(longest < 14, 3).when(longest < 20, 4).otherwise(5),
        "groups": F.least(F.size(F.split(value, "[^0-9A-Za-z]+")), F.lit(5)),
        "plus": flag(value.startswith("+")),
        "bracket": flag(value.rlike(r"\([0-9]+\)")),
        "dots": F.least(F.char_length(value) - F.char_length(F.replace(value, F.lit("."))), F.lit(4)),
        "domain": flag(value.rlike(r"(?:@|[(\[]at[)\]])\x20?[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$")),
        "date": flag(value.rlike(r"^(?:[12][0-9]{3}[-.][01]?[0-9][-.][0-3]?[0-9]|[0-3]?[0-9][-.][0-3]?[0-9][-.][12][0-9]{3})(?:\x20|$)")),
        "cue": flag(c["before"].rlike(CUES)),
        "joined": flag(c["before"].rlike(r"[0-9A-Za-z_/=.-]$")),
    }


def _pack(f: dict[str, Column]) -> Column:
    total, unit = F.lit(0), 1
    for name, bins in BINS.items():
        total, unit = total + f[name] * unit, unit * bins
    return total


def _unpack(packed: Column) -> dict[str, Column]:
    out, unit = {}, 1
    for name, bins in BINS.items():
        out[name], unit = F.floor(packed / unit).cast("int") % bins, unit * bins
    return out


@dataclass(frozen=True)
class Model:
    """``trees``: (first feature, its bound, left and right splits with their two leaves each)."""

    prior: float
    trees: list[tuple]
    thresholds: dict[str, float]

    def log_odds(self, row: dict[str, int]) -> float:
        return self.prior + sum(_leaf(t, row) for t in self.trees)

    def column(self, f: dict[str, Column]) -> Column:
        total = F.lit(self.prior)
        for feature, bound, *sides in self.trees:
            part = [F.when(f[g] <= b, low).otherwise(high) for g, b, low, high in sides]
            total = total + F.when(f[feature] <= bound, part[0]).otherwise(part[1])
        return 1 / (1 + F.exp(-total))


def _leaf(tree: tuple, row: dict[str, int]) -> float:
    feature, bound, left, right = tree
    g, b, low, high = left if row[feature] <= bound else right
    return low if row[g] <= b else high


def boost(vectors: list[tuple[dict[str, int], int, int]], rounds: int = ROUNDS) -> tuple[float, list[tuple]]:
    """Logistic boosting over (features, candidates, accepted ones) with trees of depth two."""
    n, yes = sum(v[1] for v in vectors), sum(v[2] for v in vectors)
    prior = math.log((yes + 1) / (n - yes + 1))
    odds = [prior] * len(vectors)
    trees: list[tuple] = []
    splits = sorted({(f, v) for row, _, _ in vectors for f, v in row.items()})

    def best(own: list[int], slope: list[float], curve: list[float]) -> tuple:
        found = (-1.0, splits[0][0], splits[0][1], 0.0, 0.0)
        for f, b in splits:
            g, h = [0.0, 0.0], [0.0, 0.0]
            for i in own:
                side = int(vectors[i][0][f] > b)
                g[side] += slope[i]
                h[side] += curve[i]
            gain = sum(a * a / (c + 1) for a, c in zip(g, h))
            if gain > found[0] + 1e-12:
                found = (gain, f, b, RATE * g[0] / (h[0] + 1), RATE * g[1] / (h[1] + 1))
        return found

    for _ in range(rounds if vectors else 0):
        p = [1 / (1 + math.exp(-o)) for o in odds]
        slope = [y - m * q for (_, m, y), q in zip(vectors, p)]
        curve = [m * q * (1 - q) for (_, m, _), q in zip(vectors, p)]
        _, f, b, _, _ = best(list(range(len(vectors))), slope, curve)
        sides = [[i for i, v in enumerate(vectors) if (v[0][f] > b) == high] for high in (False, True)]
        trees.append((f, b, *(best(s, slope, curve)[1:] for s in sides)))
        odds = [o + _leaf(trees[-1], v[0]) for o, v in zip(odds, vectors)]
    return prior, trees


def _proposed(text: Column, base: dict[str, Column]) -> tuple[Column, Column]:
    """Packed proposals outside the strict spans, and packed twins; with a bit for what is kept out of the fit."""
    kept_out = lambda c: F.pmod(F.xxhash64(c["value"], c["before"]), F.lit(4)) == 0
    packed = lambda c: F.struct(*(c[k].alias(k) for k in ("start", "rank", "end", "kind")), _pack(features(c)).alias("packed"), kept_out(c).alias("out"))
    strict = F.concat(*base.values())
    return F.transform(_in_context(text, bind(strict, lambda b: apart(candidates(text), b))), packed), F.transform(_in_context(text, twins(base)), packed)


def _placed(spans: Column) -> Column:
    """Named spans without their values."""
    return F.transform(spans, lambda s: F.struct(*(s[k].alias(k) for k in ("start", "rank", "end", "kind"))))


def propose(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, email, ip, card, phone, proposed, twins)``: strict spans, and packed proposals and twins, of every row."""
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = rows.select("doc_id", "text", *(c.alias(k) for k, c in base_spans(text).items()))
    proposed, likes = _proposed(text, {k: F.col(k) for k in ("email", "ip", "card", "phone")})
    return found.select("doc_id", *(_placed(F.col(k)).alias(k) for k in ("email", "ip", "card", "phone")), proposed.alias("proposed"), likes.alias("twins"))


def fit(found: DataFrame) -> Model:
    """Boosted trees and thresholds from the proposals and twins of every document in ``propose``'s result."""
    labelled = lambda column, label: F.transform(column, lambda c: F.struct(c["kind"].alias("generator"), c["packed"].alias("packed"), c["out"].alias("out"), F.lit(label).alias("yes")))
    flat = found.select(F.explode(F.concat(labelled("proposed", 0), labelled("twins", 1))).alias("x")).select("x.*")
    counts = flat.groupBy("generator", "packed", "out").agg(F.count("*").alias("n"), F.sum("yes").alias("yes"))
    rows = counts.select("generator", "out", "n", "yes", *(v.alias(k) for k, v in _unpack(F.col("packed")).items())).collect()
    table = [({k: r[k] for k in BINS} | {"kind": int(r.generator == "number")}, r.generator, r.out, r.n, r.yes) for r in rows]
    table.sort(key=lambda r: (r[1], r[2], sorted(r[0].items())))
    prior, trees = boost([(f, n, y) for f, _, out, n, y in table if not out])
    model = Model(prior, trees, {})
    thresholds = {}
    for generator in ("address", "number"):
        own = sorted(((1 / (1 + math.exp(-model.log_odds(f))), n, y) for f, g, out, n, y in table if out and g == generator), reverse=True)
        n = yes = 0
        thresholds[generator] = 2.0  # nothing passes
        for k, (p, m, y) in enumerate(own):
            n, yes = n + m, yes + y
            if k + 1 < len(own) and (n < LEVEL or own[k + 1][0] == p):
                continue  # scores are pooled from the highest on until a level holds enough
            if yes < PRECISION * n:
                break
            thresholds[generator], n, yes = p, 0, 0
    return Model(prior, trees, thresholds)


def accepted_proposals(proposed: Column, model: Model) -> Column:
    """Those of the packed proposals that the model accepts, as named spans without values."""

    def chosen(c: Column) -> Column:
        limit = F.when(c["kind"] == "address", model.thresholds["address"]).otherwise(model.thresholds["number"])
        return model.column(_unpack(c["packed"]) | {"kind": F.when(c["kind"] == "number", 1).otherwise(0)}) >= limit - 1e-9

    return _placed(F.filter(proposed, chosen))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, email, ip, card, phone, added)``: spans (start, rank, end, kind) of every row in code points, end exclusive.

    Null and empty texts have none; rows, ids (null or repeated) and their number stay as they are;
    with no strict span in any text nothing is added; an empty table gives no rows; other columns are
    not read, whatever their names.  Very long texts take time in proportion to their length;
    overlapping proposals (a tie) may both be added.
    """
    found = written(propose(docs, id_col, text_col), "pii-places")
    return found.withColumn("added", accepted_proposals(F.col("proposed"), fit(found))).drop("proposed", "twins")


def all_spans() -> Column:
    return F.concat("email", "ip", "card", "phone", "added")


def redact_pii(docs: DataFrame, text_col: str = "text", mark: str = "[PII]", model: Model | None = None) -> DataFrame:
    """``docs`` with the strict and added spans in ``text_col`` replaced by ``mark``; all else stays.

    Without a ``model`` one is fitted to the proposals and twins of all of ``docs``.
    """
    name = fresh(docs, "pii_spans")
    text = F.col(text_col).cast("string")
    model = model or fit(propose(docs, text_col, text_col))
    full = F.coalesce(text, F.lit(""))
    base = F.struct(*(c.alias(k) for k, c in base_spans(full).items()))
    kinds = ("email", "ip", "card", "phone")
    spans = bind(base, lambda b: F.concat(*(_placed(b[k]) for k in kinds), accepted_proposals(_proposed(full, {k: b[k] for k in kinds})[0], model)))
    found = docs.withColumn(name, spans)
    return found.withColumn(text_col, redact(text, F.col(name), mark)).drop(name)


def pii_digest(spans: Column) -> Column:
    return digest(spans)
