"""Operator 3: secret scans by patterns and by sliding-window Shannon entropy, with an allow-list.

Candidate strings are runs of base64-like characters.  A window slides over each with the counts of
its characters; a step moves one count down and one up, and with them the sum of c * log2(c) that
gives the window's entropy.  Each character class has its own threshold for the highest window.
Only DataFrame functions; each row by itself, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.shared import bind, fresh
from dossier.llm.spans import digest, matches, named, none, outside, redact

ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""(?i)^(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # 18 or more characters in all
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Bits a character that the highest window must reach, by the candidate's class.
THRESHOLDS = {"hex": 3.0, "letters": 4.0, "mixed": 3.6}
#: A part of a candidate, cut at = and /, that holds one of these in lower case is no secret.
ALLOWED = ["example", "sample", "placeholder", "changeme", "your_", "your-", "xxxx", "0000000", "1234567", "abcdefg", "lorem", "-----", "_____", "====="]
#: The longest stretches of a candidate without such parts.
UNNAMED = rf"(?:/|(?<!=)={{1,4}}+(?!=)|(?<![A-Za-z0-9+_-])(?![A-Za-z0-9+_-]*?(?i:{'|'.join(ALLOWED)}))[A-Za-z0-9+_-]++)++"
#: Names, paths and identifiers: words (in lower case, capitals or camel case), numbers, versions such as v2 or k8s,
#: UUIDs, with separators between them.  A candidate wholly of such parts is no secret.
WORDS = r"(?:[A-Z]{2,12}(?![a-z])|[A-Z]?[a-z]{2,18}(?![a-z]))"
PART = rf"(?:{WORDS}{{1,8}}(?:[A-Z]?[0-9]{{1,4}})?|[A-Za-z][0-9]{{1,3}}[a-z]?|[0-9]{{1,8}}[a-z]{{0,3}}|[A-Za-z])"
NAMES = rf"^(?:(?:[/=_+-]++|{PART}(?=[/=_+-]|$))++|[0-9a-f]{{8}}(?:-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}})$"


def highest_entropy(value: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy of a window of ``value``, which has at least ``window`` characters.

    The state of a step is the window's count of every distinct character and their sum of
    c * log2(c): what leaves and what enters change one count each.
    """
    weight = lambda c: F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))

    def slide(codes: Column, kinds: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            def moved(leaves: Column, enters: Column) -> Column:
                falls, rises = F.get(acc["counts"], leaves), F.get(acc["counts"], enters)
                now = acc["now"] - weight(falls) + weight(falls - 1) - weight(rises) + weight(rises + 1)
                counts = F.transform(acc["counts"], lambda c, k: c - (k == leaves).cast("int") + (k == enters).cast("int"))
                return bind(now, lambda n: F.struct(n.alias("now"), F.least(acc["least"], n).alias("least"), counts.alias("counts")))

            return bind(F.struct(F.get(codes, i).alias("leaves"), F.get(codes, i + window).alias("enters")), lambda x: F.when(x["leaves"] == x["enters"], acc).otherwise(moved(x["leaves"], x["enters"])))

        first = F.transform(kinds, lambda _, k: F.size(F.filter(F.slice(codes, 1, window), lambda x: x == k)))
        start = bind(first, lambda counts: bind(F.aggregate(counts, F.lit(0.0), lambda s, c: s + weight(c)), lambda s: F.struct(s.alias("now"), s.alias("least"), counts.alias("counts"))))
        steps = F.when(F.size(codes) > window, F.sequence(F.lit(0), F.size(codes) - window - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, start, step, lambda acc: F.log2(F.lit(float(window))) - acc["least"] / window)

    coded = lambda chars: bind(F.array_distinct(chars), lambda kinds: bind(F.transform(chars, lambda c: (F.array_position(kinds, c) - 1).cast("int")), lambda codes: slide(codes, kinds)))
    return bind(F.split(value, ""), coded)


def _suspicious(span: Column) -> Column:
    value = span["value"]
    limit = (
        F.when(value.rlike(NAMES), None)
        .when(value.rlike("^[0-9a-fA-F]+$"), F.when(value.rlike("[0-9]") & value.rlike("[a-fA-F]"), THRESHOLDS["hex"]))
        .when(value.rlike("[0-9]") & value.rlike("[A-Za-z]"), THRESHOLDS["mixed"])
        .when(value.rlike("[a-z]") & value.rlike("[A-Z]"), THRESHOLDS["letters"])
    )
    return bind(limit, lambda least: F.when(least.isNotNull(), highest_entropy(value) >= least).otherwise(F.lit(False)))


def _unnamed(span: Column) -> Column:
    """The span, or if it holds an allowed word its stretches of window length without one."""
    value, allowed = span["value"], F.lit(False)
    for word in ALLOWED:
        allowed = allowed | F.lower(value).contains(word)
    moved = lambda s: F.struct((s["start"] + span["start"]).alias("start"), (s["end"] + span["start"]).alias("end"), s["value"].alias("value"))
    rest = F.filter(matches(value, UNNAMED), lambda s: F.char_length(s["value"]) >= WINDOW)
    return F.when(allowed, F.transform(rest, moved)).otherwise(F.array(span))


def base_spans(text: Column) -> tuple[Column, Column, Column]:
    """Named spans of the kinds assign, access and hex."""
    assign = F.filter(matches(text, ASSIGN), lambda s: F.char_length(F.regexp_extract(s["value"], ASSIGN_VALUE, 1)) >= 12)
    access = F.when(F.contains(text, F.lit("AKIA")), matches(text, ACCESS)).otherwise(none())
    return named(assign, "assign", 0), named(access, "access", 1), named(matches(text, HEX), "hex", 2)


def entropy_spans(text: Column) -> Column:
    """Named spans of candidates, less their allowed parts, whose highest window passes its class's threshold."""
    return named(F.filter(F.flatten(F.transform(matches(text, CANDIDATE), _unnamed)), _suspicious), "entropy", 3)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, assign, access, hex, entropy)``: arrays of named spans for every row.

    Spans are (start, rank, end, kind, value) in code points, end exclusive.  Of entropy spans the
    parts outside the others are given.  Null and empty texts have none; an empty table gives no
    rows; rows, ids (null or repeated) and their number stay as they are; other columns are not
    read, whatever their names.  Very long texts take time in proportion to their length.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    assign, access, hexes = base_spans(text)
    rows = rows.select("doc_id", assign.alias("assign"), access.alias("access"), hexes.alias("hex"), entropy_spans(text).alias("entropy"))
    return rows.withColumn("entropy", outside(F.col("entropy"), F.concat("assign", "access", "hex")))


def all_spans() -> Column:
    return F.concat("assign", "access", "hex", "entropy")


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text_col`` replaced by ``mark``; all else stays."""
    name = fresh(docs, "secret_spans")
    text = F.col(text_col).cast("string")
    found = docs.withColumn(name, F.concat(*base_spans(F.coalesce(text, F.lit(""))), entropy_spans(F.coalesce(text, F.lit("")))))
    return found.withColumn(text_col, F.when(F.size(name) > 0, redact(text, F.col(name), mark)).otherwise(text)).drop(name)


def secret_digest(spans: Column) -> Column:
    return digest(spans)
