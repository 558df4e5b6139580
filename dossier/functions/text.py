"""Text functions as column expressions; everything stays in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"
#: Fixed values, tried in this order: particles that a search term may end in.
SUFFIXES = ["으로", "에서", "에게", "까지", "부터", "처럼", "은", "는", "이", "가", "을", "를", "에", "의", "와", "과", "로"]
#: What marks a question, and the roles that answer one.
QUESTION_SIGNALS = ["?", "습니까", "합니까", "인가요", "맞습니까", "어떻습니까"]
ANSWER_ROLES = ["국무총리", "장관", "차관", "처장", "청장", "원장", "실장", "국장", "과장", "사무처장"]
#: The same idea for the supplied pseudo-languages.
LATIN_SUFFIXES = ["tion", "ment", "ing", "ed", "er", "es", "en"]


def tokens(text: Column) -> Column:
    """Lower-cased tokens in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def strip_suffix(term: Column, suffixes: list[str] = LATIN_SUFFIXES, least: int = 2) -> Column:
    """The term without the first suffix it ends in, if ``least`` characters remain; else null."""
    out = F.lit(None).cast("string")
    for s in reversed(suffixes):
        out = F.when(term.endswith(s) & (F.char_length(term) >= len(s) + least), F.left(term, F.char_length(term) - len(s))).otherwise(out)
    return out


def query_terms(text: Column, suffixes: list[str] = LATIN_SUFFIXES) -> Column:
    """Every token, and after each its stripped form if no earlier entry equals it."""
    pairs = F.transform(tokens(text), lambda t: F.array(t, strip_suffix(t, suffixes)))

    def add(seen: Column, pair: Column) -> Column:
        raw, base = F.get(pair, F.lit(0)), F.get(pair, F.lit(1))
        kept = F.concat(seen, F.array(raw))
        return F.when(base.isNotNull() & ~F.array_contains(kept, base), F.concat(kept, F.array(base))).otherwise(kept)

    return F.aggregate(pairs, F.array().cast("array<string>"), lambda seen, pair: F.coalesce(add(seen, pair), F.concat(seen, F.array(F.get(pair, F.lit(0))))))


def normalize(text: Column) -> Column:
    """Line ends to LF, runs of blanks to one, lines trimmed, more than one empty line to one."""
    lf = F.regexp_replace(text, r"\r\n?", "\n")
    blanks = F.regexp_replace(lf, r"[ \t 　]+", " ")
    lines = F.regexp_replace(blanks, r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(lines, r"\n{3,}", "\n\n"))


def match_key(text: Column) -> Column:
    """Lower case, letters and digits alone: what containment tests compare."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def exact_numbers(text: Column, digits: int = 7) -> Column:
    """Distinct numbers of exactly ``digits`` digits, ascending."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?<![0-9])[0-9]{{{digits}}}(?![0-9])"), F.lit(0))))


def phrases(words: Column, excluded: list[str], least: int = 2) -> Column:
    """Content words' joined triples, then pairs, then single words, distinct."""
    kept = F.filter(words, lambda w: ~w.isin(excluded) & (F.char_length(w) >= least) & ~w.rlike("^[0-9]+$"))

    def runs(n: int) -> Column:
        last = F.size(kept) - n
        grams = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.concat(*(F.get(kept, i + k) for k in range(n))))
        return F.when(last >= 0, grams).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(runs(3), runs(2), kept))


def contains_any(text: Column, signals: list[str]) -> Column:
    out = F.lit(False)
    for s in signals:
        out = out | F.contains(text, F.lit(s))
    return out


def split_names(text: Column) -> Column:
    """Names of a proposer string; links are dropped, and "X et al. N" gives X alone."""
    compact = F.regexp_extract(text, r"^\s*(.+?)\s+et al\.\s*[0-9]*\s*$", 1)
    names = F.filter(F.transform(F.split(F.regexp_replace(text, r"https?://[^\s,;]+", ""), r"[,;/·]"), lambda n: F.trim(n)), lambda n: n != "")
    return F.when(compact != "", F.array(compact)).otherwise(names)


def parse_any_date(*fields: Column) -> Column:
    """The first field that holds a date as YYYY-MM-DD, YYYY.MM.DD, YYYY/MM/DD or YYYYMMDD."""
    found = []
    for f in fields:
        digits = F.regexp_replace(F.trim(f), r"[-./]", "")
        found.append(F.when(F.trim(f).rlike(r"^[0-9]{4}([-./]?)[0-9]{2}\1[0-9]{2}$"), F.try_to_date(digits, "yyyyMMdd")))
    return F.coalesce(*found)


def stable_id(*parts: Column, digits: int = 16) -> Column:
    """Leading hex digits of the sha256 of the parts, joined by a unit separator."""
    return F.left(F.sha2(F.concat_ws("\u001f", *parts), 256), F.lit(digits))
