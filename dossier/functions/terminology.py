"""Reviewed terminology over columns of text: detection, expansion, canonical forms.

A glossary is a short list of concepts: identifier, category, canonical surface, equivalent surfaces and
identifiers of related concepts.  Surfaces of several words match with any separators between them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.places import bind, matches

#: What may stand between the words of a surface, and the most terms of one expansion.
SEPARATORS = r"[\s._·()/\-]*"
MOST_TERMS = 64


@dataclass(frozen=True)
class Concept:
    id: str
    category: str
    canonical: str
    equivalents: list[str] = field(default_factory=list)
    related: list[str] = field(default_factory=list)

    @property
    def surfaces(self) -> list[str]:
        return [self.canonical, *self.equivalents]


def surface_pattern(surface: str) -> str:
    """A surface's words with separators between them, not inside a longer Latin word; any case."""
    words = re.findall(r"[^\W_]+", surface)
    edge = lambda c, look: look if c.isascii() else ""
    return "(?i)" + edge(words[0][0], "(?<![a-z0-9])") + SEPARATORS.join(map(re.escape, words)) + edge(words[-1][-1], "(?![a-z0-9])")


def surface_key(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]+", "")


def detect(text: Column, glossary: list[Concept]) -> Column:
    """Surfaces found in a text as array of (start, end, concept number, value) in order of their start.

    The longest match wins, then the earlier, then the earlier concept; no two overlap.
    """

    def spans(surface: str, k: int) -> Column:
        return F.transform(matches(text, surface_pattern(surface)), lambda m: F.struct((m["start"] - m["end"]).alias("rank"), m["start"].alias("start"), F.lit(k).alias("concept"), m["end"].alias("end"), m["value"].alias("value")))

    possible = F.concat(*(spans(s, k) for k, c in enumerate(glossary) for s in c.surfaces))
    kind = "array<struct<rank:int,start:int,concept:int,end:int,value:string>>"
    free = lambda kept, m: ~F.exists(kept, lambda o: (m["start"] < o["end"]) & (o["start"] < m["end"]))
    chosen = F.aggregate(F.array_sort(F.array_distinct(possible)), F.array().cast(kind), lambda kept, m: F.when(free(kept, m), F.concat(kept, F.array(m))).otherwise(kept))
    return F.array_sort(F.transform(chosen, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["concept"].alias("concept"), m["value"].alias("value"))))


def expand(text: Column, glossary: list[Concept], most: int = MOST_TERMS) -> Column:
    """Terms that stand for a text's concepts, as array of (term, category, relation, reason); more than ``most`` are an error.

    Each concept found gives its canonical surface, each related concept that is not itself found its own.
    """
    ids = {c.id: k for k, c in enumerate(glossary)}
    listed = F.array(*(F.struct(F.lit(c.id).alias("id"), F.lit(c.category).alias("category"), F.lit(c.canonical).alias("canonical"), (F.array(*(F.lit(ids[r]) for r in c.related)) if c.related else F.array().cast("array<int>")).alias("related")) for c in glossary))

    def told(found: Column) -> Column:
        own = F.array_sort(F.array_distinct(F.transform(found, lambda m: m["concept"])))
        first = lambda k: F.get(F.filter(found, lambda m: m["concept"] == k), F.lit(0))["value"]
        concept = lambda k: F.get(listed, k)
        reason = lambda k: F.when(surface_key(first(k)) == surface_key(concept(k)["canonical"]), F.concat(F.lit("canonical_match:"), concept(k)["id"])).otherwise(F.concat(F.lit("equivalent_alias:"), first(k), F.lit("→"), concept(k)["canonical"]))
        term = lambda k, relation, why: F.struct(concept(k)["canonical"].alias("term"), concept(k)["category"].alias("category"), F.lit(relation).alias("relation"), why.alias("reason"))
        equal = F.transform(own, lambda k: term(k, "equivalent", reason(k)))
        pairs = F.flatten(F.transform(own, lambda k: F.transform(concept(k)["related"], lambda r: F.struct(k.alias("of"), r.alias("to")))))
        fresh = F.filter(pairs, lambda p: ~F.array_contains(own, p["to"]))
        once = F.filter(fresh, lambda p, i: F.size(F.filter(F.slice(fresh, 1, i), lambda q: q["to"] == p["to"])) == 0)
        near = F.transform(once, lambda p: term(p["to"], "related", F.concat(F.lit("related_concept:"), concept(p["of"])["canonical"], F.lit("→"), concept(p["to"])["canonical"])))
        return F.concat(equal, near)

    check = lambda terms: F.when(F.size(terms) > most, F.raise_error(F.lit(f"more than {most} terms")).cast("array<struct<term:string,category:string,relation:string,reason:string>>")).otherwise(terms)
    return bind(bind(detect(text, glossary), told), check)


def canonicalize(value: Column, glossary: list[Concept], category: str | None = None) -> Column:
    """The canonical form of a value that is a surface as a whole, of the ``category`` if one is given; else the value."""
    own = {re.sub(r"[\W_]+", "", s).lower(): c.canonical for c in glossary if category in (None, c.category) for s in c.surfaces}
    if not own:
        return value
    known = F.create_map(*(F.lit(x) for pair in own.items() for x in pair))
    return F.coalesce(F.try_element_at(known, surface_key(value)), value)


def replace_equivalents(text: Column, glossary: list[Concept]) -> Column:
    """The text in lower case with every detected surface in its canonical form and white space collapsed."""
    canonical = F.lit([c.canonical for c in glossary])

    def rebuilt(found: Column) -> Column:
        piece = lambda m, i: F.concat(F.lower(F.substring(text, F.coalesce(F.get(found, i - 1)["end"], F.lit(0)) + 1, m["start"] - F.coalesce(F.get(found, i - 1)["end"], F.lit(0)))), F.get(canonical, m["concept"]))
        last = F.coalesce(F.try_element_at(found, F.lit(-1))["end"], F.lit(0))
        return F.concat(F.array_join(F.transform(found, piece), ""), F.lower(F.substring(text, last + 1, F.char_length(text))))

    return F.trim(F.regexp_replace(bind(detect(text, glossary), rebuilt), r"\s+", " "))
