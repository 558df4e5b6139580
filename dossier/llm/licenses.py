"""Operator 1: licence scans by sentence rules.

A text is brought into normal form (lower-case words, all else a space), so wrapped lines, comment
marks and list numbers vanish.  Known licence sentences are recognised at word boundaries wherever
they stand and mapped to identifiers; the sequence of identifiers is matched against rules in their
order, each of which uses up the identifiers it matches.  Every operand of a short-form expression is a
sentence of its own.  Only DataFrame functions; each row by itself, so nothing is shuffled.

For the rules each identifier is one character.  A match begins where the last one ended and goes to the next
place of each wanted character; if it fails, no later one can succeed, so a rule reads the sequence once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.shared import bind

_GPL = "you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation either version {} of the license or at your option any later version"

#: Licence sentences in normal form, as their licences word them.
SENTENCES = {
    "apache2-name": "under the apache license version 2 0",
    "apache2-short": "apache license 2 0",
    "apache2-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache2-asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2-see": "see the license for the specific language governing permissions and limitations under the license",
    "apache2-title": "apache license version 2 0 january 2004",
    "apache2-terms": "terms and conditions for use reproduction and distribution",
    "mit-name": "under the mit license",
    "mit-title": "the mit license",
    "mit-short": "mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-asis": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "gpl3-name": "under the gnu general public license version 3",
    "gpl2-name": "under the gnu general public license version 2",
    "gpl2-only": "under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gpl2-only-of": "under the terms of version 2 of the gnu general public license as published by the free software foundation",
    "gpl3-only": "under the terms of the gnu general public license version 3 as published by the free software foundation",
    "gpl3-only-of": "under the terms of version 3 of the gnu general public license as published by the free software foundation",
    "lgpl21-only": "under the terms of the gnu lesser general public license version 2 1 as published by the free software foundation",
    "lgpl21-only-of": "under the terms of version 2 1 of the gnu lesser general public license as published by the free software foundation",
    "epl1-name": "eclipse public license v 1 0",
    "epl1-v": "eclipse public license v1 0",
    "epl2-v": "eclipse public license v2 0",
    "epl1-title": "eclipse public license version 1 0",
    "epl1-short": "eclipse public license 1 0",
    "epl2-name": "eclipse public license v 2 0",
    "epl2-title": "eclipse public license version 2 0",
    "epl2-short": "eclipse public license 2 0",
    "gpl3-title": "gnu general public license version 3 29 june 2007",
    "gpl2-title": "gnu general public license version 2 june 1991",
    "gpl3-grant": _GPL.format("general public license", "3"),
    "gpl2-grant": _GPL.format("general public license", "2"),
    "lgpl3-title": "gnu lesser general public license version 3 29 june 2007",
    "lgpl21-title": "gnu lesser general public license version 2 1 february 1999",
    "lgpl3-grant": _GPL.format("lesser general public license", "3"),
    "lgpl21-grant": _GPL.format("lesser general public license", "2 1"),
    "agpl3-title": "gnu affero general public license version 3 19 november 2007",
    "agpl3-grant": _GPL.format("affero general public license", "3"),
    "gpl-hope": "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-verbatim": "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    "mpl2-subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl2-obtain": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "mpl2-title": "mozilla public license version 2 0",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant-and": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc-asis": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "cc0-title": "cc0 1 0 universal",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "ccbync4-name": "licensed under cc by nc 4 0",
    "ccby4-name": "licensed under cc by 4 0",
    "ccbysa4-name": "licensed under cc by sa 4 0",
    "ccby4-work": "under a creative commons attribution 4 0 international license",
    "ccbysa4-work": "under a creative commons attribution sharealike 4 0 international license",
    "ccbync4-work": "under a creative commons attribution noncommercial 4 0 international license",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd2-name": "under the bsd 2 clause license",
    "bsd3-name": "under the bsd 3 clause license",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
}
#: Licences by the identifiers of the public short-form list.
SHORT_NAMES = [
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-1.0", "EPL-2.0", "GPL-2.0-only",
    "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
]
#: Names of the list that newer ones have replaced.
OLD_NAMES = {"AGPL-3.0": "AGPL-3.0-only", "GPL-2.0": "GPL-2.0-only", "GPL-3.0": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3.0": "LGPL-3.0-only"}
SPDX = "spdx license identifier "


def _plain(name: str) -> str:
    return name.lower().replace("-", " ").replace(".", " ")


SENTENCES |= {f"spdx-{n}": SPDX + _plain(n) for n in [*SHORT_NAMES, *OLD_NAMES]}
#: Rules in order.  A licence needs these identifiers in this order, others between them allowed, and
#: uses them up, so the clauses of a three-clause licence are not counted for the two-clause one again.
RULES = [
    ("Apache-2.0", ["apache2-title", "apache2-terms"]),
    ("Apache-2.0", ["apache2-header", "apache2-asis", "apache2-see"]),
    ("Apache-2.0", ["apache2-header"]),
    ("Apache-2.0", ["apache2-name"]),
    ("Apache-2.0", ["apache2-short"]),
    ("Apache-2.0", ["apache2-copy"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd3-name"]),
    ("BSD-2-Clause", ["bsd2-name"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-asis"]),
    ("MIT", ["mit-name"]),
    ("MIT", ["mit-title"]),
    ("MIT", ["mit-short"]),
    ("AGPL-3.0-only", ["agpl3-title", "gpl-verbatim"]),
    ("LGPL-3.0-only", ["lgpl3-title", "gpl-verbatim"]),
    ("LGPL-2.1-only", ["lgpl21-title", "gpl-verbatim"]),
    ("GPL-3.0-only", ["gpl3-title", "gpl-verbatim"]),
    ("GPL-2.0-only", ["gpl2-title", "gpl-verbatim"]),
    ("AGPL-3.0-or-later", ["agpl3-grant", "gpl-hope"]),
    ("AGPL-3.0-or-later", ["agpl3-grant"]),
    ("LGPL-3.0-or-later", ["lgpl3-grant", "gpl-hope"]),
    ("LGPL-3.0-or-later", ["lgpl3-grant"]),
    ("LGPL-2.1-or-later", ["lgpl21-grant", "gpl-hope"]),
    ("LGPL-2.1-or-later", ["lgpl21-grant"]),
    ("GPL-3.0-or-later", ["gpl3-grant", "gpl-hope"]),
    ("GPL-3.0-or-later", ["gpl3-grant"]),
    ("GPL-2.0-or-later", ["gpl2-grant", "gpl-hope"]),
    ("GPL-2.0-or-later", ["gpl2-grant"]),
    ("GPL-3.0-only", ["gpl3-name"]),
    ("GPL-2.0-only", ["gpl2-name"]),
    ("GPL-2.0-only", ["gpl2-only"]),
    ("GPL-2.0-only", ["gpl2-only-of"]),
    ("GPL-3.0-only", ["gpl3-only"]),
    ("GPL-3.0-only", ["gpl3-only-of"]),
    ("LGPL-2.1-only", ["lgpl21-only"]),
    ("LGPL-2.1-only", ["lgpl21-only-of"]),
    *((name, [f"epl{n}-{kind}"]) for name, n in (("EPL-1.0", 1), ("EPL-2.0", 2)) for kind in ("name", "v", "title", "short")),
    ("MPL-2.0", ["mpl2-subject", "mpl2-obtain"]),
    ("MPL-2.0", ["mpl2-title"]),
    ("ISC", ["isc-grant", "isc-asis"]),
    ("ISC", ["isc-grant-and", "isc-asis"]),
    ("0BSD", ["0bsd-grant", "isc-asis"]),
    ("CC0-1.0", ["cc0-title"]),
    ("Unlicense", ["unlicense-free", "unlicense-anyone"]),
    ("CC-BY-4.0", ["ccby4-name"]),
    ("CC-BY-4.0", ["ccby4-work"]),
    ("CC-BY-NC-4.0", ["ccbync4-name"]),
    ("CC-BY-NC-4.0", ["ccbync4-work"]),
    ("CC-BY-SA-4.0", ["ccbysa4-name"]),
    ("CC-BY-SA-4.0", ["ccbysa4-work"]),
    ("BSL-1.0", ["boost-grant"]),
    ("Zlib", ["zlib-grant"]),
    *((n, [f"spdx-{n}"]) for n in SHORT_NAMES),
    *((n, [f"spdx-{old}"]) for old, n in OLD_NAMES.items()),
]
_NAMES = "|".join(sorted(map(_plain, [*SHORT_NAMES, *OLD_NAMES]), key=lambda n: (-len(n), n)))
_EXCEPTION = "(?:with (?:[a-z0-9]+ ){1,5}?(?:exception|note) (?:[0-9] )*)?"
#: A name of a short-form expression, after its mark or after another operand.
OPERAND = rf"({_NAMES}) {_EXCEPTION}"
#: Before words are taken: the plus of an old short-form name.
PLUS = (r"(gpl-[0-9][.][0-9])[+]", "{}1-or-later")
#: Words in which copies of one sentence differ, and what stands for them: secure links and the name of a holder.
VARIANTS = [(r"\bhttps ", "http "), (r"neither the name (?:of )?(?:[^ ]+ ){1,12}?nor the names of (?:its|their) contributors", "neither the name of the holder nor the names of its contributors")]
#: Every known sentence holds one of these stems; other texts need no normal form.
STEMS = "licen|permi|redistribut|provided|unencumbered|anyone is free|cc0|terms and conditions"
#: The known sentences, longer ones first, so the longest that begins at a word is taken.  A sentence ends where a word does.
KNOWN = "|".join(sorted(SENTENCES.values(), key=lambda s: (-len(s), s)))


def normal_form(text: Column) -> Column:
    """Lower-case words with a space before and after each word; each operand of a short-form expression gets the expression's mark."""
    words = F.regexp_replace(F.lower(text), PLUS[0], PLUS[1].format("$"))
    words = F.concat(F.lit(" "), F.regexp_replace(words, "[^a-z0-9]+", " "), F.lit(" "))
    for pattern, standard in VARIANTS:
        words = F.regexp_replace(words, pattern, standard)
    return F.regexp_replace(words, rf"(?:{SPDX}|\G(?<!^)(?:or|and) ){OPERAND}", f"{SPDX}$1 ")


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order, repeats included.

    Sentences do not overlap: reading goes on after the end of the last one.
    """
    identifier = F.create_map(*(F.lit(x) for name, sentence in SENTENCES.items() for x in (sentence, name)))
    found = F.regexp_extract_all(normal_form(text), F.lit(rf"\b({KNOWN})\b"), F.lit(1))
    return F.when(F.lower(text).rlike(STEMS), F.transform(found, lambda s: F.try_element_at(identifier, s))).otherwise(F.array().cast("array<string>"))


#: One character for each identifier, from the private range.
MARKS = {name: chr(0xE000 + k) for k, name in enumerate(SENTENCES)}


def _rule(ids: list[str], begin: str, keep: str, mark: str) -> tuple[str, str]:
    """A rule as a pattern over marks, and what is left when its identifiers are used up."""
    marks = [MARKS[i] for i in ids]
    gaps = [f"([^{m}]*{keep})" for m in (marks if begin else marks[1:])]
    pattern = "".join(g + m for g, m in zip(gaps, marks)) if begin else marks[0] + "".join(g + m for g, m in zip(gaps, marks[1:]))
    return begin + pattern, "".join(f"{mark}{k + 1}" for k in range(len(gaps)))


def licences(ids: Column) -> Column:
    """Names of the licences whose rules the identifier sequence meets, ascending and distinct.

    Rules are tried in their order; what a rule matches is used up, whatever stands between stays.
    """
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(p).alias("pattern"), F.lit(rest).alias("rest")) for name, (p, rest) in ((n, _rule(r, r"\G", "+", "$")) for n, r in RULES)))
    # the wanted identifiers are few, so only rules whose first identifier is there are tried
    firsts = F.array(*(F.lit(r[0]) for _, r in RULES))
    usable = F.filter(rules, lambda _, k: F.array_contains(ids, F.get(firsts, k)))
    mark = F.create_map(*(F.lit(x) for pair in MARKS.items() for x in pair))
    whole = F.array_join(F.transform(ids, lambda i: F.try_element_at(mark, i)), "")

    def step(acc: Column, rule: Column) -> Column:
        left = F.regexp_replace(acc["left"], rule["pattern"], rule["rest"])
        return bind(left, lambda now: F.struct(now.alias("left"), F.when(F.length(now) < F.length(acc["left"]), F.concat(acc["names"], F.array(rule["name"]))).otherwise(acc["names"]).alias("names")))

    none = F.array().cast("array<string>")
    found = F.aggregate(usable, F.struct(whole.alias("left"), none.alias("names")), step, lambda acc: acc["names"])
    return F.when(F.size(ids) == 0, none).otherwise(F.array_sort(F.array_distinct(found)))


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, sentence_ids, licences)`` for every row.

    Null and empty texts have neither; ids (null or repeated) and the number of rows stay as they
    are; an empty table gives none; other columns are not read, whatever their names.  Very long
    texts take time in proportion to their length; sentences of several licences that begin at one
    word (a tie) give the longest.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), sentence_ids(text).alias("sentence_ids"))
    return rows.select("doc_id", "sentence_ids", licences(F.col("sentence_ids")).alias("licences"))


def oracle() -> str:
    """DuckDB SQL for the registered query: sentences by one alternation, rules one after the other."""
    quoted = lambda s: "'" + s + "'"
    mapped = lambda pairs: "map {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in pairs) + "}"
    words = f"regexp_replace(lower(coalesce(text, '')), {quoted(PLUS[0])}, {quoted(PLUS[1].format(chr(92)))}, 'g')"
    words = f"' ' || regexp_replace({words}, '[^a-z0-9]+', ' ', 'g') || ' '"
    for pattern, standard in VARIANTS:
        words = f"regexp_replace({words}, {quoted(pattern)}, {quoted(standard)}, 'g')"
    for _ in range(4):  # as many operands after the first
        words = f"regexp_replace({words}, {quoted(f'({SPDX}(?:{_NAMES})) {_EXCEPTION}(?:or|and) ({_NAMES}) ')}, {quoted(chr(92) + f'1 {SPDX}' + chr(92) + '2 ')}, 'g')"
    left, met, steps = "s0", [], []
    for k, (name, ids) in enumerate(RULES):
        pattern, rest = _rule(ids, "", "", "\\")
        steps.append(f"r{k} AS (SELECT *, regexp_replace({left}, {quoted(pattern)}, {quoted(rest)}, 'g') AS s{k + 1} FROM {f'r{k - 1}' if k else 'whole'})")
        met.append(f"CASE WHEN s{k} != s{k + 1} THEN {quoted(name)} END")
        left = f"s{k + 1}"
    return f"""
WITH named AS (SELECT doc_id, CASE WHEN regexp_matches(lower(coalesce(text, '')), '{STEMS}') THEN list_transform(regexp_extract_all({words}, '\\b({KNOWN})\\b', 1), lambda x: {mapped((t, n) for n, t in SENTENCES.items())}[x]) ELSE [] END AS ids FROM documents),
whole AS (SELECT doc_id, ids, array_to_string(list_transform(ids, lambda x: {mapped(MARKS.items())}[x]), '') AS s0 FROM named),
{", ".join(steps)}
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ',') AS sentence_ids,
       array_to_string(list_sort(list_distinct([{', '.join(met)}])), ',') AS licences
FROM r{len(RULES) - 1}"""
