"""Speaker labels to name, role and organization; validity of names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Role words of labels, in the order in which they are tried where several fit.
ROLES = [
    "소위원장", "위원장", "간사", "위원", "의원", "장관", "차관", "처장", "처장권한대행", "청장", "은행장", "원장", "실장", "국장", "의사국장", "사무처장", "과장", "수석전문위원", "전문위원", "의장", "부의장", "국무총리", "진술인",
]
#: Characters of names, and last characters that betray the beginning of spoken text.
NAME = "[가-힣·]"
RESIDUE = "맙녕갑압후럼"


def split_label(label: Column, roles: list[str] = ROLES, name: str = NAME, residue: str = RESIDUE, usual: int = 3, most: int = 12, noisy: str = r"[가-힣?!]") -> Column:
    """A struct of name, role and organization; the first rule that fits a label decides, and without one all of it is the name.

    ``usual`` is the length of a name where nothing marks its end, ``most`` the longest marked one.  A role
    with a tail longer than a name is taken to have the first words spoken after it.
    """
    flat = F.regexp_replace(F.trim(F.regexp_replace(label, r"\s+", " ")), r"^[()（）]+|[()（）]+$", "")
    longest = "|".join(sorted(roles, key=len, reverse=True))
    given = "|".join(roles)
    short, full = f"{name}{{2,{usual + 1}}}", f"{name}{{2,{most}}}"
    #: pattern and the groups of name, role and organization (0 for none)
    rules = [
        (rf"^({given})(?=\S{{{usual + 2},}}$|\S{{{usual}}}[{residue}]$)(\S{{{usual}}})\S+$", 2, 1, 0),
        (rf"^(.+?)\s+({longest})\s+({full})$", 3, 2, 1),
        (rf"^({longest})\s*({full})$", 2, 1, 0),
        (rf"^({full}?)\s*({longest})$", 1, 2, 0),
        (rf"^(.+?)({longest})\s*({short})$", 3, 2, 1),
        (rf"^({short})({longest}){noisy}{{1,{most}}}$", 1, 2, 0),
        (rf"^({longest})({short}){noisy}{{1,{most}}}$", 2, 1, 0),
        (rf"^({given})\s*(\S{{{usual}}})\S+$", 2, 1, 0),
        (rf"^(\S{{2,{usual + 1}}}?)({given})\S.*$", 1, 2, 0),
    ]
    part = lambda pattern, k: F.nullif(F.trim(F.regexp_extract(flat, pattern, k)), F.lit("")) if k else F.lit(None).cast("string")
    as_struct = lambda n, r, o: F.struct(n.alias("name"), r.alias("role"), o.alias("organization"))
    none = F.lit(None).cast("string")
    out = as_struct(F.regexp_replace(flat, r"\s+", ""), none, none)
    for pattern, n, r, o in reversed(rules):
        out = F.when(flat.rlike(pattern), as_struct(F.regexp_replace(part(pattern, n), r"\s+", ""), part(pattern, r), part(pattern, o))).otherwise(out)
    return out


def valid_name(name: Column, pattern: str = "[가-힣]{2,5}", invalid: list[str] = (), endings: list[str] = ()) -> Column:
    """Whether a value is one whole name: of the right characters, no word that is none, without an ending that names have not."""
    ends = F.lit(False)
    for e in endings:
        ends = ends | name.endswith(e)
    return F.coalesce(name.rlike(f"^(?:{pattern})$") & ~name.isin(*invalid, "") & ~ends, F.lit(False))


def suspect_name(name: Column, pattern: str = "[가-힣·]{2,5}", longest: int = 5, roles: list[str] = ("위원", "의원", "장관", "위원장", "처장", "국장")) -> Column:
    """Whether a speaker's name looks misread: too long, with a role in it, or of other characters than names have."""
    held = F.lit(False)
    for r in roles:
        held = held | F.contains(name, F.lit(r))
    return F.coalesce((F.char_length(name) > longest) | held | ~name.rlike(f"^(?:{pattern})$"), F.lit(True))
