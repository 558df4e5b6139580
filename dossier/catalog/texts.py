"""Text and segmentation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions import text
from dossier.functions.labels import split_label, suspect_name, valid_name
from dossier.functions.terminology import Concept, canonicalize, expand, replace_equivalents
from dossier.operators.segmentation import parse_quality, segment
from dossier.registry import query
from dossier.views import Tables


@query("txt_normalize", r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS text FROM documents""")
def txt_normalize(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", text.normalize(F.col("text")).alias("text"))


@query("txt_match_key", r"SELECT doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') AS key FROM documents")
def txt_match_key(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", text.match_key(F.col("text")).alias("key"))


@query("txt_exact_numbers", r"SELECT k, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(note, '[^0-9]+'), lambda x: length(x) = 7))), ',') AS numbers FROM (SELECT o_orderkey AS k, 'bill ' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') || ', see ' || CAST(o_custkey + 1000000 AS VARCHAR) || ' and 12345678' AS note FROM orders)")
def txt_exact_numbers(t: Tables) -> DataFrame:
    note = F.concat(F.lit("bill "), F.lpad(F.col("o_orderkey").cast("string"), 7, "0"), F.lit(", see "), (F.col("o_custkey") + 1000000).cast("string"), F.lit(" and 12345678"))
    return t.raw("orders").select(F.col("o_orderkey").alias("k"), F.array_join(text.exact_numbers(note), ",").alias("numbers"))


GLOSSARY = [
    Concept("ringlet", "tool", "ringlet", ["small ring"], ["ring"]), Concept("ring", "tool", "ring", ["hoop"], ["bolt"]), Concept("widget", "tool", "widget", ["gadget"], ["bolt", "ring"]),
    Concept("bolt", "tool", "bolt", ["screw"]), Concept("red", "colour", "red", ["crimson"]), Concept("builders", "committee", "construction committee", ["building"]), Concept("homes", "committee", "home committee", ["house hold"]),
]
#: Part names with other separators, in capitals, and with more said.
NAMES_SQL = """named AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, ' ', '-') WHEN 2 THEN p_name || '  and Crimson hoop (small/ring), ringing' ELSE upper(p_name) END AS t FROM part)"""
FOUND_SQL = r"""found AS (SELECT p_partkey, t, list_transform(regexp_extract_all(t, '(?i)\b(small[\s._·()/\-]*ring|ringlet|widget|gadget|crimson|screw|bolt|ring|hoop|red)\b', 1), lambda x: regexp_replace(lower(x), '[^a-z]', '', 'g')) AS keys FROM named),
  concepts AS (SELECT *, list_distinct(list_transform(keys, lambda k: CASE k WHEN 'smallring' THEN 'ringlet' WHEN 'hoop' THEN 'ring' WHEN 'gadget' THEN 'widget' WHEN 'screw' THEN 'bolt' WHEN 'crimson' THEN 'red' ELSE k END)) AS own FROM found)"""


def named_parts(t: Tables) -> DataFrame:
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    told = F.when(k == 0, name).when(k == 1, F.regexp_replace(name, " ", "-")).when(k == 2, F.concat(name, F.lit("  and Crimson hoop (small/ring), ringing"))).otherwise(F.upper(name))
    return t.raw("part").select("p_partkey", told.alias("t"))


@query("txt_glossary_expand", f"WITH {NAMES_SQL}, {FOUND_SQL}, near AS (SELECT p_partkey, own, unnest(own) AS c FROM concepts), r AS (SELECT p_partkey, own, unnest(CASE c WHEN 'ringlet' THEN ['ring'] WHEN 'ring' THEN ['bolt'] WHEN 'widget' THEN ['bolt', 'ring'] ELSE [] END) AS term FROM near) SELECT p_partkey, c AS term, 'equivalent' AS relation FROM near UNION SELECT p_partkey, term, 'related' FROM r WHERE NOT list_contains(own, term)")
def txt_glossary_expand(t: Tables) -> DataFrame:
    """The concepts that a name speaks of, and related ones that it does not name itself."""
    return named_parts(t).select("p_partkey", F.explode(expand(F.col("t"), GLOSSARY)).alias("e")).select("p_partkey", "e.term", "e.relation")


@query("txt_canonicalize", "SELECT c_custkey, CASE lower(trim(seg)) WHEN 'building' THEN 'construction committee' WHEN 'household' THEN 'home committee' ELSE seg END AS canonical FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'Red' WHEN c_custkey % 5 = 1 THEN ' ' || lower(c_mktsegment) ELSE c_mktsegment END AS seg FROM customer)")
def txt_canonicalize(t: Tables) -> DataFrame:
    """Whole values of the committees' category alone: a colour stays as it is."""
    segment_ = F.when(F.col("c_custkey") % 5 == 0, "Red").when(F.col("c_custkey") % 5 == 1, F.concat(F.lit(" "), F.lower("c_mktsegment"))).otherwise(F.col("c_mktsegment"))
    return t.raw("customer").select("c_custkey", canonicalize(segment_, GLOSSARY, "committee").alias("canonical"))


@query("txt_replace_equivalents", rf"WITH {NAMES_SQL} SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(t), '\bsmall[\s._·()/\-]*ring\b', 'ringlet', 'g'), '\bhoop\b', 'ring', 'g'), '\bgadget\b', 'widget', 'g'), '\bscrew\b', 'bolt', 'g'), '\bcrimson\b', 'red', 'g'), '\s+', ' ', 'g')) AS text FROM named")
def txt_replace_equivalents(t: Tables) -> DataFrame:
    return named_parts(t).select("p_partkey", replace_equivalents(F.col("t"), GLOSSARY).alias("text"))


@query(
    "txt_phrases",
    r"""WITH w AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: x NOT IN ('the', 'of', 'and') AND length(x) >= 2 AND NOT regexp_matches(x, '^[0-9]+$')) AS k FROM benchmark)
    SELECT item_id, CAST(len(list_distinct(list_concat(list_concat(CASE WHEN len(k) >= 3 THEN list_transform(generate_series(1, len(k) - 2), lambda i: k[i] || k[i + 1] || k[i + 2]) ELSE [] END, CASE WHEN len(k) >= 2 THEN list_transform(generate_series(1, len(k) - 1), lambda i: k[i] || k[i + 1]) ELSE [] END), k))) AS BIGINT) AS n,
    CASE WHEN len(k) >= 3 THEN k[1] || k[2] || k[3] WHEN len(k) = 2 THEN k[1] || k[2] ELSE k[1] END AS first FROM w""",
)
def txt_phrases(t: Tables) -> DataFrame:
    own = t.raw("benchmark").select("item_id", text.phrases(text.tokens(F.col("text")), ["the", "of", "and"]).alias("p"))
    return own.select("item_id", F.size("p").cast("long").alias("n"), F.get("p", F.lit(0)).alias("first"))


def transcripts(t: Tables, turns: DataFrame | None = None) -> DataFrame:
    """Conversations joined again as transcript pages of three turns each, a marker line a turn; every fourth has agenda headings before it."""
    line = F.concat(F.lit("○"), "role", F.lit(" "), F.lpad(F.col("seq").cast("string"), 2, "0"), F.lit(" "), "text")
    if turns is not None:
        line = F.when(F.col("marked"), line).otherwise(F.substring(line, 2, 1 << 30))
    one, two = F.concat(F.lit("1. item "), F.col("seq").cast("string"), F.lit("\n")), F.lit("4. first matter\n5. second matter\n")
    heads = F.concat(F.when(F.col("seq") % 4 == 2, F.when(F.col("group_id") % 3 == 1, two).otherwise(one)).otherwise(""), line)
    page = (F.floor(F.col("seq") / 3) + 1).cast("long")
    pages = (t.turns if turns is None else turns).select("group_id", page.alias("page"), F.struct("seq", heads.alias("l")).alias("x")).groupBy("group_id", "page").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return pages.select(F.col("group_id").alias("doc"), "page", F.array_join(F.transform("xs", lambda x: x["l"]), "\n").alias("text"))


@query("txt_segment_turns", "SELECT group_id AS doc, row_number() OVER (PARTITION BY group_id ORDER BY seq) AS turn, role || ' ' || lpad(CAST(seq AS VARCHAR), 2, '0') AS label, trim(text) AS body FROM turns WHERE trim(text) != ''")
def txt_segment_turns(t: Tables) -> DataFrame:
    """A round trip: segmenting the transcripts gives the turns back."""
    turns, _ = segment(transcripts(t))
    return turns.select("doc", "turn", "label", "body")


@query("txt_segment_failures", "SELECT group_id AS doc, CAST(0 AS BIGINT) AS turn, 'long_prefix' AS reason FROM meetings WHERE group_id % 4 = 1 UNION ALL SELECT group_id, row_number() OVER (PARTITION BY group_id ORDER BY seq), 'empty_body' FROM (SELECT * FROM turns QUALIFY seq = max(seq) OVER (PARTITION BY group_id)) WHERE false")
def txt_segment_failures(t: Tables) -> DataFrame:
    """Transcripts that begin with much text before the first speaker are reported, unless an agenda heading is in it."""
    before = F.when(F.col("doc") % 4 == 1, F.repeat(F.lit("words of a cover page "), 6)).when(F.col("doc") % 4 == 2, F.concat(F.repeat(F.lit("words of a cover page "), 6), F.lit("\n3. a matter"))).when(F.col("doc") % 4 == 3, "short cover").otherwise("")
    first = F.col("page") == F.min("page").over(Window.partitionBy("doc"))
    pages = transcripts(t).withColumn("text", F.when(first & (before != ""), F.concat(before, F.lit("\n"), "text")).otherwise(F.col("text")))
    _, failures = segment(pages)
    return failures


@query("txt_stitch_pages", "WITH p AS (SELECT group_id, seq, seq // 3 + 1 AS page FROM turns) SELECT group_id AS doc, row_number() OVER (PARTITION BY group_id ORDER BY seq) AS turn, CASE WHEN seq % 3 = 2 AND EXISTS (SELECT 1 FROM p q WHERE q.group_id = p.group_id AND q.page = p.page + 1) THEN CAST(page AS VARCHAR) || '|' || CAST(page + 1 AS VARCHAR) ELSE CAST(page AS VARCHAR) END AS pages FROM p")
def txt_stitch_pages(t: Tables) -> DataFrame:
    """Every later page begins with a line that goes on with the last turn of the page before."""
    pages = transcripts(t).withColumn("text", F.regexp_replace("text", r"(?m)^[0-9]\. (?:item [0-9]+|\w+ matter)\n", ""))
    carried = pages.withColumn("text", F.when(F.col("page") > 1, F.concat(F.lit("goes on\n"), "text")).otherwise(F.col("text")))
    turns, _ = segment(carried)
    return turns.select("doc", "turn", "pages")


@query("txt_agenda_ffill", "SELECT group_id AS doc, row_number() OVER (PARTITION BY group_id ORDER BY seq) AS turn, last_value(CASE WHEN seq % 4 = 2 THEN CASE WHEN group_id % 3 = 1 THEN 'items 4..5 jointly' ELSE '1. item ' || CAST(seq AS VARCHAR) END END IGNORE NULLS) OVER (PARTITION BY group_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS agenda FROM turns")
def txt_agenda_ffill(t: Tables) -> DataFrame:
    """The agenda that was last announced, as segmentation carries it on; several headings between two speakers are taken jointly."""
    turns, _ = segment(transcripts(t))
    return turns.select("doc", "turn", "agenda")


@query("txt_agenda_entities", "SELECT lpad(CAST(l_partkey AS VARCHAR), 7, '0') AS number, max_by(p_name, (l_orderkey, l_linenumber, l_suppkey)) AS title, max_by(s_name, (l_orderkey, l_linenumber, l_suppkey)) AS proposer FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def txt_agenda_entities(t: Tables) -> DataFrame:
    """Agenda lines such as "3. title (proposer)(number 0000012)" give entities; the last line of a number counts."""
    rows = t.raw("lineitem").join(t.raw("part"), F.col("l_partkey") == F.col("p_partkey")).join(t.raw("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    line = F.concat(F.col("l_linenumber").cast("string"), F.lit(". "), "p_name", F.lit(" ("), "s_name", F.lit(")(number "), F.lpad(F.col("l_partkey").cast("string"), 7, "0"), F.lit(")"))
    pattern = r"^[0-9]+\.\s+(.+?)\s+\(([^()]*)\)\(number ([0-9]{7})\)$"
    part = lambda k: F.regexp_extract("line", pattern, k)
    named = rows.select(line.alias("line"), F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("at")).select(part(3).alias("number"), part(1).alias("title"), part(2).alias("proposer"), "at")
    return named.where("number != ''").groupBy("number").agg(F.max_by("title", "at").alias("title"), F.max_by("proposer", "at").alias("proposer"))


LABEL_ROLES = ["chair", "minister", "member"]


@query("txt_split_label", "SELECT c_custkey, c_name AS name, CASE c_custkey % 6 WHEN 0 THEN 'minister' WHEN 1 THEN 'chair' WHEN 2 THEN 'member' WHEN 3 THEN 'minister' WHEN 4 THEN 'chair' END AS role, CASE WHEN c_custkey % 6 IN (0, 3) THEN c_mktsegment END AS organization FROM customer")
def txt_split_label(t: Tables) -> DataFrame:
    """Labels in six forms, the last without a role, split by the ordered cascade, once for each distinct label."""
    k, name, org = F.col("c_custkey") % 6, F.col("c_name"), F.col("c_mktsegment")
    label = (
        F.when(k == 0, F.concat(org, F.lit(" minister "), name)).when(k == 1, F.concat(F.lit("(chair  "), name, F.lit(")"))).when(k == 2, F.concat(name, F.lit(" member")))
        .when(k == 3, F.concat(org, F.lit("minister "), name)).when(k == 4, F.concat(F.lit("chair"), name, F.lit("Thank"))).otherwise(name)
    )
    people = t.raw("customer").select("c_custkey", label.alias("label"))
    split = people.select("label").distinct().withColumn("parts", split_label(F.col("label"), LABEL_ROLES, "[A-Za-z#0-9]", "!", 18, 30, r"[A-Za-z?!]"))
    return people.join(split, "label").select("c_custkey", "parts.name", "parts.role", "parts.organization")


@query("txt_member_name", "SELECT s_suppkey, regexp_matches(n, '^[A-Za-z]+#[0-9]+$') AND NOT suffix(n, '00') AS valid, length(n) > 18 OR contains(n, 'minister') OR contains(n, 'chair') OR NOT regexp_matches(n, '^[A-Za-z]+#[0-9]{2,12}$') AS suspect FROM (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 1 THEN 'minister' WHEN 2 THEN s_name || ' chair' WHEN 3 THEN 'X' ELSE s_name END AS n FROM supplier)")
def txt_member_name(t: Tables) -> DataFrame:
    k, name = F.col("s_suppkey") % 5, F.col("s_name")
    told = F.when(k == 1, "minister").when(k == 2, F.concat(name, F.lit(" chair"))).when(k == 3, "X").otherwise(name)
    return t.raw("supplier").select("s_suppkey", valid_name(told, "[A-Za-z]+#[0-9]+", ["minister"], ["00"]).alias("valid"), suspect_name(told, "[A-Za-z]+#[0-9]{2,12}", 18, ["minister", "chair"]).alias("suspect"))


@query("txt_split_names", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_name || '|' || c_mktsegment END AS names FROM customer")
def txt_split_names(t: Tables) -> DataFrame:
    raw = F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit(" et al. 12"))).otherwise(F.concat("c_name", F.lit(", https://x.example/a ; "), "c_mktsegment", F.lit(",")))
    return t.raw("customer").select("c_custkey", F.array_join(text.split_names(raw), "|").alias("names"))


@query("txt_integrity", "SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(strlen(text) AS BIGINT) AS bytes, sha256(text) AS digest FROM documents")
def txt_integrity(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", F.char_length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("digest"))


@query("dt_parse_any", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 != 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders")
def dt_parse_any(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    formats = F.when(k % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k % 4 == 1, F.date_format("o_orderdate", "yyyy.MM.dd")).when(k % 4 == 2, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    first = F.when(k % 7 == 0, "soon").when(k % 3 == 0, " ").otherwise(formats)
    return t.raw("orders").select("o_orderkey", first.alias("a"), F.when(k % 7 == 0, "1997-13-45").otherwise(formats).alias("b")).select("o_orderkey", text.parse_any_date(F.col("a"), F.col("b")).alias("day"))


#: Every fourth conversation of three turns or more loses the mark of its third turn, every fourth gets a turn of its first's label more.
QUALITY_SQL = """sized AS (SELECT group_id AS doc, count(*) AS n FROM turns WHERE trim(text) != '' GROUP BY 1), q AS (SELECT doc, n AS expected, CASE WHEN doc % 4 = 1 AND n >= 3 THEN n - 1 WHEN doc % 4 = 3 THEN n + 1 ELSE n END AS parsed, CASE WHEN doc % 4 = 1 AND n >= 3 THEN 2 ELSE n END AS correct, CASE WHEN doc % 4 = 3 THEN 1 ELSE 0 END AS repeated FROM sized)"""


def damaged(t: Tables) -> DataFrame:
    turns = t.turns.where(F.trim("text") != "").select("group_id", "seq", "role", "text", (~((F.col("group_id") % 4 == 1) & (F.col("seq") == 2))).alias("marked"))
    pages = transcripts(t, turns)
    last = F.col("page") == F.max("page").over(Window.partitionBy("doc"))
    return pages.withColumn("text", F.when(last & (F.col("doc") % 4 == 3), F.concat("text", F.lit("\n○user 00 again"))).otherwise(F.col("text")))


@query("ag_parse_quality", f"WITH {QUALITY_SQL}, firsts AS (SELECT group_id AS doc, min_by(role, seq) AS role FROM turns GROUP BY 1) SELECT doc, expected, parsed, CAST(correct AS BIGINT) AS correct, CAST(CASE WHEN repeated = 1 AND role = 'user' THEN 1 ELSE 0 END AS BIGINT) AS duplicates, round(correct / parsed, 6) AS precision, round(correct / expected, 6) AS recall, round(2 * correct / (expected + parsed), 6) AS f1 FROM q JOIN firsts USING (doc)")
def ag_parse_quality(t: Tables) -> DataFrame:
    """Parsed turns of transcripts, some of them damaged, against the golden ones, by position."""
    turns, _ = segment(damaged(t))
    golden = t.turns.where(F.trim("text") != "").select(F.col("group_id").alias("doc"), F.row_number().over(Window.partitionBy("group_id").orderBy("seq")).cast("long").alias("turn"), F.concat("role", F.lit(" "), F.lpad(F.col("seq").cast("string"), 2, "0")).alias("label"))
    return parse_quality(golden, turns.select("doc", "turn", "label"))
