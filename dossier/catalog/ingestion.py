"""Source and sink queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions.text import stable_id
from dossier.operators import corpus
from dossier.scratch import shared_folder
from dossier.registry import query
from dossier.sources import pages
from dossier.views import PAGE_SIZE, Tables


@query("src_envelope", "SELECT dataset, year, page, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys, max(total) AS total FROM source_rows WHERE NOT (year = 1996) AND year != 1999 GROUP BY 1, 2, 3")
def src_envelope(t: Tables) -> DataFrame:
    """Pages written as envelopes and decoded again; 1996 answers no data, 1999 an error code."""
    row = F.create_map(F.lit("ID"), F.col("o_orderkey").cast("string"), F.lit("CUSTOMER"), F.col("o_custkey").cast("string"))
    bundled = t.source_rows.groupBy("dataset", "year", "page", "total").agg(F.to_json(F.collect_list(row)).alias("rows"))
    code = F.when(F.col("year") == 1996, pages.NO_DATA).when(F.col("year") == 1999, "ERROR-300").otherwise(pages.OK)
    body = F.format_string('{"d":[{"head":[{"list_total_count":%d},{"RESULT":{"CODE":"%s","MESSAGE":"m"}}]},{"row":%s}]}', "total", code, "rows")
    decoded = pages.decode_envelopes(bundled.select("dataset", "year", "page", body.alias("value")), "d")
    ids = F.col("fields")["ID"].cast("long")
    return decoded.where("error is null").groupBy("dataset", "year", "page").agg(F.count("*").alias("rows"), F.sum(ids).alias("keys"), F.max("total").alias("total"))


COHERENCE_SQL = """
  w AS (SELECT dataset, year, content, n_rows, count(*) AS copies FROM source_pages GROUP BY ALL), r AS (SELECT dataset, year, max(copies) AS copies FROM w GROUP BY 1, 2),
  s AS (SELECT dataset, year, count(DISTINCT total) AS totals, max(total) AS tm, count(*) AS n_pages, count(DISTINCT page) AS dp, min(page) AS a, max(page) AS b, CAST(sum(n_rows) AS BIGINT) AS rows,
    sum(CAST(n_rows != CASE WHEN page < ceil(total / 100) THEN 100 ELSE total - (ceil(total / 100) - 1) * 100 END AS INT)) AS short FROM source_pages GROUP BY 1, 2),
  verdicts AS (SELECT dataset, year, n_pages, rows, tm AS total, concat_ws(',', CASE WHEN totals > 1 THEN 'total_changed' END, CASE WHEN n_pages > dp THEN 'duplicate_page' END, CASE WHEN a != 1 OR b != ceil(tm / 100) OR dp < ceil(tm / 100) THEN 'missing_page' END,
    CASE WHEN short > 0 THEN 'wrong_row_count' END, CASE WHEN copies > 1 THEN 'repeated_page' END) AS reasons FROM s JOIN r USING (dataset, year))"""


@query("src_page_coherence", f"WITH {COHERENCE_SQL} SELECT *, reasons = '' AS coherent FROM verdicts")
def src_page_coherence(t: Tables) -> DataFrame:
    return pages.page_coherence(t.source_pages, ["dataset", "year"], PAGE_SIZE)


@query("src_expand_pages", "SELECT dataset, year, total, unnest(generate_series(2, CAST(ceil(total / 100) AS BIGINT))) AS page FROM (SELECT DISTINCT dataset, year, total FROM source_rows)")
def src_expand_pages(t: Tables) -> DataFrame:
    return pages.expand_pages(t.source_rows.select("dataset", "year", "total").distinct(), PAGE_SIZE)


@query("src_norm_meeting", """WITH k AS (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY 1) SELECT 'meeting-' || CASE WHEN conv_id % 11 != 6 THEN CAST(conv_id AS VARCHAR) ELSE 'h' || sha256('https://records.example.org/' || CAST(conv_id AS VARCHAR) || chr(31) || CAST(DATE '2020-01-01' + CAST(conv_id % 1500 AS INTEGER) AS VARCHAR) || chr(31) || 'session of ' || CAST(turns AS VARCHAR))[1:16] END AS meeting_id,
  DATE '2020-01-01' + CAST(conv_id % 1500 AS INTEGER) AS held_on, conv_id % 4 + 18 AS term, CASE WHEN conv_id % 2 = 0 THEN 'committee ' || CAST(conv_id % 7 AS VARCHAR) ELSE 'subcommittee' END AS committee, CASE WHEN conv_id % 2 = 1 THEN 'subcommittee' ELSE 'committee' END AS kind FROM k""")
def src_norm_meeting(t: Tables) -> DataFrame:
    """Rows as three sources name their fields, written as JSON and read again as strings; some have no identifier."""
    k = F.col("group_id")
    form = F.when(k % 3 == 0, F.date_format("held_on", "yyyy-MM-dd")).when(k % 3 == 1, F.date_format("held_on", "yyyy.MM.dd")).otherwise(F.date_format("held_on", "yyyyMMdd"))
    sizes = t.turns.groupBy("group_id", "held_on", "committee", "term").agg(F.count("*").alias("turns"))
    raw = sizes.select(
        F.when(k % 2 == 0, F.concat(F.lit(" "), "committee", F.lit(" "))).otherwise("").alias("COMM_NAME"), F.when(k % 2 == 1, F.lit("subcommittee")).alias("SB_CMIT_NM"), F.concat(F.lit("term no. "), F.col("term").cast("string")).alias("ERACO"),
        F.when(k % 5 == 0, form).otherwise(" ").alias("CONF_DATE"), F.when(k % 5 != 0, form).alias("CONF_DT"), F.when(k % 11 != 6, k.cast("string")).otherwise(" ").alias("CONF_ID"),
        F.concat(F.lit("session of "), F.col("turns").cast("string")).alias("TITLE"), F.concat(F.lit("https://records.example.org/"), k.cast("string")).alias("DOWN_URL"),
    )
    read = raw.select(F.from_json(F.to_json(F.struct("*")), raw.schema).alias("r")).select("r.*")
    return pages.normalize_meetings(read).select("meeting_id", "held_on", "term", "committee", "kind")


NORM_BILL_SQL = "n AS (SELECT CASE WHEN CAST(number AS BIGINT) % 10 != 3 THEN number END AS number, CASE WHEN CAST(number AS BIGINT) % 12 != 5 THEN name END AS name, CASE WHEN CAST(number AS BIGINT) % 14 != 9 THEN term END AS term, proposer, proposed_at FROM entities)"


def _raw_bills(t: Tables) -> DataFrame:
    k = F.col("number").cast("long")
    return t.entities.select(
        F.when(k % 10 != 3, F.col("number")).otherwise(" ").alias("BILL_NO"), F.when((k % 12 != 5) & (k % 2 == 0), F.concat(F.lit(" "), "name")).alias("BILL_NAME"), F.when((k % 12 != 5) & (k % 2 == 1), F.col("name")).alias("BILL_NM"),
        F.when(k % 14 != 9, F.concat(F.lit("no. "), F.col("term").cast("string"))).otherwise("none").alias("ERACO"), F.col("proposer").alias("RST_PROPOSER"), F.date_format("proposed_at", "yyyy/MM/dd").alias("PPSL_DT"),
    )


@query("src_norm_bill", f"WITH {NORM_BILL_SQL} SELECT number, name, term, proposer, proposed_at FROM n WHERE number IS NOT NULL AND name IS NOT NULL AND term IS NOT NULL")
def src_norm_bill(t: Tables) -> DataFrame:
    return pages.normalize_bills(_raw_bills(t))[0].select("number", "name", "term", "proposer", "proposed_at")


@query("src_norm_bill_rejects", f"WITH {NORM_BILL_SQL} SELECT CASE WHEN number IS NULL THEN 'missing_number' WHEN name IS NULL THEN 'missing_name' ELSE 'missing_term' END AS reason, count(*) AS n FROM n WHERE number IS NULL OR name IS NULL OR term IS NULL GROUP BY 1")
def src_norm_bill_rejects(t: Tables) -> DataFrame:
    return pages.normalize_bills(_raw_bills(t))[1].groupBy("reason").agg(F.count("*").alias("n"))


@query("src_classify", "SELECT group_id, kind FROM meetings")
def src_classify(t: Tables) -> DataFrame:
    name = F.when(F.col("kind") == "plenary", "Plenary session").when(F.col("kind") == "subcommittee", "Plenary sub panel").otherwise("Standing committee")
    return t.meetings.select("group_id", pages.classify_meeting(name, F.col("committee")).alias("kind"))


@query("src_stable_ids", r"SELECT group_id, seq, CAST(group_id AS VARCHAR) || ':speech-' || lpad(CAST(seq AS VARCHAR), 4, '0') AS speech_id, sha256(CAST(seq AS VARCHAR) || chr(31) || number || chr(31) || trim(regexp_replace(title, '\s+', ' ', 'g')))[1:16] AS agenda_id, regexp_replace(lower(proposer), '[^a-z0-9]+', '-', 'g') AS slug FROM agenda")
def src_stable_ids(t: Tables) -> DataFrame:
    speech = F.concat(F.col("group_id").cast("string"), F.lit(":speech-"), F.lpad(F.col("seq").cast("string"), 4, "0"))
    agenda = stable_id(F.col("seq").cast("string"), F.col("number"), F.trim(F.regexp_replace("title", r"\s+", " ")))
    return t.agenda.select("group_id", "seq", speech.alias("speech_id"), agenda.alias("agenda_id"), F.regexp_replace(F.lower("proposer"), "[^a-z0-9]+", "-").alias("slug"))


@query(
    "src_constraints",
    """SELECT 'blank_text' AS rule, count(*) FILTER (WHERE trim(text) = '') AS violations FROM turns UNION ALL SELECT 'seven_digits', count(*) FILTER (WHERE NOT regexp_matches(number, '^[0-9]{7}$')) FROM entities UNION ALL SELECT 'positive_term', count(*) FILTER (WHERE NOT term - 15 > 0) FROM entities
    UNION ALL SELECT 'confidence_range', count(*) FILTER (WHERE confidence NOT BETWEEN 0 AND 0.9) FROM links UNION ALL SELECT 'link_type_domain', count(*) FILTER (WHERE link_type NOT IN ('EXPLICIT_MENTION', 'AGENDA_MATCH')) FROM links UNION ALL SELECT 'meeting_kind_domain', count(*) FILTER (WHERE kind NOT IN ('plenary', 'committee', 'subcommittee')) FROM meetings
    UNION ALL SELECT 'unique_group_line', (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)) UNION ALL SELECT 'unique_group_turn', (SELECT count(*) FROM (SELECT group_id, seq FROM turns GROUP BY 1, 2 HAVING count(*) > 1))
    UNION ALL SELECT 'entity_exists', count(*) FROM links WHERE number NOT IN (SELECT number FROM entities WHERE result IS NOT NULL) UNION ALL SELECT 'role_domain', count(*) FILTER (WHERE role NOT IN ('user', 'assistant')) FROM turns""",
)
def src_constraints(t: Tables) -> DataFrame:
    """One data-quality report; some rules are narrower than the tables so that they find something."""
    c = F.col
    return pages.violations({
        "blank_text": (t.turns, F.trim("text") == ""), "seven_digits": (t.entities, ~c("number").rlike("^[0-9]{7}$")), "positive_term": (t.entities, ~(c("term") - 15 > 0)), "confidence_range": (t.links, ~c("confidence").between(0, 0.9)),
        "link_type_domain": (t.links, ~c("link_type").isin("EXPLICIT_MENTION", "AGENDA_MATCH")), "meeting_kind_domain": (t.meetings, ~c("kind").isin("plenary", "committee", "subcommittee")), "unique_group_line": pages.repeated(t.raw("lineitem"), "l_orderkey", "l_linenumber"),
        "unique_group_turn": pages.repeated(t.turns, "group_id", "seq"), "entity_exists": pages.orphans(t.links, t.entities.where("result is not null"), "number"), "role_domain": (t.turns, ~c("role").isin("user", "assistant")),
    })


URL_SQL = r"CASE WHEN NOT starts_with(url, 'https://') THEN 'not_https' WHEN NOT regexp_matches(regexp_extract(url, '^https?://([^/?#]+)', 1), '(^|\.)example\.(com|org)$') THEN 'host' WHEN contains(url, '#') THEN 'fragment' WHEN regexp_matches(url, '[?&](key|apikey|api_key|servicekey|token|secret)=') THEN 'secret_parameter' END"


@query("src_url_policy", f"SELECT page_id, coalesce({URL_SQL}, 'accepted') AS verdict FROM pages")
def src_url_policy(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", F.coalesce(pages.url_verdict(F.col("url"), ["example.com", "example.org"]), F.lit("accepted")).alias("verdict"))


@query("src_redact_url", "SELECT page_id, regexp_replace(url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'KEY=abc' || CAST(page_id AS VARCHAR) || '&z=1', '([?&]KEY=)[^&#]*', '\\1***') AS url FROM pages")
def src_redact_url(t: Tables) -> DataFrame:
    keyed = F.concat("url", F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("KEY=abc"), F.col("page_id").cast("string"), F.lit("&z=1"))
    return t.raw("pages").select("page_id", pages.redact_url(keyed).alias("url"))


@query("src_url_identity", "SELECT page_id, CASE WHEN len(regexp_extract_all(url, '[?&]page=([^&#]*)', 1)) = 1 AND regexp_matches(regexp_extract(url, '[?&]page=([^&#]*)', 1), '^[A-Za-z0-9_-]{1,64}$') THEN 'id:' || regexp_extract(url, '[?&]page=([^&#]*)', 1) ELSE 'url:' || sha256(url)[1:16] END AS identity FROM pages")
def src_url_identity(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", pages.url_identity(F.col("url"), "page").alias("identity"))


@query("src_html_links", """WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\\s+href="([^"]*)"[^>]*>([^<]*)</a>', 1)) AS href FROM pages), x AS (SELECT * FROM a WHERE trim(href) != ''), r AS (SELECT page_id, href, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^(https?:)', 1) || href WHEN starts_with(href, '/') THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || href WHEN starts_with(href, '?') THEN regexp_extract(url, '^(https?://[^?#]+)', 1) || href WHEN starts_with(href, '#') THEN regexp_extract(url, '^([^#]*)', 1) || href
    ELSE regexp_extract(url, '^(https?://[^/?#]+)', 1) || coalesce(nullif(regexp_extract(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '^(.*/)', 1), ''), '/') || href END AS target FROM x)
    SELECT page_id, target, CASE WHEN NOT regexp_matches(target, '^https?://') THEN 'not_http' WHEN NOT regexp_matches(lower(regexp_extract(target, '^https?://([^/?#:]+)', 1)), '(^|\\.)example\\.com$') THEN 'host' END AS verdict, count(*) AS n FROM r GROUP BY 1, 2, 3""")
def src_html_links(t: Tables) -> DataFrame:
    return pages.html_links(t.raw("pages"), "page_id", "url", "html", ["example.com"]).groupBy("page_id", "target", "verdict").agg(F.count("*").alias("n"))


UPSERT_SQL = "b AS (SELECT c_custkey, c_name, c_acctbal, 1 AS version FROM customer), i AS (SELECT c_custkey + 50 AS c_custkey, c_name || ' new' AS c_name, c_acctbal + 1 AS c_acctbal, 2 AS version FROM customer WHERE c_custkey % 3 = 0)"


@query("src_upsert", f"WITH {UPSERT_SQL} SELECT c_custkey, c_name, round(c_acctbal, 4) AS c_acctbal, CAST(version AS BIGINT) AS version FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY version DESC) AS k FROM (SELECT * FROM b UNION ALL SELECT * FROM i)) WHERE k = 1")
def src_upsert(t: Tables) -> DataFrame:
    base = t.raw("customer").select("c_custkey", "c_name", "c_acctbal", F.lit(1).cast("long").alias("version"))
    new = base.where("c_custkey % 3 = 0").select((F.col("c_custkey") + 50).alias("c_custkey"), F.concat("c_name", F.lit(" new")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit(2).cast("long").alias("version"))
    return corpus.upsert(base, new, ["c_custkey"], "version").withColumn("c_acctbal", F.round("c_acctbal", 4))


@query("src_replace_group", "SELECT group_id, seq, role FROM turns WHERE group_id % 4 != 1 UNION ALL SELECT group_id, seq + 100, 'replaced' FROM turns WHERE group_id % 4 = 1 AND seq < 2")
def src_replace_group(t: Tables) -> DataFrame:
    base = t.turns.select("group_id", "seq", "role")
    new = base.where("group_id % 4 = 1 and seq < 2").select("group_id", (F.col("seq") + 100).alias("seq"), F.lit("replaced").alias("role"))
    return corpus.replace_groups(base, new, "group_id")


FINGERPRINT_SQL = "SELECT count(*) AS n_rows, bit_xor(d) AS xored, CAST(sum(d % 1000003) AS BIGINT) AS summed FROM (SELECT CAST('0x' || sha256(CAST(doc_id AS VARCHAR) || chr(31) || coalesce(lang, chr(0)) || chr(31) || coalesce(text, chr(0)))[1:15] AS BIGINT) AS d FROM documents)"


@query("src_table_fingerprint", FINGERPRINT_SQL)
def src_table_fingerprint(t: Tables) -> DataFrame:
    return corpus.table_fingerprint(t.raw("documents"), ["doc_id", "lang", "text"])


@query("snk_snapshot", "WITH p AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents) SELECT doc_id, position, CASE WHEN length(text) <= 4000 THEN sha256(text) END AS inline_digest, length(text) > 4000 AS in_side_table, sha256(text) AS digest, CASE WHEN length(text) > 4000 THEN CAST(length(text) AS BIGINT) END AS side_chars, CAST(strlen(text) AS BIGINT) AS bytes, position // 50 AS page_bucket FROM p")
def snk_snapshot(t: Tables) -> DataFrame:
    """A snapshot written and read back: short texts in the rows, long ones found in the side table by their hash."""
    rows, texts = pages.write_snapshot(t.raw("documents"), shared_folder(t.spark, "snapshot"), "doc_id", "text")
    told = rows.select("doc_id", "position", F.sha2("inline_text", 256).alias("inline_digest"), "in_side_table", "digest", "bytes", F.col("page_bucket").cast("long").alias("page_bucket"))
    joined = told.join(texts.select("digest", F.char_length("text").cast("long").alias("side_chars")), "digest", "left")
    return joined.select("doc_id", "position", "inline_digest", "in_side_table", "digest", "side_chars", "bytes", "page_bucket")
