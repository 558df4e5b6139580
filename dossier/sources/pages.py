"""Landed source pages: envelopes, coherence, typed rows, addresses."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENVELOPE_ROW = "array<map<string,string>>"
NO_DATA = "INFO-200"
OK = "INFO-000"


def decode_envelopes(raw: DataFrame, dataset: str, json_col: str = "value") -> DataFrame:
    """``{dataset: [{head: [{list_total_count}, {RESULT: {CODE, MESSAGE}}]}, {row: [...]}]}`` to rows.

    A no-data code gives no row, any other code than success one row with ``error``, and text that is no
    envelope one row with the error ``malformed``.  Fields stay strings in a map.
    """
    head = "array<struct<list_total_count:long,RESULT:struct<CODE:string,MESSAGE:string>>>"
    schema = f"struct<`{dataset}`:array<struct<head:{head},row:{ENVELOPE_ROW}>>>"
    top = F.from_json(F.col(json_col), schema)[dataset]
    parts = raw.select("*", top.alias("parts"))
    heads = F.flatten(F.filter(F.transform("parts", lambda p: p["head"]), lambda h: h.isNotNull()))
    rows = F.flatten(F.filter(F.transform("parts", lambda p: p["row"]), lambda r: r.isNotNull()))
    total = F.array_max(F.transform(heads, lambda h: h["list_total_count"]))
    code = F.array_max(F.transform(heads, lambda h: h["RESULT"]["CODE"]))
    found = parts.select(*raw.columns, total.alias("total"), code.alias("code"), rows.alias("rows"), F.col("parts").isNull().alias("bad"))
    error = F.when(F.col("bad"), "malformed").when(F.col("code").isNull(), "missing_code").when(~F.col("code").isin(OK, NO_DATA), F.col("code"))
    known = found.withColumn("error", error).where(~F.coalesce(F.col("code") == NO_DATA, F.lit(False)))
    listed = F.when(F.col("error").isNull(), F.col("rows")).otherwise(F.array(F.lit(None).cast("map<string,string>")))
    keep = [c for c in raw.columns if c != json_col]
    return known.select(*keep, "total", "error", F.posexplode_outer(listed).alias("position", "fields"))


def read_envelopes(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """Envelope files, one a file, to rows."""
    return decode_envelopes(spark.read.text(path, wholetext=True), dataset)


def page_coherence(pages: DataFrame, keys: list[str], page_size: int) -> DataFrame:
    """Verdict on each partition of ``pages(keys, page, total, n_rows, content)``, with the reasons against it.

    The total is constant, pages are exactly 1 to the last one without repeats, every page has the rows
    that the total implies, and no whole page comes twice.  Repeated single rows are legal.
    """
    last = F.ceil(F.col("total_max") / page_size)
    whole = pages.groupBy(*keys, "content", "n_rows").agg(F.count("*").alias("copies"))
    repeated = whole.groupBy(*keys).agg(F.max("copies").alias("copies"))
    expected = F.when(F.col("page") < F.ceil(F.col("total") / page_size), page_size).otherwise(F.col("total") - (F.ceil(F.col("total") / page_size) - 1) * page_size)
    sums = pages.withColumn("short", (F.col("n_rows") != expected).cast("int")).groupBy(*keys).agg(
        F.count_distinct("total").alias("totals"), F.max("total").alias("total_max"), F.count("*").alias("n_pages"), F.count_distinct("page").alias("distinct_pages"),
        F.min("page").alias("first"), F.max("page").alias("highest"), F.sum("short").alias("short"), F.sum("n_rows").alias("rows"),
    )
    reasons = F.concat_ws(
        ",", F.when(F.col("totals") > 1, "total_changed"), F.when(F.col("n_pages") > F.col("distinct_pages"), "duplicate_page"),
        F.when((F.col("first") != 1) | (F.col("highest") != last) | (F.col("distinct_pages") < last), "missing_page"), F.when(F.col("short") > 0, "wrong_row_count"), F.when(F.col("copies") > 1, "repeated_page"),
    )
    return sums.join(repeated, keys).select(*keys, "n_pages", "rows", F.col("total_max").alias("total"), reasons.alias("reasons"), (reasons == "").alias("coherent"))


def expand_pages(firsts: DataFrame, page_size: int) -> DataFrame:
    """Work items for the pages after the first; none where the first is all."""
    last = F.ceil(F.col("total") / page_size)
    return firsts.where(last > 1).select(*[c for c in firsts.columns if c != "page"], F.explode(F.sequence(F.lit(2).cast("long"), last)).alias("page"))


#: Query parameters that carry a credential; fixed values.
SECRET_PARAMETERS = ["key", "apikey", "api_key", "servicekey", "token", "secret"]


def url_verdict(url: Column, host_suffixes: list[str]) -> Column:
    """Null for an acceptable address, else why not; addresses that do not parse are ``malformed``."""
    part = lambda p: F.try_parse_url(url, F.lit(p))
    host, query = F.lower(part("HOST")), F.lower(F.coalesce(part("QUERY"), F.lit("")))
    allowed = F.lit(False)
    for s in host_suffixes:
        allowed = allowed | (host == s) | host.endswith("." + s)
    port = F.regexp_extract(F.coalesce(part("AUTHORITY"), F.lit("")), r":([0-9]+)$", 1)
    secret = F.exists(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1).isin(SECRET_PARAMETERS))
    return (
        F.when(host.isNull(), "malformed").when(F.lower(part("PROTOCOL")) != "https", "not_https").when(~allowed, "host").when(part("USERINFO").isNotNull(), "userinfo")
        .when(~port.isin("", "443"), "port").when(part("REF").isNotNull(), "fragment").when(secret, "secret_parameter")
    )


def redact_url(url: Column, parameter: str = "KEY") -> Column:
    return F.regexp_replace(url, rf"(?i)([?&]{parameter}=)[^&#]*", "$1***")


def url_identity(url: Column, parameter: str = "id") -> Column:
    """The one safe value of the parameter, else an identifier from the address's hash."""
    found = F.regexp_extract_all(url, F.lit(rf"[?&]{parameter}=([^&#]*)"), F.lit(1))
    value = F.get(found, F.lit(0))
    return F.when((F.size(found) == 1) & value.rlike("^[A-Za-z0-9_-]{1,64}$"), F.concat(F.lit("id:"), value)).otherwise(F.concat(F.lit("url:"), F.left(F.sha2(url, 256), F.lit(16))))


def html_links(pages: DataFrame, id_col: str, url_col: str, html_col: str, hosts: list[str] | None = None, titles: list[str] | None = None, paths: list[str] | None = None) -> DataFrame:
    """Anchors of every page with absolute addresses: ``(id, position, href, target, label, verdict)``.

    Attributes come in any order and in double, single or no quotes; labels may hold other tags.  Relative
    addresses are resolved against the page's.  ``verdict`` is null for links that qualify: on one of ``hosts``
    or below, with one of ``titles`` in the label or title, with one of ``paths`` in the address (each in
    any case, null for no test); addresses of other schemes are ``not_http``.
    """
    anchors = F.regexp_extract_all(F.col(html_col), F.lit(r"(?is)<a\s(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?</a\s*>"), F.lit(0))
    rows = pages.select(id_col, url_col, F.posexplode(anchors).alias("position", "anchor"))
    opening = F.regexp_extract("anchor", r"(?is)^(<a\s(?:[^>\"']|\"[^\"]*\"|'[^']*')*>)", 1)

    def attribute(name: str) -> Column:
        quoted = F.regexp_extract(opening, rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", 1)
        return F.concat(quoted, *(F.regexp_extract(opening, rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", k) for k in (2, 3)))

    label = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("anchor", r"(?is)^<a\s(?:[^>\"']|\"[^\"]*\"|'[^']*')*>(.*)</a\s*>$", 1), "<[^>]*>", ""), r"\s+", " "))
    found = rows.select(id_col, url_col, F.col("position").cast("long").alias("position"), F.trim(attribute("href")).alias("href"), label.alias("label"), attribute("title").alias("title")).where(F.col("href") != "")
    target = resolve_url(F.col(url_col), F.col("href"))
    named = lambda text, words: F.exists(F.lit([w.lower() for w in words]), lambda w: F.contains(F.lower(text), w))
    host = F.lower(F.try_parse_url(target, F.lit("HOST")))
    on_host = F.lit(False)
    for h in hosts or []:
        on_host = on_host | (host == h) | host.endswith("." + h)
    verdict = F.when(~F.coalesce(target.rlike("(?i)^https?://"), F.lit(False)), "not_http")
    if hosts:
        verdict = verdict.when(~F.coalesce(on_host, F.lit(False)), "host")
    if titles:
        verdict = verdict.when(~named(F.concat_ws(" ", "label", "title"), titles), "title")
    if paths:
        verdict = verdict.when(~named(target, paths), "path")
    return found.select(id_col, "position", "href", target.alias("target"), "label", verdict.alias("verdict"))


def resolve_url(base: Column, href: Column) -> Column:
    """``href`` as an absolute address: as it is with a scheme, else from the base's scheme, host, folder or itself; dot segments are taken out."""
    origin = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    path = F.regexp_extract(base, r"^https?://[^/?#]+([^?#]*)", 1)
    folder = F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"^(.*/)", 1)).otherwise("/")
    joined = (
        F.when(href.rlike("(?i)^[a-z][a-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, "^(https?:)", 1), href)).when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(origin, path, href)).when(href.startswith("#"), F.concat(F.regexp_extract(base, "^([^#]*)", 1), href)).otherwise(F.concat(origin, folder, href))
    )
    short = F.regexp_replace(joined, r"/(?:\./)+", "/")
    for _ in range(4):  # each takes one folder and the two dots after it
        short = F.regexp_replace(short, r"(?<=[^/:])/(?!\.\./)[^/?#]+/\.\./", "/")
    return short


def aliased(raw: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """One column for each of ``fields``, the first of its aliases that ``raw`` has and that is not blank."""
    have = set(raw.columns)
    pick = lambda names: first_nonblank(*own) if (own := [n for n in names if n in have]) else F.lit(None).cast("string")
    return raw.select(*(pick(names).alias(name) for name, names in fields.items()))


#: The names that sources give to the fields of meetings and bills, in order of preference.
MEETING_FIELDS = {
    "id": ["CONF_ID", "CONFER_NUM"], "title": ["TITLE", "CONF_KND", "CLASS_NAME"], "term": ["DAE_NUM", "ERACO"], "committee": ["COMM_NAME", "CMIT_NM"], "subcommittee": ["SB_CMIT_NM"],
    "day_a": ["CONF_DATE"], "day_b": ["CONF_DT"], "url": ["CONF_LINK_URL", "PDF_LINK_URL", "DOWN_URL"],
}
BILL_FIELDS = {"number": ["BILL_NO"], "name": ["BILL_NAME", "BILL_NM"], "term": ["AGE", "ERACO"], "proposer": ["PROPOSER", "RST_PROPOSER"], "committee": ["COMMITTEE", "CURR_COMMITTEE"], "proposed": ["PROPOSE_DT", "PPSL_DT"], "result": ["PROC_RESULT", "PROC_RESULT_CD"]}


def normalize_meetings(raw: DataFrame) -> DataFrame:
    """Raw string rows to typed meetings: ``meeting_id, title, term, committee, kind, held_on, url``.

    Fields come under several names, days in several forms, the term inside other text; a row without an
    identifier gets one from its address, day and title.
    """
    from dossier.functions.text import parse_any_date, stable_id

    rows = aliased(raw, MEETING_FIELDS)
    day = parse_any_date(F.col("day_a"), F.col("day_b"))
    own = F.coalesce("id", F.concat(F.lit("h"), stable_id(F.coalesce("url", F.lit("")), F.coalesce(day.cast("string"), F.lit("")), F.coalesce("title", F.lit("")))))
    kind = classify_meeting(F.coalesce("subcommittee", F.lit("")), F.coalesce("committee", F.lit("")), F.coalesce("title", F.lit("")))
    return rows.select(F.concat(F.lit("meeting-"), own).alias("meeting_id"), "title", F.nullif(F.regexp_extract("term", "([0-9]+)", 1), F.lit("")).cast("long").alias("term"), F.coalesce("subcommittee", "committee").alias("committee"), kind.alias("kind"), day.alias("held_on"), "url")


def normalize_bills(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw string rows to typed bills and rejects: a bill has a number, a name and a term; a reject says what it lacks."""
    from dossier.functions.text import parse_any_date

    rows = aliased(raw, BILL_FIELDS).withColumns({"term": F.nullif(F.regexp_extract("term", "([0-9]+)", 1), F.lit("")).cast("long"), "proposed_at": parse_any_date(F.col("proposed"))}).drop("proposed")
    reason = F.when(F.col("number").isNull(), "missing_number").when(F.col("name").isNull(), "missing_name").when(F.col("term").isNull(), "missing_term")
    return rows.where(reason.isNull()), rows.withColumn("reason", reason).where("reason is not null")


def violations(rules: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """A data-quality report: for each rule the number of its table's rows that break it; a test that is null counts as broken."""
    out = None
    for name, (df, broken) in rules.items():
        row = df.agg(F.count(F.when(F.coalesce(broken, F.lit(True)), 1)).alias("violations")).select(F.lit(name).alias("rule"), "violations")
        out = row if out is None else out.unionByName(row)
    return out


def repeated(df: DataFrame, *keys: str) -> tuple[DataFrame, Column]:
    """The rule that keys are unique; a repeated key counts once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")), F.col("n") > 1


def orphans(df: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, Column]:
    """The rule that every key of ``df`` is one of ``known``."""
    return df.join(known.select(key).distinct(), key, "left_anti"), F.lit(True)


#: Characters of a text that a snapshot holds itself; fixed value.  Longer ones go to the side table.
INLINE = 4000
#: Rows of a file of a snapshot, and the most files; with more rows than both allow the files are larger.
ROWS_PER_FILE, MOST_FILES = 20_000, 2000


def _ranges(keys: DataFrame, key: str, rows_per_file: int) -> tuple[list, list[int]]:
    """First keys of ranges of about ``rows_per_file`` rows, all but the first range's, and the rows before each range; only the key is read."""
    wanted = min(MOST_FILES, max(1, math.ceil(keys.count() / rows_per_file)))
    dealt = keys.repartitionByRange(wanted, F.col(key).asc_nulls_last()).groupBy(F.spark_partition_id().alias("range"))
    held = sorted(dealt.agg(F.min(key).alias("first"), F.count("*").alias("n")).where("first is not null").collect(), key=lambda r: r.range)  # a row a range; nulls come last
    return [r["first"] for r in held[1:]], [0, *accumulate(r.n for r in held[:-1])]


def _range_of(key: Column, firsts: list) -> Column:
    """The range that a key lies in, of those that begin at 0 and ``firsts``: by blocks of first keys, then within one; nulls are in the last."""
    if not firsts:
        return F.lit(0)
    block = math.isqrt(len(firsts)) + 1
    upto = lambda held: F.size(F.filter(held, lambda first: first <= key))
    begun = (F.greatest(upto(F.lit(firsts[::block])), F.lit(1)) - 1) * block
    return F.when(key.isNull(), len(firsts)).otherwise(begun + upto(F.slice(F.lit(firsts), begun + 1, block)))


def write_snapshot(rows: DataFrame, path: str, key: str, text: str, page_size: int = 50, rows_per_file: int = ROWS_PER_FILE) -> tuple[DataFrame, DataFrame]:
    """Write an immutable snapshot and read it back: rows in order of position with sizes and hash, and the texts too long for it.

    ``(key, position, inline_text, in_side_table, digest, chars, bytes, page_bucket)`` and ``(digest, text)``; a path that
    holds a snapshot is an error.  Null keys come last, equal keys by digest.  A file holds many pages, one after the other, so the
    number of files follows that of rows, not of pages, and a page is found by the files' bounds of ``page_bucket``.
    """
    firsts, before = _ranges(rows.select(key), key, rows_per_file)
    chars = F.char_length(text).cast("long")
    told = rows.select(key, F.when(chars <= INLINE, F.col(text)).alias("inline_text"), (chars > INLINE).alias("in_side_table"), F.sha2(text, 256).alias("digest"), chars.alias("chars"), F.octet_length(text).cast("long").alias("bytes"))
    laid = told.withColumn("_range", _range_of(F.col(key), firsts)).repartitionById(len(before), "_range").sortWithinPartitions(F.col(key).asc_nulls_last(), "digest")  # a partition for each range
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # in the partition
    placed = laid.withColumn("position", F.get(F.lit(before), F.col("_range")) + place).drop("_range")
    placed.withColumn("page_bucket", F.floor(F.col("position") / page_size)).write.mode("error").parquet(f"{path}/rows")
    long = rows.where(F.char_length(text) > INLINE).select(F.sha2(text, 256).alias("digest"), F.col(text).alias("text"))
    long.repartition("digest").groupBy("digest").agg(F.min("text").alias("text")).write.mode("error").parquet(f"{path}/texts")
    spark = rows.sparkSession
    return spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/texts")


def first_nonblank(*columns: str) -> Column:
    """The first of several aliases that is not blank."""
    return F.coalesce(*(F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns))


def classify_meeting(*names: Column) -> Column:
    """plenary, subcommittee or committee by the words in the names; a subcommittee's wins."""
    joined = F.lower(F.concat_ws(" ", *names))
    return F.when(F.contains(joined, F.lit("sub")), "subcommittee").when(F.contains(joined, F.lit("plenary")), "plenary").otherwise("committee")
