"""Hand-made fixtures: edge cases that the supplied tables do not have."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from dossier.functions import text
from dossier.functions import labels, terminology
from dossier.operators import aggregation, corpus, evidence, filters, gate, index, linking, search, segmentation
from dossier.sources import pages
from dossier.streaming import arrivals


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_page_verdicts(spark):
    page = lambda part, no, total, n, content: (part, no, total, n, content)
    data = [
        page("whole", 1, 15, 10, 1), page("whole", 2, 15, 5, 2), page("missing", 1, 25, 10, 1), page("missing", 3, 25, 5, 3), page("twice", 1, 15, 10, 1), page("twice", 1, 15, 10, 4), page("twice", 2, 15, 5, 2),
        page("changed", 1, 15, 10, 1), page("changed", 2, 16, 6, 2), page("repeated", 1, 20, 10, 1), page("repeated", 2, 20, 10, 1), page("short", 1, 15, 9, 1), page("short", 2, 15, 5, 2),
    ]
    got = dict(rows(pages.page_coherence(spark.createDataFrame(data, "p string, page long, total long, n_rows long, content long"), ["p"], 10), "p", "reasons"))
    assert got == {"whole": "", "missing": "missing_page", "twice": "duplicate_page", "changed": "total_changed", "repeated": "repeated_page", "short": "wrong_row_count"}


def test_envelopes(spark):
    head = '{"d":[{"head":[{"list_total_count":2},{"RESULT":{"CODE":"%s","MESSAGE":""}}]},{"row":[{"A":1,"B":"x"},{"A":2}]}]}'
    data = spark.createDataFrame([(1, head % "INFO-000"), (2, head % "INFO-200"), (3, head % "ERROR-1"), (4, "no json"), (5, '{"other":[]}')], "k long, value string")
    got = [(r.k, r.error, None if r.fields is None else r.fields.get("A")) for r in pages.decode_envelopes(data, "d").orderBy("k", "position").collect()]
    assert got == [(1, None, "1"), (1, None, "2"), (3, "ERROR-1", None), (4, "malformed", None), (5, "malformed", None)]


def test_address_verdicts(spark):
    urls = {
        "https://a.example.org/x?id=1": None, "http://example.org/": "not_https", "https://example.org.evil.net/": "host", "https://u:p@example.org/": "userinfo", "https://example.org:8443/": "port",
        "https://example.org:443/": None, "https://example.org/#f": "fragment", "https://example.org/?KEY=1": "secret_parameter", "::": "malformed", "https://evilexample.org/": "host",
    }
    got = dict(rows(spark.createDataFrame([(u,) for u in urls], "u string").select("u", pages.url_verdict(F.col("u"), ["example.org"]).alias("v"))))
    assert got == urls


def test_segmentation_of_bullets_colons_and_failures(spark):
    data = [
        ("bullets", 1, "opening words\n○Kim member hello\nnote: not a marker\n1. first item\nloose line\n○Lee minister answer"), ("bullets", 2, "goes on\n○Park chair\n"),
        ("colons", 1, "Ann: one\ntwo\nBob: three"), ("empty", 1, ""),
    ]
    turns, failures = segmentation.segment(spark.createDataFrame(data, "doc string, page long, text string"))
    assert rows(turns, "doc", "turn", "label", "body", "agenda", "pages") == [
        ("bullets", 1, "Kim member", "hello\nnote: not a marker", None, "1"), ("bullets", 2, "Lee minister", "answer\ngoes on", "1. first item", "1|2"),
        ("colons", 1, "Ann", "one\ntwo", None, "1"), ("colons", 2, "Bob", "three", None, "1"),
    ]
    assert rows(failures) == [("bullets", 3, "empty_body")]


def test_questions_answers_and_follow_ups(spark):
    turn = lambda g, s, role, t: (g, s, f"{g}-{s}", role, t)
    data = [turn(1, 0, "member", "why?"), turn(1, 1, "장관", "so"), turn(1, 2, "member", "and?"), turn(2, 0, "member", "why?"), turn(2, 1, "clerk", "no"), turn(3, 0, "member", "statement"), turn(3, 1, "장관", "x")]
    df = spark.createDataFrame(data, "group_id long, seq long, turn_id string, role string, text string")
    got = rows(linking.question_answer_relations(df, text.contains_any(F.col("text"), text.QUESTION_SIGNALS), text.ANSWER_ROLES), "source", "target", "relation")
    assert got == [("1-0", "1-1", "QUESTION_TO"), ("1-1", "1-0", "ANSWER_TO"), ("1-2", "1-0", "FOLLOW_UP_TO")]


def test_fusion_counts_a_list_once_and_breaks_ties(spark):
    data = [(1, 1, "a", 1, 1.0), (1, 1, "a", 3, 1.0), (1, 1, "b", 2, 1.0), (1, 2, "b", 1, 1.0), (1, 2, "c", 2, 1.0), (2, 2, "y", 1, 1.0), (2, 1, "x", 1, 1.0)]
    got = rows(search.reciprocal_rank_fusion(spark.createDataFrame(data, "query_id long, list_no int, item string, rank long, weight double")), "query_id", "rank", "item")
    assert got == [(1, 1, "b"), (1, 2, "a"), (1, 3, "c"), (2, 1, "x"), (2, 2, "y")]
    with pytest.raises(ValueError):
        search.reciprocal_rank_fusion(spark.createDataFrame(data, "query_id long, list_no int, item string, rank long, weight double"), -1)


def test_gates_fail_one_at_a_time(spark):
    cand = [(q, c, n, com, d, "alphawidget", "", "beta") for q in range(1, 6) for c, n, com, d in [("a", "1", "law", "2020-01-05"), ("b", "2", "tax", None)]]
    candidates = spark.createDataFrame(cand, "query_id long, candidate string, number string, committee string, d string, title string, agenda string, body string").withColumn("day", F.col("d").cast("date")).withColumns({"kind": F.lit("event"), "proposed_on": F.lit(None).cast("date")})
    terms = spark.createDataFrame([(1, "issue", "widget"), (2, "related_issue", "beta"), (4, "issue", "widget")], "query_id long, kind string, term string")
    scopes = spark.createDataFrame([(1, None, "law", None, None), (2, None, None, None, None), (3, "2", None, None, None), (4, None, None, "2020-01-01", "2020-12-31"), (5, None, None, None, None)], "query_id long, number string, committee string, f string, u string")
    scopes = scopes.select("query_id", F.when(F.col("number").isNotNull(), F.array("number")).alias("numbers"), "committee", F.lit(False).alias("proposal_dated"), F.col("f").cast("date").alias("day_from"), F.col("u").cast("date").alias("day_to"))
    got = {(r.query_id, r.candidate): (r.score, r.rejection) for r in gate.relevance_gate(candidates, terms, scopes).collect()}
    assert got == {
        (1, "a"): (30, None), (1, "b"): (0, "committee_mismatch"), (2, "a"): (5, "below_minimum_score"), (2, "b"): (5, "below_minimum_score"), (3, "a"): (0, "exact_number_mismatch"), (3, "b"): (100, None),
        (4, "a"): (30, None), (4, "b"): (0, "missing_date"), (5, "a"): (0, "no_meaningful_terms"), (5, "b"): (0, "no_meaningful_terms"),
    }


def test_coverage_keeps_unknown_apart_from_zero(spark):
    expected = spark.createDataFrame([("full", 2), ("none", 0), ("unknown", None), ("failed", 2), ("left", 3), ("over", 1)], "s string, expected long")
    done = [("full", True)] * 2 + [("failed", True), ("failed", False), ("left", True), ("over", True), ("over", True), ("unknown", True)]
    got = {r.s: (r.unaccounted, r.complete, r.over_accounted) for r in corpus.scope_coverage(expected, spark.createDataFrame(done, "s string, ok boolean"), ["s"]).collect()}
    assert got == {"full": (0, True, False), "none": (0, True, False), "unknown": (None, False, False), "failed": (0, False, False), "left": (2, False, False), "over": (-1, False, True)}


def test_graph_merges_conflicts_and_splits_claims(spark):
    nodes = spark.createDataFrame([("p", "person", "P", "2"), ("p", "person", "P", "1"), ("a", "bill", "A", "1"), ("a", "bill", "A", "1"), ("b", "bill", "B", "1"), ("b", "bill", "B", "2")], "id string, node_type string, label string, locator string")
    good, conflicts = evidence.merge_nodes(nodes)
    assert rows(good, "id", "locator", "claims") == [("a", "1", 2), ("p", "1", 2)] and rows(conflicts, "id") == [("b",)]
    claims = spark.createDataFrame([("a", "p", "x", ""), ("a", "p", "x", ""), ("a", "b", "x", ""), ("q", "p", "x", ""), ("q", "b", "x", "")], "source string, target string, edge_type string, reason string")
    edges, rest = evidence.resolve_edges(claims, good)
    assert rows(edges, "source", "target") == [("a", "p")] and rows(rest, "source", "target", "gap") == [("a", "b", "missing_target"), ("q", "b", "missing_both"), ("q", "p", "missing_source")]


def test_substring_links_equal_all_pairs(spark):
    texts = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog again and again"), (2, "quick"), (3, ""), (4, None), (5, "abcd" * 20)], "id long, text string")
    patterns = spark.createDataFrame([(1, "quick"), (2, "brown fox jumps over the lazy dog again"), (3, "abcdabcdabcdabcd"), (4, "lazy dog"), (5, "zzzz"), (6, "abcd")], "p long, pattern string")
    assert rows(linking.substring_links(texts, patterns, "id", "p")) == [(1, 1), (1, 2), (1, 4), (2, 1), (5, 3), (5, 6)]


def test_positions_do_not_need_one_task(spark):
    data = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1000).alias("k"))
    assert [(r.k, r.position) for r in aggregation.global_positions(data, "k", 16).orderBy("k").collect()] == [(i, i) for i in range(1000)]
    assert aggregation.global_positions(data.limit(0), "k").count() == 0


def test_vector_search_in_blocks(spark):
    data = spark.createDataFrame([(i, [float(i % 5), float(i % 3), 1.0]) for i in range(40)] + [(99, [0.0, 0.0, 0.0])], "id long, v array<float>")
    wanted = data.where("id < 9").withColumnRenamed("id", "query_id")
    assert rows(search.vector_top_k(wanted, data, 4, "id", "v", block_bytes=48)) == rows(search.vector_top_k(wanted, data, 4, "id", "v"))
    assert search.vector_top_k(wanted.limit(0), data, 4, "id", "v").count() == 0


def test_terms_dates_names(spark):
    one = spark.createDataFrame([("국회에서 법안을 Nation", "1997.02.03", "Kim et al. 3", "Lee, https://a.b/c,x · Han")], "q string, d string, n string, m string")
    got = one.select(text.query_terms(F.col("q"), text.SUFFIXES), text.parse_any_date(F.lit(" "), F.col("d")), text.split_names(F.col("n")), text.split_names(F.col("m")), text.exact_numbers(F.lit("1234567 12345678 7654321."))).first()
    assert got[0] == ["국회에서", "국회", "법안을", "법안", "nation"] and str(got[1]) == "1997-02-03" and got[2] == ["Kim"] and got[3] == ["Lee", "x", "Han"] and got[4] == ["1234567", "7654321"]


def test_stream_redelivery_within_one_run(spark, sf):
    stream = arrivals.open_stream(spark, f"{sf}/events.parquet")
    rows_ = arrivals.drain(arrivals.absorb_redelivery(stream.unionByName(stream), "event_id", "ts").select("event_id"), "append")
    assert rows_.count() == rows_.select("event_id").distinct().count() == spark.read.parquet(f"{sf}/events.parquet").count()


def test_entry_survives_without_the_training_operators(monkeypatch):
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def no_llm(name, *a, **k):
        if name.startswith(("corpus_pipeline", "dossier.llm")):
            raise ImportError(name)
        return real(name, *a, **k)

    monkeypatch.setattr(builtins, "__import__", no_llm)
    for name in [m for m in sys.modules if m.startswith(("corpus_pipeline", "dossier.llm", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, name)
    entry = importlib.import_module("__spark_entry__")
    assert len(entry.queries()) > 120 and not any(n.startswith("op") for n in entry.queries())


def test_substring_links_of_short_patterns(spark):
    texts = spark.createDataFrame([(1, "abc")], "id long, text string")
    assert rows(linking.substring_links(texts, spark.createDataFrame([(1, "ab")], "p long, pattern string"), "id", "p")) == [(1, 1)]


def test_patterns_of_any_length_are_found(spark):
    texts = spark.createDataFrame([(1, "abc de"), (2, "x"), (3, ""), (4, None), (5, "aXb")], "id long, text string")
    patterns = spark.createDataFrame([(10, "b"), (11, "abc"), (12, ""), (13, None), (14, "abc"), (15, "zz")], "p long, pattern string")
    want = [(1, 10), (1, 11), (1, 12), (1, 14), (2, 12), (3, 12), (5, 10), (5, 12)]
    assert rows(linking.substring_links(texts, patterns, "id", "p")) == want
    assert rows(linking.substring_links(texts, patterns, "id", "p", block_bytes=70)) == want
    entities = spark.createDataFrame([(1, "0000007", "abc de"), (2, "0000008", "ab")], "e long, number string, name string")
    links = linking.explicit_mentions(spark.createDataFrame([(1, "see 10000007 abc de"), (2, "abc de ab")], "id long, text string"), entities, "id", "e")
    assert rows(links, "id", "e", "evidence") == [(1, 1, "0000007"), (2, 1, "abc de")]


def test_terminology(spark):
    c = terminology.Concept
    glossary = [c("a", "tool", "ring", ["large hoop"], ["b"]), c("b", "tool", "hoop"), c("k", "committee", "과학위원회", ["과방위"]), c("d", "tool", "hoop of gold chain", [], ["a"])]
    one = spark.createDataFrame([("A LARGE-hoop, a hoop",), ("rings and hooped",), ("과방위의 Ring",), ("large hoop of gold/chain",)], "t string")
    found = one.select(F.transform(terminology.detect(F.col("t"), glossary), lambda m: m["value"]).alias("v"), terminology.replace_equivalents(F.col("t"), glossary).alias("r")).collect()
    assert [r.v for r in found] == [["LARGE-hoop", "hoop"], [], ["과방위", "Ring"], ["hoop of gold/chain"]]
    assert [r.r for r in found] == ["a ring, a hoop", "rings and hooped", "과학위원회의 ring", "large hoop of gold chain"]
    terms = one.select(terminology.expand(F.col("t"), glossary).alias("e")).collect()
    assert [[(x.term, x.relation) for x in r.e] for r in terms] == [[("ring", "equivalent"), ("hoop", "equivalent")], [], [("ring", "equivalent"), ("과학위원회", "equivalent"), ("hoop", "related")], [("hoop of gold chain", "equivalent"), ("ring", "related")]]
    names = spark.createDataFrame([("Large  Hoop",), ("과방위",), ("other",)], "v string")
    assert [tuple(r) for r in names.select(terminology.canonicalize(F.col("v"), glossary), terminology.canonicalize(F.col("v"), glossary, "committee")).collect()] == [("ring", "Large  Hoop"), ("과학위원회", "과학위원회"), ("other", "other")]
    with pytest.raises(Exception, match="more than 1 terms"):
        one.select(terminology.expand(F.col("t"), glossary, 1)).collect()


def test_labels(spark):
    cases = {
        "위원장 홍길동": ("홍길동", "위원장", None), "홍길동 위원": ("홍길동", "위원", None), "과학기술정보통신부 장관 이종호": ("이종호", "장관", "과학기술정보통신부"), "위원장김정호맙": ("김정호", "위원장", None),
        "위원장홍길동": ("홍길동", "위원장", None), "홍길동의원": ("홍길동", "의원", None), "환경부장관 한화진": ("한화진", "장관", "환경부"), "홍길동": ("홍길동", None, None), "(국무총리 한덕수)": ("한덕수", "국무총리", None),
    }
    got = spark.createDataFrame([(k,) for k in cases], "l string").select("l", labels.split_label(F.col("l")).alias("p")).collect()
    assert {r.l: (r.p["name"], r.p["role"], r.p["organization"]) for r in got} == cases
    flags = spark.createDataFrame([("홍길동",), ("홍길동위원",), ("x",), (None,)], "n string").select(labels.valid_name(F.col("n")), labels.suspect_name(F.col("n"))).collect()
    assert [tuple(r) for r in flags] == [(True, False), (True, True), (False, True), (False, True)]


def test_long_prefixes_and_joint_agendas(spark):
    pages_ = [(1, 1, "x" * 100 + "\n○user 1 hello\nmore"), (2, 1, "x" * 100 + "\n1. item\n○user 1 hello"), (3, 1, "short\n○user 1 a\n4. one\n5. two\n○chair 2 b\n○user 3 c")]
    turns, failures = segmentation.segment(spark.createDataFrame(pages_, "doc long, page long, text string"))
    assert rows(failures) == [(1, 0, "long_prefix")]
    assert {(r.doc, r.turn): (r.body, r.agenda) for r in turns.collect()} == {
        (1, 1): ("hello\nmore", None), (2, 1): ("hello", "1. item"), (3, 1): ("a", None), (3, 2): ("b", "items 4..5 jointly"), (3, 3): ("c", "items 4..5 jointly")
    }


def test_links_of_any_markup(spark):
    html = """<A class=x href='/a?b=1'>One <b>more</b></A><a href="c/../d.html" title="Review report">x</a><a title='no'>y</a><a href=#top>t</a><a href="mailto:x@y">m</a><a data-x=">" href="//z.example.org/q">q</a>"""
    got = pages.html_links(spark.createDataFrame([(1, "https://h.example.org/p/i.html?k=2", html)], "id long, url string, html string"), "id", "url", "html", ["example.org"], ["review", "more"])
    assert rows(got, "position", "target", "label", "verdict") == [(0, "https://h.example.org/a?b=1", "One more", None)] + rows(got.where("position > 0"), "position", "target", "label", "verdict")
    assert rows(got.where("position > 0"), "position", "target") == [(1, "https://h.example.org/p/d.html"), (3, "https://h.example.org/p/i.html?k=2#top"), (4, "mailto:x@y"), (5, "https://z.example.org/q")]
    assert {r.position: r.verdict for r in got.collect()} == {0: None, 1: None, 3: "title", 4: "not_http", 5: "title"}


def test_gate_of_proposers_and_bases(spark):
    day = "date"
    cand = spark.createDataFrame([(q, c, k, n, "Budget", None, None, "taxlaw", "", "") for q in (1, 2, 3) for c, k, n in (("e1", "entity", "1"), ("e2", "entity", "2"), ("v1", "event", "9"))], f"query_id long, candidate string, kind string, number string, committee string, day {day}, proposed_on {day}, title string, agenda string, body string")
    terms = spark.createDataFrame([(2, "issue", "tax"), (3, "issue", "nothing")], "query_id long, kind string, term string")
    scopes = spark.createDataFrame([(1, None, None, None, None, None), (2, None, "bud-get", None, None, None), (3, None, None, None, None, True)], f"query_id long, numbers array<string>, committee string, day_from {day}, day_to {day}, proposal_dated boolean")
    offered = spark.createDataFrame([("e1", "representative", "kim"), ("e1", "co", "lee"), ("e2", "co", "kim")], "candidate string, role string, name string")
    wanted = spark.createDataFrame([(1, "representative", "kim"), (1, "co", "lee"), (3, "any", "kim")], "query_id long, role string, name string")
    got = {(r.query_id, r.candidate): (r.accepted, r.score, r.rejection) for r in gate.relevance_gate(cand, terms, scopes, offered, wanted).collect()}
    assert got[1, "e1"] == (True, 200, None) and got[1, "e2"][2] == "representative_proposer_mismatch" and got[1, "v1"][2] == "no_meaningful_terms"
    assert got[2, "e1"] == (True, 30, None) and got[3, "e2"] == (False, 100, "below_minimum_score") and got[3, "v1"] == (False, 0, "below_minimum_score")


def test_no_window_orders_a_table_in_one_task(spark, sf):
    """Windows without a partition key stand only over a row for each range, part or scope."""
    from dossier import registry

    for name in ("rk_match_search", "rk_gate_rank", "gr_evidence_records", "rk_importance", "wn_list_meetings", "rk_bm25"):
        plan = registry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "CartesianProduct" not in plan and not [line for line in plan.splitlines() if "Window [" in line and "], [" not in line and "windowspecdefinition(" in line and "windowspecdefinition(specified" in line]


def test_results_do_not_depend_on_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    built = [index.build(docs.repartition(n), "doc_id", ["text"], index.shared_folder(spark, "index"), 200) for n in (1, 7)]
    words = spark.createDataFrame([(1, "the", 1), (1, "and", 2), (2, "une", 1)], "query_id long, term string, n long")
    one, two = (rows(search.bm25(b, words, 20)) for b in built)
    assert one == two and rows(search.match_search(built[0], words.drop("n"))) == rows(search.match_search(built[1], words.drop("n")))


def test_filters_of_queries(spark):
    turns = spark.createDataFrame([("t1", 19, "user", "o", "plenary", "Budget", "Kim", "2020-01-02"), ("t2", 20, None, "o", "plenary", "Budget", None, None)], "turn_id string, term long, role string, organization string, kind string, committee string, speaker string, d string").withColumn("held_on", F.col("d").cast("date"))
    empty = {"term": None, "role": None, "organization": None, "kind": None, "committee": None, "speaker": None, "day_from": None, "day_to": None}
    make = lambda *wishes: spark.createDataFrame([(k, *({**empty, **w}.values())) for k, w in enumerate(wishes)], "query_id long, term long, role string, organization string, kind string, committee string, speaker string, day_from string, day_to string")
    got = rows(filters.matching(turns, make({}, {"role": "user"}, {"committee": "BUD", "day_to": "2020-01-02"}, {"term": 21})))
    assert got == [(0, "t1"), (0, "t2"), (1, "t1"), (2, "t1")]
    with pytest.raises(ValueError):
        filters.matching(turns, make({"day_from": "2021-01-01", "day_to": "2020-01-01"}))
    with pytest.raises(ValueError):
        filters.structured(turns, colour="red")


def test_threads_of_a_large_group_meet_their_own_turns(spark):
    turns = spark.range(1_000_000).select(F.lit(1).alias("group_id"), F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("role"))
    hits = turns.where("seq % 1000 in (0, 3, 9) and seq < 900000")
    spans = hits.groupBy("group_id", F.floor(F.col("seq") / 1000).alias("thread")).agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    kept = linking.swept(spans, turns, 2, linking.SWEEP)
    kept.write.format("noop").mode("overwrite").save()
    assert kept.count() == 900 * 14 - 2
    found = linking.threads(hits.where("seq < 5000"), turns.where("seq < 5100"), gap=8)
    assert rows(found)[0] == (1, 1, 0, 9, 3, "a,b", 12) and rows(found, "n_turns") == [(12,)] + [(14,)] * 4


def test_entities_by_any_word_then_their_texts_within_filters(spark):
    made = lambda schema, *data: spark.createDataFrame(list(data), schema)
    entities = made("number string, name string, proposer string, committee string, proposed_at string, result string, term long", ("1", "urgent tax act", "Ann", "law", "2020-01-01", None, 1), ("2", "tax", "Bob", "law", "2021-01-01", "x", 1), ("3", "roads", "Urgent Person", "works", "2022-01-01", None, 2), ("44", "other", "Eve", "law", "2019-01-01", None, 2), ("5", "none", None, None, "2018-01-01", None, 3))
    texts = made("doc_id long, text string", (1, "urgency and roads"), (2, "urgent"), (3, None), (4, "tax"))
    belongs = made("doc_id long, number string", (1, "5"), (2, "44"), (4, "1"), (4, "missing"))
    wanted = made("query_id long, q string, status string, term long, committee string", (1, "urgent tax", None, None, None), (2, " 44 ", "pending", 9, None), (3, "TAX", "pending", None, "LA"), (4, "roads", None, None, None), (5, None, None, None, None), (6, "nothing", None, None, None))
    fields = index.build(entities, "number", ["name", "proposer", "committee"], index.shared_folder(spark, "index"))
    documents = index.build(texts, "doc_id", ["text"], index.shared_folder(spark, "index"))
    found = rows(search.entity_search(fields, documents, belongs, entities, wanted, 10), "query_id", "rank", "number", "part")
    assert found == [(1, 1, "1", 1), (1, 2, "2", 1), (1, 3, "3", 1), (1, 4, "44", 2), (2, 1, "44", 0), (3, 1, "1", 1), (4, 1, "3", 1), (4, 2, "5", 2)]


def test_a_hundred_thousand_filter_queries_in_one_join(spark):
    turns = spark.range(3000).select(F.concat(F.lit("t"), "id").alias("turn_id"), (F.col("id") % 50).alias("term"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("Role "), (F.col("id") % 700).cast("string"))).alias("role"), F.concat(F.lit("Committee "), (F.col("id") % 300).cast("string")).alias("committee"), F.when(F.col("id") % 11 > 0, F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 900).cast("int"))).alias("held_on"))
    k = F.col("id")
    queries = spark.range(100_000).select(k.alias("query_id"), F.when(k % 3 == 0, k % 60).alias("term"), F.when(k % 3 == 1, F.concat(F.lit("Role "), (k % 900).cast("string"))).alias("role"), F.when(k % 3 != 1, F.concat(F.lit("TTEE "), (k % 300).cast("string"))).alias("committee"), F.when(k % 5 == 0, F.date_add(F.lit("2019-06-01").cast("date"), (k % 500).cast("int"))).alias("day_from"), F.when(k % 10 == 0, F.date_add(F.lit("2020-11-01").cast("date"), (k % 500).cast("int"))).alias("day_to"))
    odd = spark.createDataFrame([(-1, None, None, None, None, None), (-2, None, None, None, "2020-02-01", None), (-3, None, None, None, None, "2020-02-01"), (-4, None, None, None, "2031-01-01", None), (-5, None, None, None, "1990-01-01", "1991-01-01"), (-6, None, None, "mitt", None, "2020-03-01")], "query_id long, term long, role string, committee string, day_from string, day_to string").withColumns({c: F.col(c).cast("date") for c in ("day_from", "day_to")})
    found = filters.matching(turns, queries.unionByName(odd))
    got = {}
    for q, t in found.where("query_id < 0 or query_id % 997 = 0").collect():
        got.setdefault(q, []).append(t)
    listed = turns.collect()
    for q in queries.where("query_id % 997 = 0").unionByName(odd).collect():
        held = lambda t, q=q: (q.term is None or t.term == q.term) and (q.role is None or t.role == q.role) and (q.committee is None or q.committee.lower() in t.committee.lower()) and (q.day_from is None or (t.held_on is not None and t.held_on >= q.day_from)) and (q.day_to is None or (t.held_on is not None and t.held_on <= q.day_to))
        assert sorted(got.get(q.query_id, [])) == sorted(t.turn_id for t in listed if held(t))


def test_an_end_that_most_claims_name_is_looked_up_once(spark):
    claims = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hub").when(F.col("id") % 3 == 1, "gone").otherwise(F.concat(F.lit("n"), "id")).alias("source"),
        F.when(F.col("id") != 6, F.concat(F.lit("n"), (F.col("id") % 1500).cast("string"))).alias("target"), F.lit("e").alias("edge_type"), F.lit("r").alias("reason"),
    )
    nodes = spark.range(1000).select(F.concat(F.lit("n"), "id").alias("id")).unionByName(spark.createDataFrame([("hub",)], "id string"))
    known = {"hub", *(f"n{i}" for i in range(1000))}
    gap = {(False, False): None, (True, False): "missing_source", (False, True): "missing_target", (True, True): "missing_both"}
    wanted = {(r.source, r.target): gap[r.source not in known, r.target not in known] for r in claims.collect()}
    edges, rest = evidence.resolve_edges(claims.unionAll(claims), nodes)
    assert sorted(rows(edges, "source", "target"), key=str) == sorted((p for p, g in wanted.items() if g is None), key=str)
    assert {(r.source, r.target): r.gap for r in rest.collect()} == {p: g for p, g in wanted.items() if g} and edges.count() + rest.count() == len(wanted)
