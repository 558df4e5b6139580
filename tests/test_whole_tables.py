"""Queries whose tables hold high ids, on hand-made tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.catalog import evidence, linking
from dossier.views import Tables

class Small(Tables):
    """Hand-made tables."""

    def __init__(self, spark, tables):
        super().__init__(spark, "")
        self.tables = tables

    def raw(self, name):
        return self.tables[name]


def test_ends_of_agenda_edges_with_high_ids(spark):
    made = lambda schema, *data: spark.createDataFrame(list(data), schema)
    line = lambda order, number, part: (order, part, 1, number, 1.0, "1997-01-02")
    t = Small(spark, {
        "conversations": made("conv_id long, turn long, role string, text string", (1, 0, "user", "x")),
        "customer": made("c_custkey long, c_name string, c_mktsegment string", (1, "c", "BUILDING")),
        "orders": made("o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate string", (1, 1, "O", "LOW", "1997-01-01"), (5000, 1, "O", "LOW", "1997-01-01"), (9000, 1, "O", "LOW", "1997-01-01")),
        "part": made("p_partkey long, p_name string", (5000, "both"), (8000, "no bill"), (9000, "two"), (7000, "neither")),
        "supplier": made("s_suppkey long, s_name string", (1, "s")), "documents": made("doc_id long, text string, lang string, source string"), "pages": made("page_id long, url string"), "benchmark": made("item_id long, text string"),
        "lineitem": made("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long, l_extendedprice double, l_shipdate string", line(5000, 1, 5000), line(5000, 2, 8000), line(5000, 3, 9000), line(5001, 1, 9000), line(5000, 4, 7000), line(5001, 2, 7000)),
    })
    good, bad = evidence.resolved(t)
    assert [tuple(r) for r in good.where("edge_type = 'agenda_for_bill'").select("source", "target").collect()] == [("agenda:0005000", "bill:0005000")]
    gaps = {r.source: r.gap for r in bad.where("edge_type = 'agenda_for_bill'").collect()}
    assert gaps == {"agenda:0008000": "missing_target", "agenda:0009000": "missing_source", "agenda:0007000": "missing_both"}
    assert evidence.evidence_records(t).where("evidence_type = 'agendas'").count() == 6


def test_proposers_and_work_items_with_high_ids(spark):
    made = lambda schema, *data: spark.createDataFrame(list(data), schema)
    t = Small(spark, {
        "supplier": made("s_suppkey long, s_name string", (5, "low"), (57, "high")), "part": made("p_partkey long, p_name string", (1, "p")),
        "lineitem": made("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long, l_extendedprice double, l_shipdate string", (9, 1, 57, 1, 1.0, "1997-01-02"), (9, 1, 5, 2, 1.0, "1997-01-02")),
        "documents": made("doc_id long, source string", (4_800_000, "web"), (4_800_001, "web")),
    })
    assert sorted((r.query_id, r.candidate, r.all_met) for r in linking.jn_role_match(t).collect()) == [(5, 9, True), (17, 9, True)]
    assert {r.doc_id: r.outcome for r in linking.jn_exact_mapping(t).collect()} == {4_800_000: "mapped", 4_800_001: "duplicate"}


def test_counts_of_the_graph_build_it_once(spark, sf, monkeypatch):
    from dossier.operators import evidence as graph

    calls, merge, write = [], graph.merge_nodes, evidence.written
    monkeypatch.setattr(graph, "merge_nodes", lambda claimed: calls.append("nodes") or merge(claimed))
    monkeypatch.setattr(evidence, "written", lambda df, name: calls.append(f"write {name}") or write(df, name))
    evidence.gr_counts_hash(Tables(spark, sf))
    assert calls == ["nodes", "write nodes"]


def test_tiers_move_no_decision(spark):
    from dossier.operators import gate

    made = spark.range(4000).selectExpr("id % 4 query_id", "id candidate", "cast(id as string) number", "date'2020-01-01' day", "id % 50 score", "id % 3 != 0 accepted", "if(id % 5 = 0, 'issue:a@title', 'issue:a@body') reasons")
    found = gate.tier_select(made, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    kept = found.groupBy("query_id").agg({"selected": "count"}).collect()
    assert found.count() == 4000 and len(kept) == 4 and found.where("selected").count() == 20 and found.where("selected and not eligible").count() == 0


def test_entities_that_share_a_number_are_one_in_searches(spark, sf, tmp_path):
    """Order keys of eight digits are cut to seven, so several entities have one number."""
    import sys
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).parent))
    import duckdb
    import oracle

    import __spark_entry__

    for t in oracle.TABLES:
        shifted = "* REPLACE (o_orderkey + 10000000 AS o_orderkey)" if t == "orders" else "*"
        duckdb.sql(f"COPY (SELECT {shifted} FROM '{sf}/{t}.parquet') TO '{tmp_path}/{t}.parquet'")
    con, sql, queries = oracle.connect(str(tmp_path)), __spark_entry__.oracle_sql(), __spark_entry__.queries()
    assert con.execute("SELECT count(DISTINCT o_orderkey // 10) * 2 < count(*) FROM orders").fetchone()[0]
    for name in ("rk_entity_search", "pl_search_bills"):
        assert oracle.difference(queries[name](spark, str(tmp_path)), sql[name], con) == ""


def test_entities_of_a_query_are_cut_before_they_are_moved(spark):
    from dossier.operators import index, search

    n = 30_000
    entities = spark.range(n).select(F.lpad(F.col("id").cast("string"), 7, "0").alias("number"), F.lit("word").alias("name"), F.when(F.col("id") % 2 == 0, "law").alias("committee"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 100).cast("int")).alias("proposed_at"), F.lit(None).cast("string").alias("result"), (F.col("id") % 3).alias("term"))
    wanted = spark.createDataFrame([(1, "word", None, None, None), (2, "word", None, 1, "LA"), (3, "word", "done", None, None)], "query_id long, q string, status string, term long, committee string")
    fields = index.build(entities, "number", ["name"], index.shared_folder(spark, "index"))
    texts = index.build(spark.createDataFrame([], "doc_id long, text string"), "doc_id", ["text"], index.shared_folder(spark, "index"))
    belongs = spark.createDataFrame([], "doc_id long, number string")
    known = entities.select("number", "proposed_at", "term", "committee", F.lit("pending").alias("status"))
    wishes = wanted.select("query_id", *(F.col(c).alias(f"want_{c}") for c in ("status", "term", "committee")))
    words = wanted.select("query_id", F.lit("word").alias("term"), F.lit(1).alias("n"))
    assert 0 < search._named(fields, words, known, wishes, 5).count() < n // 10  # every hit was joined and ranked before
    found = search.entity_search(fields, texts, belongs, entities, wanted, 5)
    newest = lambda test: [f"{i:07d}" for i in sorted((i for i in range(n) if test(i)), key=lambda i: (-(i % 100), i))[:5]]
    got = [(r.query_id, r.number) for r in found.orderBy("query_id", "rank").collect()]
    assert got == [(1, x) for x in newest(lambda i: True)] + [(2, x) for x in newest(lambda i: i % 3 == 1 and i % 2 == 0)]


def test_proposers_move_no_decision_and_other_names_are_not_grouped(spark):
    from dossier.operators import gate

    offered = spark.range(2000).select(F.col("id").cast("string").alias("candidate"), F.when(F.col("id") % 2 == 0, "representative").otherwise("co").alias("role"), F.concat(F.lit("n"), (F.col("id") % 100).cast("string")).alias("name"))
    proposers = spark.createDataFrame([(1, "any", "n7"), (2, "representative", "n8"), (2, "co", "n9")], "query_id long, role string, name string")
    met = gate.match_proposers(offered, proposers)
    assert "LeftSemi" in met._jdf.queryExecution().optimizedPlan().toString()  # every name was grouped first
    assert met.count() == 60 and met.where("all_met").count() == 20
    candidates = spark.range(2000).select(F.explode(F.lit([1, 2]).cast("array<long>")).alias("query_id"), F.col("id").cast("string").alias("candidate"), F.lit("entity").alias("kind"), F.col("id").cast("string").alias("number"), F.lit("law").alias("committee"), F.lit(None).cast("date").alias("day"), F.lit(None).cast("date").alias("proposed_on"), F.lit("t").alias("title"), F.lit("").alias("agenda"), F.lit("").alias("body"))
    scopes = spark.createDataFrame([(q, None, None, None, None, False) for q in (1, 2)], "query_id long, numbers array<string>, committee string, day_from date, day_to date, proposal_dated boolean")
    told = gate.relevance_gate(candidates, spark.createDataFrame([], "query_id long, kind string, term string"), scopes, offered, proposers)
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") >= 1  # decisions were shuffled with their texts
    assert told.where("accepted").count() == 20


def test_claims_of_keys_are_marked_as_every_claim_is(spark, monkeypatch):
    from dossier.operators import evidence as graph

    made = lambda schema, *data: spark.createDataFrame(list(data), schema)
    ids = [f"meeting:{g}" for g in range(0, 40, 2)] + [f"minutes:{g}" for g in range(0, 40, 3)] + [f"agenda:n:{n}" for n in range(0, 9, 2)] + ["agenda:", "bill:n:1", "bill:n:2", "bill:", "report:n:5", None]
    nodes = made("id string", *((i,) for i in ids))
    pairs = made("g long, n string", *((g, f"n:{g % 9}") for g in range(40)), (1, "n:1"), (3, None), (None, "n:2"), (None, None), (7, ""))
    numbers = pairs.select("n").unionByName(made("n string", ("n:77",)))
    end = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    edge = lambda df, source, target, *told: df.select(source.alias("source"), target.alias("target"), *(F.lit(x).alias(c) for x, c in zip(told, ("edge_type", "reason"))))
    rows = lambda df: sorted(map(str, df.select("source", "target", "edge_type", "reason", "gap").collect()))
    plain = edge(pairs, end("meeting", "g"), end("agenda", "n"), "has", "x").unionByName(edge(pairs, end("agenda", "n"), end("minutes", "g"), "by", "y"))
    for few in (graph.FEW_KEYS, 0):
        monkeypatch.setattr(graph, "FEW_KEYS", few)
        got = graph.mark_pairs(pairs, [("meeting", "agenda", "has", "x", False), ("agenda", "minutes", "by", "y", True)], nodes)
        assert rows(got) == rows(graph.mark_edges(plain, nodes)) and {r.gap for r in got.collect()} == {None, "missing_source", "missing_target", "missing_both"}
    plain = edge(numbers, end("agenda", "n"), end("bill", "n"), "for", "z").unionByName(edge(pairs, end("bill", "n"), end("report", "n"), "in", "w"))
    own = graph.mark_one_key([(numbers, ("agenda", "bill", "for", "z")), (pairs.select("n"), ("bill", "report", "in", "w"))], nodes)
    assert rows(own) == rows(graph.mark_edges(plain, nodes))
    assert own._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 1


def test_claims_of_agenda_rows_and_entities_are_not_moved_as_claims(spark, sf, monkeypatch):
    from dossier import scratch, views
    from dossier.operators import evidence as graph

    kept, own = {}, []
    write = scratch.written
    monkeypatch.setattr(graph, "written", lambda df, name: kept.setdefault(name, []).append(write(df, name)) or kept[name][-1])
    monkeypatch.setattr(views.scratch, "written", lambda df, name: own.append(name) or write(df, name))
    nodes, claims = evidence.marked(Tables(spark, sf))
    (moved,) = kept["claims"]
    keyed = ["has_status", "has_agenda", "agenda_for_bill", "evidenced_by_minutes"]
    assert moved.where(F.col("edge_type").isin(keyed)).count() == 0  # these were nine tenths of the claims, made distinct, written and looked up twice
    assert moved.select("edge_type").distinct().count() + len(keyed) == claims.select("edge_type").distinct().count()
    assert sorted(own) == ["bills", "listed"]  # each join of the wide tables is made once
    assert claims.count() == claims.select("source", "target", "edge_type", "reason").distinct().count()


def test_agenda_rows_are_moved_as_keys_and_parts_looked_up_once_each(spark, sf, tmp_path, monkeypatch):
    import duckdb

    import __spark_entry__
    from dossier import views
    import oracle

    for name in oracle.TABLES:
        (tmp_path / f"{name}.parquet").symlink_to(f"{sf}/{name}.parquet")
    for name in ("part", "lineitem"):
        (tmp_path / f"{name}.parquet").unlink()
    con = duckdb.connect()
    con.execute(f"COPY (SELECT k AS p_partkey, n AS p_name FROM (VALUES (1, 'one'), (2, 'two'), (3, 'three'), (3, 'three again'), (4, 'four'), (1000000, 'short'), (10000001, 'long'), (10000002, 'longer'), (20000005, 'alone')) v(k, n)) TO '{tmp_path}/part.parquet'")
    # parts that do not exist (8, 10000003, null) or that share a number, repeats, suppliers that do not exist
    con.execute(f"""COPY (SELECT i % 23 AS l_orderkey, [1, 2, 3, 4, 8, NULL, 1000000, 10000001, 10000002, 10000003, 20000005][i * 7 % 11 + 1] AS l_partkey, CASE WHEN i % 13 = 5 THEN -1 ELSE 1 END AS l_suppkey, i % 7 AS l_linenumber, 1.0 AS l_extendedprice, DATE '1997-01-02' AS l_shipdate
        FROM range(900) r(i) UNION ALL SELECT 2 * i, 20000005, 1, 1, 1.0, DATE '1997-01-02' FROM range(40) r(i)) TO '{tmp_path}/lineitem.parquet'""")
    kept, write, queries, sql = {}, views.scratch.written, __spark_entry__.queries(), __spark_entry__.oracle_sql()
    monkeypatch.setattr(views.scratch, "written", lambda df, name: kept.setdefault(name, write(df, name)))
    for name in ("gr_nodes", "gr_node_conflicts", "gr_edges", "gr_unresolved"):
        for few in (views.FEW_KEYS, 0):
            monkeypatch.setattr(views, "FEW_KEYS", few)
            assert oracle.difference(queries[name](spark, str(tmp_path)), sql[name], oracle.connect(str(tmp_path))) == "", name
    assert kept["listed"].count() <= 2 * 12  # a row for each line item was joined with its part and written
    pairs = Tables(spark, str(tmp_path)).listed_pairs
    assert pairs.count() == pairs.distinct().count() > 100


def _odd_tables(folder, sf):
    """Tables of ``sf`` with missing, repeated and long keys and null dates."""
    import os

    import duckdb
    from oracle import TABLES

    con = duckdb.connect()
    some = lambda table, change, n: f"(SELECT * REPLACE ({change}) FROM '{sf}/{table}.parquet' LIMIT {n})"
    added = {
        "lineitem": [some("lineitem", "NULL AS l_orderkey", 30), some("lineitem", "NULL AS l_orderkey", 10), some("lineitem", "99999999 AS l_partkey", 7), some("lineitem", "NULL AS l_shipdate", 9), some("lineitem", "NULL AS l_orderkey, NULL AS l_shipdate", 4), some("lineitem", "NULL AS l_partkey", 3)],
        "part": [some("part", "upper(p_name) AS p_name", 5), some("part", "NULL AS p_partkey", 2)], "supplier": [some("supplier", "NULL AS s_suppkey", 2), some("supplier", "upper(s_name) AS s_name", 1)], "customer": [some("customer", "upper(c_name) AS c_name", 4)],
        "orders": [some("orders", "NULL AS o_orderkey", 6), some("orders", "123456780 + o_orderkey % 10 AS o_orderkey", 40), some("orders", "o_totalprice + 1 AS o_totalprice, CASE o_orderstatus WHEN 'F' THEN 'O' ELSE 'F' END AS o_orderstatus", 8), some("orders", "NULL AS o_orderdate, 'F' AS o_orderstatus", 3), some("orders", "-1 AS o_custkey", 2)],
        "documents": [some("documents", "NULL AS doc_id", 3), some("documents", "upper(text) AS text", 4), some("documents", "NULL AS source", 2)], "pages": [some("pages", "'2020-02-03' AS url", 2), some("pages", "NULL AS page_id", 2), some("pages", "html || '.' AS html", 2)],
    }
    without = {"part": "p_partkey % 50 != 7", "supplier": "s_suppkey % 5 != 2"}
    for table in TABLES:
        if table not in added:
            os.symlink(f"{sf}/{table}.parquet", folder / f"{table}.parquet")
            continue
        kept = f"(SELECT * FROM '{sf}/{table}.parquet' WHERE {without.get(table, 'true')})"
        con.execute(f"COPY ({' UNION ALL '.join([kept, *added[table]])}) TO '{folder}/{table}.parquet' (FORMAT parquet)")


def test_inventory_of_odd_keys_equals_its_sql(spark, sf, tmp_path, monkeypatch):
    from oracle import connect, difference

    from dossier import registry
    from dossier.catalog import aggregation as queries

    _odd_tables(tmp_path, sf)
    con, sql = connect(tmp_path), registry.oracle_sql()["ag_inventory"]
    assert difference(queries.ag_inventory(Tables(spark, str(tmp_path))), sql, con) == ""
    unassigned = con.execute(f"SELECT types FROM ({sql}) WHERE entity_type = 'unassigned'").fetchall()
    assert len(unassigned) == 1 and "bills:6" in unassigned[0][0]
    monkeypatch.setattr(queries, "FEW_KEYS", 0)  # parts that are missing or repeated are too many to broadcast
    assert difference(queries.ag_inventory(Tables(spark, str(tmp_path))), sql, con) == ""


def test_inventory_counts_agenda_rows_as_keys(spark, sf):
    from dossier.catalog.aggregation import ag_inventory

    plan = ag_inventory(Tables(spark, sf))._jdf.queryExecution().executedPlan().toString()
    for step in ("Window", "LeftAnti", "p_name", "c_name"):
        assert step not in plan
    assert sum("FileScan" in row and "l_orderkey" in row for row in plan.splitlines()) <= 2  # by groups and rows without one; parts are counted before
