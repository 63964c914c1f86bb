"""Queries whose work grows no faster than their input: rows between steps, searches and model calls."""

from __future__ import annotations

import datetime
import difflib
import random
import time

from auditloom.operators import chain as C
from auditloom.operators import evaluation as E
from auditloom.operators import findings as A
from auditloom.operators import metrics as M
from auditloom.operators import scope as S
from auditloom.operators import segment as G
from auditloom.operators import spans as P
from auditloom.plans import everyday, retrieval
from pyspark.sql import functions as F


def most_rows(df) -> tuple[int, list]:
    """The most rows that any step of a query gives, and the query's rows."""
    spark = df.sparkSession
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    before, rows = store.executionsCount(), df.collect()
    bus.waitUntilEmpty()
    runs, most = store.executionsList(int(before), 1000), 0
    for i in range(runs.size()):
        run = runs.apply(i).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for j in range(nodes.size()):
            metrics = nodes.apply(j).metrics()
            for k in range(metrics.size()):
                value = values.get(metrics.apply(k).accumulatorId())
                if metrics.apply(k).name() == "number of output rows" and value.isDefined():
                    most = max(most, int(value.get().replace(",", "")))
    assert most >= len(rows)
    return most, rows


def test_longest_match():
    chance = random.Random(3)
    for _ in range(500):
        hay, needle = ("".join(chance.choices("abc ", k=n)) for n in (chance.randint(0, 40), chance.randint(0, 20)))
        assert A.longest_match(hay, needle) == tuple(difflib.SequenceMatcher(None, hay, needle, autojunk=False).find_longest_match())
    begun = time.monotonic()
    assert A.locate_quote("quite other words than any of these 0123456789", "the report says so and so on " * 100_000) == (-1, -1, 0.0)
    assert time.monotonic() - begun < 2  # difflib's search takes about 2 seconds a million characters


def test_chain_searches_once(spark):
    """Each step in Python (model, replies, quotes, judge) is part of one written table."""
    passages = spark.createDataFrame([(str(n), "", f"A passage {n} with words enough for a quote of forty characters") for n in range(8)], "passage_id string, title string, text string")
    steps = []

    def keep(df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        steps.append(plan.count("MapIn") + plan.count("ArrowEvalPython"))
        return df.localCheckpoint()

    def retrieve(queries):
        return queries.selectExpr("query_id", "1 AS rk", "'Art.1.1' AS clause_id", "'Article 1' AS path", "'A requirement' AS text")

    C.audited(passages, retrieve, everyday.scripted, keep=keep, judge=everyday.scripted_judge)
    assert sum(steps) == 5


def test_clause_lists(spark):
    """Clauses of 3 chunks that many queries hit: lists and counts as those of every clause for every query, which would be 90,000 rows."""
    cover = [(c, f"C{n}", n * 7 % 50) for n in range(1000) for c in (n % 5, (n + 1) % 5 if n % 3 else n % 5)] + [(1, None, 3), (None, "C1", 0)]
    hit = [(q, rk, (q * 2 + rk * 3) % 6) for q in range(60) for rk in (1, 2, 3)]
    coverage, hits = spark.createDataFrame(cover, "chunk int, clause_id string, start int"), spark.createDataFrame(hit, "query_id int, rk int, chunk int")
    lists = {}
    for q, rk, chunk in hit:
        lists.setdefault(q, []).extend((rk, start, clause or "", clause) for c, clause, start in cover if c == chunk)
    most, rows = most_rows(E.clause_counts(hits, coverage))
    assert most <= 3 * len(cover)
    assert {tuple(r) for r in rows} == {(q, len(x), len({c for *_, c in x if c is not None})) for q, x in lists.items() if x}
    most, rows = most_rows(E.clause_hits(hits, coverage, 12))
    assert most <= 3 * len(cover)
    first = {}
    for q, x in lists.items():
        own = list(dict.fromkeys(c for *_, c in sorted(x)))[:12]
        first |= {(q, n + 1): c for n, c in enumerate(own)}
    assert {(r.query_id, r.rk): r.clause_id for r in rows} == first


def test_appended_bags(spark):
    most, rows = most_rows(everyday.bag_append(spark, "/root/testdata/sf0.01"))
    assert most < 10_000 < sum(r.n for r in rows)


def test_chosen_clauses(spark):
    """Long instruments that many passages choose: the first clauses alone meet passages. All would be 60,000 rows and more."""
    clause = [(f"I{n % 4}", n // 4, f"C{n}") for n in range(4000)] + [("I9", 1, "D1"), ("I9", 0, "D0")]
    choice = [(p, c, i) for p in range(20) for c, i in enumerate(("I9", f"I{p % 5}", f"I{(p + 1) % 5}", "I0"))]
    clauses, choices = spark.createDataFrame(clause, "instrument string, ord int, clause_id string"), spark.createDataFrame(choice, "passage_id int, choice_no int, instrument string")
    most, rows = most_rows(E.chosen_clauses(choices, clauses))
    assert most <= len(clause)
    expected = {}
    for p in range(20):
        own = sorted((c, o, k) for q, c, i in choice if q == p and c < 3 for j, o, k in clause if i == j)[:45]
        expected |= {(p, n + 1): k for n, (*_, k) in enumerate(own)}
    assert {(r.passage_id, r.place): r.clause_id for r in rows} == expected


def test_two_stage_offers(spark):
    """What is offered to all is no row for each passage: 40 passages by 400 instruments would be 16,000."""
    passages = spark.range(40).selectExpr("id AS passage_id", "'' AS text")
    catalogue = spark.range(400).selectExpr("'I' || id AS instrument", "'' AS title", "id AS place")
    clauses = spark.range(2000).selectExpr("'I' || id % 400 AS instrument", "id AS ord", "'C' || id AS clause_id", "'' AS text")
    first = lambda offers: offers.selectExpr("passage_id", "explode(array('X', 'I' || passage_id, 'I' || passage_id, 'I7')) AS instrument", "1 AS proposal_no").union(offers.selectExpr("-1", "'I1'", "1"))
    second = lambda shown: shown.selectExpr("passage_id", "posexplode(array('C1', 'C7', blocks[0].clause_id)) AS (proposal_no, clause_id)")
    most, rows = most_rows(E.two_stages(passages, catalogue, clauses, first, second))
    assert most <= 2000
    assert {r.passage_id for r in rows} == set(range(40)) and all(r.clause_id != "C1" or r.passage_id == 1 for r in rows)


def test_rolling_seconds(spark):
    """Parts of a second count towards the nearest one: 0.6 and 3601.4 are 3600 apart, 0.4 and 3600.6 are not."""
    at = lambda s: datetime.datetime(2024, 3, 10, 6, 0) + datetime.timedelta(seconds=s)
    rows = spark.createDataFrame([("a", at(0.6)), ("a", at(3601.4)), ("b", at(0.4)), ("b", at(3600.6)), ("c", at(1.5)), ("c", at(3602.5))], "k string, ts timestamp_ntz")
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            got = P.rolling_sum(rows, "k", "ts", F.lit(1), 3600).orderBy("k", "ts").collect()
            assert [r.rolling for r in got] == [1, 2, 1, 1, 1, 2]
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_label_counts(spark):
    """Counts of what labels expand to, without a row for each query and key: 40 queries by 500 keys and more would be."""
    key = [f"L{n % 3}.S{n % 12}.D{n}" for n in range(500)] + ["L1", "L1.S4", "L1.S4.D4", "Lx"]
    label = [(q, s, g) for q in range(40) for s, g in ((f"L{q % 3}", 1), (f"L{q % 3}.S{q % 12}", 2), ("L1", 3 if q % 7 == 0 else 1), (f"L1.S4.D{q}", 2), ("L", 2))]
    labels, corpus = spark.createDataFrame(label, "query_id int, scope string, grade int"), spark.createDataFrame([(k,) for k in key], "doc_id string")
    most, rows = most_rows(S.label_counts(labels, corpus))
    assert most <= 4 * len(key)
    expected = S.expand_labels(labels, corpus).groupBy("query_id", "grade").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    assert sorted(rows) == sorted(expected.collect())


def test_grades_by_rule(spark):
    """Metrics of vectors: no row for each query and document of a neighbouring label; 100 queries have 60,000 of those."""
    hits = retrieval.knn(spark, "/root/testdata/sf0.1").localCheckpoint()
    queries, graded, counts = retrieval.vector_grades(spark, "/root/testdata/sf0.1", hits)
    most, rows = most_rows(M.metrics_of(queries, graded, counts, [1, 5, 10]))
    assert most <= 6000
    q, docs = retrieval.vectors(spark, "/root/testdata/sf0.1")
    gold = q.selectExpr("query_id", "label AS ql").join(docs, F.expr("abs(label - ql) <= 1 AND doc_id <> query_id")).selectExpr("query_id", "doc_id", "if(label = ql, 2, 1) AS grade")
    assert sorted(rows) == sorted(M.metrics_at(queries, hits, gold, [1, 5, 10]).collect())
    cost = retrieval.costs(spark, "/root/testdata/sf0.1")
    assert sorted(M.budget_recalls_of(queries, graded, cost, counts, [300, 900]).collect()) == sorted(M.budget_recalls(queries, hits, cost, gold, [300, 900]).collect())


def test_outside_boxes(spark):
    """Points that many boxes could hold: 1,000 points by 300 boxes of one page, of which a place meets those near it; odd boxes and points too."""
    chance = random.Random(5)
    box = [(n % 3, x, y, x + w, y + chance.choice((0.0, 0.3, 2.0))) for n in range(300) for x, y, w in [(chance.uniform(-50, 50), chance.uniform(-50, 50), chance.choice((0.0, 1.0, 3.0)))]] * 3
    box += [(1, 5.0, 5.0, 4.0, 9.0), (2, None, 0.0, 1.0, 1.0), (0, -60.0, 20.0, 60.0, 25.0), (0, 7.0, 7.0, 7.0, 7.0)]
    point = [(n, n % 4, chance.uniform(-55, 55), chance.uniform(-55, 55)) for n in range(1000)] + [(2000, 0, 7.0, 7.0), (2001, 0, None, 7.0), (2002, None, 1.0, 1.0), (2003, 1, 4.5, 6.0)]
    point += [(3000 + i, p, x, y) for i, (p, x, y, _, _) in enumerate(box[:200])]
    lines, boxes = spark.createDataFrame(point, "n int, page int, x double, y double"), spark.createDataFrame(box, "page int, x0 double, y0 double, x1 double, y1 double")
    got = G.outside_boxes(lines, boxes)
    assert got.columns == lines.columns
    inside = lambda p, x, y: any(p == q and None not in (x, y, x0) and x0 <= x <= x1 and y0 <= y <= y1 for q, x0, y0, x1, y1 in box)
    assert {r.n for r in got.collect()} == {n for n, p, x, y in point if not inside(p, x, y)}
    # Not by page alone: the join asks for the cell too.
    assert "_cx" in got._jdf.queryExecution().optimizedPlan().toString()


def test_clause_spans(spark):
    """Only documents that hold the rarest token of a clause are opened, and the ranges are those of a plain search: 300 starts with a common first token aren't."""
    chance = random.Random(7)
    clause = {n: chance.choices("the of a device shall be safe report".split(), k=chance.randint(1, 9)) + ([f"rare{n}"] if n % 2 else []) for n in range(8)}
    text = [chance.choices("the of a device shall be safe report".split(), k=chance.randint(0, 60)) for _ in range(40)]
    for n, t in enumerate(text):
        own = [w for w in clause[n % 8] if chance.random() < 0.97]
        t[len(t) // 2 : len(t) // 2] = own[:3] + ["odd"] * (n % 3) + own[3:]
    expected = {}
    for i, t in enumerate(text):
        for c, w in clause.items():
            for start in (k for k, x in enumerate(t) if x == w[0]):
                window, j, got = t[start : start + len(w) * 3 // 2 + 24], 0, 0
                while got < len(w) and w[got] in window[j:]:
                    j, got = j + window[j:].index(w[got]) + 1, got + 1
                if got >= max(1, int(len(w) * 0.85)):
                    expected[i, c] = max(expected.get((i, c), (0,)), (got, -j, start))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(text)], "doc_id int, text string")
    clauses = spark.createDataFrame([(c, " ".join(w)) for c, w in clause.items()], "clause_id int, text string")
    assert {(r.doc_id, r.clause_id): (r.start, r.end) for r in P.clause_spans(docs, clauses).collect()} == {k: (s, s - j) for k, (_, j, s) in expected.items()}
    many = spark.createDataFrame([(i, "the " * 300 + ("unseen" if i == 7 else "")) for i in range(50)], "doc_id int, text string")
    most, rows = most_rows(P.clause_spans(many, spark.createDataFrame([(1, "the unseen word")], "clause_id int, text string")))
    assert most <= 300 and [tuple(r) for r in rows] == [(7, 1, 299, 301)]


def test_search_memory(spark):
    """A worker's blocks are arrays: what meets is scored some queries at a time, and a second block is held against what the first reached."""
    from auditloom.operators import retrieval as R

    own = lambda n, f: spark.range(n, numPartitions=2).selectExpr("id", f"transform(sequence(1, 4), i -> cast(({f}) % 7 AS float)) AS vector")
    queries, docs = own(300, "id * i * 3 + i"), own(5000, "id * id * i + 2 * i")
    got = R.dense_topk(queries.withColumnRenamed("id", "query_id"), docs.withColumnRenamed("id", "doc_id"), 3).collect()
    vectors = [(r.id, list(r.vector)) for r in docs.collect()]
    for q in queries.collect():
        best = sorted((-sum(a * b for a, b in zip(q.vector, v, strict=True)), n) for n, v in vectors)[:3]
        assert sorted((r.rk, -r.score, r.doc_id) for r in got if r.query_id == q.id) == [(k + 1, s, n) for k, (s, n) in enumerate(best)]
    import numpy as np
    import pyarrow as pa

    block = pa.array([[1.0, 2.0]] * 300)
    _, parts = R.dot_scores({"q_ids": pa.array(range(300)), "q_vals": block, "ids": pa.array(range(300)), "vals": block})
    assert [x.shape for _, x in parts] == [(128, 300), (128, 300), (44, 300)]
    edges = np.full(1, -np.inf)
    assert R.best_of_block(np.arange(4), np.array([[1.0, 5.0, 3.0, 4.0]]), 2, edges)[1].tolist() == [1, 3] and edges.tolist() == [4.0]
    assert R.best_of_block(np.arange(4, 7), np.array([[3.9, 4.0, np.nan]]), 2, edges)[1].tolist() == [1]


def test_replies_some_at_a_time(spark):
    """A worker parses 200 replies before it gives them on; all columns stay what they are, whole numbers beside nulls too."""
    frame = spark.range(450, numPartitions=1).selectExpr("if(id % 3 = 0, null, id + 9007199254740993) AS k", "if(id % 2 = 0, '{\"a\": 1}', null) AS raw")
    rows = A.parsed(frame).collect()
    assert [r.k for r in rows] == [None if n % 3 == 0 else n + 9007199254740993 for n in range(450)]
    assert {(r.payload, r.salvaged, r.error) for r in rows} == {('{"a": 1}', False, None), (None, False, "empty reply")}
