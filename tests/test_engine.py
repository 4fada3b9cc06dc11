"""The engine on a small graph of customers, products and orders with known answers."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tideline.errors import ExecutionFault, QueryError, ScoringFault
from tideline.operators.context import Policy
from tideline.plans.engine import Engine, Request, render
from tideline.plans.scorers import TokenScorer
from tideline.schema import Catalog, infer

NOON = datetime(2031, 3, 1)
MEMBER = "PREDICT EXISTS(loan.*) OVER (14 DAYS FOLLOWING) FROM member"


@pytest.fixture(scope="module")
def graph(spark):
    """A lending library: members borrow books; one loan starts after NOON, one has no date."""
    at = lambda text: text and datetime.fromisoformat(text)
    frames = {
        "member": spark.createDataFrame([(11, "north", 3.5, at("2030-11-05")), (12, "south", 0.0, at("2030-12-24")), (13, "north", None, at("2031-01-15")), (14, "east", 8.25, at("2031-02-02"))], "mid long, branch string, fees double, joined timestamp_ntz"),
        "book": spark.createDataFrame([("b-a", 412, "atlas"), ("b-k", 96, "kites"), ("b-w", 230, None)], "bid string, pages int, title string"),
        "loan": spark.createDataFrame(
            [(501, 11, "b-a", 21, at("2031-01-04 09:00")), (502, 11, "b-k", 7, at("2031-02-20 17:30")), (503, 12, "b-a", 14, at("2031-02-27 08:15")), (504, 11, "b-w", 28, at("2031-03-09 10:00")), (505, 14, "b-w", 5, None), (506, 11, "b-a", 9, at("2030-12-12"))],
            "lid long, mid long, bid string, days int, start timestamp_ntz",
        ),
    }
    schema = infer(frames, {"member": "mid", "book": "bid", "loan": "lid"}, {"loan": "start"}, [("loan", "mid", "member"), ("loan", "bid", "book")])
    return Engine(spark, Catalog(schema, frames))


def ids(df):
    return {r["entity_id"] for r in df.collect()}


def test_cohorts(graph):
    q = f"{MEMBER} WHERE COUNT(loan.*) OVER (60 DAYS PRECEDING) {{}} AS OF 2031-03-01"
    assert ids(graph.cohort(q.format("> 0"))) == {11, 12}
    assert ids(graph.cohort(q.format("= 0"))) == {13, 14}
    assert ids(graph.cohort(Request(MEMBER, anchor_time=NOON, entity_ids=[14, 11, 14]))) == {11, 14}
    assert [tuple(r) for r in graph.pinned(f"{MEMBER} WHERE mid IN (13, 99) AS OF 2031-03-01").orderBy("entity_id").collect()] == [(13, True), (99, False)]


def test_labels(graph):
    q = "PREDICT SUM(loan.days) OVER (28 DAYS FOLLOWING) FROM member WHERE mid = 11 AS OF 2031-03-01"
    assert [r["label"] for r in graph.history(q).orderBy("k").collect()] == [7.0, 21.0, 9.0]  # after Feb 1, Jan 4 at 0:00 (its loan is at 9:00) and Dec 7
    rows = {(r["entity_id"], r["k"]): r["label"] for r in graph.history("PREDICT NOT EXISTS(loan.*) OVER (28 DAYS FOLLOWING) FROM member AS OF 2031-03-01").collect()}
    assert all(rows[13, k] for k in (1, 2, 3)) and not rows[12, 1] and rows[12, 2]


def test_history_means_by_hand(spark):
    spans = {"2029-09-20": [4.0, 6.5], "2029-08-11": [1.0], "2029-06-30": [2.5, 2.5, 7.0]}  # 40, 80 and 122 days before Oct 30: windows 1, 2 and none of three
    rows = [(f"{d}/{k}", v, datetime.fromisoformat(d), 1) for d, values in spans.items() for k, v in enumerate(values)]
    frames = {"c": spark.createDataFrame([(1, 1.0)], "id long, x double"), "o": spark.createDataFrame(rows, "oid string, amount double, at timestamp_ntz, cid long")}
    e = Engine(spark, Catalog(infer(frames, {"c": "id", "o": "oid"}, {"o": "at"}, [("o", "cid", "c")]), frames))
    for what, want in (("SUM(o.amount)", (10.5 + 1.0 + 0.0) / 3), ("COUNT(o.*)", 1.0), ("AVG(o.amount)", (5.25 + 1.0) / 2)):
        assert e.execute(f"PREDICT {what} OVER (40 DAYS FOLLOWING) FROM c AS OF 2029-10-29", "history").first()["value"] == pytest.approx(want)
    forecast = e.execute("PREDICT COUNT(o.*) OVER (40 DAYS FOLLOWING HORIZONS 3) FROM c AS OF 2029-10-29", "history").first()["forecast"]
    assert forecast == pytest.approx([1, 1, 1])


def rows_of(context, entity):
    return {r["row_id"] for r in context.where(F.col("entity_id") == entity).collect()}


def test_context_holds_no_future(graph):
    q = f"{MEMBER} WHERE mid = 11 AS OF {{}}"
    assert rows_of(graph.assemble_context(q.format("2031-03-01")), "11") == {"11", "501", "502", "506", "b-a", "b-k"}
    assert {"504", "b-w"} <= rows_of(graph.assemble_context(q.format("2031-03-10")), "11")
    one = graph.assemble_context(q.format("2031-03-01"), Policy(bfs_width=1, max_hops=1))
    assert rows_of(one, "11") == {"11", "502"} and one.first()["truncated"] == 1
    assert rows_of(graph.assemble_context(q.format("2031-03-01"), Policy(max_context_cells=1)), "11") == {"11"}
    assert "12" in rows_of(graph.assemble_context(q.format("2031-03-01"), Policy(max_hops=1, cohort_size=1)), "11")


def test_assumptions(graph):
    def loans(what, who):
        q = f"{MEMBER} WHERE mid = {who} ASSUMING {what} AS OF 2031-03-01"
        return graph.assemble_context(q).where("tbl = 'loan' AND is_focal").collect()

    made = loans("COUNT(loan.*) OVER (30 DAYS PRECEDING) >= 4", 13)
    assert len(made) == 4 and all(datetime(2031, 1, 30) < r["ts"] <= NOON and r["parents"]["mid"] == "13" for r in made)
    assert {r["row_id"] for r in loans("COUNT(loan.*) OVER (100 DAYS PRECEDING) = 2", 11)} == {"501", "502"}
    assert loans("NOT EXISTS(loan.*)", 12) == []
    for bad in ("loan.days > 3", "COUNT(loan.*) < 0", "COUNT(loan.*) = 2.5", "MAX(loan.days) = 3", "COUNT(loan.* WHERE days > 1) = 1", "member.fees = 3 OR member.fees = 4", "COUNT(member.*) = 2"):
        with pytest.raises(QueryError):
            loans(bad, 11)
    with pytest.raises(Exception, match="too narrow"):
        loans("COUNT(loan.*) OVER (3 SECONDS PRECEDING) >= 9", 13)
    moved = graph.assemble_context(f"{MEMBER} ASSUMING member.branch = 'west' AS OF 2031-03-01").where("tbl = 'member' AND hop = 0").collect()
    assert {r["cells"]["branch"] for r in moved} == {"west"}


def test_ablation(graph):
    q = f"{MEMBER} WHERE mid = 11 AS OF 2031-03-01"
    got = {(r["kind"], r["name"]): r["mean_delta"] for r in graph.ablation(q).collect()}
    assert got["table", "book"] == -4 and got["column", "member.fees"] == -1 and got["table", "loan"] == -6
    score = lambda c: c.groupBy("entity_id").agg(F.sum("n_cells").cast("double").alias("score"))
    assert {(r["kind"], r["name"]): r["mean_delta"] for r in graph.ablation(q, score).collect()} == got
    assert rows_of(graph.assemble_context(f"{MEMBER} WHERE mid = 11 ABLATE TABLE book AS OF 2031-03-01"), "11") == {"11", "501", "502", "506"}


def test_explain(graph):
    plan = graph.explain(f"EXPLAIN PLAN FORMAT JSON {MEMBER} WHERE mid IN (12, 11) AS OF 2031-03-01")
    assert plan["plan"]["entity"]["selector"] == [12, 11] and plan["plan"]["execution"]["cohort_size"] == 2 and '"task_type": "binary"' in render(plan)
    context = graph.explain(f"EXPLAIN CONTEXT {MEMBER} WHERE mid = 11 AS OF 2031-03-01")
    assert {r["tbl"]: r["n_rows"] for r in context["context"]} == {"member": 1, "loan": 3, "book": 2} and "context:" in render(context)
    assert context["links"] == ["loan.mid -> member", "loan.bid -> book"] and context["unreached"] == []
    analyzed = graph.explain("EXPLAIN ANALYZE PREDICT SUM(loan.days) OVER (30 DAYS FOLLOWING) FROM member AS OF 2031-03-01", "history")
    assert analyzed["predictions"].count() == 4
    with pytest.raises(ExecutionFault):
        graph.execute(f"EXPLAIN {MEMBER} AS OF 2031-03-01", "truth")


def test_scorers_and_anchors(graph):
    with pytest.raises(ScoringFault):
        graph.execute(f"{MEMBER} AS OF 2031-03-01")
    with pytest.raises(ExecutionFault):
        graph.cohort(f"{MEMBER} WHERE COUNT(loan.*) > 1")
    with pytest.raises(ExecutionFault):
        graph.cohort(f"{MEMBER} AS OF NOW")
    assert {r["entity_id"]: r["label"] for r in graph.execute(Request(f"{MEMBER} AS OF NOW", anchor_time=NOON), "truth").collect()} == {11: 1, 12: 0, 13: 0, 14: 0}
    model = TokenScorer(lambda batch: batch["tbl"].map(len).astype(float))
    scored = graph.execute("PREDICT SUM(loan.days) OVER (30 DAYS FOLLOWING) FROM member WHERE mid = 11 AS OF 2031-03-01", model).first()
    assert scored["value"] == 1 + 3 + 3 + 6 + 4  # target, labels, and the cells of the member, of three loans and of two books


def test_no_time_zone_moves_an_anchor(graph, monkeypatch):
    import os
    import time

    was = os.environ.get("TZ")
    try:
        for zone in ("America/New_York", "Asia/Tokyo"):
            monkeypatch.setenv("TZ", zone)
            time.tzset()
            at = datetime(2031, 2, 20, 17, 30)
            assert {r["lid"] for r in graph.catalog.bounded("loan", at).collect()} == {501, 502, 505, 506}
            assert {r["lid"] for r in graph.catalog.rows("loan", [502, 503], at.replace(hour=17, minute=29)).collect()} == set()
            assert graph.candidates(Request("PREDICT LIST_DISTINCT(loan.bid) OVER (9 DAYS FOLLOWING RANK TOP 1) FROM member", anchor_time=at)).count() == 3
    finally:
        monkeypatch.undo() if was is None else os.environ.__setitem__("TZ", was)
        time.tzset()


def test_own_anchors_see_no_future(spark):
    day = lambda d: datetime(2031, 5, d)
    rows = [(1, "red", 1.0, day(2)), (2, "red", 2.0, day(4)), (3, "blue", 6.0, day(4)), (4, "blue", 9.0, day(7)), (5, "blue", 4.0, day(9)), (6, "red", 5.0, None)]
    frames = {"t": spark.createDataFrame(rows, "id long, colour string, x double, at timestamp_ntz")}
    e = Engine(spark, Catalog(infer(frames, {"t": "id"}, {"t": "at"}, []), frames))
    ask = lambda what: Request(f"PREDICT {what} FROM t", anchor_time=day(8), per_entity_anchor=True)
    got = {(r["anchor_ts"].day, r["class"]): r["n"] for r in e.class_domain(ask("colour")).collect()}
    assert got == {(2, "red"): 2, (4, "red"): 3, (4, "blue"): 1, (7, "red"): 3, (7, "blue"): 2, (8, "red"): 3, (8, "blue"): 2}
    best = {r["entity_id"]: r["predicted_class"] for r in e.execute(ask("colour"), "history").collect()}
    assert best == {1: "red", 2: "red", 3: "red", 4: "red", 6: "blue"}
    mean = {r["entity_id"]: r["value"] for r in e.execute(ask("x"), "history").collect()}
    assert mean == {1: 5.0, 2: 4.0, 3: pytest.approx(8 / 3), 4: 3.5, 6: 4.5}


def test_dangling_and_several_parents(spark):
    frames = {"a": spark.createDataFrame([(1, 1.0), (2, 2.0)], "id long, x double"), "b": spark.createDataFrame([(1, [1, 2], datetime(2024, 1, 1)), (2, [], None), (3, [2, 9], datetime(2024, 1, 2))], "bid long, aids array<long>, ts timestamp_ntz")}
    catalog = Catalog(infer(frames, {"a": "id", "b": "bid"}, {"b": "ts"}, [("b", "aids", "a")]), frames)
    assert [tuple(r) for r in catalog.dangling().collect()] == [("b", "aids", "a", 1)]
    got = Engine(spark, catalog).truth("PREDICT COUNT(b.*) OVER (9 DAYS FOLLOWING) FROM a AS OF 2023-12-31").collect()
    assert {r["entity_id"]: r["label"] for r in got} == {1: 1.0, 2: 2.0}


def test_walk_peers_and_stats(graph):
    from tideline.operators.walks import walk_peers

    cohort = graph.prepare(f"{MEMBER} AS OF 2031-03-01").cohort
    policy = Policy(walk_length=6, num_walks=12)
    rows = {(r["entity_id"], r["peer_id"]): r["visits"] for r in walk_peers(cohort, graph.catalog, "member", NOON, policy).collect()}
    assert rows.get(("11", "12"), 0) > 0 and not any("13" in k or "14" in k for k in rows if k != ("11", "14"))
    again = walk_peers(cohort.repartition(7), graph.catalog, "member", NOON, policy)
    assert {(r["entity_id"], r["peer_id"]): r["visits"] for r in again.collect()} == rows
    assert graph.stats(f"{MEMBER} WHERE mid = 11 AS OF 2031-03-01") == {"entities": 1, "truncated_contexts": 0, "truncations": 0}
    walking = Engine(graph.spark, graph.catalog, policy=Policy(max_hops=1, walk_length=6, num_walks=12), traversal="walks")
    assert "12" in rows_of(walking.assemble_context(f"{MEMBER} WHERE mid = 11 AS OF 2031-03-01"), "11")


def test_scores_to_predictions(spark):
    from tideline.functions import scoring

    df = spark.createDataFrame([([1.0, 0.0], [("a", [0.0, 2.0]), ("b", [3.0, 0.1])], [(0.2, 7), (0.9, 8), (0.9, 6)])], "f array<double>, c array<struct<name:string,vector:array<double>>>, r array<struct<p:double,id:long>>")
    row = df.select(
        scoring.class_by_cosine(F.col("f"), F.col("c")).alias("best"), scoring.class_probabilities(F.col("f"), F.col("c")).alias("p"), scoring.top_k(F.col("r"), 2).alias("top"),
        scoring.decode(F.lit(0.0), F.lit(181.0), F.lit(5.0)).alias("mean"), scoring.sigmoid(F.lit(0.0)).alias("half"),
    ).first()
    assert (row["best"], row["top"], row["mean"], row["half"]) == ("b", ["8", "6"], 181.0, 0.5) and sum(row["p"]) == pytest.approx(1)


def test_remote_scorer(graph):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from tideline.plans.scorers import RemoteScorer

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            rows = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["rows"]
            body = json.dumps({"scores": [float(len(r["tbl"])) for r in rows]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    scorer = RemoteScorer(f"http://127.0.0.1:{server.server_port}/v1/score", batch=2)
    rows = graph.execute("PREDICT SUM(loan.days) OVER (30 DAYS FOLLOWING) FROM member WHERE mid = 11 AS OF 2031-03-01", scorer).collect()
    server.shutdown()
    assert [r["value"] for r in rows] == [17.0]


def test_rescoring_stream(graph, spark, tmp_path):
    from tideline.streaming import rescore

    path = str(tmp_path / "in")
    graph.catalog.frame("loan").write.parquet(path)
    stream = spark.readStream.schema(graph.catalog.frame("loan").schema).parquet(path)
    got = []
    q = rescore(graph, stream, "start", Request("PREDICT COUNT(loan.*) OVER (90 DAYS FOLLOWING) FROM member"), lambda df, n: got.append(df.count()), str(tmp_path / "check"))
    q.awaitTermination(120)
    assert got == [4]
