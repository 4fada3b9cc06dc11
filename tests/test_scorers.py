"""Batches, heads and remote scorers."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pandas as pd
import pytest
from tideline.errors import ExecutionFault, RemoteFault, ScoringFault
from tideline.operators.context import Policy
from tideline.plans import validate as V
from tideline.plans.batches import collated, name_id, packed
from tideline.plans.engine import Engine
from tideline.plans.scorers import HeadScorer, RemoteScorer, TokenScorer
from tideline.schema import shop

NUMBER = "PREDICT COUNT(orders.*) OVER (90 DAYS FOLLOWING) FROM customer WHERE c_custkey IN (1, 2, 4, 7) AS OF 1997-01-01"
YES = "PREDICT NOT EXISTS(orders.*) OVER (90 DAYS FOLLOWING) FROM customer WHERE c_custkey IN (1, 2, 4, 7) AS OF 1997-01-01"
CLASS = "PREDICT customer.c_mktsegment FROM customer WHERE c_custkey IN (1, 2, 4, 7) AS OF 1997-01-01"


def lengths(batch):
    return [float(len(x)) for x in batch["code"]]


class Fitted:
    def __init__(self, task, classes=None):
        self.task, self.classes = task, classes

    def predict(self, features):
        return features[:, 0] / 1000 if self.classes is None else np.stack([features[:, 0] * 0, features[:, 0] / features[:, 0]], 1)


def features(arrays):
    return np.stack([arrays["mask"].sum(1), arrays["z"].sum(1)], 1)


def test_packed():
    sizes = np.array([5, 1, 9, 2, 2, 30, 1])
    batches = [b.tolist() for b in packed(sizes, 3, 12)]
    assert sorted(k for b in batches for k in b) == list(range(7)) and all(len(b) <= 3 for b in batches)
    assert all(len(b) == 1 or len(b) * max(sizes[b]) <= 12 for b in batches) and [5] in batches
    assert list(packed(np.array([], int))) == []


def test_collated():
    batch = pd.DataFrame({
        "kind": [["target", "cell"], ["target"]], "tbl": [["t", "u"], ["t"]], "col": [["", "x"], [""]], "code": [[0, 1], [0]],
        "text": [[None, "hey"], [None]], "number": [[None, 2.0], [None]], "z": [[None, 1.5], [None]],
    })
    made = collated(batch)
    assert made["mask"].tolist() == [[True, True], [True, False]] and made["code"].tolist() == [[0, 1], [0, -1]]
    assert made["z"].tolist() == [[0.0, 1.5], [0.0, 0.0]] and made["target"].tolist() == [[True, False], [True, False]]
    assert made["column"].tolist() == [[name_id("t."), name_id("u.x")], [name_id("t."), 0]] and made["text"][0, 1] == name_id("hey")
    assert collated(batch.iloc[:0])["mask"].shape == (0, 0)


def test_batches_give_the_same_scores(spark, sf):
    engine = Engine(spark, shop(spark, sf), policy=Policy(max_hops=1))
    whole = sorted(map(tuple, engine.execute(NUMBER, TokenScorer(lengths)).collect()))
    assert whole == sorted(map(tuple, engine.execute(NUMBER, TokenScorer(lengths, most_items=1)).collect())) and len(whole) == 4
    assert whole == sorted(map(tuple, engine.execute(NUMBER, TokenScorer(lambda a: a["mask"].sum(1).astype(float), arrays=True)).collect()))
    with pytest.raises(Exception, match="results for"):
        engine.execute(NUMBER, TokenScorer(lambda batch: [])).collect()


def test_heads(spark, sf):
    engine = Engine(spark, shop(spark, sf), policy=Policy(max_hops=1))
    known = {r["entity_id"]: r["value"] for r in engine.execute(NUMBER, TokenScorer(lengths)).collect()}
    head = HeadScorer(features, Fitted(V.REGRESSION), arrays=True)
    assert {r["entity_id"]: r["value"] for r in engine.execute(NUMBER, head).collect()} == pytest.approx({k: v / 1000 for k, v in known.items()})
    before = len(engine.warnings)
    assert engine.execute(YES, head).columns == engine.execute(YES, "history").columns
    engine.execute(YES, head)
    assert len(engine.warnings) == before + 1
    with pytest.raises(ExecutionFault):
        Engine(spark, shop(spark, sf), policy=Policy(max_hops=1), strict=True).execute(YES, HeadScorer(features, Fitted(V.REGRESSION), arrays=True))
    assert all(0 <= r["probability"] <= 1 for r in engine.execute(YES, HeadScorer(features, Fitted(V.BINARY), arrays=True)).collect())
    rows = engine.execute(CLASS, HeadScorer(features, Fitted(V.MULTICLASS, ("a", "b")), arrays=True)).collect()
    assert len(rows) == 4 and all(r["predicted_class"] == "b" and r["class_probs"]["b"] == pytest.approx(1 / (1 + np.exp(-1))) for r in rows)


@pytest.fixture
def server():
    class Handler(BaseHTTPRequestHandler):
        calls, failing, status = 0, 0, 503

        def reply(self, body):
            Handler.calls += 1
            failed = Handler.calls <= Handler.failing
            self.send_response(Handler.status if failed else 200)
            self.end_headers()
            self.wfile.write(b"" if failed else json.dumps(body).encode())

        def do_GET(self):
            self.reply({"status": "ok"} if self.path == "/health" else {})

        def do_POST(self):
            rows = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["rows"]
            self.reply({"scores": [float(len(r["code"])) for r in rows]})

        def log_message(self, *args):
            pass

    made = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield made, Handler
    made.shutdown()
    made.server_close()


def test_remote(spark, sf, server):
    at, handler = server
    url = f"http://127.0.0.1:{at.server_port}/v1/forward"
    engine, scorer = Engine(spark, shop(spark, sf), policy=Policy(max_hops=1)), RemoteScorer(url, wait=0.01)
    handler.failing = 2
    assert scorer.health() == {"status": "ok"} and handler.calls == 3
    whole = sorted(map(tuple, engine.execute(NUMBER, TokenScorer(lengths)).collect()))
    handler.calls, handler.failing = 0, 1
    assert sorted(map(tuple, engine.execute(NUMBER, scorer).collect())) == whole
    handler.calls, handler.failing, handler.status = 0, 9, 400
    with pytest.raises(RemoteFault, match="400"):
        scorer.health()
    assert handler.calls == 1 and issubclass(RemoteFault, ScoringFault)


def test_remote_unreachable(server):
    at, _ = server
    at.shutdown()
    at.server_close()
    with pytest.raises(RemoteFault, match="reached"):
        RemoteScorer(f"http://127.0.0.1:{at.server_port}/", wait=0.01, attempts=2).health()
