"""Scorers that run a model's code in Python workers, over token rows."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import Any, Protocol
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import RemoteFault, ScoringFault
from ..functions.scoring import softmax
from . import validate as V
from .batches import MOST_CELLS, MOST_ITEMS, collated, packed


class TokenScorer:
    """Applies ``forward`` to batches of entities: a function of a DataFrame (entity_id, kind, tbl, col, code, text, number, z as
    lists of a row for each entity) to scores, one a row. Tokens of an entity come ordered and together. A batch has at most
    ``most_items`` entities and ``most_cells`` cells with padding. With ``arrays`` forward gets what ``collated`` makes of it."""

    def __init__(self, forward: Callable[[Any], Any], output: str = "value", max_len: int = 2048, arrays: bool = False, most_items: int = MOST_ITEMS, most_cells: int = MOST_CELLS) -> None:
        self.forward, self.output, self.max_len = forward, output, max_len
        self.arrays, self.most_items, self.most_cells = arrays, most_items, most_cells

    def score(self, engine: Any, prepared: Any) -> DataFrame:
        return self.applied(engine, prepared, self.output, "double")

    def applied(self, engine: Any, prepared: Any, output: str, kind: str) -> DataFrame:
        """(entity_id, ``output``): what ``forward`` makes of each entity, of the type ``kind``."""
        rows = engine.token_rows(prepared.request, max_len=self.max_len)
        token = F.struct("pos", "kind", "tbl", "col", "code", "text", "number", "z")
        lists = rows.groupBy("entity_id").agg(F.array_sort(F.collect_list(token)).alias("t"))  # at most max_len tokens each
        wide = lists.select("entity_id", *(F.col(f"t.{c}").alias(c) for c in ("kind", "tbl", "col", "code", "text", "number", "z")))
        forward, arrays, limits = self.forward, self.arrays, (self.most_items, self.most_cells)

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for places in packed(batch["code"].map(len).to_numpy(), *limits):
                    part = batch.iloc[places].reset_index(drop=True)
                    made = list(forward(collated(part) if arrays else part))
                    if len(made) != len(part):
                        raise ScoringFault(f"the model gave {len(made)} results for {len(part)} entities")
                    yield pd.DataFrame({"entity_id": part["entity_id"], output: made})

        return wide.mapInPandas(scan, f"entity_id string, {output} {kind}")


class Head(Protocol):
    """Fitted to one task on the features of a model. ``predict`` takes (entities, features) and gives a value or a probability for
    each, or, with ``classes``, a logit for each class."""

    task: str
    classes: tuple[str, ...] | None

    def predict(self, features: np.ndarray) -> np.ndarray: ...


class HeadScorer(TokenScorer):
    """Features of a model, then a fitted head. Requests of another task than the head's go to ``otherwise``, with one warning."""

    def __init__(self, features: Callable[[Any], Any], head: Head, otherwise: Any = "history", **options: Any) -> None:
        def forward(batch: Any) -> list:
            made = np.asarray(head.predict(np.asarray(features(batch), float)), float)
            return [row.tolist() for row in made] if head.task == V.MULTICLASS else made.tolist()

        super().__init__(forward, **options)
        self.head, self.otherwise, self.warned = head, otherwise, False

    def score(self, engine: Any, prepared: Any) -> DataFrame:
        task = prepared.bound.task
        if task != self.head.task:
            if not self.warned:
                self.warned = True
                engine.warn(f"the head is fitted to {self.head.task}, not to {task}: {self.otherwise} scores instead")
            return engine.score(prepared, self.otherwise)
        if task == V.MULTICLASS:
            made = self.applied(engine, prepared, "logits", "array<double>").withColumn("p", softmax(F.col("logits")))
            classes = F.array(*(F.lit(c) for c in self.head.classes or ()))
            best = F.element_at(classes, F.array_position("p", F.array_max("p")).cast("int"))
            return made.select("entity_id", best.alias("predicted_class"), F.map_from_arrays(classes, "p").alias("class_probs"))
        if task not in (V.BINARY, V.REGRESSION):
            raise ScoringFault(f"no head can be fitted to {task}")
        return self.applied(engine, prepared, "probability" if task == V.BINARY else "value", "double")


def called(request: urllib.request.Request | str, timeout: float, attempts: int, wait: float) -> bytes:
    """The reply's body. Refused connections, time-outs and errors of the server are tried again, after twice the wait each time;
    what the server calls the request's own fault is not."""
    url = request if isinstance(request, str) else request.full_url
    for k in range(attempts):
        try:
            with urllib.request.urlopen(request, timeout=timeout) as reply:
                return reply.read()
        except urllib.error.HTTPError as fault:
            if fault.code < 500 or k == attempts - 1:
                raise RemoteFault(f"{url} answered {fault.code}") from None
        except OSError as fault:  # refused connections and time-outs
            if k == attempts - 1:
                raise RemoteFault(f"{url} cannot be reached: {fault}") from None
        time.sleep(wait * 2**k)
    raise RemoteFault(f"{url} was not called")


class RemoteScorer(TokenScorer):
    """Sends batches of at most ``batch`` entities to a server: POST {"rows": [...]} to ``url``, answered by {"scores": [...]}."""

    def __init__(self, url: str, output: str = "value", max_len: int = 2048, batch: int = MOST_ITEMS, timeout: float = 60.0, attempts: int = 3, wait: float = 0.5) -> None:
        def forward(rows: pd.DataFrame) -> list[float]:
            body = json.dumps({"rows": json.loads(rows.to_json(orient="records"))}).encode()
            reply = called(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout, attempts, wait)
            try:
                scores = json.loads(reply)["scores"]
            except (ValueError, KeyError, TypeError):
                raise RemoteFault(f"{url} gave no scores") from None
            if len(scores) != len(rows):
                raise RemoteFault(f"{url} gave {len(scores)} scores for {len(rows)} rows")
            return scores

        super().__init__(forward, output, max_len, most_items=batch)
        self.url, self.timeout, self.attempts, self.wait = url, timeout, attempts, wait

    def health(self) -> dict[str, Any]:
        """What the server says of itself at /health; raises if it cannot be reached."""
        at = urlsplit(self.url)
        reply = called(f"{at.scheme}://{at.netloc}/health", self.timeout, self.attempts, self.wait)
        try:
            said = json.loads(reply)
        except ValueError:
            said = reply.decode(errors="replace")
        return said if isinstance(said, dict) else {"status": said}
