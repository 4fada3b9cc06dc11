"""The engine: a statement to a DataFrame of predictions, and EXPLAIN.

A scorer has to be named: ``truth`` evaluates the target on what happened after the anchor, ``history`` predicts from the
target's values in past windows, and any object with ``score(engine, request)`` brings its own. There is no default.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ExecutionFault, ScoringFault
from ..functions.expressions import ARRAY
from ..lang import ast as A
from ..lang.parser import parse
from ..lang.printer import show
from ..operators import context as contexts
from ..operators import domains
from ..operators import labels as L
from ..operators import rewrites, tokens
from ..operators.aggregates import ANCHOR, value_counts
from ..operators.cohort import filtered, pins, population
from ..operators.walks import walking
from ..schema import BOOLEAN, TEXT, Catalog
from . import validate as V
from .config import ModelConfig, strict_by_default


@dataclass(frozen=True)
class Request:
    """What to run. ``entity_ids`` narrows the population; ``per_entity_anchor``: each row at its own time."""

    query: str
    anchor_time: datetime | None = None
    per_entity_anchor: bool = False
    context_anchor_time: datetime | None = None
    params: dict[str, Any] = field(default_factory=dict)
    entity_ids: list | None = None
    hurdle_gate: float | None = None


@dataclass(frozen=True)
class Prepared:
    """A bound request on its way to a scorer: ``cohort`` has passed WHERE."""

    request: Request
    bound: V.Bound
    anchor: datetime | None
    cohort: DataFrame

    @property
    def statement(self) -> A.Statement:
        return self.bound.statement

    @property
    def shared_anchor(self) -> datetime | None:
        """The one anchor of all rows; None if each has its own."""
        return None if self.request.per_entity_anchor else self.anchor

    @property
    def context_anchor(self) -> datetime | None:
        return self.request.context_anchor_time or self.shared_anchor


class Scorer(Protocol):
    """``score`` returns entity_id and one or more of value, probability, class_probs, ranked, forecast, predicted_class."""

    def score(self, engine: Engine, prepared: Prepared) -> DataFrame: ...


#: A traversal makes contexts: a function of (cohort, catalog, entity, anchor, policy).
Traversal = Callable[[DataFrame, Catalog, str, "datetime | None", contexts.Policy], DataFrame]
TRAVERSALS: dict[str, Traversal] = {"breadth_first": contexts.assemble, "walks": walking}


class Engine:
    def __init__(self, spark: SparkSession, catalog: Catalog, scorer: str | Scorer | None = None, policy: contexts.Policy = contexts.Policy(), strict: bool | None = None, static_rows: bool = False,
                 traversal: str | Traversal = "breadth_first", task_name: Callable[[A.Statement, str], str] | None = None, config: ModelConfig = ModelConfig()) -> None:
        self.spark, self.catalog, self.schema = spark, catalog, catalog.schema
        self.policy, self.static_rows, self.scorer = policy, static_rows, scorer
        self.strict = strict_by_default() if strict is None else strict
        self.traversal, self.task_name, self.config = TRAVERSALS.get(traversal, traversal), task_name, config
        self.warnings = [f"{t} is linked to no other table" for t in self.schema.tables if not any(t in (x.child, x.parent) for x in self.schema.links)]

    # -- preparing

    def warn(self, message: str) -> None:
        if self.strict:
            raise ExecutionFault(message)
        self.warnings.append(message)

    @staticmethod
    def anchor_of(s: A.Statement, given: datetime | None) -> datetime | None:
        """AS OF a date wins over ``anchor_time``, which is what NOW means; zones are turned to UTC and dropped."""
        at = s.as_of.value if isinstance(s.as_of, A.Lit) else given
        if s.as_of == "NOW" and given is None:
            raise ExecutionFault("AS OF NOW needs anchor_time")
        if isinstance(at, str):
            at = datetime.fromisoformat(at)
        if at is not None and at.tzinfo is not None:
            at = (at - at.utcoffset()).replace(tzinfo=None)
        return at

    def prepare(self, request: Request | str) -> Prepared:
        request = Request(request) if isinstance(request, str) else request
        bound = V.validate(request.query, self.schema, request.params)
        for note in bound.notes:
            self.warn(note)
        s, anchor = bound.statement, self.anchor_of(bound.statement, request.anchor_time)
        cohort = population(self.catalog, s.table, anchor, request.per_entity_anchor)
        if request.entity_ids is not None:
            kind = self.catalog.frame(s.table).schema[bound.pk].dataType
            ids = self.spark.createDataFrame([(x,) for x in dict.fromkeys(request.entity_ids)], f"__id {kind.simpleString()}")
            cohort = cohort.join(ids, cohort[bound.pk] == ids["__id"], "left_semi")
        cohort = filtered(cohort, self.catalog, s.table, s.where, None if request.per_entity_anchor else anchor, self.static_rows)
        return Prepared(request, bound, anchor, cohort)

    def cohort(self, request: Request | str) -> DataFrame:
        """The ids that WHERE admits, with their anchors."""
        p = self.prepare(request)
        at = F.col(ANCHOR) if p.request.per_entity_anchor else F.lit(p.anchor.isoformat(sep=" ") if p.anchor else None).cast("timestamp_ntz")
        return p.cohort.select(F.col(p.bound.pk).alias("entity_id"), at.alias("anchor_ts"))

    def pinned(self, request: Request | str) -> DataFrame | None:
        """(entity_id, found) of the ids that the statement fixes; None if it fixes none. Unknown ids stay, as not found."""
        p = self.prepare(request)
        ids = pins(p.statement.where, p.statement.table, p.bound.pk)
        if ids is None:
            return None
        kind = self.catalog.frame(p.statement.table).schema[p.bound.pk].dataType
        wanted = self.spark.createDataFrame([(x,) for x in ids], f"entity_id {kind.simpleString()}")
        there = population(self.catalog, p.statement.table, p.anchor, False).select(F.col(p.bound.pk).alias("entity_id"), F.lit(True).alias("found"))
        return wanted.join(there, "entity_id", "left").select("entity_id", F.coalesce("found", F.lit(False)).alias("found"))

    # -- labels

    def truth(self, request: Request | str) -> DataFrame:
        """(entity_id, label): the target's value at the anchor, or with horizons an array of them."""
        p = self.prepare(request)
        s = p.statement
        shifts = {f"__h{k}": x for k, x in enumerate(L.horizon_shifts(s.target))}
        wide = L.with_targets(p.cohort, self.catalog, s.table, s.target, p.shared_anchor, shifts, self.static_rows)
        kind = L.target_type(self.catalog, s.table, s.target)
        cols = [F.coalesce(c, F.lit(False)).cast("int") if kind == BOOLEAN else c for c in map(F.col, shifts)]
        label = F.array(*cols) if p.bound.task == V.FORECASTING else cols[0]
        if p.bound.task == V.RANKING:
            label = F.slice(label, 1, s.rank or 1)
        return wide.select(F.col(p.bound.pk).alias("entity_id"), label.alias("label"))

    def history(self, request: Request | str) -> DataFrame:
        """(entity_id, k, label) of the past windows, k = 1 the latest."""
        p = self.prepare(request)
        wide, names, _ = self.history_wide(p)
        return L.long_labels(wide, p.bound.pk, names)

    def history_wide(self, p: Prepared, tail: Any = None) -> tuple[DataFrame, list[str], str | None]:
        s = p.statement
        target = s.target if tail is None else tail
        shifts = {f"__p{k}": x for k, x in enumerate(L.history_shifts(target, self.policy.num_history_windows), 1)}
        if not shifts:
            raise ScoringFault("a target without a bounded frame has no past windows")
        wide = L.with_targets(p.cohort, self.catalog, s.table, target, p.shared_anchor, shifts, self.static_rows)
        return wide, list(shifts), L.target_type(self.catalog, s.table, target)

    # -- predictions

    def execute(self, request: Request | str, scorer: str | Scorer | None = None) -> DataFrame:
        """Predictions of a statement; one that starts with EXPLAIN is explained instead and never scored by chance."""
        request = Request(request) if isinstance(request, str) else request
        if parse(request.query).explain is not None:
            raise ExecutionFault("EXPLAIN goes to explain()")
        scorer = scorer or self.scorer
        if scorer is None:
            raise ScoringFault("name a scorer: truth, history or an object with score()")
        p = self.prepare(request)
        if request.hurdle_gate is not None:
            return self.hurdle(p, scorer)
        return self.shape(self.score(p, scorer), p)

    def execute_many(self, requests: list[Request | str], scorer: str | Scorer | None = None) -> list[DataFrame]:
        return [self.execute(r, scorer) for r in requests]

    def score(self, p: Prepared, scorer: str | Scorer) -> DataFrame:
        if scorer == "truth":
            return self.truth(p.request)
        if scorer == "history":
            return self.from_history(p)
        if isinstance(scorer, str):
            raise ScoringFault(f"no scorer {scorer}")
        return scorer.score(self, p)

    def from_history(self, p: Prepared) -> DataFrame:
        """Means, frequencies and counts of past windows, by task."""
        s, pk, task = p.statement, p.bound.pk, p.bound.task
        if task == V.RANKING:
            return self.rank_history(p)
        if isinstance(s.target, A.Col):
            return self.from_peers(p)
        wide, names, kind = self.history_wide(p)
        entity = F.col(pk).alias("entity_id")
        if task == V.MULTICLASS:
            classes = F.array_compact(F.array(*(F.col(n).cast("string") for n in names)))
            best = F.array_min(F.transform(F.array_distinct(classes), lambda c: F.struct((-F.size(F.filter(classes, lambda x: x == c))).alias("n"), c.alias("c"))))
            probs = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(classes)), lambda c: F.struct(c, F.size(F.filter(classes, lambda x: x == c)) / F.size(classes))))
            return wide.select(entity, best["c"].alias("predicted_class"), probs.alias("class_probs"))
        mean = L.mean_of([L.as_number(F.col(n), kind) for n in names])
        if task == V.BINARY:
            return wide.select(entity, mean.alias("probability"))
        if task == V.FORECASTING:
            return wide.select(entity, F.array_repeat(mean, s.horizons).alias("forecast"))
        return wide.select(entity, mean.alias("value"))

    def from_peers(self, p: Prepared) -> DataFrame:
        """A bare column: what the other rows of the table hold. Counts of all rows, less the row's own value."""
        s, pk, task = p.statement, p.bound.pk, p.bound.task
        if p.bound.virtual:
            raise ScoringFault(f"{s.table}.{s.target.name} is no column: history knows nothing of it")
        col, kind = s.target.name, L.target_type(self.catalog, s.table, s.target)
        own_time = p.shared_anchor is None and p.request.per_entity_anchor
        if task == V.MULTICLASS:
            domain = self.domain_of(p, 1000)
            entries = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col("class"))))  # 1000 classes at most
            order = domain.groupBy(*([ANCHOR] if own_time else [])).agg(entries.alias("__c"))
            less = F.array_sort(F.transform("__c", lambda x: F.struct((x["n"] + F.when(x["class"] == F.col(col), 1).otherwise(0)).alias("n"), x["class"].alias("class"))))
            made = (self.at_anchors(p.cohort, order) if own_time else p.cohort.join(F.broadcast(order))).withColumn("__c", less)
            total = F.aggregate("__c", F.lit(0).cast("long"), lambda a, x: a - x["n"])
            probs = F.map_from_entries(F.transform("__c", lambda x: F.struct(x["class"], F.try_divide(-x["n"], total))))
            return made.select(F.col(pk).alias("entity_id"), F.get("__c", F.lit(0))["class"].alias("predicted_class"), probs.alias("class_probs"))
        x = F.unix_micros(F.col(col).cast("timestamp")) / 1e6 if kind == "DATETIME" else F.col(col).cast("double")
        if own_time:
            rows = self.catalog.frame(s.table).select(domains.time_of(self.catalog, s.table).alias("__t"), x.alias("__s"), x.isNotNull().cast("long").alias("__n"))
            made = self.at_anchors(p.cohort, domains.totals_at(rows, domains.anchors_of(p.cohort), [], ["__s", "__n"]))
        else:
            made = p.cohort.join(F.broadcast(self.catalog.bounded(s.table, p.anchor).agg(F.sum(x).alias("__s"), F.count(x).alias("__n"))))  # one row
        mean = F.try_divide(F.col("__s") - F.coalesce(x, F.lit(0.0)), F.col("__n") - x.isNotNull().cast("int"))
        return made.select(F.col(pk).alias("entity_id"), mean.alias("probability" if task == V.BINARY else "value"))

    @staticmethod
    def at_anchors(cohort: DataFrame, known: DataFrame) -> DataFrame:
        """The cohort with what is known at each row's own anchor."""
        known = known.withColumnRenamed(ANCHOR, "__known_at")
        return cohort.join(known, cohort[ANCHOR].eqNullSafe(known["__known_at"]), "left").drop("__known_at")

    def domain_of(self, p: Prepared, most: int) -> DataFrame:
        t = p.statement.target
        table, col = (t.table, t.column) if isinstance(t, A.Agg) else (t.table, t.name)
        if p.request.per_entity_anchor:
            return domains.class_counts(self.catalog, table, col, domains.anchors_of(p.cohort), most)
        rows = self.catalog.bounded(table, p.anchor).where(F.col(col).isNotNull())
        return rows.groupBy(F.col(col).cast("string").alias("class")).agg(F.count("*").alias("n")).orderBy("class").limit(most)

    def class_domain(self, request: Request | str, most: int = 1000) -> DataFrame:
        """(class, n): the classes of a text target as of the anchor, the first ``most`` in byte order; with an anchor for each
        entity (anchor_ts, class, n), a domain for every anchor."""
        return self.domain_of(self.prepare(request), most).withColumnsRenamed({ANCHOR: "anchor_ts"})

    def candidates(self, request: Request | str, most: int = 1000) -> DataFrame:
        """(candidate): keys of the table that a ranking's foreign key points to, the first ``most``; numbers by value, texts by
        bytes. With an anchor for each entity (anchor_ts, candidate)."""
        return self.candidates_of(self.prepare(request), most).withColumnsRenamed({ANCHOR: "anchor_ts"})

    def candidates_of(self, p: Prepared, most: int = 1000) -> DataFrame:
        t = p.statement.target
        link = next((x for x in self.schema.links_from(t.table) if x.fk == t.column), None)
        if link is None:
            raise ExecutionFault(f"a ranking's target has to be a foreign key; {t.table}.{t.column} is none")
        key = self.schema.tables[link.parent].pk
        if p.request.per_entity_anchor:
            return domains.candidates_at(self.catalog, link.parent, key, domains.anchors_of(p.cohort), most)
        return self.catalog.bounded(link.parent, p.anchor).select(F.col(key).alias("candidate")).orderBy("candidate").limit(most)

    def score_candidates(self, request: Request | str, most: int = 1000) -> DataFrame:
        """(entity_id, candidate, probability) of every pair of a ranking's entity and candidate: in what share of the past windows
        the candidate was in the target's list. Candidates are ``most`` at most and broadcast."""
        p = self.prepare(request)
        seen, windows = self.past_values(p)
        entity = p.cohort.select(F.col(p.bound.pk).alias("entity_id"), *([ANCHOR] if p.request.per_entity_anchor else []))
        known = self.candidates_of(p, most)
        pairs = self.at_anchors(entity, known) if p.request.per_entity_anchor else entity.join(F.broadcast(known))
        share = seen.select(F.col("entity_id").alias("__e"), F.col("v").alias("__v"), (F.col("in_windows") / windows).alias("probability"))
        made = pairs.join(share, (F.col("entity_id") == F.col("__e")) & (F.col("candidate") == F.col("__v")), "left")
        return made.select("entity_id", "candidate", F.coalesce("probability", F.lit(0.0)).alias("probability"))

    def past_values(self, p: Prepared) -> tuple[DataFrame, int]:
        """(entity_id, v, n, in_windows) of the values in the past windows, and how many windows: rows, and windows with a row."""
        s, agg = p.statement, replace(p.statement.target, frame=replace(p.statement.target.frame, rank=None))
        trees = [L.shifted(agg, x) for x in L.history_shifts(agg, self.policy.num_history_windows)]
        if not trees:
            raise ScoringFault("a target without a bounded frame has no past windows")
        return value_counts(p.cohort, self.catalog, s.table, trees, p.shared_anchor), len(trees)

    def rank_history(self, p: Prepared) -> DataFrame:
        """(entity_id, ranked): the values most frequent in the past windows, ties by value, the first k as texts."""
        k = p.statement.rank or 1
        seen, _ = self.past_values(p)
        place = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("n"), "v"))
        first = seen.withColumn("__n", place).where(F.col("__n") <= k)
        ranked = first.groupBy(F.col("entity_id").alias("__e")).agg(F.array_sort(F.collect_list(F.struct("__n", "v"))).alias("__r"))
        entity = p.cohort.select(F.col(p.bound.pk).alias("entity_id"))
        made = entity.join(ranked, F.col("entity_id") == F.col("__e"), "left")
        names = F.transform("__r", lambda x: x["v"].cast("string"))
        return made.select("entity_id", F.coalesce(names, F.array().cast("array<string>")).alias("ranked"))

    def shape(self, scored: DataFrame, p: Prepared) -> DataFrame:
        """The output form that RETURN asks for."""
        form, cols = p.statement.returns, scored.columns
        if form is None or "label" in cols:
            return scored
        if "probability" in cols:
            prob = F.col("probability")
            if form == "CLASS":
                return scored.select("entity_id", F.when(prob >= 0.5, "true").when(prob < 0.5, "false").alias("predicted_class"))
            if form == "DISTRIBUTION":
                return scored.select("entity_id", F.when(prob.isNotNull(), F.create_map(F.lit("true"), prob, F.lit("false"), 1 - prob)).alias("class_probs"))
            return scored.select("entity_id", prob.alias("value" if form == "EXPECTED VALUE" else "probability"))
        if form in ("CLASS", "MULTICLASS"):
            return scored.select("entity_id", "predicted_class")
        return scored.select("entity_id", "class_probs") if form == "DISTRIBUTION" else scored

    def hurdle(self, p: Prepared, scorer: str | Scorer) -> DataFrame:
        """The value where P(target > 0) is over the gate, else 0."""
        if p.bound.task != V.REGRESSION:
            raise ExecutionFault("a hurdle needs a regression")
        positive = A.Compare(">", p.statement.target, A.Lit(0))
        gate = replace(p, bound=replace(p.bound, statement=replace(p.statement, target=positive, returns=None), task=V.BINARY))
        if scorer == "truth":
            raise ScoringFault("a hurdle needs predictions, not the truth")
        value = self.score(p, scorer)
        chance = self.score(gate, scorer).select("entity_id", "probability")
        made = value.join(chance, "entity_id")
        return made.select("entity_id", F.when(F.col("probability") > p.request.hurdle_gate, F.col("value")).otherwise(0.0).alias("value"))

    # -- contexts and EXPLAIN

    def assemble_context(self, request: Request | str, policy: contexts.Policy | None = None) -> DataFrame:
        """The contexts as a scorer sees them: assembled, then ablated and assumed."""
        p = self.prepare(request)
        made = self.traversal(p.cohort, self.catalog, p.statement.table, p.context_anchor, policy or self.policy)
        return rewrites.rewritten(made, self.catalog, p.statement, p.context_anchor)

    def shared_contexts(self, request: Request | str, chunk: int = 64) -> DataFrame:
        """(chunk, entities, tbl, row_id, hop, ts, cells, parents, n_cells): one context for about ``chunk`` entities of a cohort with
        one anchor, each row once, with the entities whose own part it belongs to. For binary tasks and regressions without
        ASSUMING and ABLATE, whose WHERE at most fixes keys."""
        p = self.prepare(request)
        s = p.statement
        if p.shared_anchor is None or p.bound.task not in (V.BINARY, V.REGRESSION) or s.assuming is not None or s.ablate:
            raise ExecutionFault("a shared context needs one anchor, a binary task or a regression, and no ASSUMING or ABLATE")
        if s.where is not None and pins(s.where, s.table, p.bound.pk) is None:
            raise ExecutionFault("a shared context's WHERE may only fix keys")
        rows = self.assemble_context(request)
        n = p.cohort.count()
        rows = rows.withColumn("chunk", F.pmod(F.xxhash64("entity_id"), F.lit(max(1, -(-n // chunk)))))
        own = F.sort_array(F.collect_set(F.when(F.col("is_focal"), F.col("entity_id"))))  # about chunk ids
        return rows.groupBy("chunk", "tbl", "row_id").agg(
            own.alias("entities"), F.min("hop").alias("hop"), *(F.any_value(c).alias(c) for c in ("ts", "cells", "parents", "n_cells")),
        )

    def token_health(self, request: Request | str, max_len: int = 2048) -> list[str]:
        """Warnings about the token rows: sequences that ``max_len`` cuts, rows with more parents than a node carries, and parents
        that are in no context of their child."""
        context = self.assemble_context(request)
        out = []
        long = context.groupBy("entity_id").agg(F.sum("n_cells").alias("n")).where(F.col("n") + 1 + self.policy.num_history_windows > max_len).count()
        if long:
            out.append(f"{long} sequences are cut at {max_len} tokens")
        crowded = context.where(F.size("parents") > tokens.MOST_PARENTS).count()
        if crowded:
            out.append(f"{crowded} rows have more than {tokens.MOST_PARENTS} parents; the first by column are kept")
        parent_of = {(x.child, x.fk): x.parent for x in self.schema.links}
        named = F.create_map(*(F.lit(v) for (t, k), parent in parent_of.items() for v in (f"{t}.{k}", parent))) if parent_of else None
        if named is not None:
            asked = context.select("entity_id", "anchor_ts", F.col("tbl").alias("child"), F.explode("parents").alias("fk", "row_id"))
            asked = asked.withColumn("tbl", named[F.concat_ws(".", "child", "fk")])
            lost = asked.join(context.select("entity_id", "tbl", "row_id"), ["entity_id", "tbl", "row_id"], "left_anti").count()
            if lost:
                out.append(f"{lost} parents are not in the context of their child")
        if self.strict and out:
            raise ExecutionFault("; ".join(out))
        return out

    def stats(self, request: Request | str) -> dict[str, int]:
        """How many entities a request scores, how many contexts a fan-out cut, and how often."""
        context = self.assemble_context(request)
        each = context.groupBy("entity_id").agg(F.max("truncated").alias("t"))
        row = each.agg(F.count("*").alias("n"), F.count(F.when(F.col("t") > 0, 1)).alias("cut"), F.coalesce(F.sum("t"), F.lit(0)).alias("events")).first()
        return {"entities": row["n"], "truncated_contexts": row["cut"], "truncations": int(row["events"])}

    def token_rows(self, request: Request | str, stats: DataFrame | None = None, max_len: int = 2048) -> DataFrame:
        p = self.prepare(request)
        labels = None
        if L.history_shifts(p.statement.target, 1) and p.bound.task != V.RANKING:
            wide, names, kind = self.history_wide(p)
            if kind not in (TEXT, ARRAY):
                wide = wide.withColumns({n: L.as_number(F.col(n), kind) for n in names})
                labels = L.long_labels(wide, p.bound.pk, names)
        return tokens.tokens(self.assemble_context(request), self.catalog, p.statement, labels, stats, max_len)

    def plan(self, request: Request | str) -> dict[str, Any]:
        """What a statement means and how it runs, without touching data."""
        request = Request(request) if isinstance(request, str) else request
        bound = V.validate(request.query, self.schema, request.params or None)
        s = bound.statement
        fixed = pins(s.where, s.table, bound.pk)
        kinds = {V.REGRESSION: "value", V.BINARY: "probability", V.MULTICLASS: "class", V.RANKING: "ranked", V.FORECASTING: "forecast"}
        return {
            "target": show(s.target), "task_type": bound.task, "task_id": self.task_name(s, bound.task) if self.task_name else bound.task_id, "model_uri": self.config.uri_for(bound.task),
            "entity": {"table": s.table, "pk": bound.pk, "selector": fixed if fixed is not None else "ALL"},
            "output": s.returns or kinds[bound.task].upper(),
            "windows": [{"aggregate": show(a), "start": a.frame.start, "end": a.frame.end, "horizons": a.frame.horizons, "step": a.frame.step} for a in A.aggregates(s.target)],
            "where": None if s.where is None else show(s.where), "assuming": None if s.assuming is None else show(s.assuming),
            "as_of": "NOW" if s.as_of == "NOW" else None if s.as_of is None else show(s.as_of), "ablations": list(s.ablate), "warnings": list(bound.notes),
            "execution": {"strategy": "hurdle" if request.hurdle_gate is not None else "per-entity", "scorer": self.scorer if isinstance(self.scorer, (str, type(None))) else type(self.scorer).__name__, "cohort_size": None if fixed is None else len(fixed)},
        }

    def explain(self, request: Request | str, scorer: str | Scorer | None = None) -> dict[str, Any]:
        """PLAN, CONTEXT, ANALYZE or ABLATION, as the statement asks."""
        request = Request(request) if isinstance(request, str) else request
        asked = parse(request.query).explain or A.Explain()
        out: dict[str, Any] = {"mode": asked.mode, "format": asked.format, "plan": self.plan(request)}
        if asked.mode == "PLAN":
            return out
        if asked.mode == "ABLATION":
            out["ablation"] = [r.asDict() for r in self.ablation(request).collect()]
            return out
        context = self.assemble_context(request)
        s = self.prepare(request).statement
        out["context"] = [r.asDict() for r in contexts.report(context).orderBy("tbl").collect()]
        present = {r["tbl"] for r in out["context"]}
        out["links"] = [f"{x.child}.{x.fk} -> {x.parent}" for x in self.schema.links if x.child in present and x.parent in present]
        out["unreached"] = sorted(set(self.schema.tables) - present)
        out["warnings"] = contexts.health(context, sorted(self.schema.tables)) + rewrites.inert(self.catalog, s, context)
        if self.strict and out["warnings"]:
            raise ExecutionFault("; ".join(out["warnings"]))
        if asked.mode == "ANALYZE":
            chosen = scorer or self.scorer
            if chosen is None:
                raise ScoringFault("name a scorer")
            out["predictions"] = self.shape(self.score(self.prepare(request), chosen), self.prepare(request))
        return out

    def ablation(self, request: Request | str, score: Any = None) -> DataFrame:
        """(kind, name, mean_delta, mean_abs_delta, max_abs_delta): what a context's score loses with each table or column.

        ``score``: a function of a context DataFrame to (entity_id, score); by default the number of cells, for which all
        variants come from one pass.
        """
        p = self.prepare(request)
        base = self.assemble_context(request)
        if score is None:
            names = [("table", t) for t in self.schema.tables if t != p.statement.table]
            names += [("column", f"{t}.{c}") for t, spec in self.schema.tables.items() for c in spec.columns if c != spec.pk]
            cells = base.select("entity_id", "tbl", F.explode("cells").alias("col", "v")).groupBy("entity_id", "tbl", "col").agg(F.count("*").cast("double").alias("n"))
            lost = cells.select("entity_id", F.explode(F.array(F.struct(F.lit("table").alias("kind"), F.col("tbl").alias("name")), F.struct(F.lit("column").alias("kind"), F.concat_ws(".", "tbl", "col").alias("name")))).alias("x"), "n")
            lost = lost.groupBy("entity_id", "x.kind", "x.name").agg(F.sum("n").alias("n"))
            total = base.select("entity_id").distinct().agg(F.count("*").alias("m"))
            wanted = self.spark.createDataFrame(names, "kind string, name string")
            sums = lost.groupBy("kind", "name").agg(F.sum("n").alias("s"), F.max("n").alias("x"))
            made = wanted.join(sums, ["kind", "name"], "left").join(F.broadcast(total))
            mean = F.coalesce(F.try_divide(F.col("s"), F.col("m")), F.lit(0.0))
            return made.select("kind", "name", (-mean).alias("mean_delta"), mean.alias("mean_abs_delta"), F.coalesce("x", F.lit(0.0)).alias("max_abs_delta")).orderBy(F.desc("mean_abs_delta"), "kind", "name")
        whole = score(base).withColumnRenamed("score", "whole")
        parts = []
        for kind, name, variant in self.variants(base, p.statement):
            delta = score(variant).join(whole, "entity_id").withColumn("d", F.col("score") - F.col("whole"))
            parts.append(delta.agg(F.avg("d").alias("mean_delta"), F.avg(F.abs("d")).alias("mean_abs_delta"), F.max(F.abs("d")).alias("max_abs_delta")).select(F.lit(kind).alias("kind"), F.lit(name).alias("name"), "*"))
        out = parts[0]
        for part in parts[1:]:
            out = out.union(part)
        return out.orderBy(F.desc("mean_abs_delta"), "kind", "name")

    def variants(self, base: DataFrame, s: A.Statement):
        for t, spec in self.schema.tables.items():
            if t != s.table:
                yield "table", t, rewrites.ablate(base, (t,))
            for c in spec.columns:
                if c != spec.pk:
                    yield "column", f"{t}.{c}", rewrites.drop_column(base, t, c)


def render(explained: dict[str, Any]) -> str:
    """EXPLAIN's dictionary as text or JSON."""
    if explained["format"] == "JSON":
        return json.dumps(explained, default=str, sort_keys=True)
    lines = []
    for key, value in explained.items():
        if isinstance(value, dict):
            lines += [f"{key}:", *(f"  {k}: {v}" for k, v in value.items())]
        elif isinstance(value, list):
            lines += [f"{key}:", *(f"  {v}" for v in value)]
        else:
            lines.append(f"{key}: {value}")
    return "\n".join(lines)
