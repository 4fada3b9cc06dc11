"""Parsing, printing and binding."""

from datetime import datetime
from math import inf

import pytest

from tideline.errors import MissingParameter, SyntaxFault, UnusedParameter, ValidationFault
from tideline.lang import ast as A
from tideline.lang import parse, show_statement
from tideline.plans import validate as V
from tideline.schema import BOOLEAN, DATETIME, NUMBER, TEXT, Schema

GOOD = [
    "PREDICT SUM(sales.amount) OVER (30 DAYS FOLLOWING) FROM shops",
    "predict count(sales.*) over (range between 10 days following and 30 days following) > 3 from shops",
    "PREDICT NOT EXISTS(sales.*) OVER (90 DAYS FOLLOWING) FROM shops s WHERE s.town = 'Ulm' AS OF 2024-01-01",
    "PREDICT SUM(sales.amount) OVER w - SUM(sales.cost) OVER w FROM shops WINDOW w AS (4 WEEKS FOLLOWING)",
    "PREDICT SUM(sales.qty) OVER (7 DAYS FOLLOWING HORIZONS 4 STEP 1 DAY) FROM shops AS OF :t RETURN EXPECTED VALUE",
    "PREDICT LIST_DISTINCT(sales.item) OVER (14 DAYS FOLLOWING RANK TOP 12) FROM shops",
    "PREDICT ARRAY_AGG(sales.item) OVER (RANK TOP 3) FROM shops",
    "PREDICT shops.town",
    "PREDICT shops.town IS NULL",
    "PREDICT label FROM shops WHERE label IS NOT NULL",
    "PREDICT shops.town NOT LIKE '%m' AND NOT shops.size IN (1, -2.5, NULL) FROM shops",
    "PREDICT shops.town STARTS WITH 'U' OR shops.town ENDS WITH 'm' OR shops.town NOT CONTAINS 'x' FROM shops",
    "PREDICT CASE WHEN COUNT(sales.*) > 1 THEN 1 ELSE 0 END CLASSIFY FROM shops",
    "PREDICT COALESCE(SUM(sales.amount), 0) * 2 / GREATEST(1, ABS(shops.size)) FROM shops AS s",
    "EXPLAIN ANALYZE FORMAT JSON PREDICT EXISTS(sales.*) FROM shops ABLATE TABLE items ABLATE TABLE notes",
    "EXPLAIN PREDICT EXISTS(sales.* WHERE sales.amount > 3 AND cost < 2) FROM shops ASSUMING COUNT(sales.*) OVER (7 DAYS PRECEDING) >= 2",
    "PREDICT COUNT(usage.count) FROM window WHERE window.of == 3 -- words that are keywords elsewhere\n AS OF NOW /* so */",
    'PREDICT shops.town = "it\'s ""so""" FROM shops WHERE shops.id IN :ids',
]
BAD = [
    "", "  \n", "SELECT 1", "PREDICT", "PREDICT FROM shops", "PREDICT SUM(sales.amount)", "PREDICT 1 > 0", "PREDICT a.x = b.y", "PREDICT 3 FROM shops",
    "PREDICT SUM(sales.amount, 0, 30) FROM shops", "PREDICT SUM(sales.amount) OVER (30 DAYS) FROM shops", "PREDICT SUM(sales.amount) OVER (3 MOONS FOLLOWING) FROM shops",
    "PREDICT SUM(sales.amount) OVER (30 DAYS FOLLOWING HORIZONS 0) FROM shops", "PREDICT SUM(sales.amount) OVER nowhere FROM shops",
    "PREDICT SUM(sales.amount) OVER (RANGE BETWEEN 1 DAY FOLLOWING AND 2 MONTHS FOLLOWING) FROM shops", "PREDICT SUM(sales.amount) OVER (RANGE BETWEEN 3 DAYS FOLLOWING AND 1 DAY FOLLOWING) FROM shops",
    "PREDICT SUM(sales.amount) OVER (UNBOUNDED FOLLOWING) FROM shops", "PREDICT SUM(sales.amount) OVER (RANGE BETWEEN NOW AND UNBOUNDED FOLLOWING HORIZONS 2) FROM shops",
    "PREDICT SUM(sales.amount) FROM shops more words", "PREDICT SUM(sales.amount) FROM shops WHERE", "PREDICT COUNT(sales.*) = FROM shops", "PREDICT shops.a IN (1, 2 FROM shops",
    "PREDICT LIST_DISTINCT(sales.item) OVER (1 DAY FOLLOWING RANK TOP) FROM shops", "PREDICT LIST_DISTINCT(sales.item) RANK TOP 3 FROM shops", "PREDICT shops.a IS FROM shops",
    "PREDICT (COUNT(sales.*) FROM shops", "PREDICT COUNT(sales.*) FROM shops ASSUMING AND", "PREDICT shops.a <> 1 FROM shops", "PREDICT shops.a FROM shops WHERE shops.a = 1 WHERE shops.a = 2",
    "PREDICT shops.a FROM shops RETURN QUANTILES", "PREDICT shops.a FROM shops RETURN PROSE", "PREDICT shops.a = 'open FROM shops", "PREDICT MEDIAN(sales.a) FROM shops", "PREDICT NULLIF(shops.a) FROM shops",
    "PREDICT shops.a FROM shops # no such comment", "PREDICT shops.a = 2024-13-01 FROM shops", "PREDICT shops.a FROM shops WINDOW w AS (1 DAY FOLLOWING) WINDOW w AS (2 DAYS FOLLOWING)",
]


@pytest.mark.parametrize("text", GOOD)
def test_round_trip(text):
    s = parse(text)
    again = parse(show_statement(s))
    assert (again.target, again.where, again.as_of, again.ablate, again.returns) == (s.target, s.where, s.as_of, s.ablate, s.returns)
    assert s.table in ("shops", "window")


@pytest.mark.parametrize("text", BAD)
def test_rejected(text):
    with pytest.raises(SyntaxFault):
        parse(text)


def frame(text):
    return parse(f"PREDICT COUNT(t.*) {text} FROM e").target_frames[0]


def test_frames():
    assert (frame("OVER (1 YEAR FOLLOWING)").end, frame("OVER (3 MONTHS FOLLOWING)").end) == (360 * 86400, 90 * 86400)
    assert (frame("").start, frame("").end, frame("").implied) == (0.0, inf, True)
    assert (frame("OVER (UNBOUNDED PRECEDING)").start, frame("OVER (2 HOURS PRECEDING)").start) == (-inf, -7200.0)
    assert frame("OVER (1 WEEK FOLLOWING HORIZONS 3 STEP 1 DAY)").step == 86400
    assert frame("OVER (5 DAYS FOLLOWING HORIZONS 3)").step == 5 * 86400
    where = parse("PREDICT COUNT(t.*) FROM e WHERE COUNT(t.*) > 1").where
    assert A.aggregates(where)[0].frame == A.PAST


def test_precedence_and_error_place():
    t = parse("PREDICT a.x + 2 * 3 > 1 OR NOT a.y AND a.z FROM a").target
    assert isinstance(t, A.Or) and isinstance(t.parts[1], A.And) and isinstance(t.parts[1].parts[0], A.Not)
    with pytest.raises(SyntaxFault, match="line 2, column 7"):
        parse("PREDICT a.x\nFROM  ")


SHOP = (
    Schema().table("shops", {"town": TEXT, "size": NUMBER, "open": BOOLEAN, "since": DATETIME}, "id")
    .table("sales", {"amount": NUMBER, "note": TEXT}, "sid", "at").table("items", {"name": TEXT}, "iid").link("sales", "shop_id", "shops").link("sales", "item_id", "items")
)


@pytest.mark.parametrize(
    ("text", "task"),
    [
        ("SUM(sales.amount) OVER (1 DAY FOLLOWING HORIZONS 2)", V.FORECASTING), ("LIST_DISTINCT(sales.item_id) OVER (1 DAY FOLLOWING RANK TOP 2)", V.RANKING), ("COUNT(sales.*) CLASSIFY", V.MULTICLASS),
        ("COUNT(sales.*) > 1", V.BINARY), ("NOT EXISTS(sales.*)", V.BINARY), ("EXISTS(sales.*)", V.BINARY), ("COUNT(sales.*) + 1", V.REGRESSION), ("LIST_DISTINCT(sales.item_id)", V.RANKING),
        ("LAST(sales.note)", V.MULTICLASS), ("LAST(sales.amount)", V.REGRESSION), ("shops.open", V.BINARY), ("shops.since", V.REGRESSION), ("shops.churns", V.BINARY), ("AVG(sales.amount)", V.REGRESSION),
    ],
)
def test_task_types(text, task):
    assert V.validate(f"PREDICT {text} FROM shops", SHOP).task == task


@pytest.mark.parametrize(
    "text",
    [
        "PREDICT COUNT(nothing.*) FROM shops", "PREDICT COUNT(sales.nothing) FROM shops", "PREDICT shops.size FROM nowhere", "PREDICT SUM(sales.note) FROM shops", "PREDICT SUM(sales.*) FROM shops",
        "PREDICT COUNT(sales.*) OVER (1 DAY PRECEDING) FROM shops", "PREDICT COUNT(sales.*) FROM shops WHERE COUNT(sales.*) OVER (1 DAY FOLLOWING) > 1", "PREDICT COUNT(items.*) OVER (1 DAY FOLLOWING) FROM shops",
        "PREDICT COUNT(sales.*) FROM shops WHERE COUNT(sales.*) OVER (RANGE BETWEEN 3 DAYS PRECEDING AND 2 DAYS PRECEDING HORIZONS 2) > 1", "PREDICT sales.amount > 1 FROM shops", "PREDICT FIRST(sales.shop_id) FROM shops",
        "PREDICT COUNT(sales.* WHERE items.name = 'x') FROM shops", "PREDICT COUNT(sales.*) FROM shops RETURN CLASS", "PREDICT shops.town FROM shops RETURN PROBABILITY", "PREDICT COUNT(sales.*) FROM shops ABLATE TABLE shops",
        "PREDICT COUNT(sales.*) FROM shops ABLATE TABLE nothing", "PREDICT COUNT(sales.*) OVER (1 DAY FOLLOWING RANK TOP 2) FROM shops",
    ],
)
def test_does_not_fit(text):
    with pytest.raises(ValidationFault):
        V.validate(text, SHOP)


def test_parameters():
    text = "PREDICT COUNT(sales.*) FROM shops WHERE town IN :towns AND size > :least AS OF :at"
    bound = V.validate(text, SHOP, {"towns": ["Ulm"], "least": 3, "at": datetime(2024, 1, 1)})
    assert not [x for x in A.walk(bound.statement.where) if isinstance(x, A.Param)] and bound.statement.as_of == A.Lit(datetime(2024, 1, 1))
    with pytest.raises(MissingParameter):
        V.validate(text, SHOP, {"towns": ["Ulm"], "least": 3})
    with pytest.raises(UnusedParameter):
        V.validate(text, SHOP, {"towns": [], "least": 3, "at": datetime(2024, 1, 1), "more": 1})
    with pytest.raises(ValidationFault):
        V.validate(text, SHOP, {"towns": "Ulm", "least": 3, "at": datetime(2024, 1, 1)})
    assert V.validate(text, SHOP).task == V.REGRESSION


def test_task_ids():
    one, same, other = ("PREDICT COUNT(sales.*) OVER (1 DAY FOLLOWING) FROM shops", "predict  count(sales.*) over (24 hours following) from shops s", "PREDICT COUNT(sales.*) OVER (2 DAYS FOLLOWING) FROM shops")
    ids = [V.validate(x, SHOP).task_id for x in (one, same, other)]
    assert ids[0] == ids[1] != ids[2]
    assert V.validate("PREDICT shops.size FROM shops", SHOP).task_id == "column:shops.size:regression"
