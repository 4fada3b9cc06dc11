"""tideline: declarative predictive queries over linked tables, compiled to Spark plans."""

from .errors import (
    CatalogFault, EvaluationFault, ExecutionFault, MissingParameter, QueryError, RemoteFault, ScoringFault, SyntaxFault, UnusedParameter, ValidationFault,
)
from .lang.parser import parse
from .operators.context import Policy
from .plans.config import ModelConfig
from .plans.engine import Engine, Request, render
from .plans.scorers import HeadScorer, RemoteScorer, TokenScorer
from .plans.validate import validate
from .schema import Catalog, Link, Schema, Table, infer

__version__ = "0.2.0"
__all__ = [
    "Catalog", "CatalogFault", "Engine", "EvaluationFault", "ExecutionFault", "HeadScorer", "Link", "MissingParameter", "ModelConfig", "Policy", "QueryError",
    "RemoteFault", "RemoteScorer", "Request", "Schema", "ScoringFault", "SyntaxFault", "Table", "TokenScorer", "UnusedParameter", "ValidationFault", "infer", "parse",
    "render", "validate",
]
