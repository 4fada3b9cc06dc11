"""Errors of the engine; each is a QueryError."""


class QueryError(Exception):
    """Something is wrong with a query or what it meets."""


class SyntaxFault(QueryError):
    """The text is no statement; carries the place."""

    def __init__(self, message: str, at: int = 0, text: str = "") -> None:
        line = text.count("\n", 0, at) + 1
        column = at - text.rfind("\n", 0, at)
        super().__init__(f"line {line}, column {column}: {message}")
        self.at, self.line, self.column = at, line, column


class ValidationFault(QueryError):
    """The statement does not fit the schema."""


class MissingParameter(QueryError):
    pass


class UnusedParameter(QueryError):
    pass


class EvaluationFault(QueryError):
    """An expression has no value under the language's rules."""


class ExecutionFault(QueryError):
    pass


class CatalogFault(QueryError):
    """A table or link has no data behind it."""


class ScoringFault(QueryError):
    pass


class RemoteFault(ScoringFault):
    """A server that scores cannot be reached, or answers something else."""
