"""What the engine refuses, by kind."""

from __future__ import annotations

import re


class EngineError(Exception):
    """Any refusal."""


class NotAllowed(EngineError):
    """A statement, table or function outside the surface."""


class PlanError(EngineError):
    """A statement that can't be planned as asked."""


class Overflow(EngineError):
    """A number without room in its type."""


class SeamError(EngineError):
    """Sealed and live rows that don't fit together."""


class LimitExceeded(EngineError):
    """More rows, bytes or time than allowed."""


class Timeout(LimitExceeded):
    """A statement that took longer than allowed."""


class Cancelled(EngineError):
    """A statement that its caller gave up."""


class Substrate(EngineError):
    """A failure beneath the engine: storage, network, lost executors."""


class NoSegments(EngineError):
    """A folder without segments."""


class ParseError(EngineError):
    """Text that isn't SQL."""


#: What Spark's conditions mean, and how DuckDB words them; {0}, {1} are the groups of the pattern, sought in Spark's message.
_KINDS: tuple[tuple[str, type[EngineError], str, str], ...] = (
    ("ARITHMETIC_OVERFLOW", Overflow, r"^(.*?)(?: If necessary|\. Use|$)", "Out of Range Error: {0}"),
    ("NUMERIC_VALUE_OUT_OF_RANGE", Overflow, r"(The .*? cannot be represented as .*?)(?: If|\.|$)", "Out of Range Error: {0}"),
    ("NUMERIC_OUT_OF_SUPPORTED_RANGE", Overflow, "", "Out of Range Error: a number has no room in its type"),
    ("CAST_OVERFLOW", Overflow, r"The value (\S+) of the type \"?(\w+)\"? cannot be cast to \"?(\w+)", "Conversion Error: Type {1} with value {0} can't be cast because the value is out of range for the destination type {2}"),
    ("overflow", Overflow, r"(overflow.*?)(?: SQLSTATE|$)", "Out of Range Error: {0}"),
    ("PARSE_SYNTAX_ERROR", ParseError, r"at or near ('[^']*'|end of input)", "Parser Error: syntax error at or near {0}"),
    ("TABLE_OR_VIEW_NOT_FOUND", NotAllowed, r"`([^`]*)` cannot be found", "Catalog Error: Table with name {0} does not exist!"),
    ("UNRESOLVED_ROUTINE", NotAllowed, r"routine `([^`]*)`", "Catalog Error: Scalar Function with name {0} does not exist!"),
    ("UNRESOLVED_COLUMN", PlanError, r"with name (\S+) cannot be resolved", "Binder Error: Referenced column {0} not found in FROM clause!"),
    ("AMBIGUOUS_REFERENCE", PlanError, r"Reference (\S+) is ambiguous", "Binder Error: Ambiguous reference to column name {0}"),
    ("MISSING_GROUP_BY", PlanError, "", "Binder Error: a column must appear in the GROUP BY clause or must be part of an aggregate function."),
    ("MISSING_AGGREGATION", PlanError, r"expression \"([^\"]*)\"", 'Binder Error: column "{0}" must appear in the GROUP BY clause or must be part of an aggregate function.'),
    ("SCALAR_SUBQUERY_TOO_MANY_ROWS", PlanError, "", "Invalid Input Error: More than one row returned by a subquery used as an expression - scalar subqueries can only return a single row."),
    ("CAST_INVALID_INPUT", PlanError, r"The value '(.*?)' of the type \"?(\w+)\"? cannot be cast to \"?(\w+)", "Conversion Error: Could not convert string '{0}' to {2}"),
    ("MALFORMED_RECORD_IN_PARSING", PlanError, "", "Invalid Input Error: Malformed JSON"),
    ("MALFORMED_VARIANT", PlanError, "", "Invalid Input Error: Malformed JSON"),
    ("USER_RAISED_EXCEPTION", PlanError, r"^(?:\[\w+(?:\.\w+)?\] )?(.*?)(?: SQLSTATE|$)", "Invalid Input Error: {0}"),
    ("spark.driver.maxResultSize", LimitExceeded, "", "more bytes than the driver takes"),
    ("ExecutorLostFailure", Substrate, "", ""),
    ("FetchFailed", Substrate, "", ""),
    ("TASK_WRITE_FAILED", Substrate, "", ""),
    ("FAILED_READ_FILE", Substrate, "", ""),
    ("Py4JNetworkError", Substrate, "", ""),
)


def restated(error: Exception) -> EngineError:
    """The engine's error for one of Spark's, in DuckDB's words where it has its own."""
    said = str(error)
    text = f"{getattr(error, 'getCondition', lambda: None)() or ''} {type(error).__name__} {said}"
    first = said.split("\n")[0]
    for mark, kind, pattern, words in _KINDS:
        if mark in text:
            found = re.search(pattern, re.sub(r"^\[[\w.]+\] ", "", first)) if pattern else None
            return kind(words.format(*(found.groups() if found else ())) if words and (found or not pattern) else first)
    return PlanError(first)
