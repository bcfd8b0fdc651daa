"""Errors of the query language."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass
class QueryError(Exception):
    """One error of a request; ``text`` is its line in a response."""

    message: str
    code: str = "QueryExecutionError"
    phase: str = "execution"
    path: str = "query"
    line: int = 1
    col: int = 1
    statement: int | None = None

    def __str__(self) -> str:
        return self.text()

    def text(self) -> str:
        where = "" if self.statement is None else f"statement_index={self.statement} "
        escaped = self.message.replace("\\", "\\\\").replace('"', '\\"')
        return f'ERR query: {where}message="{escaped}" phase={self.phase} code={self.code} path={self.path} line={self.line} col={self.col}'


#: What a run-time error code says when it ends a request.
RUNTIME = {
    "NullArithmeticOperand": "arithmetic operand cannot be null",
    "IntegerOverflow": "integer overflow",
    "DivisionByZero": "division by zero",
    "NumericDomain": "value is outside the function's domain",
}
