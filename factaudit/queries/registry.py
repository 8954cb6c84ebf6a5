"""A registry that keeps each query beside the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable


def folded_sql(column: str) -> str:
    """SQL of the folded form of texts (NFKC, full case folding) for what the project's tables hold."""
    wide = f"translate(lower({column}), '（），：；！？＠　' || chr(160), '(),:;!?@  ')"
    for old, new in (("ß", "ss"), ("½", "1⁄2"), ("¯", " ̄"), ("º", "o"), ("…", "...")):
        wide = f"replace({wide}, '{old}', '{new}')"
    return f"nfc_normalize({wide})"


class Registry:
    def __init__(self) -> None:
        self._queries: dict[str, Callable] = {}
        self._sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable:
        """Register a query (spark, sf_dir) -> DataFrame, with its SQL where SQL can express it."""

        def keep(query: Callable) -> Callable:
            self._queries[name] = query
            if sql is not None:
                self._sql[name] = sql
            return query

        return keep

    def queries(self) -> dict[str, Callable]:
        return dict(self._queries)

    def oracle_sql(self) -> dict[str, str]:
        return dict(self._sql)
