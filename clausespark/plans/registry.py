"""All registered queries with their DuckDB counterparts."""

FLAGSHIP = "e18_hybrid_search"
_QUERIES: dict = {}
_SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Register a query function under name, with its SQL where there is one."""

    def keep(f):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def queries() -> dict:
    return _QUERIES


def oracle_sql() -> dict:
    return _SQL


def load() -> None:
    """Import the modules that register queries."""
    from importlib import import_module

    for name in MODULES:
        import_module(f"clausespark.plans.{name}")


MODULES = ["text_queries", "retrieval_queries", "rule_queries", "lexicon_queries", "context_queries", "quality_queries", "structure_queries", "source_queries"]
