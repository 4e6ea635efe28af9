"""Registered queries over the given tables, each with the SQL that checks it."""

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its check SQL, if it has one."""

    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def load_all() -> None:
    from registry import cleaning, profiles, recommend, search, sources, texts  # noqa: F401
