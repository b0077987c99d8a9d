"""All registered queries of the library, by operator id."""

from __future__ import annotations

REGISTERED: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame, with its DuckDB twin if it has one."""

    def keep(f):
        REGISTERED[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def _load() -> None:
    from weftline.plans import cases, checks, reco, stores, trend  # noqa: F401


def queries() -> dict:
    _load()
    return dict(REGISTERED)


def oracle_sql() -> dict:
    _load()
    return dict(ORACLES)
