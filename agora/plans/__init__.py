"""The registered queries, each with the SQL that must give the same rows."""

from importlib import import_module

MODULES: list[str] = ["filters", "aggregates", "joins", "windows", "votes", "search", "scalars", "documents", "incremental", "sources", "records", "minutes", "matching", "alignment", "evidence", "ballots", "research"]


def load() -> None:
    """Imports every module that registers queries."""
    for name in MODULES:
        import_module(f"agora.plans.{name}")
