"""The query catalogues, with their SQL."""

MODULES = ("catalogue", "cleaning", "diagnosis", "quality", "structure", "feedback", "intake", "artifacts", "records")


def _modules():
    from importlib import import_module

    return [import_module(f"docmill.plans.{m}") for m in MODULES]


def all_queries():
    return {k: f for m in _modules() for k, f in m.queries().items()}


def all_oracles():
    return {k: q for m in _modules() for k, q in m.SQL.items()}
