"""The query catalogue over the bound tables."""

from importlib import import_module

#: Modules that register queries when they are imported.
MODULES = ("coverage", "scalars", "store", "retrieval", "evaluation", "tables", "answers")


def load():
    """The catalogue with every module's queries registered."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return import_module(f"{__name__}.catalogue")
