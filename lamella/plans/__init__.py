"""Query registry modules."""


def load_all() -> None:
    """Import every module that registers queries."""
    import importlib
    import pkgutil

    for info in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{info.name}")
