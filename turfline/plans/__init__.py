from importlib import import_module

MODULES = ("people_queries", "field_queries", "rule_queries", "desk_queries", "stream_queries")


def load_all() -> None:
    """Import every module of named queries, which registers them."""
    for module in MODULES:
        import_module(f"turfline.plans.{module}")
