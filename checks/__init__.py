"""Every operator as a query over the given tables, with SQL that must agree."""


def registry() -> dict:
    """name -> (query, sql or None)."""
    import importlib

    out = {}
    for part in ("sources_and_text", "similarity", "evaluation", "serving"):
        out.update(importlib.import_module(f"checks.{part}").QUERIES)
    return out
