"""Registered queries, by subject."""

from importlib import import_module

MODULES = ["text_queries", "retrieval_queries", "chunk_queries", "profile_queries", "quality_queries", "registry_queries", "source_queries"]


def load() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
