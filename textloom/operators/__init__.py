"""Operators; importing this package registers their queries."""

from . import codebook, corpus, duplicates, indexed, labels, misc, more, pilot, prepare, ranking, sources_queries, sql_surface, streams, text_queries, threads, training  # noqa: F401
