"""The chunk table and its vocabulary, kept together: only what a change touches is read and written."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loregrid.operators import search
from loregrid.operators.graph import cut
from loregrid.sources.tables import BUCKETS, Tables


def _note(tables: Tables, name: str) -> str:
    return f"{name} {tables.version(name)}"


def vocabulary_of(tables: Tables, name: str = "chunks") -> DataFrame | None:
    """The vocabulary that was written for the chunk table as it is now; None if there is none, or one of another version."""
    table = f"{name}_vocabulary"
    return tables.read(table) if tables.version(name) is not None and tables.note(table) == _note(tables, name) else None


def replace_chunks(tables: Tables, made: DataFrame, touched: DataFrame, name: str = "chunks", buckets: int = BUCKETS) -> None:
    """New chunks in place of those of the touched sources (column source), and the vocabulary changed by the difference.

    A job that dies after the chunks leaves a vocabulary of another version, which is then counted anew.
    """
    known = vocabulary_of(tables, name)
    if known is not None:
        gone = search.vocabulary(tables.of_sources(name, touched))
        known = cut(search.changed_vocabulary(known, gone, search.vocabulary(made)))
    after = tables.replace_sources(name, made, touched, buckets=buckets)
    tables.write(f"{name}_vocabulary", search.vocabulary(after) if known is None else known, note=_note(tables, name))
