"""Many strings in many texts: one automaton per case, one pass over each text.

The strings of all cases are collected and sent to the workers when their
bytes are counted and found to be under ``SHIPPED``; callers have a join for
larger sets. A worker builds the automaton of a case when it meets the case
first. Rows go through whole, so no text is shuffled or joined back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHIPPED = 16 << 20
_VALUE = 16


def shipped(patterns: DataFrame, columns: Sequence[str]) -> pa.Table | None:
    """Distinct values of some columns on the driver, or None where they exceed ``SHIPPED`` bytes."""
    rows = patterns.select(*columns).distinct()
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in columns), F.lit(_VALUE * len(columns)))
    total = rows.agg(F.sum(size)).first()[0] or 0
    return rows.toArrow() if total <= SHIPPED else None


def grouped(rows: pa.Table, keys: Sequence[str], pattern: str, value: str) -> dict[tuple, dict[str, list]]:
    """key -> string -> its values."""
    out: dict[tuple, dict[str, list]] = {}
    for *key, text, item in zip(*(rows.column(c).to_pylist() for c in [*keys, pattern, value]), strict=True):
        if text:
            out.setdefault(tuple(key), {}).setdefault(text, []).append(item)
    return out


def _built(words) -> object:
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, value in words:
        found.add_word(word, value)
    found.make_automaton()
    return found


def mapped(texts: DataFrame, keys: Sequence[str], text: str, sent: dict[tuple, object], prepare: Callable, find: Callable, out: str, kind: T.DataType) -> DataFrame:
    """``texts`` with ``out``: what ``find(prepared, text)`` gives for each row's text.

    ``prepare(sent[key])`` is made once per key and task; rows of other keys
    and null texts get an empty array.
    """
    box = texts.sparkSession.sparkContext.broadcast(sent)
    schema = T.StructType([*(f for f in texts.schema.fields if f.name != out), T.StructField(out, T.ArrayType(kind))])
    names, item = [f.name for f in schema.fields[:-1]], {"bigint": pa.int64(), "string": pa.string()}[kind.simpleString()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[tuple, object] = {}
        for batch in batches:
            found = []
            for value, *key in zip(*(batch.column(c).to_pylist() for c in [text, *keys]), strict=True):
                key = tuple(key)
                if key not in ready:
                    ready[key] = prepare(box.value[key]) if key in box.value else None
                found.append(find(ready[key], value) if value and ready[key] is not None else [])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.list_(item))], [*names, out])

    return texts.mapInArrow(run, schema)


def _every(table: dict[str, list]):
    return _built((word, tuple(values)) for word, values in table.items())


def _values(built, text: str) -> list:
    return sorted({v for _, values in built.iter(text) for v in values})


def contained(texts: DataFrame, keys: Sequence[str], text: str, sent: dict[tuple, dict[str, list]], out: str, kind: T.DataType) -> DataFrame:
    """``texts`` with the sorted distinct values of all strings that each text contains."""
    return mapped(texts, keys, text, sent, _every, _values, out, kind)
