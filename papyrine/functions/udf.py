"""Vectorised functions whose Spark types are parsed when they are first used, so that modules can be imported without a session."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

#: Bytes of a batch that are Python objects at a time.
PIECE = 1 << 20


def vectorised(returns: str, once: bool = False) -> Callable[[Callable], Callable[..., Column]]:
    """once: keep the optimiser from repeating the call for each field that is read of its result."""

    def wrap(function: Callable) -> Callable[..., Column]:
        def call(*columns: Column) -> Column:
            made = pandas_udf(function, returns)
            return (made.asNondeterministic() if once else made)(*columns)

        return call

    return wrap


def _cutting() -> Callable[..., Iterator]:
    def pieces(batch, most: int = PIECE) -> Iterator:
        """The rows of an Arrow array or batch in order, as slices of at most so many bytes, or of one row."""
        waiting = [batch]
        while waiting:
            some = waiting.pop()
            half = len(some) // 2
            if not half or some.nbytes <= most:
                yield some
            else:
                waiting += [some.slice(half), some.slice(0, half)]

    return pieces


#: Made by a function, so that it is pickled by value: workers needn't find this module.
pieces = _cutting()


def each(returns: str) -> Callable[[Callable], Callable[[Column], Column]]:
    """A function of single values. Batches, of up to 64 MB by Spark's default, stay in Arrow; only a piece of one at a time becomes
    Python objects, and pieces that the function leaves as they are, are given back uncopied."""

    def wrap(function: Callable) -> Callable[[Column], Column]:
        def call(column: Column) -> Column:
            kind = to_arrow_type(_parse_datatype_string(returns))

            def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
                for batch in batches:
                    for piece in pieces(batch):
                        values = piece.to_pylist()
                        made = [function(x) for x in values]
                        unchanged = piece.type == kind and all(a is b for a, b in zip(values, made))
                        yield piece if unchanged else pa.array(made, kind)

            return arrow_udf(run, returns)(column)

        return call

    return wrap
