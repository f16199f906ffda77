"""What the corpus operators share: document groups, written tables, session settings.

The window operators all work the same way. Documents are dealt into groups of
bounded size; each group asks about hashes ("does this occur elsewhere?") with one
row for each distinct hash it holds, so a hash that a third of all documents have costs
one row a group, never one row a document. Rows are counted by hash with ordinary
aggregates, and only hashes that do occur elsewhere go back to the groups that asked.
The number of rows is in proportion to the input at any size.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.staging import BATCH_BYTES, ROW_GROUP_BYTES, discard, ship, written  # noqa: F401
from . import _text

GROUP = "__group"
#: Bytes of stored input in one document group; with Parquet about twice as many bytes of text.
GROUP_BYTES = 2_500_000


def group_count(df: DataFrame, per_group: int = GROUP_BYTES) -> int:
    """Groups for a table, by the size Spark's own statistics give it; shuffle partitions if that is unknown."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(1, math.ceil(size / per_group))


def group_of(row: Column, groups: int) -> Column:
    """The group of a row, by its number."""
    return F.pmod(F.xxhash64(row), F.lit(groups)).cast("int")


def in_groups(df: DataFrame, groups: int) -> DataFrame:
    """``df`` with its group number, by row: neither equal ids nor equal texts share a group for that.

    Every read of ``df`` must give the same rows in the same partitions, as that of a stored table does.
    """
    return df.withColumn(GROUP, group_of(F.monotonically_increasing_id(), groups))


def by_text(docs: DataFrame, text_col: str, result: T.StructType, make: Callable[[], Callable[[pa.Array], list]]) -> DataFrame:
    """``docs`` with the columns ``result`` of its texts. ``make`` runs once a task and gives a function from texts to lists of values.

    Only texts go to Python, in slices, and only results come back. A filter on the results stays behind them: moved
    before them, it would read every text a second time, in another worker of the same task.
    """
    ship(docs.sparkSession)

    @F.arrow_udf(result)
    def found(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        function = make()
        for column in columns:
            batch = pa.RecordBatch.from_arrays([column], names=["text"])
            for part in _text.slices([batch]):
                yield pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(function(part.column(0)), kinds, strict=True)], names=result.names)
        release()

    arrow = {T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.StringType(): pa.string(), T.BinaryType(): pa.binary()}
    kinds = [arrow[f.dataType] for f in result.fields]
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in result.names]
    return docs.select(*keep, found.asNondeterministic()(F.col(f"`{text_col}`")).alias("__found")).select(*keep, "__found.*")


_caches: dict[str, Callable[[], None]] = {}


def keep(owner: str, clear: Callable[[], None]) -> None:
    """A worker's cache stays for the next task of its owner; ``clear`` is called once the worker ends a task of another."""
    _caches[owner] = clear


def release(owner: str = "") -> None:
    """Gives a Python worker's free memory back to the machine: workers outlive their tasks, and stand beside others."""
    for name in [k for k in _caches if k != owner]:
        _caches.pop(name)()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def released(table: pa.Table) -> pa.Table:
    """``table``, after what was used to make it has been given back."""
    release()
    return table


def among(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which keys are among some others."""
    if not len(some):
        return np.zeros(len(keys), bool)
    some = np.sort(some)
    return some[np.minimum(np.searchsorted(some, keys), len(some) - 1)] == keys


def small(rows: DataFrame, most: int = 250_000) -> DataFrame:
    """``rows`` of ids, to be broadcast if they are few enough (about 25 MB at most); a shuffle join serves otherwise."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows
