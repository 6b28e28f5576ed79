"""What several text operators share: Arrow-batched columns and id remainders."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType, _parse_datatype_string

from brindle.operators.ordered import broadcast_if_small, written


Batches = Iterator[pa.RecordBatch]


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run``, for ``mapInArrow``, with the memory that Arrow keeps unused given back by each task.

    Python workers go on to other tasks and stages, and would hold what their largest task took.
    """
    def whole(batches: Batches) -> Batches:
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def give_back() -> None:
    """Give memory that Arrow keeps unused back to the system."""
    pa.default_memory_pool().release_unused()


def with_fields(df: DataFrame, inputs: str | Sequence[str], schema: str,
                rows: Callable[[Iterable], Iterable[tuple]]) -> DataFrame:
    """``df`` with the fields of ``schema`` that ``rows`` makes of each row's inputs.

    ``rows`` gets the values of an Arrow batch one by one (tuples, for several
    columns) and gives a tuple for each. A column of ``df`` that is named like a field
    is replaced by it; all others stay as they are.
    """
    wanted: StructType = _parse_datatype_string(schema)
    fields = [(f.name, to_arrow_type(f.dataType)) for f in wanted]
    single = isinstance(inputs, str)

    @F.arrow_udf(wanted)
    def made(*columns: pa.Array) -> pa.Array:
        values = zip(*((v.as_py() for v in c) for c in columns))
        give_back()
        found = list(zip(*rows((v for v, in values) if single else values)))
        return pa.StructArray.from_arrays(
            [pa.array(c, kind) for c, (_, kind) in zip(found or [()] * len(fields), fields)],
            names=[n for n, _ in fields])

    box = free_name(df, "_made")
    kept = [c for c in df.columns if c not in {n for n, _ in fields}]
    return (df.withColumn(box, made(*[
        F.col(quoted(c)) for c in ([inputs] if single else inputs)]))
            .select(*[quoted(c) for c in kept],
                    *[F.col(f"{box}.{quoted(n)}").alias(n) for n, _ in fields]))


def quoted(name: str) -> str:
    """A column name in which dots and the like mean themselves."""
    return "`" + name.replace("`", "``") + "`"


def free_name(df: DataFrame, name: str) -> str:
    """The name, lengthened where ``df`` has a column of that name."""
    while name in df.columns:
        name += "_"
    return name


def id_remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(quoted(doc_id)).cast("string").cast("binary")) % modulus


def least_hashed(df: DataFrame, group: str, unique: str, n: int) -> DataFrame:
    """At most ``n`` rows of each group, those whose ``unique`` value has the least hash.

    Groups are counted first, so that only rows with a chance are ordered: a few times ``n``
    of each group, however large it is and from however many tasks.
    """
    hashed = F.shiftrightunsigned(F.xxhash64(unique), 33)  # 31 bits
    # broadcast if there are few groups, so that no group's rows are gathered to be counted off
    sizes = broadcast_if_small(written(df.groupBy(group).agg(F.count("*").alias("_size"))))
    chance = F.least(F.lit(1.0), F.lit(3.0 * n + 100) / F.col("_size"))
    some = (df.join(sizes, group).withColumn("_hashed", hashed)
            .where(F.col("_hashed") < chance * 2 ** 31))
    order = Window.partitionBy(group).orderBy("_hashed", unique)
    return (some.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= n)
            .drop("_size", "_hashed", "_place"))
