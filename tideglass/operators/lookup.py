"""Many-to-one lookup join that holds up under hot keys and large dimensions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A dimension is broadcast only when its measured content stays below this.
BROADCAST_BYTES = 64 * 1024 * 1024


def content_bytes(dim: DataFrame) -> int:
    """Measured size of a stored dimension's rows: text bytes plus 16 per other field."""
    texts = [f.name for f in dim.schema.fields if isinstance(f.dataType, T.StringType)]
    fixed = 16 * (len(dim.columns) - len(texts)) + 24 * len(texts)
    row = reduce(
        lambda a, b: a + b,
        [F.coalesce(F.octet_length(name).cast("bigint"), F.lit(0)) for name in texts],
        F.lit(fixed),
    )
    return dim.agg(F.sum(row)).first()[0] or 0


def lookup_join(
    facts: DataFrame,
    dim: DataFrame,
    keys: Sequence[str],
    *,
    weight: str,
    spread: str,
    nullable: Sequence[str] = (),
    how: str = "left",
    dim_bytes: int | None = None,
) -> DataFrame:
    """Join `facts` to `dim`, which is unique on `keys`; NULL matches NULL in `nullable` keys.

    A dimension measured below BROADCAST_BYTES is broadcast, so the facts are not
    shuffled at all. A larger one is shuffled on the keys plus a salt: `weight` is a
    dimension column with the number of facts per row, so the rows that would fill
    more than one shuffle partition are known beforehand. There are at most as many
    of them as partitions; they are repeated once per salt, and their facts are
    spread over the salts by the `spread` column. Facts without any key are spread as
    well; the dimension must have no row with all keys NULL, so they match nothing.
    The weight column does not reach the result.
    """
    if dim_bytes is None:
        dim_bytes = content_bytes(dim)
    if dim_bytes <= BROADCAST_BYTES:
        return _equal_join(facts, F.broadcast(dim.drop(weight)), keys, nullable, how)
    return _salted_join(facts, dim, keys, nullable, weight=weight, spread=spread, how=how)


def _equal_join(
    facts: DataFrame, dim: DataFrame, keys: Sequence[str], nullable: Sequence[str], how: str
) -> DataFrame:
    renamed = dim.withColumnsRenamed({key: f"_dim_{key}" for key in keys})
    matches = [
        F.col(key).eqNullSafe(F.col(f"_dim_{key}"))
        if key in nullable
        else F.col(key) == F.col(f"_dim_{key}")
        for key in keys
    ]
    joined = facts.join(renamed, reduce(lambda a, b: a & b, matches), how)
    return joined.drop(*[f"_dim_{key}" for key in keys])


def _salted_join(
    facts: DataFrame,
    dim: DataFrame,
    keys: Sequence[str],
    nullable: Sequence[str],
    *,
    weight: str,
    spread: str,
    how: str,
) -> DataFrame:
    partitions = int(dim.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = dim.agg(F.sum(weight)).first()[0] or 0
    share = max(total // partitions, 1)
    salts = F.greatest(F.ceil(F.col(weight) / F.lit(share)), F.lit(1)).cast("int")

    # At most `partitions` rows can weigh more than total / partitions.
    hot = dim.where(F.col(weight) > share).select(*keys, salts.alias("_salts"))
    salted_dim = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop(weight)
    no_key: Column = reduce(lambda a, b: a & b, [F.col(key).isNull() for key in keys])
    spread_over = F.when(no_key, F.lit(partitions)).otherwise(
        F.coalesce(F.col("_salts"), F.lit(1))
    )
    salted_facts = (
        _equal_join(facts, F.broadcast(hot), keys, nullable, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(spread), spread_over).cast("int"))
        .drop("_salts")
    )
    return _equal_join(salted_facts, salted_dim, [*keys, "_salt"], nullable, how).drop("_salt")
