"""On-chain state: which calls to make, and their results as a long table and as nested maps."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

ABI = "array<struct<type: string, name: string, stateMutability: string, inputs: array<struct<name: string, type: string>>>>"
# Results not shown.
ZERO = "0x0000000000000000000000000000000000000000"
SKIPPED = ("DOMAIN_SEPARATOR", "PERMIT_TYPEHASH")
BATCH = 500


def readable(addresses: DataFrame) -> DataFrame:
    """Registered addresses on ethereum."""
    return addresses.where(F.col("registry_name").isNotNull() & (F.col("chain") == "ethereum"))


def with_abi(addresses: DataFrame, cache: DataFrame) -> DataFrame:
    """Adds ``abi``: the implementation's for a proxy if there is one, else the contract's own; rows of none go."""
    abis = cache.where("chain_id = 1 and abi <> ''").select(F.col("address").alias("_a"), F.col("abi").alias("_abi"))
    impl = abis.select(F.col("_a").alias("_i"), F.col("_abi").alias("_impl_abi"))
    joined = addresses.join(abis, F.col("address") == F.col("_a"), "left").join(impl, F.when(F.col("is_proxy"), F.col("implementation")) == F.col("_i"), "left")
    return joined.withColumn("abi", F.coalesce("_impl_abi", "_abi")).where("abi is not null").drop("_a", "_abi", "_i", "_impl_abi")


def calls(addresses: DataFrame) -> DataFrame:
    """``address, registry_name, pos, fn``: view or pure functions without arguments, in the interface's order."""
    f = F.col("f")
    rows = addresses.select("address", "registry_name", F.posexplode(F.from_json("abi", ABI)).alias("pos", "f"))
    return rows.where((f["type"] == "function") & f["stateMutability"].isin("view", "pure") & (F.coalesce(F.size(f["inputs"]), F.lit(0)) <= 0)).select("address", "registry_name", "pos", f["name"].alias("fn"))


def state_long(results: DataFrame) -> DataFrame:
    """``address, fn, value, status``: the last result of overloads; a reverted call keeps a null value."""
    w = W.partitionBy("address", "fn").orderBy(F.desc("pos"))
    last = results.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    ok = F.col("status") == "success"
    return last.select("address", "fn", F.when(ok, F.col("value")).alias("value"), F.when(ok, "success").otherwise("reverted").alias("status"))


def state_nested(state: DataFrame) -> DataFrame:
    """``address, values``: a map of function to value, null where the call was reverted."""
    return state.groupBy("address").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("fn", "value")))).alias("values"))


def serialise(value: Column, kind: T.DataType | None = None) -> Column:
    """Nested values as JSON. ``kind``: the column's type; of it, longs and decimals keep all digits as text."""
    return F.to_json(value if kind is None else _digits_as_text(value, kind))


def _digits_as_text(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.LongType | T.DecimalType):
        return value.cast("string")
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _digits_as_text(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: _digits_as_text(x, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(_digits_as_text(value[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    return value


def shown(state: DataFrame) -> DataFrame:
    return state.where(F.col("value").isNotNull() & ~F.col("value").isin(ZERO, "") & ~F.col("fn").isin(*SKIPPED))


class _Number(float):
    """A number of a JSON text that is written as it was read, whatever its digits."""

    def __new__(cls, text: str) -> _Number:
        made = super().__new__(cls, text)
        made.text = text
        return made

    def __repr__(self) -> str:
        return self.text


def _as_json(value: object) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_as_json(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_as_json, value)) + "]"
    return value.text if isinstance(value, _Number) else json.dumps(value, ensure_ascii=False)


def display(value: object) -> str:
    """A value of JSON as it is shown: dash for null, bare strings, members of arrays at any depth, objects as JSON."""
    if value is None:
        return "—"
    if isinstance(value, list):
        return ", ".join(map(display, value))
    return value if isinstance(value, str) else _as_json(value)


@F.pandas_udf(T.StringType())
def _display(column: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        try:
            return None if text is None else display(json.loads(text, parse_int=_Number, parse_float=_Number))
        except ValueError:
            return text

    return column.map(one)


def format_value(value: Column) -> Column:
    """A result, as JSON text, for display: dash for null, bare strings, arrays by their members, anything else as JSON.

    Numbers keep their digits and objects the order of their keys, which a variant does not; so arrays, objects and
    strings are read in Arrow batches, and all else stays JVM-side. A text that is no JSON is shown as it is.
    """
    return F.when(value.isNull() | (value == "null"), "—").when(value.rlike(r'^\s*["\[{]'), _display(value)).otherwise(value)


def short_address(address: Column) -> Column:
    return F.concat(F.substring(address, 1, 6), F.lit("…"), F.right(address, F.lit(4)))


def success_counts(state: DataFrame) -> DataFrame:
    return state.agg(F.count_if(F.col("value").isNotNull()).alias("succeeded"), F.count_if(F.col("value").isNull()).alias("failed"))


def node_state(refs: DataFrame, addresses: DataFrame, state: DataFrame, key: str = "id") -> DataFrame:
    """References of nodes (``key, address_refs``) with the address's facts and its values, null where not fetched."""
    rows = refs.select(key, F.posexplode("address_refs").alias("pos", "address"))
    return rows.join(addresses, "address", "left").join(state_nested(state), "address", "left")
