"""Functions of metadata columns: array<struct<key, value>> in the order of the file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of one element.
WIDTHS = {"f64": 8, "f32": 4, "f16": 2, "bf16": 2, "i64": 8, "i32": 4, "i16": 2, "i8": 1, "u64": 8, "u32": 4, "u16": 2, "u8": 1, "bool": 1, "fp8_e4m3": 1, "fp8_e5m2": 1}
#: Names of types in safetensors files.
SAFETENSORS = {"F64": "f64", "F32": "f32", "F16": "f16", "BF16": "bf16", "I64": "i64", "I32": "i32", "I16": "i16", "I8": "i8", "U64": "u64", "U32": "u32", "U16": "u16", "U8": "u8", "BOOL": "bool", "F8_E4M3": "fp8_e4m3", "F8_E5M2": "fp8_e5m2"}
#: Element type codes of ONNX.
ONNX = {1: "f32", 2: "u8", 3: "i8", 4: "u16", 5: "i16", 6: "i32", 7: "i64", 9: "bool", 10: "f16", 11: "f64", 12: "u32", 13: "u64", 16: "bf16", 17: "fp8_e4m3", 19: "fp8_e5m2"}


def mapped(x: Column, names: dict) -> Column:
    """The value of each name; null for others."""
    return F.element_at(F.create_map(*(F.lit(v) for kv in names.items() for v in kv)), x)


def with_key(metadata: Column, key: str) -> Column:
    return F.filter(metadata, lambda m: m["key"] == key)


def first_value(metadata: Column, key: str) -> Column:
    """The value of the first pair with a key, else null."""
    return F.get(with_key(metadata, key), 0)["value"]


def unique_value(metadata: Column, key: str) -> Column:
    """As first_value(); a key that comes twice or has an empty value is an error."""
    found = with_key(metadata, key)
    value = F.get(found, 0)["value"]
    return F.when(F.size(found) > 1, F.raise_error(F.lit(f"duplicate {key}"))).when(value == "", F.raise_error(F.lit(f"empty {key}"))).otherwise(value)


def has_prefix(metadata: Column, prefix: str) -> Column:
    return F.exists(metadata, lambda m: F.startswith(m["key"], F.lit(prefix)))


def with_prefix(metadata: Column, prefix: str) -> Column:
    return F.filter(metadata, lambda m: F.startswith(m["key"], F.lit(prefix)))


def without_prefix(metadata: Column, prefix: str) -> Column:
    return F.filter(metadata, lambda m: ~F.startswith(m["key"], F.lit(prefix)))


def _pair(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))


def upsert(metadata: Column, key: str, value: Column) -> Column:
    """The first pair with the key gets the value; without one, a pair is appended."""
    at = F.array_position(F.transform(metadata, lambda m: m["key"]), key)
    changed = F.transform(metadata, lambda m, i: F.when(i == at - 1, _pair(key, value)).otherwise(_pair_of(m)))
    return F.when(at > 0, changed).otherwise(F.concat(F.transform(metadata, _pair_of), F.array(_pair(key, value))))


def _pair_of(m: Column) -> Column:
    return F.struct(m["key"].alias("key"), m["value"].alias("value"))


def replaced(metadata: Column, key: str, value: Column) -> Column:
    """All pairs with the key go, and one with the value is appended."""
    return F.concat(F.transform(F.filter(metadata, lambda m: m["key"] != key), _pair_of), F.array(_pair(key, value)))


def element_count(shape: Column) -> Column:
    """The product of a shape; null where it overflows 64 bits or a dimension is negative."""
    return F.aggregate(shape, F.lit(1).cast("long"), lambda a, n: F.when(n >= 0, F.try_multiply(a, n)))


def byte_size(shape: Column, dtype: Column) -> Column:
    return F.try_multiply(element_count(shape), mapped(dtype, WIDTHS).cast("long"))


def whole_number(text: Column, bits: int = 32) -> Column:
    """A decimal number without sign of so many bits; null for anything else."""
    value = F.when(F.rlike(text, F.lit("^\\+?[0-9]{1,20}$")), text.try_cast("decimal(20,0)"))
    out = F.when(value < F.lit(str(1 << bits)).cast("decimal(20,0)"), value)
    return out.try_cast("long") if bits < 64 else out


def typed(text: Column) -> Column:
    """struct<kind, value>: array (JSON), bool, int, float (finite) or string, in this order, as model files keep them."""
    is_array = F.startswith(F.ltrim(text), F.lit("[")) & F.try_parse_json(text).isNotNull()
    kind = (
        F.when(is_array, "array").when(text.isin("true", "false"), "bool").when(F.rlike(text, F.lit("^[+-]?[0-9]+$")) & text.try_cast("long").isNotNull(), "int")
        .when(F.rlike(text, F.lit(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")) & (F.abs(text.try_cast("double")) < float("inf")), "float").otherwise("string")
    )
    return F.when(text.isNotNull(), F.struct(kind.alias("kind"), text.alias("value")))


CONFIG = (
    "model_type string, hidden_size long, intermediate_size long, num_hidden_layers long, num_attention_heads long, num_key_value_heads long, vocab_size long, "
    "max_position_embeddings long, rms_norm_eps double, rope_theta double, tie_word_embeddings boolean, bos_token_id long, eos_token_id string, pad_token_id long"
)


def model_config(text: Column) -> Column:
    """The configuration of a decoder from its JSON, with defaults: key and value heads as attention heads, eps 1e-6, theta 10000.

    eos_token_ids is an array, whether one id or a list is given. ``problem`` names the first rule that is broken, else null.
    """
    c = F.from_json(text, CONFIG)
    heads = F.coalesce(c["num_key_value_heads"], c["num_attention_heads"])
    eps, theta = F.coalesce(c["rms_norm_eps"], F.lit(1e-6)), F.coalesce(c["rope_theta"], F.lit(10_000.0))
    eos = c["eos_token_id"]
    ids = F.when(eos.isNull(), F.array().cast("array<bigint>")).when(F.startswith(eos, F.lit("[")), F.from_json(eos, "array<bigint>")).otherwise(F.array(eos.try_cast("long")))
    needed = ["hidden_size", "intermediate_size", "num_hidden_layers", "num_attention_heads", "vocab_size", "max_position_embeddings"]
    problem = F.when(c["model_type"].isNull(), "model_type is missing")
    for name in needed:
        problem = problem.when(c[name].isNull() | (c[name] <= 0), f"{name} has to be positive")
    problem = problem.when(heads <= 0, "num_key_value_heads has to be positive").when(c["hidden_size"] % c["num_attention_heads"] != 0, "hidden_size has to be divisible by num_attention_heads")
    problem = problem.when(c["num_attention_heads"] % heads != 0, "num_attention_heads has to be divisible by num_key_value_heads")
    problem = problem.when(eps <= 0, "rms_norm_eps has to be positive").when(theta <= 0, "rope_theta has to be positive")
    return F.struct(
        *(c[n].alias(n) for n in ["model_type", *needed]), heads.alias("num_key_value_heads"), eps.alias("rms_norm_eps"), theta.alias("rope_theta"),
        F.coalesce(c["tie_word_embeddings"], F.lit(False)).alias("tie_word_embeddings"), c["bos_token_id"].alias("bos_token_id"), ids.alias("eos_token_ids"), c["pad_token_id"].alias("pad_token_id"),
        problem.alias("problem"),
    )
