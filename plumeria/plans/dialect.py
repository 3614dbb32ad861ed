"""One text for Spark SQL and for the DuckDB check, with the few spots where the two differ."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .registry import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events embeddings documents conversations benchmark labels".split()


class Spark:
    """Spark SQL."""

    emb = "(SELECT vec_id, label, dim, CAST(x AS DOUBLE) AS v FROM embeddings LATERAL VIEW posexplode(embedding) t AS dim, x)"

    def list(self, x: str, order: str) -> str:
        return f"listagg({x}, ',') WITHIN GROUP (ORDER BY {order})"

    def even(self, x: str) -> str:
        return f"bround({x}, 0)"

    def double(self, x: str) -> str:
        """A number in double precision; with a plain 101.0, Spark divides in decimals of six digits."""
        return f"{x}D"

    def range(self, n: int) -> str:
        return f"(SELECT id FROM range({n}))"

    def words(self, cols: str, table: str, pattern: str) -> str:
        return f"(SELECT {cols}, pos + 1 AS pos, w FROM (SELECT {cols}, regexp_extract_all(text, '{pattern.replace(chr(92), chr(92) * 2)}', 0) AS ws FROM {table}) LATERAL VIEW posexplode(ws) t AS pos, w)"

    def numbers(self, cols: str, table: str, low: str, high: str) -> str:
        return f"(SELECT {cols}, n FROM {table} LATERAL VIEW explode(CASE WHEN {low} <= {high} THEN sequence({low}, {high}) END) t AS n)"


class Duck:
    """DuckDB SQL."""

    emb = "(SELECT vec_id, label, CAST(unnest(range(len(embedding))) AS INT) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"

    def list(self, x: str, order: str) -> str:
        return f"string_agg({x}, ',' ORDER BY {order})"

    def even(self, x: str) -> str:
        return f"round_even({x}, 0)"

    def double(self, x: str) -> str:
        return x

    def range(self, n: int) -> str:
        return f"(SELECT range AS id FROM range({n}))"

    def words(self, cols: str, table: str, pattern: str) -> str:
        return f"(SELECT {cols}, CAST(unnest(range(1, len(ws) + 1)) AS INT) AS pos, unnest(ws) AS w FROM (SELECT {cols}, regexp_extract_all(text, '{pattern}') AS ws FROM {table}))"

    def numbers(self, cols: str, table: str, low: str, high: str) -> str:
        return f"(SELECT {cols}, unnest(range({low}, {high} + 1)) AS n FROM {table})"


#: What follows a table that has an alias of its own: a word that is no keyword.
ALIAS = re.compile(r"\s+(?:AS\s+)?(?!(?:ON|JOIN|LEFT|CROSS|FULL|WHERE|GROUP|ORDER|HAVING|EXCEPT|UNION|LATERAL|WINDOW)\b)[A-Za-z_]\w*")


def _named(text: str, tables: list[str], prefix: str) -> str:
    """The text with each table read by its view's name, under its own name as an alias where it has none."""

    def view(m: re.Match) -> str:
        return m[1] + prefix + m[2] + ("" if ALIAS.match(text, m.end()) else f" AS {m[2]}")

    return re.sub(rf"\b((?:FROM|JOIN)\s+)({'|'.join(tables)})\b", view, text)


def sql_query(build: Callable[[object], str]) -> Callable[[SparkSession, str], DataFrame]:
    """Register a query that both engines can run; build(dialect) gives its text."""
    name = build.__name__
    text = build(Spark())
    used = [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # views of one folder have names of their own, so that queries over two folders do not meet
        own = f"t{zlib.crc32(sf_dir.encode()):08x}_"
        for t in used:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(own + t)
        return spark.sql(_named(text, used, own) if used else text)

    run.__name__, run.__doc__ = name, build.__doc__
    QUERIES[name] = run
    ORACLE[name] = build(Duck())
    return build
