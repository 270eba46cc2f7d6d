"""One query text for two engines: the few spellings in which Spark SQL and DuckDB differ."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bindings import PROFILES_SQL
from .catalogue import query

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Spark:
    explode, matches, size, distinct, intersect, minus, concat = "explode", "regexp_like", "size", "array_distinct", "array_intersect", "array_except", "concat"
    profiles = PROFILES_SQL

    def s(self, text: str) -> str:
        return "r'" + text.replace("'", "\\x27") + "'"

    def sub(self, x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, {self.s(pattern)}, '{to}')"

    def found(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, {self.s(pattern)}, 0)"

    def tokens(self, x: str) -> str:
        """Keyword tokens; possessive, so that a long dotted run takes no stack."""
        return self.found(f"lower({x})", r"[a-z0-9]++(?:[.\-][a-z0-9]++)*+")

    def has(self, x: str, pattern: str) -> str:
        return f"regexp_like({x}, {self.s(pattern)})"

    def part(self, x: str, pattern: str, group: int) -> str:
        return f"regexp_extract({x}, {self.s(pattern)}, {group})"

    def joined(self, x: str, order: str, by: str = ",") -> str:
        return f"listagg({x}, '{by}') WITHIN GROUP (ORDER BY {order})"

    def text_of(self, array: str, by: str = ",") -> str:
        return f"array_join({array}, '{by}')"

    def where(self, array: str, x: str, test: str) -> str:
        return f"filter({array}, {x} -> {test})"

    def each(self, array: str, x: str, to: str) -> str:
        return f"transform({array}, {x} -> {to})"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})"

    def ordered(self, array: str) -> str:
        return f"array_sort({array})"

    def placed(self, table: str, array: str) -> str:
        """FROM item: each row of ``table`` with (place, item) of an array, place from 0."""
        return f"{table} LATERAL VIEW posexplode({array}) e AS place, item"

    def split(self, x: str, by: str) -> str:
        return f"split({x}, {self.s(re.escape(by))})"

    def series(self, a: str, b: str) -> str:
        return f"explode(sequence({a}, {b}))"


class Duck(Spark):
    explode, matches, size, distinct, intersect = "unnest", "regexp_matches", "len", "list_distinct", "list_intersect"

    def s(self, text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def sub(self, x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, {self.s(pattern)}, '{re.sub(r'[$](\d)', r'\\\1', to)}', 'g')"

    def tokens(self, x: str) -> str:
        return self.found(f"lower({x})", r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")

    def has(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.s(pattern)})"

    def joined(self, x: str, order: str, by: str = ",") -> str:
        return f"string_agg({x}, '{by}' ORDER BY {order})"

    def text_of(self, array: str, by: str = ",") -> str:
        return f"array_to_string({array}, '{by}')"

    def where(self, array: str, x: str, test: str) -> str:
        return f"list_filter({array}, lambda {x}: {test})"

    def each(self, array: str, x: str, to: str) -> str:
        return f"list_transform({array}, lambda {x}: {to})"

    def array(self, *items: str) -> str:
        return f"[{', '.join(items)}]"

    def ordered(self, array: str) -> str:
        return f"list_sort({array})"

    def placed(self, table: str, array: str) -> str:
        return f"(SELECT *, generate_subscripts({array}, 1) - 1 AS place, unnest({array}) AS item FROM {table})"

    def split(self, x: str, by: str) -> str:
        return f"string_split({x}, {self.s(by)})"

    def series(self, a: str, b: str) -> str:
        return f"unnest(generate_series({a}, {b}))"


def sql_query(name: str, text: Callable[[Spark], str]) -> None:
    """Registers a query whose text is given for either engine."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = text(Spark())
        spark = spark.newSession()  # its views are not the caller's
        for table in TABLES:
            if re.search(rf"\b{table}\b", own):
                spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
        return spark.sql(own)

    query(name, text(Duck()))(run)
