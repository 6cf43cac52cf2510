"""A query is a function of a context; its check is SQL over the same derived relations."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from firnline.catalog.relations import RELATIONS, TABLES


NAME = r"(?<!\{)\{(\w+)\}(?!\})"


SPREAD = r"@@(.*?)@@"


def _spread_spark(m: re.Match) -> str:
    alias, columns, *rows = m.group(1).split("|")
    return f"LATERAL VIEW inline(array({', '.join(f'struct({r})' for r in rows)})) {alias} AS {columns}"


def _spread_values(m: re.Match) -> str:
    alias, columns, *rows = m.group(1).split("|")
    return f"CROSS JOIN (VALUES {', '.join(f'({r})' for r in rows)}) AS {alias}({columns})"


class Context:
    """Gives DataFrames of the given tables and of the relations derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                text = RELATIONS[name]
                self._made[name] = self.spark.sql(re.sub(SPREAD, _spread_spark, text, flags=re.S), **{d: self(d) for d in _inputs(text)})
        return self._made[name]


def _inputs(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(NAME, text)))


def _plain(text: str) -> str:
    text = re.sub(SPREAD, _spread_values, text, flags=re.S)
    return re.sub(NAME, r"\1", text).replace("{{", "{").replace("}}", "}")


@dataclass
class Query:
    name: str
    build: Callable[[Context], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Context(spark, sf_dir))

    def oracle(self) -> str:
        """One SQL text: the derived relations it names as CTEs, then its own body."""
        ordered: list[str] = []

        def visit(text: str) -> None:
            for d in _inputs(text):
                if d not in TABLES and d not in ordered:
                    visit(RELATIONS[d])
                    ordered.append(d)

        visit(self.sql)
        ctes = [f"{n} AS (\n{_plain(RELATIONS[n])}\n)" for n in ordered]
        body = _plain(self.sql).strip()
        if not ctes:
            return body
        if re.match(r"(?i)with\s+recursive\s", body):
            return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + re.sub(r"(?i)^with\s+recursive\s", "", body)
        if re.match(r"(?i)with\s", body):
            return "WITH " + ",\n".join(ctes) + ",\n" + re.sub(r"(?i)^with\s", "", body)
        return "WITH " + ",\n".join(ctes) + "\n" + body


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in REGISTRY:
            raise ValueError(f"query {name!r} is already registered")
        REGISTRY[name] = Query(name, fn, sql)
        return fn
    return add
