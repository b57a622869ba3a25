"""SQLite files as a Spark data source, split by ranges of rowid; and imports from them."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from mnemolake.schema import HISTORY, MEMORY, ddl

_BATCH = 1000


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def columns_of(path: str, table: str) -> list[str]:
    with _open(path) as db:
        return [r[0] for r in db.execute("SELECT name FROM pragma_table_info(?)", (table,))]


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


#: Comparisons that SQLite answers as Spark does; a null is never true in either.
_TESTS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.table, self.parts, self.schema = options["path"], options["table"], int(options.get("partitions", 8)), schema
        self.tests, self.values = [], []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of columns of text with texts. Names come from the schema, values are bound, so neither becomes statement text that a caller wrote."""
        texts = {f.name for f in self.schema.fields if f.dataType.simpleString() == "string"}
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in texts and type(f) in _TESTS and isinstance(f.value, str):
                self._take(f'"{name}" COLLATE BINARY {_TESTS[type(f)]} ?', name, [f.value])
            elif name in texts and isinstance(f, In) and 0 < len(f.value) <= 100 and all(isinstance(v, str) for v in f.value):
                self._take(f'"{name}" COLLATE BINARY IN ({", ".join("?" * len(f.value))})', name, list(f.value))
            elif name in texts and isinstance(f, IsNotNull):
                self._take(f'"{name}" IS NOT NULL', name, [])
            else:
                yield f

    def _take(self, test: str, name: str, values: list[str]) -> None:
        self.tests.append(test)
        self.values += values

    def partitions(self) -> list[_Range]:
        with _open(self.path) as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [_Range(0, 0)]
        step = -(-(high - low + 1) // self.parts)
        return [_Range(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, part: _Range) -> Iterator[tuple]:
        # names come from the declared schema only, so a hostile column name never reaches the statement
        names = ", ".join(f'"{f.name}"' for f in self.schema.fields)
        with _open(self.path) as db:
            tests = "".join(f" AND {t}" for t in self.tests)
            rows = db.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid >= ? AND rowid < ?{tests}', (part.low, part.high, *self.values))
            while batch := rows.fetchmany(_BATCH):
                yield from batch


class SqliteSource(DataSource):
    """options: path, table (memories or history), partitions."""

    @classmethod
    def name(cls) -> str:
        return "mnemolake_sqlite"

    def schema(self) -> str:
        # text, not types: this runs in a worker, which has no session to parse types with
        model = {"memories": MEMORY, "history": HISTORY}[self.options["table"]]
        have = set(columns_of(self.options["path"], self.options["table"]))
        kinds = {"embedding": "binary"}
        return ddl(tuple((n, kinds.get(n, k), d) for n, k, d in model if n in have))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)


def _scan(spark: SparkSession, path: str, table: str, needed: tuple[str, ...]) -> DataFrame:
    try:
        missing = [c for c in needed if c not in columns_of(path, table)]
    except sqlite3.DatabaseError as error:
        raise ValueError(f"not a SQLite file: {path}") from error
    if missing:
        raise ValueError(f"{table} lacks {', '.join(missing)}")
    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(SqliteSource.name()).option("path", path).option("table", table).load()


def read_memories(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """Rows as an import takes them: only known columns, vectors as base64 text. `where` is asked of SQLite as far as it can answer."""
    rows = _scan(spark, path, "memories", ("id", "identifier", "fact_text", "embedding"))
    rows = rows if where is None else rows.where(where)
    rows = rows.withColumn("embedding_b64", F.base64("embedding")).drop("embedding").withColumn("line", F.monotonically_increasing_id())
    for name, kind, default in MEMORY:
        if name not in rows.columns and name != "embedding":
            rows = rows.withColumn(name, F.lit(default).cast(kind))
    return rows


def read_history(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    rows = _scan(spark, path, "history", tuple(c[0] for c in HISTORY))
    return rows if where is None else rows.where(where)
