"""A catalog is a warehouse folder: `<database>.db/<table>` (O-01 to O-04)."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from ..plans.schema import TableSchema
from ..plans.store import Store
from .table import Table

SYSTEM = "sys"


class Catalog:
    def __init__(self, spark: SparkSession, warehouse: str):
        self.spark, self.store = spark, Store(spark)
        self.warehouse = self.store.qualified(warehouse).rstrip("/")

    def _database(self, name: str) -> str:
        if name == SYSTEM:
            raise ValueError(f"{SYSTEM!r} is the system's database")
        if not re.fullmatch(r"[^/\s.]+", name):
            raise ValueError(f"{name!r} is no name for a database")
        return f"{self.warehouse}/{name}.db"

    def _table(self, name: str) -> str:
        database, _, table = name.partition(".")
        if not table or "/" in table:
            raise ValueError(f"{name!r} isn't database.table")
        return f"{self._database(database)}/{table}"

    def create_database(self, name: str, ignore_if_exists: bool = False) -> None:
        path = self._database(name)
        if self.store.exists(path):
            if not ignore_if_exists:
                raise ValueError(f"database {name!r} exists")
            return
        self.store.mkdirs(path)

    def database_exists(self, name: str) -> bool:
        return self.store.exists(self._database(name))

    def databases(self) -> list[str]:
        return [n.removesuffix(".db") for n in self.store.names(self.warehouse) if n.endswith(".db")]

    def tables(self, database: str) -> list[str]:
        path = self._database(database)
        if not self.store.exists(path):
            raise ValueError(f"no database {database!r}")
        return [n for n in self.store.names(path) if self.store.exists(f"{path}/{n}/schema/schema-0")]

    def table_exists(self, name: str) -> bool:
        path = self._table(name)
        return self.store.exists(f"{path}/schema/schema-0") or any(n.startswith("schema-") for n in self.store.names(f"{path}/schema"))

    def create_table(self, name: str, schema: T.StructType | dict, partition_keys=(), primary_keys=(), options: dict | None = None, comment: str = "", ignore_if_exists: bool = False) -> Table:
        """Checks the schema, numbers its fields and stores it as version 0, which only one caller can."""
        database = name.partition(".")[0]
        if not self.database_exists(database):
            raise ValueError(f"no database {database!r}")
        path = self._table(name)
        new = TableSchema.create(schema, partition_keys, primary_keys, options, comment)
        if self.table_exists(name) or not (self.store.mkdirs(f"{path}/schema") or self.store.publish(f"{path}/schema/schema-0", new.to_json())):
            if not ignore_if_exists:
                raise ValueError(f"table {name!r} exists")
        return self.table(name)

    def table(self, name: str, branch: str | None = None) -> Table:
        if not self.table_exists(name):
            raise ValueError(f"no table {name!r}")
        return Table(self.spark, self._table(name), branch)
