"""A catalog of databases and tables in folders: ``warehouse/name.db/table``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from .fs import Files
from .schema import Schemas, TableSchema
from .table import LakeTable

SYSTEM_DATABASE = "sys"


class Catalog:
    def __init__(self, spark: SparkSession, warehouse: str):
        self.spark, self.files, self.root = spark, Files(spark), warehouse.rstrip("/")

    def _db(self, name: str) -> str:
        if name == SYSTEM_DATABASE:
            raise ValueError(f"{name} is a system database")
        return f"{self.root}/{name}.db"

    def create_database(self, name: str, ignore_if_exists: bool = False) -> None:
        if self.files.exists(self._db(name)) and not ignore_if_exists:
            raise ValueError(f"database {name} exists")
        self.files.mkdirs(self._db(name))

    def databases(self) -> list[str]:
        return [i.name[:-3] for i in self.files.list(self.root) if i.is_dir and i.name.endswith(".db")]

    def create_table(self, name: str, fields: T.StructType, partition_keys=(), primary_keys=(), options=None, comment: str = "", ignore_if_exists: bool = False) -> LakeTable:
        db, _, table = name.partition(".")
        if not self.files.exists(self._db(db)):
            raise ValueError(f"database {db} does not exist")
        if "$" in table:
            raise ValueError(f"{table} is a system table")
        path = f"{self._db(db)}/{table}"
        if Schemas(self.files, path).latest() is not None:
            if not ignore_if_exists:
                raise ValueError(f"table {name} exists")
            return LakeTable(self.spark, path)
        return LakeTable.create(self.spark, path, fields, partition_keys, primary_keys, options, comment)

    def tables(self, db: str) -> list[str]:
        return [i.name for i in self.files.list(self._db(db)) if i.is_dir and Schemas(self.files, i.path).ids()]

    def table(self, name: str, **options: str) -> LakeTable:
        db, _, table = name.partition(".")
        table, _, branch = table.partition("$branch_")
        return LakeTable(self.spark, f"{self._db(db)}/{table}", branch or "main", options)

    def load_schema(self, name: str) -> TableSchema:
        return self.table(name).schema

    def register(self, name: str, view: str | None = None) -> None:
        """Make a table's latest rows a temporary view for SQL."""
        self.table(name).read().createOrReplaceTempView(view or name.replace(".", "_"))
