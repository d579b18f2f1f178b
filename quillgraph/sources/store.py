"""A store of parsed pages: what has been parsed once is not parsed again.

Rows are keyed by path and a hash of the content.  Bringing a corpus up to date
parses only what the store does not hold, by an anti-join on the key, and
appends it; a corpus then meets its facets by the same key, and branches read
only the columns they need.  One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import parse

KEY = ["rel_path", "content"]
#: Facets change with the reader; a store of another version is not read.
VERSION = 1


def content_hash(source: str = "source") -> Column:
    """Two 64-bit hashes of a text and its length; 128 bits tell versions of one page apart."""
    text = F.coalesce(F.col(source), F.lit(""))
    return F.concat_ws("-", F.hex(F.xxhash64(text)), F.hex(F.xxhash64(F.lit(VERSION), text)), F.octet_length(text))


class ParseStore:
    """Parsed pages in Parquet below ``path``, with the facets it was made for."""

    def __init__(self, spark: SparkSession, path: str, facets: tuple[str, ...] = tuple(parse.FACETS)):
        self._spark, self.path, self.facets = spark, f"{path.rstrip('/')}/v{VERSION}", tuple(sorted(facets))
        empty = parse.parse_documents(spark.createDataFrame([], "rel_path string, content string, source string"), self.facets)
        self._schema = empty.drop("source").schema

    def _table(self) -> DataFrame:
        parts = self._parts()
        return self._spark.read.schema(self._schema).parquet(*parts) if parts else self._spark.createDataFrame([], self._schema)

    def update(self, files: DataFrame) -> int:
        """Parse what is new among ``files`` (rel_path, source); how many that was."""
        keyed = files.select("rel_path", content_hash().alias("content"), "source")
        new = keyed.join(self._table().select(*KEY), KEY, "left_anti")
        part = f"{self.path}/{uuid.uuid4().hex}"
        parse.parse_documents(new, self.facets).drop("source").write.parquet(part)
        return self._spark.read.schema(self._schema).parquet(part).count()

    def parsed(self, files: DataFrame) -> DataFrame:
        """``files`` with the facets of their present content; after ``update``."""
        keyed = files.withColumn("content", content_hash())
        return keyed.join(self._table(), KEY).drop("content")

    def compact(self, files: DataFrame) -> None:
        """Keep only what ``files`` hold now, as one part."""
        current = files.select("rel_path", content_hash().alias("content"))
        old = self._parts()
        self._table().join(current, KEY, "left_semi").dropDuplicates(KEY).write.parquet(f"{self.path}/{uuid.uuid4().hex}")
        for part in old:
            self._fs().delete(self._path(part), True)

    def _path(self, path: str):
        return self._spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.path).getFileSystem(self._spark._jsc.hadoopConfiguration())

    def _parts(self) -> list[str]:
        """The parts whose writing has ended."""
        if not self._fs().exists(self._path(self.path)):
            return []
        found = [s.getPath().toString() for s in self._fs().listStatus(self._path(self.path))]
        return [p for p in found if self._fs().exists(self._path(f"{p}/_SUCCESS"))]
