"""Record files as a paged source: one partition a page, pages chosen by pushed filters on the time of change.

An export lies in folders by month of change, each file a page of JSON records.
A scan lists the folders, takes those that the filters leave, and reads each
page in a task of its own. The source goes through pyarrow's file systems, so
it reads local folders, HDFS and object stores that pyarrow knows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json as pj
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Comparisons that choose pages, by name.
COMPARED = {GreaterThan: "greater", GreaterThanOrEqual: "greater_equal", LessThan: "less", LessThanOrEqual: "less_equal", EqualTo: "equal"}


@dataclass
class Page(InputPartition):
    path: str


class PagedRecords(DataSource):
    """Options: path; updated, the column of the time of change as ISO text (default updated_at). The schema is the caller's."""

    @classmethod
    def name(cls) -> str:
        return "paged_records"

    def schema(self) -> str:
        raise ValueError("give the schema of the records")

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(self.options["path"], self.options.get("updated", "updated_at"), schema)


class PagedReader(DataSourceReader):
    def __init__(self, path: str, updated: str, schema: StructType):
        self.path, self.updated, self.schema = path, updated, to_arrow_schema(schema)
        self.bounds: list[tuple[str, str]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons of the time of change are done here, exactly; all others stay with Spark."""
        for f in filters:
            if type(f) in COMPARED and f.attribute == (self.updated,) and isinstance(f.value, str):
                self.bounds.append((COMPARED[type(f)], f.value))
            else:
                yield f

    def wanted(self, period: str) -> bool:
        """Whether the folder of a period, a beginning of the times in it, can hold a record within the bounds."""
        for how, value in self.bounds:
            own = value[: len(period)]
            if not (period >= own if how.startswith("greater") else period <= own if how.startswith("less") else period == own):
                return False
        return True

    def partitions(self) -> list[Page]:
        files, root = fs.FileSystem.from_uri(self.path)
        pages = []
        for folder in files.get_file_info(fs.FileSelector(root)):
            name = folder.base_name
            if folder.type == fs.FileType.Directory and name.startswith("period=") and self.wanted(name.removeprefix("period=")):
                pages += [Page(f.path) for f in files.get_file_info(fs.FileSelector(folder.path)) if f.is_file and not f.base_name.startswith((".", "_"))]
        return sorted(pages, key=lambda p: p.path) or [Page("")]

    def read(self, page: Page) -> Iterator[pa.RecordBatch]:
        if not page.path:
            return
        files, _ = fs.FileSystem.from_uri(self.path)
        with files.open_input_stream(page.path) as raw:
            table = pj.read_json(raw, parse_options=pj.ParseOptions(explicit_schema=self.schema, unexpected_field_behavior="ignore"))
        for how, value in self.bounds:
            table = table.filter(getattr(pc, how)(table.column(self.updated), value))
        yield from table.select(self.schema.names).to_batches()


def export_pages(df: DataFrame, path: str, updated: str = "updated_at", rows: int = 1000, length: int = 7) -> None:
    """Write records as pages of at most rows, in folders by the first length characters of the time of change (7: month).

    Rows without a time go to the period "none", which no comparison reaches.
    """
    period = F.coalesce(F.substring(F.col(updated).cast("string"), 1, length), F.lit("none"))
    paged = df.withColumn("period", period).repartitionByRange("period", updated)
    paged.write.option("maxRecordsPerFile", rows).partitionBy("period").json(path)


def paged_records(spark: SparkSession, path: str, schema: StructType | str, updated: str = "updated_at", since: str | None = None) -> DataFrame:
    """The records under path, or those changed at since (ISO text) or later; only pages of those periods are read."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedRecords)
    df = spark.read.format("paged_records").schema(schema).option("updated", updated).load(path)
    return df if since is None else df.where(F.col(updated) >= since)
