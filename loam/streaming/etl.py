"""Streaming preparation of documents: chunks, graph, vectors and status of a micro-batch under one number.

Each table has a folder per batch, and a batch that is repeated writes its own
folders again. The status folder is written last: a batch counts only once it is
there, so a reader sees all of a batch's tables or none, wherever a run stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.sketches import mentions
from ..session import file_system
from .pipelines import run_batches

TABLES = ("chunks", "edges", "vectors", "status")
#: From documents (doc_id, text, ...) to rows (doc_id, position, chunk).
Chunker = Callable[[DataFrame], DataFrame]


class DocumentFlow:
    """path: the tables' folder; chunk, keep and embed: how chunks are made, which stay, and their vectors."""

    def __init__(self, path: str, chunk: Chunker, keep: Callable[[Column], Column], embed: Callable[[Column], Column], names: Callable[[Column], Column] = mentions):
        self.path, self.chunk, self.keep, self.embed, self.names = path.rstrip("/"), chunk, keep, embed, names

    def folder(self, table: str, batch: int) -> str:
        return f"{self.path}/{table}/batch={batch}"

    def save(self, df: DataFrame, table: str, batch: int) -> DataFrame:
        df.write.mode("overwrite").parquet(self.folder(table, batch))
        return df.sparkSession.read.schema(df.schema).parquet(self.folder(table, batch))

    def handle(self, docs: DataFrame, batch: int) -> None:
        """Write all tables of a batch; chunks are read back, so the others follow what was written.

        A document without text, or of which no chunk stays, has a status with
        no chunks. A doc_id twice in a batch has both rows' chunks.
        """
        status = f"{self.path}/status/batch={batch}"
        files, place = file_system(docs.sparkSession, status)
        files.delete(place, True)  # a repeated batch doesn't count until all of it is written again
        made = self.chunk(docs).where(self.keep(F.col("chunk"))).select("doc_id", "position", "chunk", F.sha2("chunk", 256).alias("hash"))
        chunks = self.save(made, "chunks", batch)
        edges = chunks.select("doc_id", F.explode(self.names(F.col("chunk"))).alias("name")).groupBy("doc_id", "name").agg(F.count("*").alias("times"))
        self.save(edges, "edges", batch)
        self.save(chunks.select("hash", "doc_id", "position", self.embed(F.col("chunk")).alias("vector")), "vectors", batch)
        counts = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"))
        known = docs.select("doc_id").distinct()
        done = known.join(counts, known["doc_id"].eqNullSafe(counts["doc_id"]), "left").select(known["doc_id"], F.coalesce("chunks", F.lit(0).cast("long")).alias("chunks"))
        self.save(done, "status", batch)

    def run(self, docs: DataFrame, checkpoint: str) -> StreamingQuery:
        """Handle all that a stream of documents holds; start it again after a failure with the same checkpoint."""
        return run_batches(docs, self.handle, checkpoint)

    def batches(self, spark: SparkSession) -> list[int]:
        """The batches that count."""
        files, place = file_system(spark, f"{self.path}/status")
        names = [s.getPath() for s in files.listStatus(place)] if files.exists(place) else []
        done = [p for p in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().removeprefix("batch=")) for p in done)

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        """A table's rows of all batches that count, with their batch."""
        if table not in TABLES:
            raise ValueError(f"no table {table}")
        paths = [self.folder(table, b) for b in self.batches(spark)]
        return spark.read.option("basePath", f"{self.path}/{table}").parquet(*paths)
