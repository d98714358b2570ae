"""Streaming preparation: whatever sink a run dies after, a restart loses and doubles nothing."""

import pytest
from pyspark.sql import functions as F

from loam.streaming.etl import TABLES, DocumentFlow


def flow_at(path):
    chunk = lambda df: df.select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "chunk"))
    return DocumentFlow(path, chunk, lambda c: F.length(c) > 3, lambda c: F.array(F.length(c).cast("float")))


def contents(spark, flow):
    return {name: sorted(map(str, flow.read(spark, name).drop("batch").collect())) for name in TABLES}


@pytest.mark.parametrize("dies_after", [None, *TABLES])
def test_restart_after_each_sink(spark, tmp_path, dies_after):
    docs = [(i, f"Alpha line {i}\nno\nBeta_{i % 3} and Gamma" if i % 5 else None) for i in range(40)]
    for i in range(4):
        spark.createDataFrame(docs[i * 10 : i * 10 + 10], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = lambda: spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    flow = flow_at(f"file://{tmp_path}/out")
    died = []
    save = flow.save

    def failing(df, table, batch):
        out = save(df, table, batch)
        if batch == 2 and table == dies_after and not died:
            died.append(table)
            assert 2 not in flow.batches(spark) or table == "status"
            raise OSError("killed")
        return out

    flow.save = failing
    q = flow.run(source(), f"file://{tmp_path}/checkpoint")
    if dies_after:
        with pytest.raises(Exception, match="killed"):
            q.awaitTermination()
        q = flow.run(source(), f"file://{tmp_path}/checkpoint")
    q.awaitTermination()
    assert flow.batches(spark) == [0, 1, 2, 3] and died == [dies_after] * bool(dies_after)
    got = contents(spark, flow)
    assert len(got["status"]) == 40 and len(got["chunks"]) == len(got["vectors"]) == 64
    whole = flow_at(f"file://{tmp_path}/whole")
    whole.handle(spark.createDataFrame(docs, "doc_id long, text string"), 0)
    assert got == contents(spark, whole)
