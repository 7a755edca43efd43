import os

import pytest
from pyspark.sql import functions as F

from quarry.sources.corpus_source import CorpusReader, corpus_stream
from quarry.streaming.text_stream import cleaned_stream, run_once

SCHEMA = "doc_id long, text string"


def put(spark, folder, name, rows, groups=1):
    import pyarrow as pa
    import pyarrow.parquet as pq

    os.makedirs(folder, exist_ok=True)
    table = pa.table({"other": [0] * len(rows), "text": [t for _, t in rows], "doc_id": pa.array([i for i, _ in rows], pa.int64())})
    pq.write_table(table, f"{folder}/{name}", row_group_size=max(1, len(rows) // groups))


def test_stop_and_restart_give_every_row_once(spark, tmp_path):
    """New files between runs, a name that sorts before the others, and a run with nothing new."""
    folder, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    run = lambda: run_once(spark, cleaned_stream(corpus_stream(spark, folder, SCHEMA)), out, state)
    put(spark, folder, "b.parquet", [(i, f" a\r\nb{i} ") for i in range(100)], groups=7)
    assert sorted(r.doc_id for r in run().collect()) == list(range(100))
    put(spark, folder, "a.parquet", [(i, "x") for i in range(100, 150)])
    put(spark, folder, ".c.parquet", [(9999, "not whole yet")])
    assert sorted(r.doc_id for r in run().collect()) == list(range(150))
    got = run().orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == list(range(150)) and got[7].text == "a\nb7" and got[7].n_words == 2


def test_a_failed_batch_is_run_again_whole(spark, tmp_path):
    folder, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    put(spark, folder, "a.parquet", [(i, "x") for i in range(40)], groups=4)
    rows = corpus_stream(spark, folder, SCHEMA)
    broken = rows.withColumn("text", F.when(F.col("doc_id") == 33, F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        run_once(spark, broken, out, state)
    put(spark, folder, "b.parquet", [(i, "y") for i in range(40, 60)])
    assert sorted(r.doc_id for r in run_once(spark, corpus_stream(spark, folder, SCHEMA), out, state).collect()) in (list(range(40)), list(range(60)))
    assert sorted(r.doc_id for r in run_once(spark, corpus_stream(spark, folder, SCHEMA), out, state).collect()) == list(range(60))


def test_offsets_part_the_files(spark, tmp_path):
    folder = f"{tmp_path}/in"
    reader = CorpusReader({"path": folder, "rowGroups": "2"}, ["doc_id", "text"])
    assert reader.latestOffset() == reader.initialOffset()
    put(spark, folder, "a.parquet", [(i, "x") for i in range(10)], groups=5)
    first = reader.latestOffset()
    put(spark, folder, "b.parquet", [(i, "x") for i in range(10, 12)])
    last = reader.latestOffset()
    assert len(reader.partitions(reader.initialOffset(), first)) == 3 and len(reader.partitions(first, last)) == 1 and reader.partitions(last, last) == []
    ids = [x for p in reader.partitions(reader.initialOffset(), last) for b in reader.read(p) for x in b.column("doc_id").to_pylist()]
    assert ids == list(range(12)) and next(reader.read(reader.partitions(first, last)[0])).schema.names == ["doc_id", "text"]


def test_an_empty_folder(spark, tmp_path):
    assert run_once(spark, corpus_stream(spark, f"{tmp_path}/none", SCHEMA), f"{tmp_path}/out", f"{tmp_path}/state").count() == 0


def test_a_row_group_is_not_held_whole(tmp_path):
    import random

    import pyarrow as pa
    import pyarrow.parquet as pq

    from quarry.sources.corpus_source import RowGroups

    draw = random.Random(7)
    rows = pa.table({"doc_id": range(20_000), "text": [draw.randbytes(800).hex() for _ in range(20_000)]})
    pq.write_table(rows, f"{tmp_path}/x.parquet", row_group_size=20_000)
    held, most, ids = pa.total_allocated_bytes(), 0, []
    for batch in CorpusReader({"path": str(tmp_path)}, ["doc_id", "text"]).read(RowGroups(f"{tmp_path}/x.parquet", 0, 1)):
        most = max(most, pa.total_allocated_bytes() - held)
        ids += batch.column("doc_id").to_pylist()
    assert ids == list(range(20_000)) and most < rows.nbytes / 3, (most, rows.nbytes)
