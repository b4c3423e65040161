"""Canonical tables, text files and passages by run: written, read and replaced."""

from pyspark.sql import types as T

from bidlens.operators import index as ix
from bidlens.sources import tables


def test_missing_columns_get_their_default(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("at", T.TimestampType())])
    tables.write_table(spark.createDataFrame([(1,), (None,)], "id int"), str(tmp_path / "t"))
    got = tables.read_table(spark, str(tmp_path / "t"), schema)
    assert got.schema.simpleString() == schema.simpleString()
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "", 0, None), (None, "", 0, None)]


def test_append_partitions_and_json_lines(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id long, part string, text string")
    tables.write_table(rows, str(tmp_path / "t"), partition_by=("part",))
    tables.write_table(rows.filter("id = 1"), str(tmp_path / "t"), partition_by=("part",))
    assert sorted((r.id, r.part) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(1, "a"), (1, "a"), (2, "b")]
    assert (tmp_path / "t" / "part=a").is_dir()
    tables.write_json_lines(rows, str(tmp_path / "j"))
    assert sorted(r.id for r in spark.read.json(str(tmp_path / "j")).collect()) == [1, 2]


def test_text_files_are_one_row_each(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("가나\n다".encode())
    got = {r.path.rsplit("/", 1)[-1]: r.text for r in tables.read_text_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "가나\n다"}


def test_only_written_runs_are_replaced(spark, tmp_path):
    path = str(tmp_path / "passages")
    rows = lambda *given: spark.createDataFrame(list(given), "doc_id long, run_id long, chunk_text string")
    ix.write_runs(rows((1, 1, "old"), (2, 2, "other")), path)
    ix.write_runs(rows((1, 1, "again"), (1, 3, "new")), path)
    stored = spark.read.parquet(path)
    assert sorted((r.doc_id, r.run_id, r.chunk_text) for r in stored.collect()) == [(1, 1, "again"), (1, 3, "new"), (2, 2, "other")]
    runs = spark.createDataFrame([(1, 1, "completed"), (1, 3, "completed"), (2, 2, "completed"), (2, 4, "failed")], "doc_id long, run_id long, status string")
    assert sorted((r.doc_id, r.chunk_text) for r in ix.swap_runs(stored, runs).collect()) == [(1, "new"), (2, "other")]
