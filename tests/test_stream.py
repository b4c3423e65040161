"""The intake stream takes every notice once, also when a body or a batch comes again, and counts blank numbers."""

import json

from bidlens.streaming import intake


def body(*numbers, name="notice"):
    return json.dumps({"response": {"body": {"items": {"item": [{"bidNtceNo": n, "bidNtceNm": f"{name} {n}"} for n in numbers]}}}})


def run(spark, folder, table, marks):
    query = intake.start(spark, str(folder), str(table), str(marks))
    query.awaitTermination(120)
    assert query.exception() is None
    return query


def test_intake_takes_every_notice_once(spark, tmp_path):
    folder, table, marks = tmp_path / "in", tmp_path / "out", tmp_path / "marks"
    folder.mkdir()
    (folder / "a.json").write_text(body("1", "2", "1", ""))
    run(spark, folder, table, marks)
    assert sorted(r.bid_ntce_no for r in intake.saved(spark, str(table)).collect()) == ["1", "2"]
    assert intake.failures(spark, str(table)) == 1
    # restart from the checkpoint: what was taken in is known from state, the table is not read
    (folder / "b.json").write_text(body("2", "3", "", "", name="later"))
    run(spark, folder, table, marks)
    got = {r.bid_ntce_no: r.bid_ntce_nm for r in intake.saved(spark, str(table)).collect()}
    assert got == {"1": "notice 1", "2": "notice 2", "3": "later 3"}
    assert intake.failures(spark, str(table)) == 3


def test_a_repeated_batch_replaces_its_own_folder(spark, tmp_path):
    folder, table, marks = tmp_path / "in", tmp_path / "out", tmp_path / "marks"
    folder.mkdir()
    (folder / "a.json").write_text(body("1", "2"))
    run(spark, folder, table, marks)
    (tmp_path / "marks" / "commits" / "0").unlink()  # the batch was written, but its commit got lost
    (tmp_path / "marks" / "commits" / ".0.crc").unlink(missing_ok=True)
    (folder / "b.json").write_text(body("2", "3"))
    run(spark, folder, table, marks)
    assert sorted(r.bid_ntce_no for r in intake.saved(spark, str(table)).collect()) == ["1", "2", "3"]


def test_read_rows_do_not_grow_with_the_table(spark, tmp_path):
    folder, table, marks = tmp_path / "in", tmp_path / "out", tmp_path / "marks"
    folder.mkdir()
    (folder / "a.json").write_text(body(*[str(n) for n in range(500)]))
    run(spark, folder, table, marks)
    (folder / "b.json").write_text(body("1", "501"))
    query = run(spark, folder, table, marks)
    assert query.lastProgress is None or query.lastProgress["numInputRows"] <= 1
    assert intake.saved(spark, str(table)).count() == 501
