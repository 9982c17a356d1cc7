import hashlib

from ledgerline.streaming import ingest


def test_rows_of_the_latest_batch(spark, tmp_path):
    """Statement 1 comes again in a later batch, with a smaller file id; the other statement, and the same number of another user, stay."""
    schema = "user_id long, statement_id long, file_id long, debit int"
    path = str(tmp_path / "t")
    for batch, rows in enumerate([[(1, 1, 10, 5), (1, 1, 10, 6), (1, 2, 20, 7), (2, 1, 30, 8)], [(1, 1, 9, 50)]]):
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/batch={batch}")
    got = {tuple(r) for r in ingest.statement_rows(spark, path).select("user_id", "statement_id", "file_id", "debit").collect()}
    assert got == {(1, 1, 9, 50), (1, 2, 20, 7), (2, 1, 30, 8)}


STATEMENT = b"Date,Narration,Withdrawal (INR),Deposit (INR),Closing Balance\n01-09-2025,UPI/X,,5000.00,15000.00\n02-09-2025,RENT,1000.00,,14000.00\n"


def test_first_uploads_by_id_are_new(spark):
    """Of equal contents the smallest valid id is the new one, unless an earlier batch has brought the content; invalid ones leave nothing behind."""
    sent = [(1, 5, "a.csv", b"x"), (1, 4, "b.csv", b"x"), (1, 3, "c.exe", b"x"), (2, 6, "d.csv", b"x"), (None, 7, "e.csv", b"x"), (None, 8, "f.csv", b"x"), (1, 9, "g.csv", b"y"), (1, 2, "h.csv", b"z")]
    uploads = spark.createDataFrame([(*r, len(r[3])) for r in sent], ingest.UPLOADS)
    sha = {c: hashlib.sha256(c).hexdigest() for c in (b"y", b"z")}
    before = spark.createDataFrame([(1, sha[b"y"], 1, "NEW"), (1, sha[b"z"], 0, "INVALID"), (2, sha[b"z"], 0, "NEW")], "user_id long, sha256 string, file_id long, verdict string")
    got = {r.file_id: (r.verdict, r.original) for r in ingest.admitted(uploads, before).collect()}
    assert got == {5: ("DUPLICATE", 4), 4: ("NEW", None), 3: ("INVALID", None), 6: ("NEW", None), 7: ("NEW", None), 8: ("DUPLICATE", 7), 9: ("DUPLICATE", 1), 2: ("NEW", None)}


def test_uploads_are_known_by_the_report_not_by_calls_for_each_content(spark, tmp_path):
    """Two batches; nothing is kept in a state store, whose function was called in Python for each content of each batch."""
    sent, table, state = (str(tmp_path / n) for n in ("sent", "table", "state"))
    waves = [
        [(1, 10, "a.csv", STATEMENT), (1, 11, "b.csv", STATEMENT), (2, 12, "c.csv", STATEMENT), (1, 13, "x.exe", STATEMENT), (1, 14, "bad.csv", b"not,a,statement\n")],
        [(1, 20, "a.csv", STATEMENT), (1, 21, "bad.csv", b"not,a,statement\n"), (1, 22, "n.csv", b"Branch 7\n" + STATEMENT)],
    ]
    for wave in waves:
        spark.createDataFrame([(*r, len(r[3])) for r in wave], ingest.UPLOADS).write.mode("append").parquet(sent)
        query = ingest.ingest_once(spark.readStream.schema(ingest.UPLOADS).parquet(sent), table, state)
        query.awaitTermination()
        assert not any(p["stateOperators"] for p in query.recentProgress)
    report = {r.file_id: (r.verdict, r.n_rows, r.error is None) for r in spark.read.parquet(f"{table}_files").collect()}
    assert report == {
        10: ("NEW", 2, True), 11: ("DUPLICATE", None, True), 12: ("NEW", 2, True), 13: ("INVALID", None, False), 14: ("NEW", 0, False),
        20: ("DUPLICATE", None, True), 21: ("AGAIN", 0, False), 22: ("NEW", 2, True),
    }
    assert sorted(r.file_id for r in ingest.statement_rows(spark, table).collect()) == [10, 10, 12, 12, 22, 22]
