from glossweave.streaming import documents


def test_stream_equals_batch(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/links.parquet")
    (tmp_path / "in").mkdir()
    table.write.parquet(str(tmp_path / "in" / "a"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in" / "*"))
    q = documents.delivered_once(stream.filter("id is not null"), "4000 days").writeStream.format("memory").queryName("links_once").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("links_once").count() == documents.delivered_once(table.filter("id is not null")).count()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert documents.arrivals(docs).selectExpr("sum(documents)").first()[0] == docs.filter("posted_at is not null").count()


def _streamed(spark, df, order, make, path, name):
    """The rows that ``make`` gives of a stream of ``df``, a file and batch for each row in ``order``, by update mode."""
    for i, row in enumerate(df.orderBy(order).collect()):
        spark.createDataFrame([row], df.schema).coalesce(1).write.parquet(f"{path}/in/{i}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")
    got = []
    q = make(stream).writeStream.outputMode("update").foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", f"{path}/cp").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return got


def test_typed_links_are_kept(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/links.parquet")
    typed = table.filter("id is null")
    want = typed.select("doc_id", "text").distinct().count()
    once = documents.delivered_once(table)
    assert once.filter("id is null").select("doc_id", "text").distinct().count() == want > typed.select("doc_id").distinct().count()
    rows = [("d", None, None, t, f"2024-01-{n:02d}") for t, n in (("a", 1), ("b", 2), ("a", 3))] + [("d", 1, "m", "c", "2024-01-04"), ("d", 1, "m", "c", "2024-03-03")]
    df = spark.createDataFrame(rows, "doc_id string, start_offset int, id string, text string, loaded_at string")
    got = _streamed(spark, df, "loaded_at", documents.delivered_once, tmp_path, "typed")
    assert sorted((r.id or "", r.text) for r in got) == sorted((r.id or "", r.text) for r in documents.delivered_once(df).collect()) == [("", "a"), ("", "b"), ("m", "c")]


def test_late_documents_are_counted(spark, tmp_path):
    days = [("2024-06-01", "2024-06-01"), ("2024-06-02", "2024-06-02"), ("2024-04-05", "2024-06-03"), ("2024-01-01", "2024-06-04")]
    df = spark.createDataFrame([("news", p, r) for p, r in days], "source string, posted_at string, received_at string")
    got = _streamed(spark, df, "received_at", documents.arrivals, tmp_path, "late")
    assert sorted(str(r["from"])[:10] for r in got) == ["2024-04-05", "2024-06-01", "2024-06-02"]
    assert [r.posted_at for r in documents.overdue(df).collect()] == ["2024-01-01"]


def test_a_delivery_after_the_bound_is_new(spark):
    rows = [("d", 1, "m", "c", t, n) for t, n in (("2024-01-01", 1), ("2024-01-11", 2), ("2024-04-20", 3), ("2024-06-01", 4), (None, 5))] + [("d", 2, "m", None, "2024-01-01", 6)] * 2
    df = spark.createDataFrame(rows, "doc_id string, start_offset int, id string, text string, loaded_at string, n int")
    assert sorted(r.n for r in documents.delivered_once(df.filter("n <> 5")).collect()) == [1, 3, 6]
    assert documents.delivered_once(df.filter("false")).columns == df.columns
