from retort.streaming.lines import stream_lines


def test_stream_gives_what_a_batch_gives(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('k-1-2-3\tx\nbad\nk-1-2-3\t"y\n')
    q = stream_lines(spark, str(tmp_path / "in"), "reverse").writeStream.format("memory").queryName("lines_seen").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.line_text, r.reason) for r in spark.table("lines_seen").collect()}
    assert got == {("k-1-2-3\tx", None), ("bad", "columns"), ('k-1-2-3\t"y', "quoting")}
