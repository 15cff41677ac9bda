"""Record files of every kind: lines, arrays, single objects, broken, empty and ignored ones."""

import json

from skein.sources import files


def test_verdicts_and_records(spark, tmp_path):
    def put(name, text):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")

    row = lambda t: json.dumps({"title": t, "year": 2020})
    put("a/news_records.jsonl", row("one") + "\n\n  " + row("two é") + "\n[1]\n3\n")
    put("a/news_records.json", json.dumps([{"title": "the sibling gives way"}]))
    put("a/2020/single.json", row("three"))
    put("a/2020/array.json", json.dumps([{"title": "four"}, 5, None, {"title": "five"}]))
    put("b/broken.jsonl", row("lost") + "\n{not json\n" + row("lost too"))
    put("b/broken.json", "[{")
    put("b/empty.jsonl", "\n")
    put("b/nothing.jsonl", "")  # of no bytes: not listed
    put("b/none.json", "[]")
    put("b/numbers.json", "[1, 2]")
    put("b/merge_report.json", row("a report"))
    put("c/notes.txt", row("no record"))
    found = {r.path.split("/")[-1]: (r.rows, r.reason) for r in files.verdicts(spark, str(tmp_path)).collect()}
    broken, empty = (0, files.BROKEN), (0, files.EMPTY)
    # The sibling of broken.jsonl gives way too: lines are preferred before anything is read.
    assert found == {"news_records.jsonl": (2, ""), "single.json": (1, ""), "array.json": (2, ""), "broken.jsonl": broken, "empty.jsonl": empty, "none.json": empty, "numbers.json": broken}
    rows = files.records(spark, str(tmp_path)).collect()
    assert sorted(r.title for r in rows) == ["five", "four", "one", "three", "two é"] and {r.year for r in rows} == {2020, None}
    reports = {r.source_key: r.asDict() for r in files.report(spark, str(tmp_path)).collect()}
    assert reports["a"] == {"source_key": "a", "files_found": 1, "files_with_rows": 1, "rows_seen": 2, "read_failures_or_empty": 0, "unavailable_reasons": {}}
    assert reports["b"]["unavailable_reasons"] == {files.EMPTY: 2, files.BROKEN: 2} and reports["b"]["read_failures_or_empty"] == 4


def test_counters_equal_a_count_of_each_batch(spark, tmp_path):
    import time

    from pyspark.sql import functions as F

    from skein.streaming import counters

    listener = counters.Counters()
    spark.streams.addListener(listener)
    try:
        want = {}
        for batch in range(3):
            rows = [(i, "news" if i % (batch + 2) else "forum") for i in range(10 * (batch + 1))]
            spark.createDataFrame(rows, "i int, genre string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = counters.counted(spark.readStream.schema("i int, genre string").parquet(str(tmp_path / "in")), news=F.col("genre") == "news")
            stream.writeStream.queryName("live").format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
            want[batch, "rows"], want[batch, "news"] = len(rows), sum(g == "news" for _, g in rows)
        for _ in range(50):  # events come a little after the batch
            found = {(r.batch, r.counter): r.n for r in listener.batches(spark).collect() if r.query == "live"}
            if found == want:
                break
            time.sleep(0.2)
        assert found == want
        assert {r.counter: r.n for r in listener.totals(spark).collect()} == {"rows": 60, "news": want[0, "news"] + want[1, "news"] + want[2, "news"]}
    finally:
        spark.streams.removeListener(listener)
