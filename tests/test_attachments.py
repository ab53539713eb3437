from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions import attachments as A
from gristmill.functions import fields as S
from gristmill.functions.columns import let
from gristmill.operators import history as Y
from gristmill.streaming import stateful


def values(spark, make, *inputs):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], "k int, x string")
    return [r["y"] for r in df.select("k", make(F.col("x")).alias("y")).orderBy("k").collect()]


def test_names(spark):
    assert values(spark, A.without_size_label, "a.hwp [29.0 KByte]", "b.pdf (3MB)", "c 12", None) == ["a.hwp", "b.pdf", "c 12", None]
    assert values(spark, A.known_extension, "notice.hwp [29.0 KB]", "a.PDF; b.zip", "x.tar", "none") == ["hwp", "pdf", "tar", ""]
    assert values(spark, lambda c: A.is_blocked(c, F.lit("")), "a.zip", "a.hwp", "a", "a.exe") == [True, False, False, True]
    assert values(spark, lambda c: A.is_blocked(F.lit("a.pdf"), c), "image/png", "application/zip", "text/plain", None) == [True, True, False, False]
    ids = values(spark, lambda c: A.file_identity(c, F.lit(5), hwpx_as_hwp=True), "d/A.HWPX", "a.hwp", ".hwp")
    assert ids[0] == ids[1] and ids[2]["stem"] == "file"


def test_keys_and_boards(spark):
    assert values(spark, A.attachment_key, "https://www.a.kr/portal/file/down.do?menuNo=3&atchFileId=F1&fileSn=2", "https://a.kr/web/download/x?id=1&mid=2", "", "https://a.kr/web/page?id=1") == [
        "https://a.kr/cmm/fms/FileDown.do?atchFileId=F1&fileSn=2", "https://a.kr/download/x?id=1", "", "https://a.kr/web/page?id=1"]
    base = F.lit("https://www.a.kr/bbs/B1/list.do?menuNo=3")
    assert values(spark, lambda c: A.same_board(base, c), "http://a.kr/bbs/b1/view.do", "https://a.kr/x?bbsId=b1", "https://a.kr/x?menuNo=3", "https://a.kr/x?menuNo=4",
                  "https://a.kr/x", "https://b.kr/bbs/b1/view.do") == [True, True, True, False, False, False]
    assert values(spark, lambda c: A.page_url(c, F.lit(7)), "https://a.kr/l?page=2&x=1", "https://a.kr/l#t", "https://a.kr/l?x=1") == [
        "https://a.kr/l?page=7&x=1", "https://a.kr/l?page=7", "https://a.kr/l?x=1&page=7"]


def test_titles_and_failures(spark):
    assert values(spark, A.is_placeholder_title, "404", "Not Found", "", None, "A title") == [True, True, True, True, False]
    assert values(spark, A.ocr_failure, "OCR returned 429", "ocr api down", "ocr error", "failed", None) == ["ocr_status_429", "ocr_api_failed", "ocr_failed", None, None]
    assert values(spark, S.title, "A  title 등록일 2024-01-02 조회 3", "B 2024.1.2", "C", "등록 안내") == ["A title", "B", "C", "등록 안내"]
    assert values(spark, S.rule_tokens, '["a", "b", "a"]', '"x|y"', None) == [["a", "b"], ["x", "y"], None]
    assert values(spark, lambda c: A.smoothed(c.cast("int"), F.lit(100)), "0", "99", "100", "200") == [25, 100, 100, 100]


def test_let_is_the_value(spark):
    assert values(spark, lambda c: let(F.upper(c), lambda u: F.concat(u, u)), "a", None) == ["AA", None]


def test_progress_is_monotone_and_sticky(spark):
    rows = spark.createDataFrame([(1, 1, 5, "running"), (1, 2, 3, "done"), (1, 3, None, "running"), (1, 4, 9, "failed")], "u int, t int, n int, s string")
    got = Y.sticky_status(Y.monotonic(rows, ["u"], [F.col("t")], ["n"]), ["u"], [F.col("t")], "s", ["done", "failed"]).orderBy("t").collect()
    assert [r["n"] for r in got] == [5, 5, 5, 9] and [r["s"] for r in got] == ["running", "done", "done", "failed"]


def test_streams_over_many_batches(spark, tmp_path):
    for k in range(4):
        spark.createDataFrame([("a", k * 100), ("a", k * 100 + 50), ("b", k)], "u string, s int").withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.parquet(str(tmp_path / "e" / f"{k}"))
    stream = spark.readStream.schema("u string, s int, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e" / "*"))
    assert sorted(r["u"] for r in stateful.run_available(stateful.first_seen(stream, ["u"]).select("u")).collect()) == ["a", "b"]
    claims = stateful.run_available(stateful.claims(stream, ["u"], "ts", 100)).collect()
    assert sorted((r["u"], r["ts"].minute * 60 + r["ts"].second) for r in claims)[0] == ("a", 0) and sum(r["u"] == "b" for r in claims) == 1
    last = stateful.run_available(stateful.progress(stream, ["u"], ["s"]), "update").groupBy("u").agg(F.max("s").alias("s")).collect()
    assert {r["u"]: r["s"] for r in last} == {"a": 350, "b": 3}
