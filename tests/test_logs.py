import logging

from gristmill.logs import observed, say


def test_counts_ride_on_the_run(spark, caplog):
    rows = [("converted", 2048, 1024, None), ("converted", 2048, None, 1024), ("skipped", None, None, None), ("fallback", 5, None, 5)]
    df, seen = observed(spark.createDataFrame(rows, "outcome string, originalSize long, convertedSize long, size long"), "run")
    assert df.count() == 4
    with caplog.at_level(logging.INFO, "gristmill"):
        got = say(seen)
    assert (got["converted"], got["skipped"], got["fallback"], got["original_bytes"], got["converted_bytes"]) == (2, 1, 1, 4096, 2048)
    assert "saved 50.0 %" in caplog.text and "could not be kept" in caplog.text
