"""Delimited text keeps quotes and line breaks, and refuses values that do not fit."""

import pytest

from tabforge.sources import io


def test_quotes_and_line_breaks(spark, tmp_path):
    rows = [(1, 'say "hi", ok'), (2, "two\nlines"), (3, "plain"), (4, '"')]
    io.write_frame(spark.createDataFrame(rows, "id long, text string"), str(tmp_path / "t"), fmt="csv")
    back = io.read_frame(spark, str(tmp_path / "t"))
    assert back.dtypes == [("id", "bigint"), ("text", "string")] and sorted(map(tuple, back.collect())) == rows


def test_late_values(spark, tmp_path):
    (tmp_path / "late.csv").write_text("a\n" + "1\n" * 12_000 + "abc\n")
    assert io.read_frame(spark, str(tmp_path / "late.csv")).dtypes == [("a", "string")]
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|CAST"):
        io.read_frame(spark, str(tmp_path / "late.csv"), schema="a long").collect()
