"""Row and cell errors of CSV files against literal cases."""

from bytemill.sources.checked import read_checked_rows


def test_every_kind_of_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿Id, x ,note\r\n1,1.5,fine\r\n2,one,\r\n3\r\n\r\n4,2,"open\r\n5,3,"a, ""b"" c"\r\n6,inf,z,more\r\n , 7 ,"x"\r\n8,Infinity,"1,2",\r\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("Id,x,note\n9,,last\nId,x,note\n9223372036854775808,1e400,é\n")
    out = read_checked_rows(spark, str(tmp_path), {"Id": "bigint", "x": "double", "other": "string"}, required=("Id",))
    errors = sorted(((r.row, r.column, r.reason) for r in out.errors.collect()), key=str)
    assert errors == sorted([
        ("2,one,", "x", "not double"), ("3", None, "too few values"), ('4,2,"open', None, "broken quotes"), ("6,inf,z,more", None, "too many values"), (' , 7 ,"x"', "Id", "missing"),
        ('8,Infinity,"1,2",', None, "too many values"), ("9223372036854775808,1e400,é", "Id", "not bigint"), ("9223372036854775808,1e400,é", "x", "infinite"), (None, "other", "missing column"),
    ], key=str)
    assert {r.file.rsplit("/", 1)[1] for r in out.errors.filter("row IS NOT NULL").collect()} == {"a.csv", "b.csv"}
    rows = sorted(((r.Id, r.x, r.other) for r in out.rows.collect()), key=str)
    assert rows == sorted([(1, 1.5, None), (2, None, None), (5, 3.0, None), (None, 7.0, None), (9, None, None), (None, float("inf"), None)], key=str)


def test_only_a_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Id,x\n")
    out = read_checked_rows(spark, str(tmp_path), {"Id": "bigint"})
    assert out.rows.count() == out.errors.count() == 0
