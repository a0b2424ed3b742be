import datetime
import decimal
import json

import pyarrow as pa
import pytest

from tessergrid.sources import xz_parts


def _rows(spark):
    day = datetime.date(2024, 2, 29)
    at = datetime.datetime(2024, 2, 29, 1, 2, 3, 456789)
    rows = [(i, None if i % 7 == 0 else f"Zeile\n{i}é ", day + datetime.timedelta(i), at, decimal.Decimal(f"{i}.10"), i / 3, [i, None], (i, "y")) for i in range(200)]
    rows += [(None,) * 8, (5, "", None, None, None, float("nan"), [], None), (5, "", None, None, None, float("-inf"), [], (None, None)), (6, "x" * 9_000_000, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "k bigint, s string, d date, t timestamp_ntz, m decimal(20,2), x double, a array<int>, b struct<i:int,j:string>")


def _texts(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_round_trip(spark, tmp_path):
    rows = _rows(spark)
    xz_parts.write_parts(rows, f"file://{tmp_path}/a", by="k", parts=6)
    got = xz_parts.read_parts(spark, f"file://{tmp_path}/a")
    assert got.schema == rows.schema
    assert _texts(got) == _texts(rows)
    with pytest.raises(Exception, match="holds parts already"):
        xz_parts.write_parts(rows, f"file://{tmp_path}/a")
    utc = spark.sql("SELECT timestamp'2024-01-01 05:06:07.000008' AS t")
    xz_parts.write_parts(utc, f"{tmp_path}/utc")
    assert _texts(xz_parts.read_parts(spark, f"{tmp_path}/utc")) == _texts(utc)


def test_empty_and_refused(spark, tmp_path):
    xz_parts.write_parts(_rows(spark).limit(0), f"{tmp_path}/none")
    got = xz_parts.read_parts(spark, f"{tmp_path}/none")
    assert got.count() == 0 and got.columns[0] == "k"
    for sql in ("SELECT binary('a') AS c", "SELECT array(date'2024-01-01') AS c", "SELECT map(1, 2) AS c"):
        with pytest.raises(Exception, match="types that parts do not hold"):
            xz_parts.write_parts(spark.sql(sql), f"{tmp_path}/{len(sql)}")


@pytest.mark.parametrize("where, most", [("k = 17", 1), ("k in (3, 4)", 2), ("k > 190", 1), ("k >= 400", 0), ("k < 2", 1), ("k <= 2", 1), ("s = 'zz'", 6), ("k = 17 or k = 180", 6), ("x > 1", 6)])
def test_filters_leave_parts_out(spark, tmp_path, where, most):
    rows = _rows(spark).where("k is not null and length(s) < 100")
    xz_parts.write_parts(rows, str(tmp_path), by="k", parts=6)
    got = xz_parts.read_parts(spark, str(tmp_path)).where(where)
    assert got.rdd.getNumPartitions() <= max(most, 1)
    assert _texts(got) == _texts(rows.where(where))


def test_days_leave_parts_out(spark, tmp_path):
    rows = _rows(spark).where("d is not null")
    xz_parts.write_parts(rows, str(tmp_path), by="d", parts=6)
    got = xz_parts.read_parts(spark, str(tmp_path))
    for where in ("d >= date'2024-09-01'", "t > timestamp_ntz'2024-03-01 00:00:00'"):
        assert _texts(got.where(where)) == _texts(rows.where(where))
    assert got.where("d >= date'2024-09-01'").rdd.getNumPartitions() == 1


@pytest.mark.parametrize("harm", ["changed", "cut", "longer", "gone", "another"])
def test_changed_parts_fail(spark, tmp_path, harm):
    xz_parts.write_parts(spark.range(1000), str(tmp_path), by="id", parts=3)
    parts = [p["name"] for p in json.loads((tmp_path / "manifest.json").read_text())["parts"]]
    victim = tmp_path / parts[1]
    content = victim.read_bytes()
    made = {"changed": content[:-40] + b"x" + content[-39:], "cut": content[: len(content) // 2], "longer": content + b"\0\0\0\0", "another": (tmp_path / parts[0]).read_bytes()}
    victim.unlink()
    if harm != "gone":
        victim.write_bytes(made[harm])
    with pytest.raises(Exception, match="cannot be read|is not the part"):
        xz_parts.read_parts(spark, str(tmp_path)).collect()


def test_columns_are_spelled_and_read_whole(monkeypatch):
    """Lines are what ``json.dumps`` writes; plain rows are read without a Python object a row, odd ones still are read."""
    odd = ['a"b', "\\", "\x01\n", "é漢\x7f", "", None]
    batch = pa.RecordBatch.from_pydict({"k": [1, None, -3, 4, 5, 2**62], "x": [0.1, 1e300, None, 2.0, -0.0, 1e-7], 's"t': odd, "p": ["u", None, "v w", "{}", "null", ", "], "b": [True, False, None, True, True, False], "a": [[1, None], [], None, [2], [3], [4]], "d": [datetime.date(2024, 1, 2)] * 5 + [None]})
    spelled = [{k: v.isoformat() if isinstance(v, datetime.date) else v for k, v in r.items()} for r in batch.to_pylist()]
    want = "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in spelled).encode()
    assert bytes(xz_parts._json_lines(batch)) == want
    assert bytes(xz_parts._json_lines(batch.slice(2, 3))) == b"".join(want.splitlines(True)[2:5])
    lines = want.split(b"\n")[:-1]
    nan = [b'{"k": 1, "x": NaN}']
    assert xz_parts._parsed(nan, batch.schema).to_pydict()["x"][0] != xz_parts._parsed(nan, batch.schema).to_pydict()["x"][0]
    monkeypatch.setattr(xz_parts, "_batch", None)
    assert xz_parts._parsed(lines, batch.schema).equals(batch)
