import gzip
import pathlib

import pytest

from patternfold.config import Config
from patternfold.errors import ConfigError, EmptyDataError, PatternError
from patternfold.schema import observations, require
from patternfold.sources import reader, state


def rows(df):
    return [(r.idx, r.value, r.value_str, r.label, r.ts) for r in df.orderBy("idx").collect()]


def test_python_values(spark):
    got = rows(reader.parse(spark, [1.0, "A", None, {"value": 5, "label": "x", "t": "3"}, True, float("nan"), " ? ", {"v": " s ", "class": "k"}]))
    assert got == [(0, 1.0, None, None, None), (1, None, "A", "A", None), (2, None, None, None, None), (3, 5.0, None, "x", 3.0), (4, 1.0, None, "True", None), (5, None, None, None, None), (6, None, None, None, None), (7, None, " s ", "k", None)]


def test_text_and_files(spark, tmp_path):
    assert reader.parse_text("value,label\n1,a\n\n2,b\n") == [{"value": 1, "label": "a"}, {"value": 2, "label": "b"}]
    assert reader.parse_text("1\n2.5\nna") == [1, 2.5, None]
    assert reader.parse_text("1,2,x") == [1, 2, "x"]
    assert reader.parse_text("[1, 2]") == [1, 2] and reader.parse_text('{"v": 1}') == [{"v": 1}] and reader.parse_text("") == []
    plain, packed, odd = tmp_path / "a.csv", tmp_path / "b.csv.gz", tmp_path / "c.csv"
    plain.write_text("value\n10\n20\n")
    packed.write_bytes(gzip.compress(b"value\n4\n5\n"))
    odd.write_bytes("value,label\n1,é\n".encode("latin-1"))
    assert [r[1] for r in rows(reader.parse(spark, str(plain)))] == [10, 20]
    assert [r[1] for r in rows(reader.parse(spark, packed))] == [4, 5]
    assert rows(reader.parse(spark, odd))[0][3] == "é"
    with pytest.raises(FileNotFoundError):
        reader.parse(spark, pathlib.Path("/no/such/file"))
    assert rows(reader.parse(spark, None)) == []


def test_large_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text("t,value,label\n2,20,b\n1, 10 ,a\n3,?,c\n")
    got = rows(reader.read_csv(spark, str(tmp_path / "x.csv")))
    assert [(r[1], r[3], r[4]) for r in got] == [(10, "a", 1), (20, "b", 2), (None, "c", 3)]
    (tmp_path / "x.json").write_text('{"t": 1, "v": 3}\n{"t": 2, "v": "up"}\n')
    assert [(r[1], r[2]) for r in rows(reader.read_json(spark, str(tmp_path / "x.json")))] == [(3, None), (None, "up")]


def test_adapter_and_checks(spark):
    df = spark.createDataFrame([(2, 1.0, "x"), (1, float("nan"), "x")], "at int, v double, s string")
    assert rows(observations(df, ["at"], "v", None, "s")) == [(0, None, None, None, None), (1, 1.0, None, None, None)]
    with pytest.raises(PatternError):
        require(df, ["nothing"])
    with pytest.raises(EmptyDataError):
        require(df.limit(0), ["at"])
    assert reader.numeric_columns(df) == ["at", "v"]


def test_config():
    c = Config.of({"z_threshold": 2, "max_n": 4.0, "unknown": 1})
    assert (c.z_threshold, c.max_n, c.min_support) == (2, 4, 3)
    for bad in ({"max_n": True}, {"max_n": 2.5}, {"corr_threshold": 2}, {"z_threshold": float("inf")}, {"regimes": 1}, {"weights": 3}):
        with pytest.raises(ConfigError):
            Config.of(bad)


def test_state(spark, tmp_path):
    t = spark.createDataFrame([("P-001", 2)], "id string, frequency long")
    state.save({"patterns": t}, str(tmp_path / "s"), {"a": 1})
    tables, settings = state.load(spark, str(tmp_path / "s"))
    assert tables["patterns"].collect() == t.collect() and settings == {"a": 1}
    state.export_json(t, str(tmp_path / "j"))
    back, nxt = state.import_json(spark, str(tmp_path / "j"), "id string, frequency long")
    assert back.collect() == t.collect() and nxt == 2
