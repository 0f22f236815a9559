import json
import struct

import numpy as np
import pytest
from pyspark.errors import PySparkException

from gradloom import config as c
from gradloom.sinks import model as sink
from gradloom.sinks import reports
from gradloom.sources import tables


def rows(df, *names):
    return [tuple(r[n] for n in names) for r in df.orderBy("row_id").collect()]


def test_inline(spark):
    df = tables.inline(spark, c.InlineDataset((1, 2, 3, 4, 5, 6), (3, 7, 11), 2, 1))
    assert rows(df, "row_id", "x", "y") == [(0, [1, 2], [3]), (1, [3, 4], [7]), (2, [5, 6], [11])]
    assert tables.count_rows(df, 2, 1) == 3
    with pytest.raises(tables.DataError):
        tables.count_rows(df, 3, 1)
    with pytest.raises(tables.DataError):
        tables.inline(spark, c.InlineDataset((1, 2), (1,), 1, 1))


def test_packed(spark, tmp_path):
    x, y = np.arange(300, dtype="<f4"), np.arange(100, dtype="<f4") * 2
    x.tofile(tmp_path / "x.bin")
    y.tofile(tmp_path / "y.bin")
    df = tables.local(spark, c.LocalDataset(str(tmp_path / "x.bin"), str(tmp_path / "y.bin"), 3, 1))
    assert rows(df, "row_id", "x", "y") == [(k, [3 * k, 3 * k + 1, 3 * k + 2], [2 * k]) for k in range(100)]


@pytest.mark.parametrize(("name", "sep", "header"), [("a.csv", ",", ""), ("a.csv", ",", "p,q\n"), ("a.tsv", "\t", "\n p\tq\n")])
def test_text(spark, tmp_path, name, sep, header):
    (tmp_path / name).write_text(header + "".join(f" {k} {sep}{k * 0.5}\n\n" for k in range(500)))
    df = tables.text_table(spark, str(tmp_path / name), 2)
    assert rows(df, "row_id", "values") == [(k, [k, k * 0.5]) for k in range(500)]


def test_text_errors(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n\n3,oops\n")
    with pytest.raises(PySparkException, match="line 4: a field isn't a number"):
        tables.text_table(spark, str(tmp_path / "a.csv"), 2).collect()
    (tmp_path / "b.csv").write_text("1,2\n3\n")
    with pytest.raises(PySparkException, match="line 2: 1 fields"):
        tables.text_table(spark, str(tmp_path / "b.csv"), 2).collect()
    (tmp_path / "c.csv").write_text("\n")
    with pytest.raises(tables.DataError):
        tables.text_table(spark, str(tmp_path / "c.csv"), 2)


def test_row_counts_must_agree(spark, tmp_path):
    (tmp_path / "x.csv").write_text("1\n2\n3\n")
    (tmp_path / "y.csv").write_text("1\n2\n")
    with pytest.raises(PySparkException, match="different row counts"):
        tables.local(spark, c.LocalDataset(str(tmp_path / "x.csv"), str(tmp_path / "y.csv"), 1, 1)).collect()


def test_dataframe_append_subset(spark):
    df = spark.createDataFrame([(k, [float(k)], k % 3) for k in range(6)], "id long, f array<double>, cls int")
    data = tables.from_dataframe(c.DataFrameDataset(df, "f", "cls", "id", 1, 3, 3))
    assert rows(data, "y")[:3] == [([1, 0, 0],), ([0, 1, 0],), ([0, 0, 1],)]
    assert rows(tables.append(data, tables.subset(data, 2)), "row_id", "x") == [*[(k, [k]) for k in range(6)], (6, [0]), (7, [1])]


def test_history(spark, tmp_path):
    (tmp_path / "1.jsonl").write_text('{"run_key": "a|1", "v": 1}\nnot json\n{"run_key": "plain", "v": 9}\n{"run_key": "b|1", "v": 5}\n')
    (tmp_path / "2.jsonl").write_text('{"run_key": "a|1", "v": 2}\n{"run_key": "a|1", "v": 3}\n')
    got = sorted((r["run_key"], r["v"]) for r in tables.history(spark, str(tmp_path)).collect())
    assert got == [("a|1", 2), ("a|1", 3), ("b|1", 5)]


def test_idx(spark, tmp_path):
    images, labels = np.arange(2 * 4, dtype=np.uint8) * 30, np.array([7, 3], np.uint8)
    (tmp_path / "i").write_bytes(struct.pack(">iiii", 2051, 2, 2, 2) + images.tobytes())
    (tmp_path / "l").write_bytes(struct.pack(">ii", 2049, 2) + labels.tobytes())
    got = tables.idx_images(spark, str(tmp_path / "i")).orderBy("row_id").collect()
    assert [r["x"] for r in got] == [pytest.approx(images[:4] / 255), pytest.approx(images[4:] / 255)]
    assert rows(tables.idx_labels(spark, str(tmp_path / "l")), "row_id", "label") == [(0, 7), (1, 3)]


MODEL = c.Sequential([c.Conv2d((1, 4, 4), (2, 1, 3), 1, 0), c.MaxPooling((2, 2, 2), 1, 1), c.Dense(3)])


def test_safetensors(spark, tmp_path):
    params = np.arange(20 + 27, dtype=np.float32)
    path = str(tmp_path / "m" / "a.safetensors")
    sink.save_safetensors(path, MODEL, 16, params)
    got = sink.read_safetensors(path)
    assert {k: v.shape for k, v in got.items()} == {
        "layer_0.weight": (2, 1, 3, 3), "layer_0.bias": (2,), "layer_1.weight": (0,), "layer_1.bias": (0,), "layer_2.weight": (8, 3), "layer_2.bias": (3,),
    }
    assert np.concatenate([v.ravel() for v in got.values()]).tolist() == params.tolist()
    raw = open(path, "rb").read()
    n = struct.unpack("<Q", raw[:8])[0]
    assert json.loads(raw[8 : 8 + n])["layer_0.weight"] == {"dtype": "F32", "shape": [2, 1, 3, 3], "data_offsets": [0, 72]}
    table = sink.params_table(spark, MODEL, 16, params).orderBy("layer", "name").collect()
    assert [(r["layer"], r["name"], len(r["values"])) for r in table] == [(0, "bias", 2), (0, "weight", 18), (1, "bias", 0), (1, "weight", 0), (2, "bias", 3), (2, "weight", 24)]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("convergence", "m", "b", 5, 0.5, 0.1), ("convergence", "m", "a", 3, None, None), ("scalability", "m", "a", 3, 2.0, None)], "suite string, model string, strategy string, workers int, accuracy double, accuracy_std double")
    reports.append_records(df, str(tmp_path / "r"))
    reports.append_records(df, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 6
    reports.write_csv(df, str(tmp_path / "c"))
    (file,) = (tmp_path / "c").glob("*.csv")
    assert [line.split(",")[:3] for line in file.read_text().splitlines()] == [["suite", "model", "strategy"], ["convergence", "m", "a"], ["convergence", "m", "b"], ["scalability", "m", "a"]]
    text = reports.markdown(df)
    assert "| m | b | 5 | - | - | 0.500 ± 0.100 |" in text and text.index("| m | a | 3 |") < text.index("| m | b | 5 |")
