"""Sectioned files: round trips, ranges, refusals, and the export against NumPy."""

import numpy as np
import pytest

from gridloom.sources import binary_files, sections


def rows_of(spark, layout, values):
    rows = [(s.name, i, float(v)) for s in layout.sections for i, v in enumerate(values[s.name])]
    return spark.createDataFrame(rows, "section string, idx long, val double").repartition(5)


@pytest.fixture(scope="module")
def fixture():
    layout = sections.Layout((sections.Section("a", (3, 5), "<i4"), sections.Section("b", (7,)), sections.Section("c", (2, 2), "bf16")), (99, 1, 3))
    rng = np.random.default_rng(1)
    return layout, {"a": np.arange(15) - 4, "b": rng.normal(size=7).astype(np.float32), "c": np.array([0.5, -2.0, 1.5, 256.0])}


@pytest.mark.parametrize("stretch", [1, 4, 100])
def test_round_trip_by_ranges(spark, tmp_path, fixture, stretch):
    layout, values = fixture
    uri = f"file://{tmp_path}/f/x.bin"
    sections.write(rows_of(spark, layout, values), uri, layout, stretch)
    raw = (tmp_path / "f/x.bin").read_bytes()
    head = np.zeros(256, "<i4")
    head[:3] = (99, 1, 3)
    assert raw == head.tobytes() + values["a"].astype("<i4").tobytes() + values["b"].tobytes() + binary_files.to_bf16(values["c"]).tobytes()
    assert [p.name for p in (tmp_path / "f").iterdir()] == ["x.bin"]
    got = {(r.section, r.idx): r.val for r in sections.read(spark, uri, layout, stretch=stretch).collect()}
    assert got == {(k, i): float(x) for k, v in values.items() for i, x in enumerate(v)}
    assert {r.section for r in sections.read(spark, uri, layout, only=["b"]).collect()} == {"b"}


def test_wrong_files_are_refused(spark, tmp_path, fixture):
    layout, values = fixture
    uri = f"file://{tmp_path}/x.bin"
    sections.write(rows_of(spark, layout, values), uri, layout)
    with pytest.raises(ValueError, match="header"):
        sections.read(spark, uri, sections.Layout(layout.sections, (98, 1, 3)))
    (tmp_path / "short.bin").write_bytes((tmp_path / "x.bin").read_bytes()[:-1])
    with pytest.raises(ValueError, match="bytes"):
        sections.read(spark, f"file://{tmp_path}/short.bin", layout)
    (tmp_path / "tiny.bin").write_bytes(b"123")
    with pytest.raises(ValueError):
        sections.export(spark, f"file://{tmp_path}/tiny.bin")
    with pytest.raises(ValueError, match="not a model"):
        sections.export(spark, uri)


@pytest.mark.parametrize("spoil", ["missing", "twice", "null", "out", "section"])
def test_values_that_are_not_all_there_once_are_refused(spark, tmp_path, fixture, spoil):
    layout, values = fixture
    df = rows_of(spark, layout, values)
    extra = {"twice": ("a", 0, 1.0), "null": ("b", 0, None), "out": ("b", 7, 1.0), "section": ("z", 0, 1.0)}
    df = df.where("not (section = 'b' and idx = 3)") if spoil == "missing" else (df.where("not (section = 'b' and idx = 0)") if spoil == "null" else df).unionByName(spark.createDataFrame([extra[spoil]], df.schema))
    with pytest.raises(Exception):
        sections.write(df, f"file://{tmp_path}/x.bin", layout, 4)
    assert not (tmp_path / "x.bin").exists()


@pytest.mark.parametrize("version", [3, 5])
@pytest.mark.parametrize("tile", [3, 256])
def test_export_equals_numpy(spark, tmp_path, version, tile):
    context, vocab, layers, heads, c, padded = 5, 6, 2, 2, 8, 8
    layout = sections.model_layout(context, vocab, layers, heads, c, padded, version)
    sizes = binary_files.tensor_sizes(context, padded, layers, c)
    values = np.random.default_rng(3).normal(size=sum(sizes.values())).astype(np.float32)
    path = tmp_path / "model.bin"
    path.write_bytes(binary_files.encode_checkpoint(values, context, vocab, layers, heads, c, padded, version))
    kept = values if version == 3 else binary_files.from_bf16(binary_files.to_bf16(values))
    w = dict(zip(sizes, np.split(kept, np.cumsum(list(sizes.values()))[:-1])))
    want = {"transformer.wte.weight": w["wte"].reshape(padded, c)[:vocab], "transformer.wpe.weight": w["wpe"].reshape(context, c), "transformer.ln_f.weight": w["lnfw"].reshape(1, c), "transformer.ln_f.bias": w["lnfb"].reshape(1, c)}
    want["lm_head.weight"] = want["transformer.wte.weight"]
    for k, (name, turned) in sections.LAYER.items():
        for i, part in enumerate(w[k].reshape(layers, -1)):
            n = {"qkvw": 3 * c, "attprojw": c, "fcw": 4 * c, "fcprojw": c}.get(k, 1)
            m = part.reshape(n, -1)
            want[f"transformer.h.{i}.{name}"] = m.T if turned else m
    got = {}
    for r in sections.export(spark, f"file://{path}", tile, tile).collect():
        got.setdefault(r.name, {})[r.row] = r["values"]
    assert got.keys() == want.keys()
    for name, m in want.items():
        assert np.array_equal(np.array([got[name][i] for i in range(len(m))], np.float32), m), name
    assert sections.model_layout(context, vocab, layers, heads, c, padded, version) == layout
    (tmp_path / "bad.bin").write_bytes(path.read_bytes() + b"\0")
    with pytest.raises(ValueError):
        sections.export(spark, f"file://{tmp_path}/bad.bin")


def test_runs_of_values_are_cut_at_stretches(spark, tmp_path, fixture):
    layout, values = fixture
    runs = [(k, int(lo), [float(x) for x in v[lo : lo + 3]]) for k, v in values.items() for lo in range(0, len(v), 3)]
    df = spark.createDataFrame(runs, "section string, idx long, val array<double>")
    sections.write(df, f"file://{tmp_path}/runs.bin", layout, 4)
    sections.write(rows_of(spark, layout, values), f"file://{tmp_path}/rows.bin", layout, 4)
    assert (tmp_path / "runs.bin").read_bytes() == (tmp_path / "rows.bin").read_bytes()
    with pytest.raises(Exception, match="aren't all there"):
        sections.write(df.where("not (section = 'b' and idx = 3)"), f"file://{tmp_path}/gap.bin", layout, 4)
