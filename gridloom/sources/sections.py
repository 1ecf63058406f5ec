"""Binary files of sections: an optional header of 256 integers, then arrays of known types end to end.

A layout lists sections in order. A reader turns it into byte ranges, each of which a task reads by itself; a file
of another magic number, version or size is refused before anything is read. A writer takes (section, idx, val) rows:
each task writes stretches of one section as files of their own, after checking that no place is missing or
there twice, and one task then copies those files behind each other, a buffer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .binary_files import HEAD, MODEL, WIDTH, from_bf16, tensor_sizes, to_bf16

#: Values of a stretch.
STRETCH = 1 << 20
#: Magic number and version of debug states: fixed values of the format.
STATE = (20240327, 2)
BYTES = {"<f4": 4, "<i4": 4, "bf16": 2}


@dataclass(frozen=True)
class Section:
    name: str
    shape: tuple[int, ...]
    kind: str = "<f4"

    @property
    def values(self) -> int:
        return prod(self.shape)


@dataclass(frozen=True)
class Layout:
    sections: tuple[Section, ...]
    header: tuple[int, ...] | None = None

    @property
    def begin(self) -> int:
        return 0 if self.header is None else HEAD

    def offsets(self) -> dict[str, int]:
        out, at = {}, self.begin
        for s in self.sections:
            out[s.name] = at
            at += BYTES[s.kind] * s.values
        return out

    @property
    def size(self) -> int:
        return self.begin + sum(BYTES[s.kind] * s.values for s in self.sections)


def decoded(raw: bytes, kind: str) -> np.ndarray:
    return from_bf16(np.frombuffer(raw, "<u2")) if kind == "bf16" else np.frombuffer(raw, kind)


def encoded(values: np.ndarray, kind: str) -> bytes:
    return (to_bf16(values) if kind == "bf16" else np.asarray(values).astype(kind)).tobytes()


def header_of(uri: str) -> tuple[np.ndarray, int]:
    """The 256 integers that a file begins with, and its size."""
    import pyarrow.fs as pafs

    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        head = f.read(HEAD)
        if len(head) < HEAD:
            raise ValueError(f"{uri}: {len(head)} bytes are no header")
        return np.frombuffer(head, "<i4"), f.size()


def checked(uri: str, layout: Layout) -> None:
    """Refuses a file whose size or header isn't the layout's."""
    import pyarrow.fs as pafs

    fs, path = pafs.FileSystem.from_uri(uri)
    size = fs.get_file_info(path).size
    if size != layout.size:
        raise ValueError(f"{uri}: {size} bytes, not {layout.size}")
    if layout.header is not None:
        found = tuple(header_of(uri)[0][: len(layout.header)].tolist())
        if found != layout.header:
            raise ValueError(f"{uri}: header {found}, not {layout.header}")


def read(spark: SparkSession, uri: str, layout: Layout, only: Sequence[str] | None = None, stretch: int = STRETCH) -> DataFrame:
    """(section, idx, val) of all sections, or some."""
    checked(uri, layout)
    at = layout.offsets()
    ranges = [(s.name, s.kind, lo, min(stretch, s.values - lo), at[s.name] + BYTES[s.kind] * lo) for s in layout.sections if only is None or s.name in only for lo in range(0, s.values, stretch)]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs

        fs, path = pafs.FileSystem.from_uri(uri)
        with fs.open_input_file(path) as f:
            for batch in batches:
                for name, kind, lo, n, offset in zip(*(c.to_pylist() for c in batch.columns)):
                    f.seek(offset)
                    v = decoded(f.read(BYTES[kind] * n), kind)
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(name), n), pa.array(np.arange(lo, lo + n)), pa.array(v.astype(np.float64))], names=["section", "idx", "val"])

    rows = spark.createDataFrame(ranges, "section string, kind string, lo long, n long, offset long")
    return rows.repartition(max(1, min(len(ranges), 4096))).mapInArrow(load, "section string, idx long, val double")


def write(values: DataFrame, uri: str, layout: Layout, stretch: int = STRETCH) -> None:
    """(section, idx, val) rows as one file; a value that is missing, null, twice or out of place is an error. With arrays
    as val, a row is a run of values from idx on: no value is a row of its own."""
    if not dict(values.dtypes)["val"].startswith("array"):
        values = values.withColumn("val", F.array("val"))
    import pyarrow.fs as pafs

    spark = values.sparkSession
    order = {s.name: i for i, s in enumerate(layout.sections)}
    kinds, sizes = {s.name: s.kind for s in layout.sections}, {s.name: s.values for s in layout.sections}
    parts = f"{uri}.{uuid.uuid4().hex}.parts"
    fs, path = pafs.FileSystem.from_uri(uri)

    def one(key, t):
        name, k = key[0].as_py(), key[1].as_py()
        if name not in order:
            raise ValueError(f"no section {name}")
        t = t.sort_by("idx")
        lo, runs = k * stretch, t["val"].combine_chunks()
        ends = t["idx"].to_numpy() + runs.value_lengths().to_numpy()
        val = runs.flatten()
        whole = len(ends) and not runs.null_count and not val.null_count and np.array_equal(t["idx"].to_numpy(), [lo, *ends[:-1]])
        if not whole or lo < 0 or ends[-1] != min(lo + stretch, sizes[name]):
            raise ValueError(f"section {name}: values {lo} to {min(lo + stretch, sizes[name])} aren't all there once")
        out, folder = pafs.FileSystem.from_uri(parts)
        out.create_dir(folder, recursive=True)
        held = f"{folder}/{uuid.uuid4().hex}.tmp"
        with out.open_output_stream(held) as f:
            f.write(encoded(val.to_numpy(), kinds[name]))
        out.move(held, f"{folder}/{order[name]:06d}_{k:012d}")
        return pa.table({"section": pa.array([name]), "k": pa.array([k], pa.int64())})

    n = F.size("val")
    first_k, last_k = F.floor(F.col("idx") / stretch), F.floor((F.col("idx") + F.greatest(n, F.lit(1)) - 1) / stretch)
    inside = values.select("section", "idx", "val", F.explode(F.sequence(first_k, F.greatest(first_k, last_k))).alias("k"))
    low, high = F.greatest("idx", F.col("k") * stretch), F.least(F.col("idx") + n, (F.col("k") + 1) * stretch)
    cut = F.when((low == F.col("idx")) & (high - low == n), F.col("val")).otherwise(F.slice("val", (low - F.col("idx") + 1).cast("int"), (high - low).cast("int")))
    got = inside.select("section", "k", low.alias("idx"), cut.alias("val")).groupBy("section", "k").applyInArrow(one, "section string, k long").count()
    want = sum(-(-s.values // stretch) for s in layout.sections)
    if got != want:
        raise ValueError(f"{got} stretches of {want} are there")
    head = np.zeros(256, "<i4")
    if layout.header is not None:
        head[: len(layout.header)] = layout.header
    first = head.tobytes()[: layout.begin]

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, folder = pafs.FileSystem.from_uri(parts)
            names = sorted(i.path for i in out.get_file_info(pafs.FileSelector(folder)) if not i.path.endswith(".tmp"))
            held = f"{folder}/{uuid.uuid4().hex}.tmp"
            with out.open_output_stream(held) as f:
                f.write(first)
                for n in names:
                    with out.open_input_stream(n) as g:
                        while block := g.read(1 << 22):
                            f.write(block)
            out.move(held, pafs.FileSystem.from_uri(uri)[1])
            yield batch

    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    spark.range(1).coalesce(1).mapInArrow(together, "id long").collect()
    fs.delete_dir(pafs.FileSystem.from_uri(parts)[1])
    checked(uri, layout)


def model_layout(context: int, vocab: int, layers: int, heads: int, channels: int, padded: int, version: int = 3) -> Layout:
    """A model checkpoint: its header and tensors."""
    if version not in WIDTH:
        raise ValueError(f"model checkpoint of version {version}")
    return Layout(tuple(Section(k, (n,), WIDTH[version]) for k, n in tensor_sizes(context, padded, layers, channels).items()), (MODEL, version, context, vocab, layers, heads, channels, padded))


def state_layout(b: int, t: int, context: int, vocab: int, layers: int, channels: int, padded: int) -> Layout:
    """A debug state: inputs, targets, logits, loss and the gradients of all tensors."""
    grads = tuple(Section(f"grad.{k}", (n,)) for k, n in tensor_sizes(context, padded, layers, channels).items())
    return Layout((Section("x", (b, t), "<i4"), Section("y", (b, t), "<i4"), Section("logits", (b, t, vocab)), Section("loss", (1,)), *grads), (*STATE, b, t))


def layernorm_layout(b: int, t: int, c: int) -> Layout:
    """A layer's fixture: inputs, weights, results and gradients, without a header."""
    rows, stats, one = (b, t, c), (b, t), (c,)
    shapes = {"x": rows, "w": one, "b": one, "out": rows, "mean": stats, "rstd": stats, "dout": rows, "dx": rows, "dw": one, "db": one}
    return Layout(tuple(Section(k, s) for k, s in shapes.items()))


#: Rows of a matrix that one task reads for the export, and columns of a tile that it hands on.
TILE_ROWS, TILE_COLUMNS = 256, 256
#: Names of an exported layer's tensors, and whether their matrices are turned: fixed values of the other format.
LAYER = {"ln1w": ("ln_1.weight", False), "ln1b": ("ln_1.bias", False), "qkvw": ("attn.c_attn.weight", True), "qkvb": ("attn.c_attn.bias", False), "attprojw": ("attn.c_proj.weight", True), "attprojb": ("attn.c_proj.bias", False), "ln2w": ("ln_2.weight", False), "ln2b": ("ln_2.bias", False), "fcw": ("mlp.c_fc.weight", True), "fcb": ("mlp.c_fc.bias", False), "fcprojw": ("mlp.c_proj.weight", True), "fcprojb": ("mlp.c_proj.bias", False)}
OUTER = {"wte": ("transformer.wte.weight", "lm_head.weight"), "wpe": ("transformer.wpe.weight",), "lnfw": ("transformer.ln_f.weight",), "lnfb": ("transformer.ln_f.bias",)}


def export(spark: SparkSession, uri: str, rows: int = TILE_ROWS, columns: int = TILE_COLUMNS) -> DataFrame:
    """(name, row, values) of a model checkpoint under the names of the other format: padded words go, the word
    table counts as the last layer too, four matrices of each layer are turned. A task reads `rows` rows of a matrix;
    those of one that is turned are cut into tiles of `columns` columns, each turned by itself and sent to where its
    columns are rows: one shuffle. A vector is one row."""
    head, _ = header_of(uri)
    if head[0] != MODEL:
        raise ValueError(f"{uri}: not a model checkpoint")
    version, context, vocab, layers, heads, c, padded = head[1:8].tolist()
    layout = model_layout(context, vocab, layers, heads, c, padded, version)
    checked(uri, layout)
    kind = WIDTH[version]
    width, at = BYTES[kind], layout.offsets()
    matrices = {"qkvw": (3 * c, c), "attprojw": (c, c), "fcw": (4 * c, c), "fcprojw": (c, 4 * c)}
    vectors = {"qkvb": 3 * c, "fcb": 4 * c}
    wanted = []  # (name, turned, first row, rows, columns, rows in all, offset)

    def add(name: str, turned: bool, n: int, m: int, offset: int) -> None:
        for lo in range(0, n, rows):
            wanted.append((name, turned, lo, min(rows, n - lo), m, n, offset + width * lo * m))

    for k, names in OUTER.items():
        n = {"wte": vocab, "wpe": context}.get(k, 1)
        for name in names:
            add(name, False, n, c, at[k])
    for k, (name, turned) in LAYER.items():
        n, m = matrices.get(k, (1, vectors.get(k, c)))
        for i in range(layers):
            add(f"transformer.h.{i}.{name}", turned, n, m, at[k] + width * i * n * m)

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs

        fs, path = pafs.FileSystem.from_uri(uri)
        with fs.open_input_file(path) as f:
            for batch in batches:
                for name, turned, lo, n, m, whole, offset in zip(*(x.to_pylist() for x in batch.columns)):
                    f.seek(offset)
                    x = decoded(f.read(width * n * m), kind).astype(np.float32).reshape(n, m)
                    cut = [(j, x[:, j : j + columns].T, lo, whole) for j in range(0, m, columns)] if turned else [(lo, x, 0, m)]
                    for row, v, start, all_ in cut:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name]), pa.array([turned]), pa.array([row], pa.int64()), pa.array([v.shape[0]], pa.int64()), pa.array([start], pa.int64()), pa.array([all_], pa.int64()), pa.array([np.ascontiguousarray(v).ravel()], pa.list_(pa.float32()))],
                            names=["name", "turned", "row", "n", "start", "width", "tile"],
                        )

    def lines(key, t):
        """Rows of one band of tiles."""
        name, first = key[0].as_py(), key[1].as_py()
        n, m = t["n"][0].as_py(), t["width"][0].as_py()
        out = np.zeros((n, m), np.float32)
        for start, v in zip(t["start"].to_pylist(), t["tile"]):
            v = v.values.to_numpy().reshape(n, -1)
            out[:, start : start + v.shape[1]] = v
        return pa.table({"name": pa.array([name] * n), "row": pa.array(np.arange(first, first + n)), "values": pa.array(list(out), pa.list_(pa.float32()))})

    d = spark.createDataFrame(wanted, "name string, turned boolean, lo long, n long, m long, whole long, offset long")
    t = d.repartition(max(1, min(len(wanted), 4096))).mapInArrow(tiles, "name string, turned boolean, row long, n long, start long, width long, tile array<float>")
    cell = F.posexplode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.slice("tile", (i * F.col("width") + 1).cast("int"), F.col("width").cast("int")))).alias("i", "values")
    whole = t.where("not turned").select("name", "row", cell).select("name", (F.col("row") + F.col("i")).alias("row"), "values")
    return whole.unionByName(t.where("turned").groupBy("name", "row").applyInArrow(lines, "name string, row long, values array<float>"))
