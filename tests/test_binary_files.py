import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.sources import binary_files as b


def test_examples_round_trip():
    x = [b.Example(2, [1, 2, 3], [[4], [], [5, 6], [7]]), b.Example(0, [], [[9]] * 4)]
    data = b.encode_examples(x)
    assert b.decode_examples(data) == x
    words = np.frombuffer(data[b.HEAD :], "<u2")
    assert words[:9].tolist() == [65535, 34, 0, 2, 4, 3, 1, 2, 3]  # 17 words
    for broken in (data[:-2], data[: b.HEAD] + b"\0" * 40, b"\0" * 2000):
        with pytest.raises(ValueError):
            b.decode_examples(broken)
    with pytest.raises(ValueError):
        b.encode_examples([b.Example(0, [65535], [[1]])])


def test_tokenizer_round_trip():
    pieces = [bytes([i]) for i in range(1, 200)] + [b"\xff\xfe", b"the"]
    assert b.decode_tokenizer(b.encode_tokenizer(pieces, 5)) == (pieces, 5)
    with pytest.raises(ValueError):
        b.decode_tokenizer(b.encode_tokenizer(pieces, 5)[:-1])
    assert b.printable(b"a") and b.printable(b"\n") and not b.printable(b"\x01") and b.printable(b"\x01\x02") and not b.printable(b"")


def test_bf16_is_nearest_even():
    x = np.array([1.0, 1.00390625, 1.01171875, -3.0, 0.0], np.float32)
    assert b.from_bf16(b.to_bf16(x)).tolist() == [1.0, 1.0, 1.015625, -3.0, 0.0]


@pytest.mark.parametrize("version", [3, 5])
def test_checkpoint_round_trip(spark, tmp_path, version):
    sizes = b.tensor_sizes(4, 16, 1, 8)
    values = np.arange(sum(sizes.values()), dtype=np.float32) % 128
    p = tmp_path / "model.bin"
    p.write_bytes(b.encode_checkpoint(values, 4, 11, 1, 2, 8, 16, version))
    got = b.read_checkpoint(spark, f"file://{p}", chunk=100)
    total = {r.tensor: (r.n, r.s) for r in got.groupBy("tensor").agg(F.count("*").alias("n"), F.sum("val").alias("s")).collect()}
    at = 0
    for name, n in sizes.items():
        assert total[name] == (n, float(values[at : at + n].sum()))
        at += n
    p.write_bytes(p.read_bytes()[:-4])
    with pytest.raises(ValueError):
        b.read_checkpoint(spark, f"file://{p}")
