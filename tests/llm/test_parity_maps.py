"""Parity maps rule out no pair of sets that is within the limit, and most pairs that are far beyond."""

import numpy as np
import pyarrow as pa

from gridloom.llm import ngram_jaccard as j


def _kept(a, b, slack):
    cells = j._cells(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    names = ["a", "b", "na", "nb", "ca", "cb", "ka", "kb"]
    row = [pa.array([v]) for v in (1, 2, len(a), len(b))] + [pa.array([c], pa.binary()) for c in cells] + [pa.array([v]) for v in (1, 2)]
    return next(j._possible(slack)([pa.RecordBatch.from_arrays(row, names=names)])).num_rows == 1


def test_no_pair_within_the_limit_is_ruled_out():
    rng = np.random.default_rng(1)
    for n in [1, 2, 3, 4, 5, 7, 8, 9, 16, 17, *rng.integers(10, 3000, 300).tolist()]:
        x = rng.integers(0, 1 << 63, 2 * n, dtype=np.int64).astype(np.uint64)
        shared = int(n * rng.choice([0.5, 0.7, 0.85, 0.9, 0.95, 1.0]))
        a, b = np.unique(x[:n]), np.unique(np.concatenate([x[:shared], x[n : n + int(rng.integers(0, n - shared + 1))]]))
        if not len(b):
            continue
        differ = len(np.setxor1d(a, b))
        for slack in (1, 3):
            if 9 * differ <= slack * (len(a) + len(b)):
                assert _kept(a, b, slack), (n, shared, slack)


def test_unrelated_sets_of_like_size_are_ruled_out():
    rng = np.random.default_rng(2)
    for n in (65, 127, 128, 129, 700, 1000, 1024, 3000):
        x = np.unique(rng.integers(0, 1 << 63, 2 * n, dtype=np.int64).astype(np.uint64))
        rng.shuffle(x)
        a, b = np.sort(x[:n]), np.sort(x[n:])
        assert not _kept(a, b, 1) and not _kept(a, b, 3), n
