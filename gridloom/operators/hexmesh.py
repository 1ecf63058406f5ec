"""Geometry of hexahedra, as column expressions over eight corners' coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def gather(corners: DataFrame, nodes: DataFrame, columns: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """(e, x, y, z): arrays of the eight corners' values in corner order."""
    j = corners.join(nodes.select("n", *columns), "n")
    g = j.groupBy("e").agg(F.sort_array(F.collect_list(F.struct("c", *columns))).alias("k"))  # eight each
    return g.select("e", *[F.col("k")[c].alias(c) for c in columns])


def corner(i: int) -> Vec:
    return tuple(F.col(c)[i] for c in ("x", "y", "z"))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b))


def add(a: Vec, b: Vec) -> Vec:
    return tuple(p + q for p, q in zip(a, b))


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def volume() -> Column:
    """Volume of a hexahedron with faces that may be bent: twelfths of three triple products."""
    c = [corner(i) for i in range(8)]
    triple = lambda a, b, d: dot(a, cross(b, d))
    d = lambda i, j: sub(c[i], c[j])
    return (
        triple(add(d(3, 1), d(7, 2)), d(6, 3), d(2, 0))
        + triple(add(d(4, 3), d(5, 7)), d(6, 4), d(7, 0))
        + triple(add(d(1, 4), d(2, 5)), d(6, 1), d(5, 0))
    ) / 12.0


#: Corners of the six faces.
FACES = ((0, 1, 2, 3), (4, 5, 6, 7), (0, 1, 5, 4), (1, 2, 6, 5), (2, 3, 7, 6), (3, 0, 4, 7))


def face_area(a: int, b: int, c: int, d: int) -> Column:
    """16 times the squared area of a face, from its diagonals' sum and difference."""
    p, q, r, s = map(corner, (a, b, c, d))
    f = sub(sub(r, p), sub(s, q))
    g = add(sub(r, p), sub(s, q))
    return dot(f, f) * dot(g, g) - dot(f, g) * dot(f, g)


def characteristic_length(vol: Column) -> Column:
    return 4.0 * vol / F.sqrt(F.greatest(*[face_area(*f) for f in FACES]))


def nodal_mass(corners: DataFrame, volumes: DataFrame) -> DataFrame:
    """(n, mass): an eighth of each element's volume at its corners."""
    return corners.join(volumes.select("e", "volume"), "e").groupBy("n").agg((F.sum("volume") / 8).alias("mass"))
