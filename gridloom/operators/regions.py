"""Material regions of elements, in runs of random length drawn as the C library's generator draws them.

A domain's elements are dealt to regions in runs: a region by weight (its number to the power of `balance`), never the same
twice in a row, and a length from a skewed distribution. All domains use one seed, and a domain's regions are
those of the first one turned by its number; so one table of a domain's places serves all of them, whatever the rows
number, and it has DOMAIN rows at most.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import BLOCK, accumulated

#: Elements of a domain.
DOMAIN = 1 << 17
#: A draw below the first number (of 1,000) gives `most` lengths from `least` on: fixed values of the distribution.
LENGTHS = ((773, 1, 15), (937, 16, 16), (970, 32, 32), (974, 64, 64), (978, 128, 128), (981, 256, 256), (1000, 512, 1537))


def draws(seed: int) -> Iterator[int]:
    """The additive-feedback generator of the C library: x[n] = x[n-3] + x[n-31], the lowest bit dropped."""
    x = [seed or 1]
    while len(x) < 31:
        x.append(16807 * x[-1] % 2147483647)
    x += x[:3]
    n = 34
    while True:
        x.append((x[-31] + x[-3]) & 0xFFFFFFFF)
        x = x[-31:]
        n += 1
        if n > 344:
            yield x[-1] >> 1


def runs(n: int, regions: int, balance: int = 1, seed: int = 0) -> list[tuple[int, int]]:
    """(region from 0, elements) of the first domain's runs, which cover n elements."""
    if regions == 1:
        return [(0, n)] if n else []
    g, bounds = draws(seed), list(accumulate((i + 1) ** balance for i in range(regions)))
    out, left, last = [], n, None
    while left > 0:
        region = last
        while region == last:
            region = bisect_right(bounds, next(g) % bounds[-1])
        kind = next(g) % 1000
        _, least, most = next(x for x in LENGTHS if kind < x[0])
        length = min(left, least + next(g) % most)
        out.append((region, length))
        left, last = left - length, region
    return out


def assigned(elements: DataFrame, order: str, regions: int = 11, balance: int = 1, domain: int = DOMAIN, block: int = BLOCK) -> DataFrame:
    """elements with domain, element (its place there, in order) and region from 1."""
    spark = elements.sparkSession
    d = accumulated(elements, [order], block=block).withColumn("domain", F.floor(F.col("_k") / domain)).withColumn("element", F.col("_k") % domain)
    start, rows = 0, []
    for region, length in runs(domain, regions, balance):
        rows.append((start, start + length - 1, region))
        start += length
    places = spark.createDataFrame(rows, "low long, high long, first long").select(F.explode(F.sequence("low", "high")).alias("element"), "first")
    out = d.join(F.broadcast(places), "element")  # DOMAIN rows at most
    return out.select(*elements.columns, "domain", "element", ((F.col("first") + F.col("domain")) % regions + 1).alias("region"))
