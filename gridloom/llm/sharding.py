"""Sharding by extendible hashing, in DataFrame functions only.

A row's key is hashed (first 48 bits of MD5); a directory indexed by hash-prefix bits names its
bucket. A bucket splits on one more bit only while its bytes exceed the limit. Bytes are summed for
cells of a depth somewhat above what the total needs; every prefix of a cell is then summed from
these, and a cell belongs to its shortest prefix that fits. Cells that are still too large at that
depth are summed again, alone, at greater depths.

Rows that share all 48 bits can't be parted by hash: such a bucket gets overflow pages. Its rows are
dealt to groups of at most some 64 pages; in a group, rows of up to half the limit fill pages by
their running bytes, and each larger row has a page of its own (oversized if above the limit).

Defined cases: a null text has 0 bytes, a null key hashes as the empty string; repeated rows are
placed each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

BITS = 48
#: Directory cells up to which the directory is broadcast (about 60 bytes each).
SMALL = 200_000
#: Bits that a cell lies below what the total needs.
FINER = 6
#: Pages of a bucket of one hash that one task fills.
GROUP = 64


def directory(sized: DataFrame, limit: int, low: int, high: int) -> DataFrame:
    """(cell, prefix, depth, shard_bytes, fits): the bucket of each cell of `high` bits that holds
    rows, at a depth from low to high."""
    cell = sized.groupBy(F.shiftright("h", BITS - high).alias("cell")).agg(F.sum("n_bytes").alias("bytes"))
    up = cell.select("cell", "bytes", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {high} - depth)"))
    sums = up.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"))
    # ancestors hold no less, so the first prefix that fits is the bucket
    fit = F.min(F.when(F.col("shard_bytes") <= limit, F.struct("depth", "prefix", "shard_bytes")))
    whole = F.max(F.when(F.col("depth") == high, F.col("shard_bytes")))
    found = up.drop("bytes").join(sums, ["depth", "prefix"]).groupBy("cell").agg(fit.alias("b"), whole.alias("whole"))
    return found.select(
        "cell",
        F.coalesce("b.prefix", "cell").alias("prefix"),
        F.coalesce("b.depth", F.lit(high)).alias("depth"),
        F.coalesce("b.shard_bytes", "whole").alias("shard_bytes"),
        F.col("b").isNotNull().alias("fits"),
    )


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 1 << 20) -> DataFrame:
    """(doc_id, n_bytes, shard, depth, shard_bytes, page, oversized), a row for each row. shard is
    the bucket's prefix as 0s and 1s; page tells overflow pages of a bucket of one hash apart."""
    h = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")
    size = F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long")
    rest = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), size.alias("n_bytes"), h.alias("h")), "sized")
    total = rest.agg(F.sum("n_bytes")).first()[0] or 0
    low, high = 0, min(BITS, max(1, -(-total // limit)).bit_length() + FINER)
    out = None
    while True:
        cells = stored(directory(rest, limit, low, high), "directory")
        n, over = cells.agg(F.count(F.lit(1)), F.count_if(~F.col("fits"))).first()
        placed = rest.withColumn("cell", F.shiftright("h", BITS - high)).join(F.broadcast(cells) if n <= SMALL else cells, "cell")
        done = placed if high == BITS else placed.where("fits")
        out = done if out is None else out.unionByName(done)
        if over == 0 or high == BITS:
            break
        rest = stored(placed.where("not fits").select(*rest.columns), "sized")
        low, high = high + 1, min(BITS, high + 1 + FINER)
    shard = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    own = ["doc_id", "n_bytes", shard.alias("shard"), F.col("depth").cast("long").alias("depth"), "shard_bytes"]
    whole = out.where("fits").select(*own, F.lit(0).cast("long").alias("page"), F.lit(False).alias("oversized"))
    if high < BITS or over == 0:
        return whole
    groups = F.ceil(F.col("shard_bytes") / (GROUP * limit))
    full = out.where("not fits").withColumn("deal", F.pmod("row", groups)).withColumn("large", F.col("n_bytes") * 2 > limit)
    run = Window.partitionBy("prefix", "deal", "large").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    small = 2 * F.floor(F.greatest(F.sum("n_bytes").over(run) - 1, F.lit(0)) * 2 / limit)
    page = F.col("deal") * (1 << 32) + F.when(F.col("large"), 2 * F.row_number().over(run) + 1).otherwise(small)
    return whole.unionByName(full.withColumn("page", page.cast("long")).select(*own, "page", (F.col("n_bytes") > limit).alias("oversized")))
