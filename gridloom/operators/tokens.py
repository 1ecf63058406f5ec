"""Token streams: shards, batches, targets and evaluation sets, over (shard, pos, tok)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .ordering import BLOCK, accumulated


def stream(docs: DataFrame, key: str, size: str, block: int = BLOCK) -> DataFrame:
    """docs with base: tokens of all documents before, in order of key (null first; a null size is 0)."""
    out = accumulated(docs, [key], sums={"base": F.col(size)}, block=block)
    return out.withColumn("base", F.col("base").cast("long")).drop("_k", "_n")


def shards_of(docs: DataFrame, key: str, size: str, shard_size: int) -> DataFrame:
    """(key, shard, start, length): pieces of documents in shards cut exactly at shard_size; what
    doesn't fit goes on in the next. Shard 0 is for validation."""
    d = stream(docs.where(F.col(size) > 0), key, size).select(key, size, "base")
    first, last = F.floor(F.col("base") / shard_size), F.floor((F.col("base") + F.col(size) - 1) / shard_size)
    p = d.withColumn("shard", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("base"), F.col("shard") * shard_size)
    hi = F.least(F.col("base") + F.col(size), (F.col("shard") + 1) * shard_size)
    return p.select(key, "shard", (lo - F.col("base")).alias("start"), (hi - lo).alias("length"))


def shard_pieces(docs: DataFrame, key: str, ids: str, shard_size: int) -> DataFrame:
    """(shard, start, ids): shards cut exactly at shard_size out of documents' arrays of ids, in order of key; start is
    a piece's place in its shard. Pieces stay arrays: no token is a row of its own. The arrays are written first, since
    numbering reads them more than once."""
    d = stream(stored(docs.select(key, ids, F.size(ids).alias("n")).where("n > 0"), "ids"), key, "n")
    shard = F.explode(F.sequence(F.floor(F.col("base") / shard_size), F.floor((F.col("base") + F.col("n") - 1) / shard_size)))
    p = d.withColumn("shard", shard)
    low = F.greatest(F.col("base"), F.col("shard") * shard_size)
    high = F.least(F.col("base") + F.col("n"), (F.col("shard") + 1) * shard_size)
    return p.select("shard", (low - F.col("shard") * shard_size).alias("start"), F.slice(ids, (low - F.col("base") + 1).cast("int"), (high - low).cast("int")).alias("ids"))


def next_token(tokens: DataFrame) -> DataFrame:
    return tokens.withColumn("target", F.lead("tok").over(Window.partitionBy("shard").orderBy("pos")))


def batches(tokens: DataFrame, sizes: DataFrame, b: int, t: int, ranks: int = 1, rank: int = 0) -> DataFrame:
    """(shard, step, row, t, input, target): B x T windows of a shard for one rank; what is left
    after the last whole step of all ranks is dropped. sizes: (shard, n) tokens."""
    step = b * t * ranks
    d = tokens.join(sizes, "shard")
    at = F.col("pos") - rank * b * t
    with_target = next_token(d)
    at_ok = (at >= 0) & (at % step < b * t) & (F.floor(F.col("pos") / step) < F.floor((F.col("n") - 1) / step))
    inside = at % step
    return with_target.where(at_ok).select("shard", F.floor(at / step).alias("step"), F.floor(inside / t).alias("row"), (inside % t).alias("t"), F.col("tok").alias("input"), "target")


def head_split(tokens: DataFrame, n: int) -> DataFrame:
    """split: the first n tokens validate."""
    return tokens.withColumn("split", F.when(F.col("pos") < n, "val").otherwise("train"))


def out_of_range(tokens: DataFrame, vocabulary: int) -> DataFrame:
    return tokens.where((F.col("tok") < 0) | (F.col("tok") >= vocabulary))


def sections(text: Column) -> Column:
    """Parts between empty lines; all but the last keep the empty line."""
    parts = F.split(text, "\n\n")
    return F.transform(parts, lambda x, i: F.when(i < F.size(parts) - 1, F.concat(x, F.lit("\n\n"))).otherwise(x))


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """place: a seeded order by hash within a shard."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed) + F.col("shard"), key), key)).cast("long"))


def example_losses(losses: DataFrame) -> DataFrame:
    """(idx, label, pick_norm, pick_sum): per example the completion of least mean and of least total
    loss at masked positions, the first of equals; a completion without any has loss 0."""
    c = losses.groupBy("idx", "label", "choice").agg(F.coalesce(F.avg(F.when(F.col("mask"), F.col("loss"))), F.lit(0.0)).alias("norm"), F.coalesce(F.sum(F.when(F.col("mask"), F.col("loss"))), F.lit(0.0)).alias("sum"))
    pick = lambda v: F.min(F.struct(v, "choice"))["choice"]
    return c.groupBy("idx", "label").agg(pick("norm").alias("pick_norm"), pick("sum").alias("pick_sum"))


def enough(sizes: DataFrame, b: int, t: int, ranks: int) -> DataFrame:
    """sizes (shard, n) with enough: whether a shard has one batch of all ranks and a target for its last token."""
    return sizes.withColumn("enough", F.col("n") >= b * t * ranks + 1)


class MersenneTwister:
    """MT19937 with a modulo-biased Fisher-Yates shuffle, as the loaders' permutations need."""

    def __init__(self, seed: int):
        self.s, self.i = [seed & 0xFFFFFFFF], 624
        for k in range(1, 624):
            self.s.append((1812433253 * (self.s[-1] ^ (self.s[-1] >> 30)) + k) & 0xFFFFFFFF)

    def u32(self) -> int:
        if self.i == 624:
            for k in range(624):
                y = (self.s[k] & 0x80000000) | (self.s[(k + 1) % 624] & 0x7FFFFFFF)
                self.s[k] = self.s[(k + 397) % 624] ^ (y >> 1) ^ (0x9908B0DF if y & 1 else 0)
            self.i = 0
        y = self.s[self.i]
        self.i += 1
        y ^= y >> 11
        y ^= (y << 7) & 0x9D2C5680
        y ^= (y << 15) & 0xEFC60000
        return y ^ (y >> 18)

    def permutation(self, n: int) -> list[int]:
        return self.shuffled(range(n))

    def shuffled(self, p) -> list[int]:
        p = list(p)
        for i in range(len(p) - 1, 0, -1):
            j = self.u32() % (i + 1)
            p[i], p[j] = p[j], p[i]
        return p


def byte_tokens(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, tok): a text's bytes as ids below 256; 256 ends a text."""
    hexed = F.hex(F.encode(F.col(text), "UTF-8"))
    n = F.octet_length(text)
    ids = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.conv(F.substring(hexed, 2 * i + 1, F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.concat(F.array(F.lit(256).cast("long")), ids)).alias("pos", "tok"))


def word_tokens(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, tok): words as their places in the ordered vocabulary of docs; its size ends a text."""
    d = docs.where(F.col(text).isNotNull())
    w = d.select(key, F.posexplode(F.split(text, " ")).alias("pos", "w")).where("w <> ''")
    vocabulary = accumulated(w.select("w").distinct(), [F.encode("w", "UTF-8")]).select("w", F.col("_k").alias("tok"))
    size = vocabulary.agg(F.count(F.lit(1)).alias("tok"))
    ends = d.select(key, F.lit(0).alias("pos")).crossJoin(F.broadcast(size))  # one row
    return w.join(vocabulary, "w").select(key, (F.col("pos") + 1).alias("pos"), "tok").unionByName(ends)


#: Tokenizers by the name that a model's descriptor gives: each puts the end of a text before every text.
TOKENIZERS = {"bytes": byte_tokens, "words": word_tokens}


def tokenised(docs: DataFrame, key: str, text: str, model: str) -> DataFrame:
    return TOKENIZERS[model](docs, key, text)
