"""Quality rules with cross-document line frequency, in DataFrame functions only.

Each line of a text is normalised (trimmed, lower case, digit runs as one 0) and hashed; a line counts
once for each distinct document of a host that has it, however many rows repeat the document. Lines
that more than `line_limit` documents of one host share are taken out as boilerplate, and a document
that keeps less than `least_share` of its words is depleted and rejected. `apply` reports verdicts with
base statistics of the whole text, `clean` returns the documents that stay with their remaining lines.

Words in 3-word windows found again are told by sorting a text's window hashes, each with its place in
64 bits; where two different windows fall on one hash, the text's windows themselves are sorted.

Defined cases: a null text has no words (base_failed). A null host is a host of its own, apart from the
empty one. Rows without a doc_id are told apart by their texts. Rows that repeat are one document in
the counts and are returned each, with equal verdicts. Other columns are ignored, whatever their names.
An empty table gives an empty result. Counts are pre-aggregated before the shuffle; the join with
frequent lines is a semi join, whose hot lines adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .graph import unused

SPACE = r"[\x20\x09-\x0D]+"
_TRIM = " \t\n\x0b\f\r"
#: Bits of a window's hash that are kept, at most; what its place needs is taken off them.
HASH = 64
#: Columns of `clean` while it runs.


def _words(text: Column) -> Column:
    t = F.btrim(text, F.lit(_TRIM))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE))


def _line(line: Column) -> Column:
    t = F.btrim(line, F.lit(_TRIM))
    return F.struct(
        F.xxhash64(F.regexp_replace(F.lower(t), "[0-9]+", "0")).alias("h"),
        F.when(t == "", 0).otherwise(F.size(F.split(t, SPACE))).alias("w"),
    )


def _again(d: DataFrame) -> DataFrame:
    """d (words, n) with again: the places of windows of three words that a text has twice or more."""
    shift = lambda way, x, n: F.call_function(way, x, n)
    word = lambda i, o: F.get("words", i + o)
    places = F.when(F.col("n") >= 3, F.sequence(F.lit(0), F.col("n") - 3)).otherwise(F.array().cast("array<int>"))
    d = d.withColumn("bits", F.greatest(F.lit(64 - HASH), F.length(F.bin(F.col("n").cast("long")))))
    d = d.withColumn("packed", F.sort_array(F.transform(places, lambda i: shift("shiftleft", F.xxhash64(word(i, 0), word(i, 1), word(i, 2)), F.col("bits")).bitwiseOR(i.cast("long")))))
    place = lambda x: x.bitwiseAND(F.bitwise_not(shift("shiftleft", F.lit(-1).cast("long"), F.col("bits")))).cast("int")
    alike = lambda x, y: F.coalesce(shift("shiftright", x, F.col("bits")) == shift("shiftright", y, F.col("bits")), F.lit(False))
    d = d.withColumn("runs", F.filter("packed", lambda x, j: alike(x, F.get("packed", j - 1)) | alike(x, F.get("packed", j + 1))))

    def differ(x: Column, y: Column) -> Column:
        i, j = place(x), place(y)
        return alike(x, y) & ((word(i, 0) != word(j, 0)) | (word(i, 1) != word(j, 1)) | (word(i, 2) != word(j, 2)))

    d = d.withColumn("clash", F.exists(F.transform("runs", lambda x, j: differ(x, F.get("runs", j + 1))), lambda x: F.coalesce(x, F.lit(False))))
    d = d.withColumn("named", F.when(F.col("clash"), F.sort_array(F.transform(places, lambda i: F.struct(F.concat_ws(" ", word(i, 0), word(i, 1), word(i, 2)).alias("g"), i.alias("i"))))))
    named = lambda x, j: F.coalesce(x["g"] == F.get("named", j)["g"], F.lit(False))
    slow = F.transform(F.filter("named", lambda x, j: named(x, j - 1) | named(x, j + 1)), lambda x: x["i"])
    return d.withColumn("again", F.sort_array(F.when(F.col("clash"), slow).otherwise(F.transform("runs", place))))


def base(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", row: Column | None = None) -> DataFrame:
    """A row for each row: row, doc_id, host and doc as keys, the base statistics, and the hashed lines."""
    row = F.monotonically_increasing_id() if row is None else row
    d = docs.select(row.alias("row"), F.col(key).alias("doc_id"), F.col(host).cast("string").alias("host"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    d = d.withColumns({"words": _words(F.col("t")), "split": F.split("t", "\n")})
    d = _again(d.withColumns({"worded": F.filter("split", lambda x: F.btrim(x, F.lit(_TRIM)) != ""), "n": F.size("words")}))
    covered = F.aggregate(F.transform("again", lambda x, j: F.least(F.lit(3), F.coalesce(F.get("again", j + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda s, x: s + x)
    return d.select(
        "row",
        "doc_id",
        F.when(F.col("host").isNull(), "").otherwise(F.concat(F.lit("="), "host")).alias("host"),
        F.when(F.col("doc_id").isNull(), F.struct(F.lit(1).alias("bare"), F.xxhash64("t").alias("id"))).otherwise(F.struct(F.lit(0).alias("bare"), F.col("doc_id").cast("long").alias("id"))).alias("doc"),
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.transform("worded", _line).alias("lines"),
    )


def _frequent(b: DataFrame, line_limit: int) -> DataFrame:
    """(row, h, w) of each line that more than line_limit documents of its host share."""
    once = b.select("host", "doc", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h")).distinct()
    often = once.groupBy("host", "h").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > line_limit).select("host", "h")
    return b.select("row", "host", F.inline("lines")).join(often, ["host", "h"], "left_semi")


def _verdicts(b: DataFrame, lines: DataFrame, least_share: float, least_words: int, most_repeated: float) -> DataFrame:
    removed = lines.groupBy("row").agg(F.sum("w").cast("long").alias("removed_words"))
    out = b.drop("lines", "host", "doc").join(removed, "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    failed = (F.col("n_words") < least_words) | (F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    depleted = F.col("n_words") - F.col("removed_words") < least_share * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def apply(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", line_limit: int = 10, least_share: float = 0.2, least_words: int = 50, most_repeated: float = 0.5) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and
    removed_words (those in lines above the limit), a row for each row."""
    b = stored(base(docs, key, text, host), "line-rules")
    out = _verdicts(b, _frequent(b, line_limit), least_share, least_words, most_repeated)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", line_limit: int = 10, least_share: float = 0.2, least_words: int = 50, most_repeated: float = 0.5) -> DataFrame:
    """The documents that `apply` keeps, all their columns, without the lines above the limit."""
    row, gone_ = unused(docs, "line_rules_row"), unused(docs, "line_rules_gone")
    keyed = stored(docs.withColumn(row, F.monotonically_increasing_id()), "line-rules-rows")
    b = stored(base(keyed, key, text, host, F.col(row)), "line-rules")
    lines = stored(_frequent(b, line_limit), "line-rules-frequent")
    kept = _verdicts(b, lines, least_share, least_words, most_repeated).where("kept").select(F.col("row").alias(row))
    gone = lines.groupBy("row").agg(F.collect_set("h").alias(gone_)).withColumnRenamed("row", row)
    rest = F.filter(F.split(text, "\n"), lambda x: ~F.coalesce(F.array_contains(gone_, _line(x)["h"]), F.lit(False)))
    return keyed.join(kept, row).join(gone, row, "left").withColumn(text, F.when(F.col(gone_).isNull(), F.col(text)).otherwise(F.array_join(rest, "\n"))).drop(row, gone_)
