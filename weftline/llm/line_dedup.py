"""Line dedup: a suffix array over line-id sequences by distributed prefix doubling.

Only lines that occur more than once take part, in stretches of consecutive such lines within a document (lines without words
are passed over). A suffix is a position of a stretch. Ranks of suffixes by their first line, then by 2, 4, ...
lines come from sorting pairs (rank at p, rank at p + 2^k) across range partitions; they preserve order, so suffixes
that share a prefix are consecutive. Every suffix has a head: the fewest lines that hold ``MIN_WORDS`` words.
Suffixes with the same head form an interval of the array in which adjacent longest common prefixes reach that many
words. Within an interval, every prefix from the head on (up to as many lines after it as hold fewer words than that in
all: a longer run is found again at a later suffix) stays where it occurs first, by doc_id, then line. A suffix loses the lines of its
longest prefix that occurs before it, wherever that is; ranks beyond the longest head are not needed.

DataFrame operations only. No task holds an interval or a line's occurrences: copies of one rank count once in the array,
and joins are by keys that skew handling can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import Saved, saved, text_of

MIN_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"
DOC = ["doc", "text_hash"]


def _keyed(documents: DataFrame) -> DataFrame:
    """With the key of a document: its id (null: last) and its text's hash."""
    return documents.withColumns({"doc": F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), "text_hash": F.xxhash64(text_of())})


def _lines(documents: DataFrame) -> DataFrame:
    """doc, text_hash, pos (among lines with words), line, h, c, words."""
    one = lambda x, i: F.struct(i.alias("line"), F.xxhash64(x).alias("h"), F.crc32(x.cast("binary")).alias("c"), F.regexp_count(x, F.lit(WORD)).alias("words"))
    lines = F.filter(F.transform(F.split(text_of(), "\n"), one), lambda x: x["words"] > 0)
    return _keyed(documents.select("doc_id", "text")).select(*DOC, F.posexplode(lines).alias("pos", "x")).select(*DOC, "pos", "x.*")


def _ranked(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with a column ``name``: an integer that orders as the keys do, equal for equal keys."""
    ordered = rows.select(*keys).distinct().repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranks = saved(ordered.withColumn(name, F.monotonically_increasing_id()), "ranks")
    on = [rows[k].eqNullSafe(ranks[k]) for k in keys]
    return rows.join(ranks, on).select(*[rows[c] for c in rows.columns], ranks[name])


def _reach(ahead: Column, min_words: int) -> Column:
    """head: lines up to min_words words; n: with the lines after it that hold fewer words than that in all."""

    def step(a: Column, x: Column) -> Column:
        inside = a["words"] < min_words
        more = ~inside & ~a["over"] & (a["after"] + x["words"] < min_words)
        return F.struct(
            F.when(inside, a["words"] + x["words"]).otherwise(a["words"]).alias("words"),
            F.when(inside, a["head"] + 1).otherwise(a["head"]).alias("head"),
            F.when(more, a["after"] + x["words"]).otherwise(a["after"]).alias("after"),
            F.when(inside | more, a["n"] + 1).otherwise(a["n"]).alias("n"),
            (a["over"] | ~(inside | more)).alias("over"),
        )

    zero = F.struct(*(F.lit(0).alias(k) for k in ("words", "head", "after", "n")), F.lit(False).alias("over"))
    return F.aggregate(ahead, zero, step)


def suffixes(documents: DataFrame, min_words: int) -> Saved:
    """doc, text_hash, grp, pos, line, r (rank by first line), lines, head, ids: suffixes with a whole head."""
    lines = _lines(documents)
    # written, so that the join with all lines is one whose crowded lines Spark can split
    often = saved(lines.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "c"), "often")
    hits = lines.join(often, ["h", "c"], "left_semi").dropDuplicates([*DOC, "pos"])
    hits = hits.withColumn("grp", F.col("pos") - F.row_number().over(Window.partitionBy(*DOC).orderBy("pos")))
    total = F.sum("words").over(Window.partitionBy(*DOC, "grp"))
    hits = Saved(hits.withColumn("total", total).where(F.col("total") >= min_words).drop("total"), "hits").read()
    rows = _ranked(hits, ["h", "c"], "r")
    frame = Window.partitionBy(*DOC, "grp").orderBy("pos").rowsBetween(0, 2 * min_words)
    ahead = F.collect_list(F.struct("r", "words", "line")).over(frame)
    rows = rows.withColumn("ahead", ahead).withColumn("reach", _reach(F.col("ahead"), min_words))
    kept = F.slice("ahead", 1, F.col("reach.n"))
    return Saved(rows.select(*DOC, "grp", "pos", "r", F.when(F.col("reach.words") >= min_words, F.col("reach.head")).alias("head"), F.transform(kept, lambda x: x["r"]).alias("ids"), F.transform(kept, lambda x: x["line"]).alias("lines")), "suffixes")


def doubled(rows: Saved) -> Saved:
    """Ranks by as many lines as the longest head has."""
    longest = rows.read().agg(F.max("head")).first()[0] or 1
    length = 1
    while length < longest:
        ahead = F.lead("a", length).over(Window.partitionBy(*DOC, "grp").orderBy("pos"))
        pairs = _ranked(rows.read().withColumnRenamed("r", "a").withColumn("b", ahead), ["a", "b"], "r").drop("a", "b")
        done = Saved(pairs, "suffixes")
        rows.drop()
        rows, length = done, 2 * length
    return rows


def intervals(rows: DataFrame) -> DataFrame:
    """r, interval: the rank of the first suffix of the array with the same head."""
    heads = rows.where("head IS NOT NULL").groupBy("r").agg(F.first(F.slice("ids", 1, F.col("head"))).alias("own"))
    array = saved(heads.repartitionByRange("r").withColumn("part", F.spark_partition_id()), "array")
    inside = Window.partitionBy("part").orderBy("r")
    parts = array.groupBy("part").agg(F.max_by("own", "r").alias("last"))  # a row for each range partition
    parts = parts.select("part", F.lag("last").over(Window.orderBy("part")).alias("before"))
    marked = array.join(F.broadcast(parts), "part").withColumn("previous", F.coalesce(F.lag("own").over(inside), F.col("before")))
    begun = F.when(F.col("previous").isNull() | (F.col("previous") != F.col("own")), F.col("r"))
    marked = saved(marked.select("part", "r", begun.alias("begun")), "intervals")
    ends = marked.groupBy("part").agg(F.max("begun").alias("open"))
    ends = ends.select("part", F.last("open", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("open"))
    own = F.last("begun", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("own", own).join(F.broadcast(ends), "part").select("r", F.coalesce("own", "open").alias("interval"))


def repeated_lines(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc, text_hash, removed (sorted line numbers from 0): the lines that later copies lose."""
    rows = doubled(suffixes(documents, min_words)).read().where("head IS NOT NULL")
    own = F.struct(*DOC, "pos")
    placed = saved(rows.join(intervals(rows), "r").select(*DOC, "pos", "head", "ids", "lines", "interval"), "placed")
    many = saved(placed.groupBy("interval").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("interval"), "shared")
    lengths = placed.join(many, "interval").withColumn("n", F.explode(F.sequence("head", F.size("ids"))))
    prefixes = saved(lengths.select(*DOC, "pos", "interval", "n", F.slice("ids", F.col("head") + 1, F.col("n") - F.col("head")).alias("rest"), F.slice("lines", 1, F.col("n")).alias("lines")), "prefixes")
    firsts = prefixes.groupBy("interval", "rest").agg(F.count(F.lit(1)).alias("m"), F.min(own).alias("first")).where("m > 1").drop("m")
    later = prefixes.join(saved(firsts, "firsts"), ["interval", "rest"]).where(own != F.col("first"))
    longest = later.groupBy(*DOC, "pos").agg(F.max_by("lines", "n").alias("lines"))
    gone = longest.select(*DOC, F.explode("lines").alias("line")).distinct()
    return gone.groupBy(*DOC).agg(F.sort_array(F.collect_list("line")).alias("removed"))


def dedup_lines(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every row of ``documents`` as ``row`` (all its columns), with text (what is left), n_lines, removed (line numbers).

    A repeated run of ``min_words`` words or more stays where it occurs first, in doc_id order. Null texts stay null and
    lose nothing; equal rows (same doc_id and text) are one document and get one result; a null doc_id comes last;
    an empty table gives no rows; other columns, whatever their names, stay in ``row``.
    """
    gone = repeated_lines(documents, min_words)
    rows = documents.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64(text_of()).alias("text_hash"))
    rows = rows.join(gone, DOC, "left")
    lines = F.split(F.col("row.text"), "\n")
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("removed", i)), "\n")
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(left)
    return rows.select("row", text.alias("text"), F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))
