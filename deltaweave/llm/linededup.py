"""Line deduplication with DataFrame operations only: common lines go from every document.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends and with A-Z lower-cased. Hashes of the keys are
range-partitioned by (hash, document) and sorted by document and position, so that a key that a third of all lines
share lies over many partitions; the first occurrences in a document stream by and are counted, combined before
the second shuffle. What comes back for a document is a bitmap of lines to keep, 64 lines a number, not text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, texts, written

SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Common keys, of 12 bytes, that are broadcast at most; more are joined by a shuffle.
BROADCAST_KEYS = 500_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return texts(docs, id_col, text_col).withColumn("seal", F.xxhash64("text"))


def _bit(bitmap: str, i: Column) -> Column:
    """Whether bit i of an array of longs is 1."""
    return F.element_at(bitmap, F.shiftright(i, 6) + 1).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i % 64)) != 0


def keep_bitmaps(docs: DataFrame, *, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document (doc_id, seal): ``keep``, an array of longs; bit i % 64 of number i div 64 is 1 if line i stays.

    Keys of at least ``min_chars`` code points found in at least ``min_docs`` documents lose all their lines. Null and
    empty texts are one empty line, which always stays. Repeated rows (same id, same text) are one document;
    ``seal``, a hash of the text, tells rows of one id with other texts apart. A null id is an id like any other.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    rows = written(  # texts are split and hashed once; the range sample, the sort and the bitmaps read the hashes
        _documents(docs, id_col, text_col)
        .select("doc_id", "seal", F.posexplode(_lines(F.col("text"))).alias("at", "line"))
        .select("doc_id", "seal", "at", _key(F.col("line")).alias("key"))
        .select("doc_id", "seal", "at", F.xxhash64("key").alias("h"), F.hash("key").alias("g"), (F.char_length("key") >= max(1, min_chars)).alias("counts")),
        "line-hashes",
    )
    sorted_rows = rows.where("counts").select("h", "g", "doc_id", "at").repartitionByRange(n, "h", "g", "doc_id").sortWithinPartitions("h", "g", "doc_id", "at")
    first = F.row_number().over(Window.partitionBy("h", "g", "doc_id").orderBy("at")) == 1
    common = written(
        sorted_rows.withColumn("first", first).where("first").groupBy("h", "g").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs).select("h", "g", F.lit(True).alias("common")),
        "common-lines",
    )
    if common.count() <= BROADCAST_KEYS:
        common = F.broadcast(common)
    stays = F.coalesce(~(F.col("counts") & F.col("common")), F.lit(True)).cast("long")
    return (
        rows.join(common, ["h", "g"], "left")
        .select("doc_id", "seal", F.expr("at div 64").alias("w"), F.expr("cast(at % 64 as int)").alias("bit"), stays.alias("stays"))
        .groupBy("doc_id", "seal", "w")
        .agg(F.bit_or(F.expr("shiftleft(stays, bit)")).alias("bits"))
        .groupBy("doc_id", "seal")
        .agg(F.sort_array(F.collect_list(F.struct("w", "bits"))).getField("bits").alias("keep"))
    )


def drop_common_lines(docs: DataFrame, *, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``text_col`` less its common lines, and columns ``__n_lines`` and ``__n_dropped``.

    Other columns pass through. The text of a document of which no line stays is empty. An empty table gives an
    empty table.
    """
    bitmaps = keep_bitmaps(docs, min_docs=min_docs, min_chars=min_chars, id_col=id_col, text_col=text_col).select(F.col("doc_id").alias("__id"), F.col("seal").alias("__seal"), F.col("keep").alias("__keep"))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    joined = docs.join(bitmaps, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__seal")), "left")
    return (
        joined.withColumn("__lines", _lines(text))
        .withColumn(text_col, F.array_join(F.filter("__lines", lambda _, i: _bit("__keep", i)), "\n"))
        .withColumn("__n_lines", F.size("__lines").cast("long"))
        .withColumn("__n_dropped", (F.size("__lines") - F.aggregate("__keep", F.lit(0), lambda a, b: a + F.bit_count(b))).cast("long"))
        .drop("__id", "__seal", "__keep", "__lines")
    )


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_common_lines(docs).select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(c.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key GROUP BY k.doc_id
"""
