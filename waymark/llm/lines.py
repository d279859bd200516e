"""Line dedup: hashes of lines, range-partitioned and sorted by document and position, give keep bitmaps per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.text import ascii_lower

MIN_CHARS, MIN_DOCS = 20, 3


def _lines(column: Column | str) -> Column:
    return F.split(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    return F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_hash, n_dropped, bitmap) for each document that loses lines.

    ``bitmap`` has one bit per line (1: stays; the first line is the highest bit of the first byte) and ends with the byte
    of the last line that goes.

    A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with A-Z lower-cased. The hashes of keys
    (128 bits) of at least ``min_chars`` code points are range-partitioned by (hash, salt of the document) and sorted by
    document, largest first, and position: the first document of each sorted run is its first occurrence. The runs
    of one key, as many as a shuffle has partitions at most, are then combined, so that a line of all documents is spread over
    all tasks and no text is shuffled.

    Equal (doc_id, text) rows are one document; ids are of any type that has an order, a null id counts as one id smaller than every other.
    """
    salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    line = F.posexplode(F.transform(_lines("text"), _key)).alias("pos", "key")
    found = docs.select(F.col("doc_id").alias("owner"), F.xxhash64("text").alias("text_hash"), line).where(F.char_length("key") >= min_chars)
    found = found.withColumn("key", ascii_lower("key"))
    hashed = found.select("owner", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
    salted = hashed.withColumn("salt", F.pmod(F.xxhash64("owner"), F.lit(salts)))
    ranged = salted.repartitionByRange("h1", "h2", "salt")
    run = Window.partitionBy("h1", "h2", "salt").orderBy(F.desc("owner"), "pos")
    other = (F.row_number().over(run) == 1) | ~F.lag("owner").over(run).eqNullSafe(F.col("owner"))
    seen = ranged.withColumn("new", other.cast("int"))
    runs = seen.groupBy("h1", "h2", "salt").agg(F.sum("new").alias("n"), F.max("owner").alias("first"))
    key = Window.partitionBy("h1", "h2")
    whole = runs.withColumn("docs", F.sum("n").over(key)).withColumn("keeper", F.max("first").over(key))
    repeated = whole.where(F.col("docs") >= min_docs).select("h1", "h2", "salt", "keeper")
    gone = ranged.join(repeated, ["h1", "h2", "salt"]).where(~F.col("owner").eqNullSafe(F.col("keeper")))
    bytes_ = gone.groupBy("owner", "text_hash", F.expr("pos div 8").alias("byte")).agg(F.bit_or(F.expr("shiftright(128, cast(pos % 8 as int))")).alias("bits"))
    per_doc = bytes_.groupBy("owner", "text_hash").agg(F.sort_array(F.collect_list(F.struct("byte", "bits"))).alias("bytes"))
    n_dropped = F.aggregate("bytes", F.lit(0).cast("long"), lambda n, x: n + F.bit_count(x["bits"]))
    return per_doc.select(F.col("owner").alias("doc_id"), "text_hash", n_dropped.alias("n_dropped"), _bitmap("bytes").alias("bitmap"))


def _bitmap(column: str) -> Column:
    """Bytes of a bitmap from its sorted (byte, bits that are 0), with bytes of ones between them."""
    c = F.col(column)

    def part(x: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(-1).cast("long")).otherwise(F.try_element_at(c, i)["byte"])
        return F.concat(F.repeat(F.lit("FF"), (x["byte"] - before - 1).cast("int")), F.lpad(F.hex(255 - x["bits"]), 2, "0"))

    return F.unhex(F.array_join(F.transform(c, part), ""))


def _stays(bitmap: str, i: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (i / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return (i >= 8 * F.octet_length(bitmap)) | byte.bitwiseAND(F.element_at(F.array(*[F.lit(128 >> k) for k in range(8)]), (i % 8 + 1).cast("int"))).cast("boolean")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents with their remaining lines joined by \\n, and n_lines, n_dropped and the keep bitmap (null: all stay).

    Keys of at least ``min_chars`` code points found in at least ``min_docs`` documents lose all their lines except in the
    largest doc_id holding it. A null or empty text is one empty line; a null text stays null. Rows and other
    columns stay; an input column named like an added one is replaced.
    """
    drops = keep_bitmaps(docs.select("doc_id", "text"), min_chars, min_docs).select(F.col("doc_id").alias("owner"), F.col("text_hash").alias("hash"), F.col("n_dropped").alias("dropped"), "bitmap")
    given = docs.select(*[c for c in docs.columns if c not in ("n_lines", "n_dropped", "keep_bitmap")])
    # the row as one column, so that no name of it can clash
    asked = given.select(F.struct(*[F.col(f"`{c}`") for c in given.columns]).alias("row"), F.col("doc_id").alias("asker"), F.xxhash64("text").alias("own"))
    joined = asked.join(drops, F.col("asker").eqNullSafe(F.col("owner")) & (F.col("own") == F.col("hash")), "left")
    text = F.col("row.text")
    kept = F.array_join(F.filter(_lines(text), lambda line, i: _stays("bitmap", i)), "\n")
    whole = F.coalesce(text, F.lit(""))
    n_lines = F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1
    columns = [F.when(F.col("bitmap").isNull(), text).otherwise(kept).alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in given.columns]
    return joined.select(*columns, n_lines.cast("long").alias("n_lines"), F.coalesce("dropped", F.lit(0).cast("long")).alias("n_dropped"), F.col("bitmap").alias("keep_bitmap"))
