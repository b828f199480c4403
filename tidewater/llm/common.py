"""What the operators share: written intermediate tables, skew-safe joins, Bloom filters over slots."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that the contracts call white space, U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
#: A word of the contracts, for Java and RE2 alike.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where it is unset, and driver and executors
    are one process, a folder of this machine is made and set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return str(known.get())
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tidewater-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tidewater-{spark.sparkContext.applicationId}"


#: Rows of an Arrow batch between Spark and its Python workers, where the session has Spark's own 10,000: texts are long.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_ROWS rows, if they are as large as Spark makes them by itself."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts lineage and survives lost executors.

    Results are read lazily from these tables, so they stay until release() or the owner of the folder removes them.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{own_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(table: DataFrame) -> None:
    """Removes a table made by written() that nothing will read any more."""
    spark = table.sparkSession
    for name in {f.rpartition("/")[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Removes all tables of this application; results that read them must be stored before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def without_spaces(text: Column) -> Column:
    """text without SPACES; replace() searches bytes, several times as fast as translate() or a regexp."""
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def attach(members: DataFrame, groups: DataFrame, key: str | list[str], size: str, total: int, how: str = "inner", least: int = 256) -> DataFrame:
    """members joined with groups (a written table, one row per key, its members counted in size).

    Groups above total / 4096 members are fewer than 4096, so that broadcasting them is bounded;
    no key of the remaining, shuffled join has more than a 4096th of the rows (or `least`). how: inner or left.
    """
    limit = max(least, total // 4096)
    hot = groups.filter(F.col(size) > limit)
    cold = groups.filter(F.col(size) <= limit)
    return members.join(F.broadcast(hot), key).unionByName(
        members.join(F.broadcast(hot.select(*([key] if isinstance(key, str) else key))), key, "left_anti").join(cold, key, how)
    )


def fresh(columns: list[str], name: str) -> str:
    """name, or a longer one if the columns have it (Spark does not tell capitals apart)."""
    known = {c.lower() for c in columns}
    while name.lower() in known:
        name += "_"
    return name


#: Non-empty 64-bit words of a Bloom filter that are broadcast (some 50 MB as a hashed relation); larger filters stay distributed.
FILTER_WORDS = 1 << 20
#: Bits of a filter for each key.
FILTER_BITS = 32


def filter_bits(rows: int) -> int:
    """Bits of a Bloom filter for so many keys, a power of two. They grow with the rows without an end: a filter is a table of
    its non-empty words, whose size depends on the keys alone."""
    return 1 << min(62, max(16, (rows * FILTER_BITS - 1).bit_length()))


def _bit(slot: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))


def twice_seen(rows: DataFrame, key: str, bits: int) -> DataFrame:
    """The twice-seen filter of rows[key], 64-bit hashes, as its non-empty words: (word, bits, n rows). A slot seen once goes no
    further. Slots are counted map-side first, so that a key of a third of all rows costs a row per task."""
    slot = F.col(key).bitwiseAND(F.lit(bits - 1)).alias("slot")
    seen = rows.select(slot).groupBy("slot").agg(F.count("*").alias("n")).filter("n > 1")
    return seen.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(_bit(F.col("slot"))).alias("bits"), F.sum("n").alias("n"))


def suspects(rows: DataFrame, key: str, total: int, what: str, alone: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """(rows whose hash in key may be that of another row too, the other rows; nulls are among these). Without `alone` the others
    are not made.

    Of hashes that no other row has, at most one in FILTER_BITS is suspected, at any number of rows. A filter of up to
    FILTER_WORDS words is broadcast, and no row moves. A larger one stays distributed by ranges of slots, and the
    rows, which should be hashes and ids, are sent to it (hot words by attach).
    """
    names = rows.columns
    word, mask = fresh(names, "_word"), fresh(names, "_bits")
    bits = filter_bits(total)
    words = written(twice_seen(rows.filter(F.col(key).isNotNull()), key, bits), f"{what}-filter")
    words = words.select(F.col("word").alias(word), F.col("bits").alias(mask), F.col("n").alias("n_" + word))
    slot = F.col(key).bitwiseAND(F.lit(bits - 1))
    hit = F.coalesce(F.col(mask).bitwiseAND(_bit(slot)) != 0, F.lit(False))
    marked = rows.withColumn(word, F.shiftright(slot, 6))
    if words.count() <= FILTER_WORDS:
        marked = marked.join(F.broadcast(words), word, "left")
        return marked.filter(hit).select(*names), marked.filter(~hit).select(*names)
    if not alone:
        return attach(marked, words, word, "n_" + word, total).filter(hit).select(*names), None
    found = written(attach(marked, words, word, "n_" + word, total, "left").withColumn(word, hit).select(*names, word), f"{what}-marked")
    return found.filter(word).select(*names), found.filter(~F.col(word)).select(*names)


def split_by_ids(rows: DataFrame, key: str, ids: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among ids, the other rows): a filter of up to FILTER_WORDS ids is broadcast, and nothing is shuffled.
    Of more ids there is no filter, and all rows may be among them."""
    total = ids.count()
    if total > FILTER_WORDS:
        return rows, rows.filter(F.lit(False))
    names = rows.columns
    word, mask = fresh(names, "_word"), fresh(names, "_bits")
    bits = filter_bits(total)
    slot_of = lambda c: F.xxhash64(F.col(c).cast("long")).bitwiseAND(F.lit(bits - 1))
    held = ids.select(slot_of(id_col).alias("slot")).groupBy(F.shiftright("slot", 6).alias(word)).agg(F.bit_or(_bit(F.col("slot"))).alias(mask))
    marked = rows.withColumn(word, F.shiftright(slot_of(key), 6)).join(F.broadcast(held), word, "left")
    hit = F.coalesce(F.col(mask).bitwiseAND(_bit(slot_of(key))) != 0, F.lit(False))
    return marked.filter(hit).select(*names), marked.filter(~hit).select(*names)


def likely_in(rows: DataFrame, key: str, ids: DataFrame, id_col: str) -> DataFrame:
    """rows whose key may be among ids[id_col]: all that are, and a few others."""
    return split_by_ids(rows, key, ids, id_col)[0]


def without(rows: DataFrame, key: str, ids: DataFrame, id_col: str) -> DataFrame:
    """rows whose key is none of ids; only rows that the filter doubts are shuffled. Null keys are none of them."""
    some, rest = split_by_ids(rows, key, ids, id_col)
    gone = fresh(rows.columns, "_gone")
    known = ids.select(F.col(id_col).alias(gone)).distinct()
    return rest.unionByName(some.join(known, F.col(key) == F.col(gone), "left_anti"))
