"""Exact duplicates by a stateful stream whose state lives on disk (RocksDB) and never expires.

Digests of normalised texts are a stream of (digest, id, row, locator). Its state keeps for each digest the
smallest (doc_id, arrival, row) - the stable identifier of the row that stays -, the row that came first
with its content locator (the file that holds it), and the number of rows. Rows are combined before the
shuffle, so a text that makes up a third of the corpus is a handful of state updates.

With a `state` folder the stream goes on where it ended: each call is one arrival of documents, and only its
rows are read. Every hit is then checked on full bytes, within the arrival and against the row that came
first, which is fetched by its locator; were a digest ever shared by different texts, those rows would be
regrouped by text.

Texts are equal when identical after each run of [\\x20\\x09-\\x0D] is replaced by one space.

Defined results: null is the empty text; of equal texts the smallest doc_id stays, of rows that repeat it too
the first written; a null doc_id sorts last; over several arrivals group_size counts all rows so far, and
`kept` is about the rows of the arrival (a smaller id that comes later takes over, the earlier verdict
stands); after a digest collision a group counts the arrival's rows and the one that came first. Extra
columns are ignored; an empty table gives an empty one. Documents that aren't read from Parquet files are
copied to the state folder, so that a later arrival can be checked against them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import columns_of, fresh, new_path, prepare, settle
from .sieve import Sieve

#: State on disk, with bounded memory, and without fallocate, which would reserve megabytes for each partition however little it holds.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "100",
}
_ROW = "doc_id long, digest binary, check long, row long, locator string"


def normalised(text):
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest_of(body):
    return F.unhex(F.sha2(body, 256))


def _numbers(spark, path: str) -> list[int]:
    """The numbers n of the folders key=n under path."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return []
    return sorted(int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(target) if "=" in x.getPath().getName())


def _groups(spark, folder: str) -> DataFrame:
    """digest, keep, first, group_size of every digest of the arrivals that the stream hasn't read yet."""
    before = {key: spark.conf.get(key, None) for key in _STATE}
    done = set(_numbers(spark, f"{folder}/groups"))
    for key, value in _STATE.items():
        spark.conf.set(key, value)
    try:
        rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "arrival", "row")
        stream = (
            spark.readStream.schema(f"{_ROW}, arrival int")
            .parquet(f"{folder}/arrivals")
            .groupBy("digest")
            .agg(F.min(rank).alias("keep"), F.min(F.struct("arrival", "row", "locator")).alias("first"), F.count(F.lit(1)).alias("group_size"))
        )

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/groups/batch={number}")

        query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/log").foreachBatch(write).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    new = [n for n in _numbers(spark, f"{folder}/groups") if n not in done]
    if not new:
        return spark.createDataFrame([], stream.schema)  # no row, no batch
    found = spark.read.schema(stream.schema).parquet(*(f"{folder}/groups/batch={n}" for n in new))
    if len(new) == 1:
        return found
    # a digest that several batches updated: rows only add up
    return found.groupBy("digest").agg(F.min("keep").alias("keep"), F.min("first").alias("first"), F.max("group_size").alias("group_size"))


def exact_duplicates(docs: DataFrame, state: str | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, row."""
    spark = prepare(docs.sparkSession)
    folder = state or new_path(spark, "exact")
    arrival = max(_numbers(spark, f"{folder}/arrivals"), default=-1) + 1
    if state and not (files := docs.inputFiles()) or state and not all(f.endswith(".parquet") for f in files):
        copy = f"{folder}/content/arrival={arrival}"
        docs.select("doc_id", "text").write.parquet(copy)
        docs = spark.read.parquet(copy)
    body = normalised(F.col("text"))
    arrived = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), digest_of(body).alias("digest"), F.xxhash64(body).alias("check"),
        F.monotonically_increasing_id().alias("row"), F.input_file_name().alias("locator"),
    )
    own = f"{folder}/arrivals/arrival={arrival}"
    arrived.write.parquet(own)
    digests = spark.read.schema(_ROW).parquet(own)
    hits = settle(_groups(spark, folder).where(F.col("group_size") > 1), "hits")
    keep = F.when(F.col("keep.arrival") == arrival, F.col("keep.row")).otherwise(F.lit(-1))
    joined = digests.select("digest", "check", "doc_id", "row").join(hits.withColumn("keep_row", keep), "digest", "left").select(
        "doc_id", "row", "digest", "check", F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("keep_row", "row").alias("keep_row"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
    )
    joined = settle(_checked(docs, joined, hits, arrival), "grouped")
    return joined.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "row")


def _checked(docs: DataFrame, grouped: DataFrame, hits: DataFrame, arrival: int) -> DataFrame:
    """grouped, if all texts of each hit's digest are the same bytes; else with those digests' rows grouped by text.

    The least and the greatest text of a digest are combined before the shuffle, so that a large group costs
    as much as a small one.
    """
    spark = docs.sparkSession
    sieve = Sieve(hits, "digest")

    def bodies(rows: DataFrame, wanted: DataFrame) -> DataFrame:
        """What the sieve lets through besides is a digest of one row, which does no harm."""
        texts = rows.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("body"))
        return sieve.maybe(texts.select("doc_id", digest_of(F.col("body")).alias("digest"), "body"), "digest")

    found = bodies(docs, hits)
    earlier = hits.where(F.col("first.arrival") < arrival)
    # as many paths at most as the earlier arrivals had files
    files = [r[0] for r in earlier.select("first.locator").distinct().collect()]
    if files:
        fetched = bodies(spark.read.parquet(*files).select("doc_id", "text"), earlier)
        found = found.unionByName(fetched.join(earlier.select("digest"), "digest", "left_semi").dropDuplicates(["digest", "body"]).select(*found.columns))
    shared = found.groupBy("digest").agg(F.min("body").alias("x"), F.max("body").alias("y")).where(F.col("x") != F.col("y"))
    shared = settle(shared.select("digest"), "collisions")
    if shared.isEmpty():
        return grouped
    rows = found.join(shared, "digest", "left_semi").withColumn("check", F.xxhash64("body"))
    by_text = rows.groupBy("digest", "body").agg(F.first("check").alias("check"), F.min("doc_id").alias("k"), F.count(F.lit(1)).alias("n"))
    by_text = by_text.select("digest", "check", "k", "n")
    wrong = grouped.join(shared, "digest", "left_semi").select("doc_id", "row", "digest", "check").join(by_text, ["digest", "check"])
    first = F.min(F.when(F.col("doc_id").eqNullSafe(F.col("k")), F.col("row"))).over(Window.partitionBy("digest", "check"))
    fixed = wrong.select("doc_id", "row", "digest", "check", F.col("k").alias("keep_id"), F.coalesce(first, F.lit(-1)).alias("keep_row"), F.col("n").alias("group_size"))
    return grouped.join(shared, "digest", "left_anti").unionByName(fixed)


def without_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts, and its columns as they are."""
    digest, place = fresh(docs, "digest"), fresh(docs, "place")
    at = lambda i, d: F.coalesce(i, F.xxhash64(d))  # noqa: E731  rows without an id go by their text
    found = settle(exact_duplicates(docs).select("doc_id", "kept", F.unhex("text_sha256").alias("digest")), "duplicates")
    found = found.select(at(F.col("doc_id"), F.col("digest")).alias("place"), "digest", "kept")
    touched = settle(found.where(~F.col("kept")).select("place").distinct(), "touched")
    own = digest_of(normalised(F.col("text")))
    marked = docs.select(*columns_of(docs), own.alias(digest), at(F.col("doc_id").cast("long"), own).alias(place))
    sieve = Sieve(touched, "place")
    # a row that repeats the id and the text of the one that stays goes, too
    doubtful = sieve.maybe(marked, place).dropDuplicates([place, digest])
    stays = found.where(F.col("kept")).select(F.col("place").alias(place), F.col("digest").alias(digest))
    return sieve.surely_not(marked, place).unionByName(doubtful.join(stays, [place, digest], "left_semi").select(*columns_of(marked))).select(*columns_of(docs))
