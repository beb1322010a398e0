"""Update streams taken from ordinary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillcount.functions.hashing import string_id

# Word ids end in the number of one of so many classes.
WORD_CLASSES = 4096


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan with fewer splits than cores before costly per-row work.

    A large table has far more splits than cores and passes through unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def word_uses(spark: SparkSession, sf_dir: str, docs_per_block: int, together: bool = False) -> DataFrame:
    """``(item, weight, block)``: every use of a word, the word itself as item, in blocks of documents.

    ``together`` deals the texts by their blocks first: a text is smaller than the words
    it is opened to, and what is summed up by block then needs no other shuffle.
    """
    texts = read_table(spark, sf_dir, "documents").select(F.expr(f"doc_id div {docs_per_block}").alias("block"), "text")
    texts = texts.repartition("block") if together else spread(texts)
    return texts.select(
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("item"),
        F.lit(1).cast("long").alias("weight"), "block")


def numbered_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(word, item, weight)``: every word of every document with its number and its uses.

    A word is a run of letters of any script, lower-cased. Words are counted as text, so
    no two share an id: the classes of their MD5 number them in alphabetical order,
    class by class. Ids stay below 2^32 for up to 2^20 words in a class. They are never null;
    saying so keeps joins on them from testing for nulls before the words are counted.
    """
    texts = spread(read_table(spark, sf_dir, "documents").select("text"))
    words = texts.select(
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("weight"))
    in_class = Window.partitionBy("class").orderBy("word")
    item = (F.row_number().over(in_class) - 1).cast("long") * WORD_CLASSES + F.col("class")
    return counted.withColumn("class", string_id(F.col("word"), 12)).select(
        "word", F.coalesce(item, F.lit(0)).alias("item"), "weight")


def word_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(item, weight)``: the numbers of all words with their uses."""
    return numbered_words(spark, sf_dir).select("item", "weight")


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(item, weight, pos)``: one unit update per event; ``event_id`` is dense from 0."""
    return read_table(spark, sf_dir, "events").select(
        F.col("user_id").alias("item"), F.lit(1).cast("long").alias("weight"),
        F.col("event_id").alias("pos"))


def signed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As :func:`user_events`, with every fifth update a removal."""
    return user_events(spark, sf_dir).withColumn(
        "weight", F.when(F.col("pos") % 5 == 0, F.lit(-1)).otherwise(F.lit(1)).cast("long"))


def part_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("item"), F.col("l_quantity").cast("long").alias("weight"))


def part_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractional weights as DECIMAL, so that sums do not depend on their order."""
    return read_table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("item"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("weight"))


def customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("item"), F.lit(1).cast("long").alias("weight"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("item"), F.lit(1).cast("long").alias("weight"))
