"""A corpus from raw documents to token ids, in stages that are written and read again.

Stages return lazy results, so those that run workers lower the session's limit on what workers are
handed at once (`blocks.bound_batches`) and leave it so."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm import blocks, byte_cnn, mixing, setsketch, suffix_trees, word_bpe
from furrow.llm.queries import vocabulary_path
from furrow.sources.stages import WorkingTables, lifetime, stage

#: row_key names a row in all stages: ids may be null or repeated.
#: mix_position is null until the mixing stage sets it: files may be read in any order.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "row_key", "mix_position"]
#: A text whose language is less likely than this is no running text of a known language.
LEAST_LANGUAGE_SCORE = 0.3


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a known language, each judged by its own text; `lang` becomes the predicted one. Texts
    without letters, null texts and texts without a clear language go.

    `row_key` is the id; further rows of an id and rows without one get keys behind all ids."""
    blocks.bound_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), *COLUMNS[1:5])
    model = byte_cnn.train(docs)
    known = byte_cnn.predict(docs, model, keep=["text", "source", "n_chars"]).where(
        (F.col("lang_pred") != byte_cnn.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    known = stage(known.withColumn("row", F.monotonically_increasing_id()), "languages")
    named = known.where("doc_id is not null")
    repeated = stage(named.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("row").alias("first"))
                     .where("n > 1").select("doc_id", "first"), "repeated-ids")
    most = named.agg(F.max("doc_id")).first()[0]
    behind = F.lit(max(0, -1 if most is None else most) + 1).cast("long") + F.col("row")
    own = F.coalesce(F.col("first") == F.col("row"), F.lit(True))
    keyed = (named.join(repeated, "doc_id", "left")
             .withColumn("row_key", F.when(own, F.col("doc_id")).otherwise(behind)).drop("first")
             .unionByName(known.where("doc_id is null").withColumn("row_key", behind)))
    return (keyed.withColumn("lang", F.col("lang_pred"))
            .withColumn("mix_position", F.lit(None).cast("long")).select(*COLUMNS))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest key of each group of near duplicates."""
    kept = setsketch.near_duplicates(docs, doc_id="row_key").where("kept").select(
        F.col("doc_id").alias("row_key"))
    return docs.join(kept, "row_key", "left_semi").select(*COLUMNS)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand earlier; documents of which nothing is left go. The other
    columns travel with the texts: joining them would send all texts once more."""
    blocks.bound_batches(spark)
    others = ["own_id", "lang", "source", "mix_position"]
    cut = suffix_trees.remove_repeats(docs.withColumnRenamed("doc_id", "own_id"), doc_id="row_key", keep=others)
    return (cut.where("n_removed = 0 or n_removed < n_words")
            .withColumnsRenamed({"doc_id": "row_key", "own_id": "doc_id"})
            .withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order in which sources take turns by their weights, their places in it
    as `mix_position`."""
    return mixing.mix(docs, doc_id="row_key").orderBy("mix_position").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, the text that they decode to, and the text's place in the mixed
    order, by which texts are encoded and joined: it is one row's own."""
    blocks.bound_batches(spark)
    path = vocabulary_path()
    place = F.coalesce("mix_position", F.raise_error(F.lit("a document has no mix_position")).cast("long"))
    docs = docs.withColumn("mix_position", place)
    encoded = word_bpe.encode(docs.select("mix_position", "text"), path, doc_id="mix_position")
    named = encoded.withColumnRenamed("doc_id", "mix_position").join(
        docs.select("doc_id", "mix_position"), "mix_position")
    return word_bpe.decode(named, path, keep=["mix_position"]).select(
        "doc_id", "mix_position", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language ID", identify_languages),
    ("near duplicates", drop_near_duplicates),
    ("repeated passages", cut_repeated_passages),
    ("mixing", mix_sources),
    ("BPE", encode),
]

ORACLE_SQL = None  # a trained network, sketches and a vocabulary: tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in a row. What a stage writes on its way goes at its end, and its input once its
    output is written; the mixed documents stay, as the last stage reads them when asked to."""
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), WorkingTables()
    for name, step in STAGES[:-1]:
        written = WorkingTables()
        try:
            with lifetime():
                docs = written(step(spark, docs, sf_dir), f"corpus-{name.replace(' ', '-')}")
        except BaseException:
            written.drop()
            raise
        finally:
            read.drop()
        read = written
    return STAGES[-1][1](spark, docs, sf_dir)
