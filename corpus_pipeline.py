"""From raw documents to token ids: five stages, each over all rows that the one before kept.

``STAGES`` lists (name, function); a function takes ``(spark, docs, sf_dir)``, with ``docs`` the
rows written by its predecessor, and returns a DataFrame. All but the last return the columns of
``documents``. ``run`` writes and rereads every stage's result in the shared folder.

Rows are told apart by ``doc_id`` and text where a decision has to find its document again, so
repeated ids do no harm; rows equal in both share their fate, except that one of them stays where
near duplicates go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleargrain.llm import bpe, minhash, mixing, quality, suffix_index
from cleargrain.session import scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
NEAR_WORDS, NEAR_PERCENT = 5, 80
# A passage of 50 words has about so many bytes if they are short, 4 with the space; op1 has its own length.
REPEAT_BYTES = 200
RANKS = "byte_bpe_multi_50k.tiktoken"

# SQL cannot express a trained classifier, nor the merges of the last stage.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier does not reject."""
    model = quality.trained(spark, sf_dir, docs)
    return quality.score(docs.select(*COLUMNS), model).filter("predicted = 1").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id, of several the one with the smallest hash."""
    path = f"{scratch_path(spark, 'groups')}/rows"
    minhash.near_duplicates(docs, shingle=NEAR_WORDS, percent=NEAR_PERCENT, groups=True).write.parquet(path)
    rows = spark.read.parquet(path).groupBy("doc_id", "group", "n_shingles", "text_hash").agg(F.count(F.lit(1)).alias("copies"))
    # An id does not name a group: it can be null or repeat.
    first = rows.filter("n_shingles > 0").groupBy("group").agg(F.min(F.struct("doc_id", "text_hash", "copies")).alias("at"))
    first = first.select(F.col("at.doc_id").alias("kept_id"), "at.text_hash", "at.copies")
    alone = rows.filter("n_shingles = 0").select(F.col("doc_id").alias("kept_id"), "text_hash", F.lit(1).cast("long").alias("copies"))
    chosen = first.union(alone)
    text_hash = F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash_")
    own = docs.select(*COLUMNS, text_hash)
    found = own.join(chosen, own.doc_id.eqNullSafe(chosen.kept_id) & (own.hash_ == chosen.text_hash))
    if chosen.filter("copies > 1").isEmpty():
        return found.select(*COLUMNS)
    once = found.filter("copies > 1").dropDuplicates(["doc_id", "hash_"])
    return found.filter("copies = 1").union(once).select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of REPEAT_BYTES that occur again; what a cut leaves of a character goes too."""
    cut = suffix_index.remove_repeats(docs, REPEAT_BYTES, carry=("lang", "source"), keep_text=True)
    return cut.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken, the last of a source in part."""
    rows = mixing.repeated(mixing.mix(docs.select(*COLUMNS)))
    return rows.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, with their number and the prints of the ids and of the bytes they decode to."""
    import public_tokenizers

    rows = docs.select("doc_id", "lang", "source", "text")
    return bpe.encode(rows, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", one_of_each_group),
    ("suffix-array dedup", without_repeats),
    ("mixing sources to target weights", mixed),
    ("byte-level BPE", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of the last is read from the shared folder."""
    folder = scratch_path(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
