"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

toxicity     documents that score as toxic go
near_copies  one document (the smallest id) of each group of near copies stays: five words, similarity 0.8
privacy      personal data in texts is replaced by its kind, ``n_chars`` follows
mixture      documents are left out or repeated (up to three times) until sources meet their target weights
tokens       texts become token ids

``doc_id`` names a document: rows that repeat an id stay or go together; a row without an id is a document of its own,
and goes if its text is a copy of another one's. Null and empty texts count as empty: they aren't toxic by themselves,
link with nothing, hold no personal data, are left out by the mixture (no words to take, unless they share an id with
others) and have no tokens. Null sources
are one source. An empty table passes as an empty one, further columns of ``documents`` pass through up to the last
stage, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringside.llm import bpe, jaccard, mixing, pii, toxicity
from ringside.llm.common import cleared, remove, shared_folder, table

TOXIC = 0.3
SEED = 29


def free_name(docs: DataFrame, like: str) -> str:
    """A column name that the table doesn't have yet."""
    taken = {c.lower() for c in docs.columns}
    return next(x for x in (f"_{like}{'_' * k}" for k in range(len(taken) + 1)) if x not in taken)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a score below the threshold, judged by a lexicon learned from the labels of these documents."""
    lexicon = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.text_score(docs, lexicon) < TOXIC)


def name_of() -> Column:
    """The id; for rows without one a hash of their text, above all ids."""
    return F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(F.xxhash64("text"), 2) + F.lit(1 << 62))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without an id are named by their text, above all ids, so that they never stay for a named row."""
    key = free_name(docs, "key")
    named = docs.withColumn(key, name_of())
    groups = jaccard.jaccard_groups(named, words=5, num=80, den=100, id_col=key)
    gone = groups.filter(F.col(key) != F.col("component_id")).select(key).distinct()
    kept = named.join(gone, key, "left_anti")
    nameless = F.col("doc_id").isNull() & F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)) > 0, F.lit(False))
    return kept.filter(~nameless).unionByName(kept.filter(nameless).dropDuplicates(["text"])).select(docs.columns)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stays as many times as the mix takes its words. Of a broken part a hash decides; rows without id that
    share source and text divide theirs among them. They meet in one task, as rows that repeat an id do."""
    name, key, times, row, k = (free_name(docs, x) for x in ("name", "key", "times", "row", "copy"))
    named = docs.withColumns({name: name_of(), key: mixing.source_key(F.col("source"))})
    taken = mixing.mix_sources(named.select(F.col(name).alias("doc_id"), "source", "text"))
    plan = (
        taken.groupBy(F.col("doc_id").alias(name), F.col("key").alias(key))
        .agg(F.try_divide(F.sum("taken").cast("double"), F.sum("size")).alias(times)).filter(F.col(times) > 0)
    )
    draw = F.pmod(F.xxhash64(name, F.lit(SEED)), F.lit(1 << 20)) / float(1 << 20)
    place = F.when(F.col("doc_id").isNull(), F.row_number().over(Window.partitionBy(name, key).orderBy(name))).otherwise(1)
    upto = lambda n: F.ceil(n * F.col(times) - draw)
    joined = named.join(plan, [name, key]).withColumn(row, place)
    copies = (upto(F.col(row)) - upto(F.col(row) - 1)).cast("int")
    return joined.withColumn(k, F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)))).select(docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, ["doc_id", "source"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_copies", keep_one_of_each_group),
    ("privacy", hide_personal_data),
    ("mixture", mix),
    ("tokens", tokenise),
]

#: Learned weights, tries and tokens can't be told in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's table is deleted once the next one is written, with all that a stage
    itself has written to the shared folder; the last one stays for the caller to read."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        with cleared(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
