"""A corpus pipeline of the training-data operators; a part of heronlake.llm.

Each stage reads what the one before it wrote, over whole texts. What they share: a stage decides by doc_id, so rows that
share an id stay or go together, and repeated rows do; rows with a null id are kept by the stages that compare documents.
Null and empty texts have no words: they are never toxic, repeated, alike or contaminated, and encode to no tokens. Further
columns stay as they are, whatever they are called. No documents give no documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronlake.llm import bpe, decontam, jaccard, linededup, toxicity
from heronlake.llm.common import read, stored
from heronlake.llm.queries import bpe_digests, vocabulary


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The documents with numbers for column names, which clash with none of an operator's, and the number of each name."""
    names = {c: f"_column_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out the documents that the toxicity classifier rejects. The model learns from the labels that aren't held out;
    without any, none is rejected."""
    model = toxicity.train(docs.select("doc_id", "text"), read(spark, sf_dir, "labels"))
    plain, names = numbered(docs)
    key, text = names["doc_id"], names["text"]
    scored = toxicity.score(plain, model, key, text, also=tuple(c for c in plain.columns if c != key))
    return scored.where(F.col("score") < toxicity.THRESHOLD).select(*plain.columns).toDF(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later repeated runs of lines, and documents of which nothing is left; n_chars follows the text.

    Places are ordered by id, a null one first, then by the text; rows with one id and text count as one place.
    """
    plain, names = numbered(docs)
    key, text, size = names["doc_id"], names["text"], names.get("n_chars")
    found = linededup.dedup(plain, key, text)
    cut = F.size("removed") > 0
    emptied = cut & (F.trim(F.regexp_replace(text, r"\s+", " ")) == "")
    found = found.where(~F.coalesce(emptied, F.lit(False)))
    if size:
        kind = plain.schema[size].dataType
        found = found.withColumn(size, F.when(cut, F.length(text).cast(kind)).otherwise(F.col(size)))
    return found.select(*plain.columns).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest id, of each group that five-word shingles link at 0.8."""
    found = jaccard.link(docs.select("doc_id", "text"), k=5, threshold="0.8")
    return without(docs, found.where("doc_id != component_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents that hold a passage of the benchmark."""
    found = decontam.decontaminate(docs.select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return without(docs, found.where("contaminated"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents whose id isn't among those of ``gone``; a null id never is."""
    return docs.join(gone.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode what is left and decode it again; the last stage, a row for each row."""
    return bpe_digests(bpe.encode(docs.select("doc_id", "text"), vocabulary()))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of a data folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
