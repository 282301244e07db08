"""The corpus pipeline: each stage works on all that its predecessor kept.

1. toxicity: documents scored 0.5 or more go;
2. SimHash near-dedup: one document of each group of near-duplicates stays
   (five-word shingles, similarity 0.8 or more);
3. benchmark decontamination: documents that hold a benchmark window go;
4. secret scans: every secret is replaced by a mark, all documents stay;
5. mixing: sources are replicated to their target weights and shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewspan.llm import decontam, mixing, neardups, secrets, toxicity
from viewspan.llm.common import quoted, read, spare, stored


def _columns(docs: DataFrame) -> list:
    return [F.col(quoted(c)) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5. Null and empty texts have a score too and mostly stay; repeated rows go or stay together."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    score = spare(docs, "_vs_toxicity")
    return toxicity.with_toxicity(docs, model, name=score).where(F.col(score) < 0.5).select(*_columns(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least id of each group of equal or near-duplicate texts; null is the empty text, null ids come last."""
    return neardups.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item. Null and empty texts have none and stay."""
    prefix = spare(docs, "_vs_")
    hits = decontam.benchmark_hits(docs, read(spark, sf_dir, "benchmark"), prefix=prefix)
    return hits.where(F.size(prefix + "spans") == 0).select(*_columns(docs))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in the text replaced by a mark; ``n_chars``, if there, follows the new text. Null stays null."""
    ratios = secrets.train(secrets.labelled_samples(spark))
    name = spare(docs, "_vs_secrets")
    found = secrets.with_secrets(docs, ratios, name=name)
    text = secrets.redacted(F.col("text"), F.col(name))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size(name) > 0, F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.withColumns(new).select(*_columns(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as a Poisson number of its source's rate says, in a global shuffle, with ``copy_no``."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("source mixing", mix_sources),
]

#: Fitting, components and fingerprints aren't SQL; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; between stages the rows are a table in the shared checkpoint folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
