"""A pipeline for training text: toxicity, near-duplicates, benchmark decontamination, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which :func:`run` writes as Parquet and reads again for the next one.
All but the last keep the columns of ``documents``. A row is dropped only where the stage's own operator rejects it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rulespark.llm import decontaminate, mixing, near_dup, pii, toxicity
from rulespark.llm.common import forget, map_rows, stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores 0.5 or more go; each row is judged by its own text, whatever its id. Null and empty texts score low and stay,
    repeated rows share their fate, an empty table stays empty, and all columns, clashing names too, stay as they are."""
    known = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("label"))
    named = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    model = toxicity.train(named, known.filter(~toxicity.held_out(F.col("id"))))
    return toxicity.clean_rows(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8, one row stays: of those with the lowest id, or without any id, the one with the least
    hash of all columns. Rows go by that hash, so of two rows that share an id each is judged by its own text, and of equal rows one stays.
    Rows without words (null, empty) all stay; an empty table stays empty; all columns stay as they are, whatever their names and types."""
    key = "row"
    while key in (c.lower() for c in docs.columns):
        key += "_"
    quoted = {c: "`" + c.replace("`", "``") + "`" for c in docs.columns}
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    values = [F.to_json(F.struct(q)) if "map<" in kinds[c] or "variant" in kinds[c] else F.col(q) for c, q in quoted.items()]  # maps have no hash
    keyed = docs.withColumn(key, F.struct(F.xxhash64(*values).alias("a"), F.xxhash64(F.lit(1), *values).alias("b")))
    named = keyed.select(F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id"), F.col(key).alias("row")).alias("doc_id"), "text")
    gone = near_dup.near_duplicates(named).filter(~F.col("kept")).select(F.col("id.row").alias(key)).distinct()
    worded = F.coalesce(F.col("text").cast("string"), F.lit("")).rlike("[^ \\t\\n\\r\\x0B\\f]")
    kept = keyed.filter(worded).join(gone, key, "left_anti").dropDuplicates([key])  # equal rows share a hash
    return kept.select(*quoted.values()).unionAll(docs.filter(~worded))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go, each row judged by its own text, whatever its id; null and empty texts stay, repeated rows share
    their fate, an empty table or benchmark takes nothing away; all columns stay as they are."""
    return decontaminate.clean_rows(docs, _table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind in brackets; ``n_chars`` follows the text. Every row stays: null and empty texts as they are,
    repeated rows alike, other columns untouched."""
    model = pii.train(docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    text, count = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def clean(*row):
        if not row[text]:
            return row
        new = pii.redact(row[text], pii.find(row[text], model)[1])
        if new == row[text]:
            return row
        return tuple(new if i == text else len(new) if i == count else v for i, v in enumerate(row))

    return map_rows(docs, clean, docs.schema)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds each document's expected copies (``rate``) and the drawn ones (``copies``) for the target shares of good and poor text; rows
    whose rate is 0 go. Null and empty texts have no tokens and keep the rate of their posterior; equal rows have equal rates."""
    domains = mixing.quality_domains(_table(spark, sf_dir, "labels"), toxic=False)
    return mixing.mix_rows(docs, domains, {"good": 0.9, "poor": 0.1}).filter("rate > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
]

#: No stage can be put in SQL; the tests hold each operator against brute force and the stages against planted rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        made = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if i:
            forget(docs)  # the stage before
        docs = made
    return docs
