"""A corpus pipeline of five stages over ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that ``run`` writes as
Parquet and rereads as the next stage's ``docs``: a lost executor costs one stage at
most. All stages but the last return the columns of their input. Each works on all rows
that its predecessor kept:

1. toxicity: rows predicted toxic go;
2. line dedup: shared lines stay in the smallest doc_id that holds them; n_chars follows the text;
3. SimHash near-dedup: one document of each group stays, that of the smallest doc_id (among several
   texts of that id, the one of the least hash);
4. decontamination: documents that hold a benchmark item go;
5. best-fit packing: what is left as token sequences.

Rows that repeat (doc_id, text) are one document and share its fate. All null ids count as one id, smaller
than any other: rows of a null id and one text are one document, those of another text another. Null texts count as
empty ones; empty tables pass through; extra columns are carried to the last stage. SQL cannot
express the model, the hash and the vocabulary, so there is no ORACLE_SQL for the whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm import decontamination as DC
from reviewlake.llm import line_dedup as LD
from reviewlake.llm import packing as PK
from reviewlake.llm import simhash_dedup as SH
from reviewlake.llm import toxicity as TX
from reviewlake.llm.common import fresh, id_key, release, table, whole_text, written
from reviewlake.llm.queries import vocabulary
from reviewlake.session import scratch_dir

#: Rows (16 bytes each) of a list of dropped documents that may be broadcast; a longer one is joined by a shuffle.
MAX_BROADCAST_ROWS = 1_000_000

#: Words that a worker of the last stage remembers.
PACKING_MEMO = 200_000


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows named by (_d, _r): the id's key and a hash of the text."""
    gone = written(gone.select("_d", "_r").distinct(), "dropped")
    gone = F.broadcast(gone) if gone.count() <= MAX_BROADCAST_ROWS else gone.hint("shuffle_hash")
    d, r = fresh(docs, "_key"), fresh(docs, "_hash")
    keyed = docs.withColumns({d: id_key(), r: F.xxhash64(whole_text())})
    return keyed.join(gone, (keyed[d] == gone["_d"]) & (keyed[r] == gone["_r"]), "left_anti").select(*[f"`{c}`" for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = TX.toxicity(docs, table(spark, sf_dir, "labels"))
    return _without(docs, scored.where("predicted = 1").withColumn("_d", id_key()))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = LD.line_dedup(docs, carry=True)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[f"`{c}`" for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, SH.simhash_dedup(docs).where("_d <> component_id or _r <> _first"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, DC.decontamination(docs, table(spark, sf_dir, "benchmark")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the workers have held the tables of the stages before; a smaller one here keeps executors small
    return PK.pack(docs, vocabulary(), memo=PACKING_MEMO)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over ``documents``: the packed pieces."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_dir(spark, f"pipeline-{name}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        release(spark)
    return docs


ORACLE_SQL = None
QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
