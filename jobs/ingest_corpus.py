"""Ingests document files as they arrive: cleaned, judged, cut into numbered and linked chunks with point ids.

    python jobs/ingest_corpus.py --source DOCUMENTS --output FOLDER --checkpoint FOLDER [--config jobs/ingest_corpus.json]

Each run takes the files that its checkpoint doesn't know yet, some at a time. A batch's documents go to
``documents/batch=N/status=S``, its chunks to ``chunks/batch=N/lang=L``. A batch that was cut off is overwritten when it is run again, and
documents whose id an earlier batch has stored are left out, so running it again changes nothing.

Defined results. Rows without an id are left out; of several with one id in a batch the least (text, language, source) counts, and over
batches the first. Null, empty or short texts are listed as such and have no chunks. English texts with few common
words are listed for recognition from the page. Of the chunks' languages null and the empty string are one partition, read as null.
"""

from __future__ import annotations

import sys
from pathlib import Path

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, main
from passagework.functions import ids, text
from passagework.operators import chunk
from passagework.sources.tables import one_each, staged_at, stored
from passagework.streaming.ingest import before, run_batches, write_batch

DEFAULTS = {"format": "parquet", "files_per_batch": 16, "size": 1000, "overlap": 150, "per_page": 2, "least_chars": 40}
INPUT = "doc_id long, text string, lang string, source string"
DOCUMENTS = "doc_id long, lang string, source string, n_chars long, n_chunks long"
#: As many ids go to every task.
FEW = 100_000
CHUNKS = "doc_id long, idx long, chunk_id string, point_id string, prev_chunk_id string, next_chunk_id string, page long, chunk string"


def judged(docs: DataFrame, least_chars: int) -> DataFrame:
    """Adds the cleaned text, its length and the status: empty, short, corrupted or ready. Each text is cleaned and searched for words once."""
    clean = docs.withColumn("text", F.coalesce(text.sanitize(F.col("text")), F.lit(""))).withColumn("n_chars", F.length("text").cast("long"))
    n, words, english = F.col("n_chars"), F.col("_words"), (F.col("lang") == "en") & (F.col("n_chars") >= 50)
    found = clean.withColumn("_words", F.when(english, text.whole_words(F.col("text"), 2)))
    stops = F.size(F.filter(words, lambda w: w.isin(*text.STOP_WORDS)))
    poor = words.isNotNull() & (F.size(words) >= 15) & (stops * 10 < F.size(words))
    return found.withColumn("status", F.when(n == 0, "empty").when(n < least_chars, "short").when(poor, "corrupted").otherwise("ready")).drop("_words")


def chunked(ready: DataFrame, config: dict) -> DataFrame:
    """The chunks of documents, with their places, neighbours and ids, which follow from a document's number of chunks alone."""
    named = ready.withColumn("name", chunk.doc_name(F.col("doc_id")))
    cut = chunk.fixed(named, config["size"], config["overlap"], keep=("name", "n_chunks"))
    idx, at = F.col("idx"), lambda i: ids.chunk_id(F.col("name"), i)
    linked = cut.select(
        "lang", "doc_id", "idx", at(idx).alias("chunk_id"), F.when(idx > 0, at(idx - 1)).otherwise("").alias("prev_chunk_id"),
        F.when(idx + 1 < F.col("n_chunks"), at(idx + 1)).otherwise("").alias("next_chunk_id"), F.floor(idx / config["per_page"]).alias("page"), "chunk",
    )
    return linked.select("lang", "doc_id", "idx", "chunk_id", ids.uuid5(F.col("chunk_id")).alias("point_id"), "prev_chunk_id", "next_chunk_id", "page", "chunk")


def fresh(rows: DataFrame, stored_ids: DataFrame) -> tuple[DataFrame, int]:
    """One row for each id that isn't stored, and the number of all rows. Ids tell what is to be left out; texts move only for repeated ids or many stored ones."""
    each = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    met = each.join(stored_ids.select("doc_id", F.lit(True).alias("known")), "doc_id", "left")
    told = met.agg(F.sum("n").alias("n"), F.max(F.when(F.col("doc_id").isNotNull(), F.col("n"))).alias("most"), F.count("known").alias("known")).first()
    new = one_each(rows, "doc_id") if (told["most"] or 0) > 1 else rows.where("doc_id IS NOT NULL")
    if told["known"]:
        known = each.join(stored_ids, "doc_id", "left_semi").select("doc_id")
        new = new.join(F.broadcast(known) if told["known"] <= FEW else known, "doc_id", "left_anti")
    return new, told["n"] or 0


def run(spark: SparkSession, source: str, output: str, checkpoint: str, config: dict = DEFAULTS) -> dict[str, int]:
    """Takes what is new in ``source``; returns and logs how many rows were read and written."""
    told = {"batches": 0, "rows_read": 0, "documents_written": 0, "chunks_written": 0}

    def work(rows: DataFrame, batch: int) -> None:
        kept, made = (Observation() for _ in range(2))
        new, read = fresh(rows, before(spark, f"{output}/documents", "doc_id long", batch))
        # Judged texts are kept for the batch: whatever follows would judge them again otherwise.
        with staged_at(judged(new, config["least_chars"]), f"{output}/_judged") as docs:
            n_chunks = F.when(F.col("status") == "ready", chunk.last_index(F.col("n_chars"), config["size"], config["overlap"]).cast("long") + 1)
            docs = docs.withColumn("n_chunks", F.coalesce(n_chunks, F.lit(0).cast("long")))
            cut = chunked(docs.where("status = 'ready'"), config)
            write_batch(cut.observe(made, F.count(F.lit(1)).alias("n")), f"{output}/chunks", batch, "lang")
            listed = docs.select("doc_id", "lang", "source", "n_chars", "n_chunks", "status")
            write_batch(listed.observe(kept, F.count(F.lit(1)).alias("n")), f"{output}/documents", batch, "status")
        found = {"batches": 1, "rows_read": read, "documents_written": kept.get["n"], "chunks_written": made.get["n"]}
        log.info("batch %d: read %d rows, wrote %d documents and %d chunks", batch, *list(found.values())[1:])
        for k, v in found.items():
            told[k] += v

    # A pattern that only this path matches: Spark takes a single file as a stream's source by pattern alone.
    one = source[:-1] + f"[{source[-1]}]" if source[-1].isalnum() else source
    stream = spark.readStream.schema(INPUT).format(config["format"]).option("maxFilesPerTrigger", config["files_per_batch"]).load(one)
    run_batches(stream, checkpoint, work)
    log.info("%s: %s", source, told)
    return told


def documents(spark: SparkSession, output: str) -> DataFrame:
    return stored(spark, f"{output}/documents", f"{DOCUMENTS}, batch int, status string")


def chunks(spark: SparkSession, output: str) -> DataFrame:
    return stored(spark, f"{output}/chunks", f"{CHUNKS}, batch int, lang string")


if __name__ == "__main__":
    main("ingest_corpus", ("source", "output", "checkpoint"), DEFAULTS, run)
