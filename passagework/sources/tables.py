"""Sources and sinks: tables, chunk files in either JSON form, raw files, HTML, keyed upserts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK = (
    "page_content string, metadata struct<doc_id string, chunk_id string, source string, filename string, subject string, "
    "language string, extraction_method string, heading string, page string, method string, chunk_index int, total_chunks int, "
    "prev_chunk_id string, next_chunk_id string, char_count int, chapter string, section string>, id string, type string"
)
CHUNK_FIELDS = re.sub(r"(^|, )(\w+) (?=string|struct|int)", r"\1\2: ", CHUNK)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new folder that driver and executors share, as ``spark.checkpoint.dir`` names it; removed when the driver's JVM ends, or kept.

    Where that is unset, a local session gets a temporary folder, and a cluster an error.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="passagework-")
        sc.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for made in () if keep else (path, f"{path}-state"):
        hadoop = sc._jvm.org.apache.hadoop.fs.Path(made)
        hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read from there by all that use it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def staged_at(df: DataFrame, path: str) -> Iterator[DataFrame]:
    """``df`` written to ``path``, in place of what is there, and read from there; removed at the end."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a Parquet folder; none where it isn't there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def one_each(rows: DataFrame, key: str) -> DataFrame:
    """Rows with a key, one for each: of several the least by its other columns. Texts move only if keys repeat."""
    given = rows.where(F.col(key).isNotNull())
    if given.groupBy(key).count().where("count > 1").isEmpty():
        return given
    others = [c for c in rows.columns if c != key]
    return given.groupBy(key).agg(F.min(F.struct(*others)).alias("_row")).select(*(F.col(key) if c == key else F.col(f"_row.{c}") for c in rows.columns))


def raw_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """Files of a tree with the language and subject that their path names."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    parts = F.split("path", "/")
    return files.select("path", "length", path_language(F.col("path")).alias("language"),
                        F.try_element_at(parts, F.lit(-2)).alias("subject"), F.element_at(parts, -1).alias("filename"), "content")


def path_language(path: Column) -> Column:
    """A path component that is a language's name; null if there is none."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.when(F.array_contains(parts, "english"), "english").when(F.array_contains(parts, "telugu"), "telugu")


def chunk_forms(spark: SparkSession, path: str) -> DataFrame:
    """file, size, lines: every file with text under ``path``, its bytes, and whether each of its lines is an object or array of its own."""
    text = spark.read.option("recursiveFileLookup", True).text(path).select(F.trim("value").alias("line"), "_metadata.file_path", "_metadata.file_size")
    own = F.col("line").rlike(r"^(\{.*\}|\[.*\])$")
    return text.where("line <> ''").groupBy(F.col("file_path").alias("file"), F.col("file_size").alias("size")).agg(F.bool_and(own).alias("lines"))


def read_chunks(spark: SparkSession, path: str, lines: bool | None = None, only: DataFrame | None = None) -> DataFrame:
    """Chunk records with the file, its size and the place in it from 1: order by (file, pos) for the order of files.

    Files are JSON arrays, or hold one object or array a line. ``lines`` says which; where it is null, it is told for each file,
    so both forms can lie in one folder. Files without text give no rows. ``only`` names the files that count (``file``).
    """
    if lines is None:
        forms = staged(chunk_forms(spark, path), "forms")
        both = [read_chunks(spark, path, form, forms.where(F.col("lines") == form).select("file")) for form in (True, False)]
        return both[0].unionByName(both[1])
    named = lambda rows: rows if only is None else rows.join(only, "file", "left_semi")
    if lines:
        text = spark.read.option("recursiveFileLookup", True).text(path).select(
            F.trim("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"),
            F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"),
        )
        array = F.when(F.col("line").startswith("["), F.col("line")).otherwise(F.concat(F.lit("["), "line", F.lit("]")))
        listed = named(text.where("line <> ''")).select("file", "size", "at", F.posexplode(F.from_json(array, f"array<struct<{CHUNK_FIELDS}>>")).alias("nth", "c"))
        found = listed.select("c.*", "file", "size", F.struct("at", "nth").alias("at"))
    else:
        whole = spark.read.schema(CHUNK).option("multiLine", True).option("recursiveFileLookup", True).json(path)
        found = named(whole.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("at")))
    return found.withColumn("pos", F.row_number().over(Window.partitionBy("file").orderBy("at")).cast("long")).drop("at")


def outputs(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, size, modified of the files under ``folder``, by their metadata alone; none where it isn't there."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    try:
        return files.load(folder).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "path string, size long, modified timestamp")


def write_chunks(chunks: DataFrame, path: str, each: int | None = None) -> None:
    """Chunk records (``page_content``, ``metadata``) as JSON arrays, a document's in order of chunk_id, characters as they are.

    A document's array is a line of its own. With ``each``, files hold one array over several lines, of about ``each`` documents
    one after another, so that the number of files stays small; with 1, every document has a file of its own.
    """
    record = F.struct("metadata.chunk_id", F.to_json(F.struct("page_content", "metadata")).alias("r"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(record)), lambda x: x["r"]), ",\n" if each else ",")
    arrays = chunks.groupBy(F.col("metadata.doc_id").alias("file")).agg(joined.alias("value"))  # a document's chunks
    if each:
        n = max(1, -(-chunks.select("metadata.doc_id").distinct().count() // each))
        group = F.col("file") if each == 1 else F.pmod(F.xxhash64("file"), F.lit(n))
        whole = arrays.groupBy(group.alias("group")).agg(F.array_join(F.collect_list("value"), ",\n").alias("value"))
        value = F.concat(F.lit("[\n"), "value", F.lit("\n]"))
        whole.select(value.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    else:
        arrays.select(F.concat(F.lit("["), "value", F.lit("]")).alias("value")).write.text(path)


class Store:
    """Rows by key in a Parquet folder that is only appended to; a row that takes another one's place is a row with a higher number.

    Keys are compared null-safely, and a null is a key like others. Of several new rows with one key the least by the other columns counts.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str) -> None:
        self.spark, self.path, self.schema, self.key = spark, path, schema, key

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, _number long").parquet(self.path)

    def create(self) -> bool:
        """Makes the empty store if there is none; tells whether it did."""
        try:
            self._rows()
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            self.spark.createDataFrame([], f"{self.schema}, _number long").write.parquet(self.path)
            return True
        return False

    def read(self) -> DataFrame:
        """The stored rows, the last one of each key; an error where there is no store."""
        rows = self._rows()
        if not rows.agg(F.max("_number")).first()[0]:
            return rows.drop("_number")  # nothing was replaced
        last = rows.groupBy(self._safe().alias("_key")).agg(F.max_by(F.struct(*rows.columns), "_number").alias("_row"))
        return last.select("_row.*").drop("_number")

    def _safe(self, name: str | None = None) -> Column:
        """The key in a struct: one that holds a null equals another one."""
        return F.struct(F.col(f"`{name or self.key}`").alias("key"))

    def _each(self, rows: DataFrame) -> DataFrame:
        """One row for each key."""
        keyed = rows.select(*(f.name for f in self._rows().drop("_number").schema))
        if keyed.groupBy(self.key).count().where("count > 1").isEmpty():
            return keyed
        return keyed.groupBy(self._safe().alias("_key")).agg(F.min(F.struct(*keyed.columns)).alias("_row")).select("_row.*")

    def new(self, rows: DataFrame) -> DataFrame:
        """The rows whose key isn't stored."""
        known = self._rows().select(self._safe().alias("_key"))
        return rows.withColumn("_key", self._safe()).join(known, "_key", "left_anti").drop("_key")

    def add(self, rows: DataFrame) -> None:
        """Appends those that are new, one for each key; run again, it adds nothing."""
        self._append(self._each(self.new(rows)), 0)

    def upsert(self, rows: DataFrame) -> None:
        """Rows whose key is stored take the stored ones' place; those that are stored as they are aren't written again."""
        each = self._each(rows)
        self._append(each.exceptAll(self.read().select(*each.columns)), (self._rows().agg(F.max("_number")).first()[0] or 0) + 1)

    def _append(self, rows: DataFrame, number: int) -> None:
        if not rows.isEmpty():
            rows.withColumn("_number", F.lit(number).cast("long")).write.mode("append").parquet(self.path)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key isn't among them."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def html_text(html: Column) -> Column:
    """Text between tags, without scripts, styles and comments; blanks collapsed."""
    out = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "<[^>]*>", " "), r"[\s\x0B]+", " "))


def headings(pages: DataFrame) -> DataFrame:
    """page_id, pos, level, heading of all h1 to h6, in order."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)<h[1-6][^>]*>.*?</h[1-6]>"), F.lit(0))
    return pages.select("page_id", F.posexplode(found).alias("pos", "h")).select(
        "page_id", F.col("pos").cast("long").alias("pos"), F.substring("h", 3, 1).cast("long").alias("level"), html_text(F.col("h")).alias("heading")
    )
