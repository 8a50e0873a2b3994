"""Readers: the nested corpus, schema catalogues, source trees and delimited files."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import names

# Endings of files that are searched for SQL.
SOURCE_ENDINGS = (
    ".py", ".java", ".js", ".ts", ".rb", ".php", ".go", ".cs", ".sql", ".scala", ".kt", ".swift", ".pl", ".dart", ".r",
    ".erl", ".ex", ".exs", ".cpp", ".c", ".h", ".hpp", ".html", ".xml", ".jsp", ".vue", ".tsx", ".jsx",
)
# Endings of files that are kept as they are, and the size that they must stay under.
METADATA_ENDINGS = (".json", ".yaml", ".yml", ".txt", ".md")
METADATA_BYTES = 1 << 20


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """The nested corpus: Parquet files one directory level below ``folder``."""
    return spark.read.schema(schemas.CORPUS).parquet(f"{folder}/*/*.parquet")


def read_processed_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses of the repositories in a corpus; none if there is no corpus yet."""
    glob = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/*/*.parquet")
    found = glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(glob)
    if not found:
        return spark.createDataFrame([], "repo_url string")
    return read_corpus(spark, folder).select("repo_url")


def read_repo_list(spark: SparkSession, path: str) -> DataFrame:
    """The list of repositories to mine."""
    return spark.read.schema(schemas.REPO_LIST).parquet(path)


def read_all_parquet(spark: SparkSession, folder: str) -> DataFrame:
    """All Parquet files below a folder, unreadable ones left out."""
    return spark.read.option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).parquet(folder)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(file_key, position, info, tables) of each entry of JSON catalogues; a file is one object."""
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.from_json("value", schemas.CATALOGUE).alias("m"), F.col("_metadata.file_path").alias("source"))
    entries = parsed.select("source", F.posexplode(F.map_entries("m")).alias("position", "e"))
    return entries.select(F.col("e.key").alias("file_key"), "source", "position", F.col("e.value.INFO").alias("info"), F.col("e.value.TABLES").alias("tables"))


def read_catalogue_repos(spark: SparkSession, path: str) -> DataFrame:
    """The repository list of JSON catalogues: the first entry of each address."""
    rows = read_catalogue(spark, path).withColumn("repo", names.repository(F.trim("info.URL")))
    first = F.min_by(F.struct("info.LICENSE", "info.PERMISSIVE"), F.struct("source", "position"))
    found = rows.where("repo is not null").groupBy("repo").agg(first.alias("f"))
    return found.select("repo.name", "repo.url", F.col("f.LICENSE").alias("license"), F.col("f.PERMISSIVE").alias("permissive"))


def decoded(content: Column) -> Column:
    """UTF-8 text without the bytes that aren't (and without replacement marks)."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("\ufffd"), F.lit(""))


def ending_glob(endings: tuple[str, ...]) -> str:
    """The glob that lists files by their endings: other files are not opened, whatever their size."""
    return f"*{{{','.join(endings)}}}"


def read_sources(spark: SparkSession, folder: str, *, endings: tuple[str, ...] = SOURCE_ENDINGS, file_filter: Column | None = None) -> DataFrame:
    """(file_path, content) of the source files below a folder; bytes that aren't UTF-8 are left out.

    The ending is matched as it is written, when files are listed; ``file_filter`` acts on what has been read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", ending_glob(endings)).load(folder)
    if file_filter is not None:
        files = files.where(file_filter)
    return files.select(F.col("path").alias("file_path"), decoded(F.col("content")).alias("content"))


def read_benchmark_scripts(spark: SparkSession, folder: str, directories: tuple[str, ...]) -> DataFrame:
    """(file_path, content) of SQL scripts in the named directories below a folder."""
    inside = F.lit(False)
    for name in directories:
        inside = inside | F.contains("path", F.lit(f"/{name}/"))
    return read_sources(spark, folder, endings=(".sql", ".SQL"), file_filter=inside)


def read_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """(file_path, file_type, content) of small descriptive files directly in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", ending_glob(METADATA_ENDINGS)).load(folder).where(F.col("length") < METADATA_BYTES)
    name = F.substring_index("path", "/", -1)
    return files.select(name.alias("file_path"), names.extension(name).alias("file_type"), decoded(F.col("content")).alias("content"))


def sniff_delimiter(sample: list[str]) -> str:
    """The delimiter that parts most lines of a sample into the same number of fields, more than one."""
    best, score = ",", 0.0
    for mark in (",", "\t", ";", "|"):
        counts = [line.count(mark) for line in sample if line.strip()]
        usual = max(set(counts), key=counts.count, default=0)
        if usual and counts.count(usual) * usual > score:
            best, score = mark, counts.count(usual) * usual
    return best


def read_delimited(spark: SparkSession, path: str, *, header: bool = True, delimiter: str | None = None) -> DataFrame:
    """A delimited file with inferred types: short rows are padded with nulls, rows that can't be read are dropped."""
    if delimiter is None:
        delimiter = sniff_delimiter([r["value"] for r in spark.read.text(path).limit(50).collect()])
    reader = spark.read.option("header", header).option("inferSchema", True).option("sep", delimiter)
    schema = reader.csv(path).schema
    kept = reader.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_unread")
    wide = kept.schema(schema.add("_unread", "string")).csv(path)
    # a short row is marked too, but can be told by its nulls at the end
    empty = F.lit(True)
    for field in schema.fields:
        if field.name != "_unread":
            empty = empty & F.col(f"`{field.name}`").isNull()
    return wide.where(F.col("_unread").isNull() | ~empty).drop("_unread")


def import_delimited_tree(spark: SparkSession, folder: str, *, pattern: str = "*/*", errors: dict[str, str] | None = None) -> dict[tuple[str, str], DataFrame]:
    """Tables of a tree of delimited files: (directory, file name up to its first dot) to DataFrame.

    A file that can't be read as a table raises, or, with ``errors``, is named there with the reason.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    glob = jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = glob.getFileSystem(conf).globStatus(glob)
    out = {}
    for status in found or []:
        path = status.getPath()
        try:
            out[path.getParent().getName(), path.getName().split(".")[0]] = read_delimited(spark, path.toString())
        except (PySparkException, Py4JJavaError) as e:
            if errors is None:
                raise
            errors[path.toString()] = str(e).splitlines()[0]
    return out
