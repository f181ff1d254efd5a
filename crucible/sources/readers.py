"""Readers: archive members, delimited tables, matrices, reports and configurations. Paths go through Spark, so any store it knows will do."""

from __future__ import annotations

import csv
import io
import tarfile
import uuid
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crucible.operators.digests import digest_tree
from crucible.sources.matrices import read_matrix


def fetched(spark: SparkSession, url: str, path: str) -> bool:
    """Copy what a URL gives to a path of any store that Spark knows, unless there is something; whether it was copied. A copy that breaks off leaves nothing at the path."""
    from urllib.request import urlopen

    hadoop = spark._jvm.org.apache.hadoop.fs
    at, part = hadoop.Path(path), hadoop.Path(path + ".part")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(at):
        return False
    out = fs.create(part, True)
    try:
        with urlopen(url) as source:
            while block := source.read(1 << 20):
                out.write(block, 0, len(block))
    finally:
        out.close()
    return fs.rename(part, at)


class _Stream:
    """What a file object has of an iterator of bytes, read once and forwards."""

    def __init__(self, chunks):
        self.chunks, self.have = chunks, b""

    def read(self, n: int) -> bytes:
        parts, size = [self.have], len(self.have)
        while size < n and (more := next(self.chunks, None)) is not None:
            parts.append(more)
            size += len(more)
        whole = b"".join(parts)
        self.have = whole[n:]
        return whole[:n]


def tar_members(spark: SparkSession, path: str, suffix: str = "", basename: str | None = None) -> DataFrame:
    """(archive, member, basename, ordinal, content) of the regular files of tar archives, compressed or not, of one basename if it is given.

    An archive is streamed, whatever its size: Spark's text reader hands out its
    bytes between line feeds, decompressed where the name tells how (as .gz), and
    a task takes out members as they pass. Only a member's own content is ever
    held, and only of members that are asked for. An archive that the reader
    splits, as it does without such a name, is put in order by a shuffle first;
    then the bytes themselves tell the compression. Tasks work on archives side
    by side. Without any file at the path there are no rows.
    """

    def chunks(batches):
        """(archive, bytes): of each batch what belongs to one archive together."""
        for batch in batches:
            names = batch.column(0).to_pylist()
            lines = batch.column(1).to_pylist()
            at = 0
            for name, same in groupby(names):
                end = at + sum(1 for _ in same)
                yield name, b"\n".join(lines[at:end]) + b"\n"
                at = end

    def untar(batches):
        for name, own in groupby(chunks(batches), key=lambda x: x[0]):
            with tarfile.open(fileobj=_Stream(b for _, b in own), mode="r|*") as tar:
                for i, m in enumerate(tar):
                    if m.isfile() and m.name.endswith(suffix) and basename in (None, m.name.rsplit("/", 1)[-1]):
                        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((name, pa.string()), (m.name, pa.string()), (m.name.rsplit("/", 1)[-1], pa.string()), (i, pa.int64()), (tar.extractfile(m).read(), pa.binary()))], names=["archive", "member", "basename", "ordinal", "content"])

    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("archive"), F.col("value").cast("binary").alias("value"), F.col("_metadata.file_block_start").alias("start"))
    whole = F.lower("archive").rlike(r"\.(gz|zst|deflate)$")  # the reader decompresses these and does not split them
    split = lines.filter(~whole).withColumn("at", F.monotonically_increasing_id()).repartition("archive").sortWithinPartitions("archive", "start", "at")
    schema = "archive string, member string, basename string, ordinal long, content binary"
    of = lambda df: df.select("archive", "value").mapInArrow(untar, schema)
    return of(lines.filter(whole)).unionByName(of(split))


def last_by_name(members: DataFrame) -> DataFrame:
    """Of members with one basename, the last."""
    w = Window.partitionBy("basename").orderBy(F.desc("archive"), F.desc("ordinal"))
    return members.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def decoded(members: DataFrame, name: str = "text") -> DataFrame:
    """members with their content as text; bytes that are no UTF-8 become the replacement character."""
    schema = members.schema
    at = schema.fieldNames().index("content")

    def work(batches):
        for batch in batches:
            text = pa.array([x.decode("utf-8", "replace") if x is not None else None for x in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns)), text], names=[*schema.fieldNames(), name])

    from pyspark.sql import types as T

    return members.mapInArrow(work, T.StructType([*schema.fields, T.StructField(name, T.StringType())]))


def tsv_from_tar(spark: SparkSession, path: str, basename: str, columns: list[str], header: bool = True) -> DataFrame:
    """As tsv_from_members, of an archive."""
    return tsv_from_members(tar_members(spark, path, basename=basename), basename, columns, header)


def tsv_from_members(members: DataFrame, basename: str, columns: list[str], header: bool = True) -> DataFrame:
    """The named columns, as strings, of the first member with that basename; without a header the names are given in order. Fields may be quoted; empty ones stay empty."""

    def parse(batches):
        for batch in batches:
            for raw in batch.column(0):
                rows = csv.reader(io.StringIO(raw.as_py().decode("utf-8"), newline=""), delimiter="\t")
                names = next(rows, columns) if header else columns
                at = [names.index(c) for c in columns]
                block: list[list[str]] = []
                for row in rows:
                    block.append([row[i] if i < len(row) else None for i in at])
                    if len(block) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*block, strict=True)], names=columns)
                        block = []
                if block:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*block, strict=True)], names=columns)

    found = members.filter(F.col("basename") == basename)
    first = found.orderBy("archive", "ordinal").limit(1).select("content")
    return first.mapInArrow(parse, ", ".join(f"`{c}` string" for c in columns))


def delimited(spark: SparkSession, path: str, columns: list[str] | None = None, sep: str = "\t") -> DataFrame:
    """A delimited table of strings; with columns given, the file has no header. Empty fields are empty texts, not null."""
    reader = spark.read.option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", True)
    if columns:
        return reader.schema(", ".join(f"`{c}` string" for c in columns)).csv(path).na.fill("")
    return reader.option("header", True).csv(path).na.fill("")


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key, the last in order."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def npy_rows(spark: SparkSession, path: str) -> DataFrame:
    """(row_index, vector) of .npy matrices of numbers; pickled objects are refused."""
    return read_matrix(spark, path)


def text_of(spark: SparkSession, path: str) -> str:
    """A small text file, such as a report or a configuration, on the driver."""
    return spark.read.option("wholetext", True).text(path).first()[0]


def json_report(spark: SparkSession, path: str) -> dict:
    import json

    return json.loads(text_of(spark, path))


def yaml_config(spark: SparkSession, path: str) -> dict:
    import yaml

    return yaml.safe_load(text_of(spark, path))


#: What a kept table's manifest holds.
MANIFEST = "data string, rows long, digest string, members string"


def _root(df: DataFrame) -> str:
    """The digest of all rows; empty for an empty table."""
    found = digest_tree(df).filter("level = 0").first()
    return found.digest if found else ""


def cached_table(spark: SparkSession, folder: str, fingerprint: str, version: int, build, members: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """The table kept for a fingerprint and a version; where it is missing, damaged or of other members it is built and kept.

    Data goes to a folder of its own, never over data that someone may read; the
    manifest is written last, so a table without one is none. It names the folder,
    the number of rows, the digest of all rows, and that of `members` (such as the
    list of what was encoded). Rows are counted on each call; with `whole` they are
    digested too. Older data stays until its folder is deleted.
    """
    at = f"{folder}/{fingerprint}-v{version}"
    of = None if members is None else _root(members)
    try:
        kept = spark.read.schema(MANIFEST).json(f"{at}/manifest").collect()
        if len(kept) == 1 and kept[0].data and kept[0].members == of:
            out = spark.read.parquet(f"{at}/{kept[0].data}")
            if out.count() == kept[0].rows and (not whole or _root(out) == kept[0].digest):
                return out
    except Exception as e:
        if type(e).__name__ not in ("AnalysisException", "Py4JJavaError", "SparkException", "SparkRuntimeException", "IllegalArgumentException", "SparkFileNotFoundException"):
            raise
    name = f"data-{uuid.uuid4().hex}"
    build().write.parquet(f"{at}/{name}")
    out = spark.read.parquet(f"{at}/{name}")
    spark.createDataFrame([(name, out.count(), _root(out), of)], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{at}/manifest")
    return out
