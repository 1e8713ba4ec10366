"""Readers: texts by file extension, delimited tables, disease annotations, ontologies, run tables, settings."""

from __future__ import annotations

import configparser
import io
import os
import re
import sys
import zipfile
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, fields
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.plans.lineage import cut
from lattica.session import ship

#: Columns of a disease-to-phenotype annotation file (a fixed format); all are text.
ANNOTATION_COLUMNS = ("disease_id", "disease_label", "phenotype_id", "source", "evidence", "onset", "frequency", "sex", "modifier", "aspect", "biocuration", "extra")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each file as one UTF-8 string."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes, joiner: str = "\n") -> str:
    """The paragraphs of a word-processing document."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    return joiner.join("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in body.iter(f"{_W}p"))


def pdf_text(content: bytes, joiner: str = "\n") -> str:
    """The text of each page; needs the optional library pypdf."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF files needs the library pypdf, which isn't installed") from e
    return joiner.join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages)


def _binary(convert: Callable[[bytes, str], str]):
    def read(spark: SparkSession, path: str, joiner: str = "\n") -> DataFrame:
        ship(spark)

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                yield pd.DataFrame({"path": p["path"], "text": [convert(bytes(c), joiner) for c in p["content"]]})

        return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string")

    return read


read_docx, read_pdf = _binary(docx_text), _binary(pdf_text)


class Readers:
    """Reader functions (spark, path) by file extension."""

    def __init__(self):
        plain = lambda spark, path: read_texts(spark, path)
        self.known = {".txt": plain, ".md": plain, ".markdown": plain, ".mdx": plain, ".docx": read_docx, ".pdf": read_pdf}

    def register(self, extension: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
        self.known[extension.lower()] = reader

    def load(self, spark: SparkSession, path: str, **options) -> DataFrame:
        """(path, text) of a file by its extension, in any case. The path may be in any store that Spark reads."""
        extension = os.path.splitext(path)[1].lower()
        if extension not in self.known:
            raise ValueError(f"no reader registered for {extension!r}")
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            raise FileNotFoundError(path)
        return self.known[extension](spark, path, **options)

    def load_directory(self, spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
        """(path, text, filename) of all files below a folder that match a pattern."""
        found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder, wholetext=True)
        return found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.col("_metadata.file_name").alias("filename"))


def read_table(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",", header: bool = True) -> DataFrame:
    """A delimited table with a given schema; quoted fields may hold line breaks. Types are never guessed."""
    return spark.read.schema(schema).option("header", header).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, ord, line): the lines of text files, numbered from 0 by their place in their file.

    Files are read in splits. A split's lines are counted, and prefix sums of the counts give each split its first
    number, so no task reads a whole file that can be split. What is read is written once, so that splits stay.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    lines = cut(text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"), F.regexp_replace("value", r"\r$", "").alias("line")))
    splits = lines.groupBy("path", "start").agg(F.count("*").alias("lines"), F.min("n").alias("first"))
    before = F.sum("lines").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.withColumn("before", F.coalesce(before, F.lit(0)))
    return lines.join(splits, ["path", "start"]).select("path", (F.col("before") + F.col("n") - F.col("first")).alias("ord"), "line")


def read_headerless(spark: SparkSession, path: str, columns: Sequence[str], skip: int, sep: str = "\t") -> DataFrame:
    """Text columns of files without header after `skip` leading lines, with ord, the line's number in its file (see `numbered_lines`).

    Empty lines count but give no row; empty fields and those that a line lacks are null.
    """
    parts = numbered_lines(spark, path).where((F.col("ord") >= skip) & (F.col("line") != "")).select("ord", F.split("line", re.escape(sep)).alias("f"))
    return parts.select("ord", *[F.nullif(F.get("f", i), F.lit("")).alias(c) for i, c in enumerate(columns)])


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """A disease annotation file: five leading lines, then tab-separated columns."""
    return read_headerless(spark, path, ANNOTATION_COLUMNS, 5)


def read_ontology(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Classes (uri, id, label) and their SUBCLASSOF edges (src, dst) of an RDF/XML ontology.

    A class's id is the end of its uri with ':' for '_'.
    """
    schema = "`_rdf:about` string, `rdfs:label` string, `rdfs:subClassOf` array<struct<`_rdf:resource`: string>>"
    rows = spark.read.format("xml").option("rowTag", "owl:Class").schema(schema).load(path).where("`_rdf:about` is not null")
    of = lambda c: F.replace(F.regexp_replace(c, ".*[/#]", ""), F.lit("_"), F.lit(":"))
    nodes = rows.select(F.col("`_rdf:about`").alias("uri"), of(F.col("`_rdf:about`")).alias("id"), F.col("`rdfs:label`").alias("label"))
    up = rows.select(of(F.col("`_rdf:about`")).alias("src"), F.explode(F.col("`rdfs:subClassOf`")).alias("p"))
    return nodes, up.select("src", of(F.col("p.`_rdf:resource`")).alias("dst"), F.lit("SUBCLASSOF").alias("type")).where("dst is not null").distinct()


def first_rows(df: DataFrame, n: int | None, *order: str) -> DataFrame:
    """The first n rows in an order, all for 0 or None."""
    return df.orderBy(*order).limit(n) if n else df


def load_if_empty(existing: DataFrame, load: Callable[[], DataFrame]) -> DataFrame:
    """existing if it has rows, else what load gives; nothing is read from the source while there are rows."""
    return load() if existing.isEmpty() else existing


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def load_run_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table that a run has logged; FileNotFoundError if there is none of that name."""
    path = f"{folder.rstrip('/')}/tables/{name}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        raise FileNotFoundError(path)
    return spark.read.parquet(path)


def inline(spark: SparkSession, rows: Sequence[dict], schema: T.StructType | str) -> DataFrame:
    """Rows written in code as a table."""
    names = T._parse_datatype_string(schema).names if isinstance(schema, str) else schema.names
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], schema)


@dataclass
class Settings:
    """Connection settings; an option beats the environment, that beats the file, that beats the default."""

    uri: str = "local"
    user: str = ""
    password: str = ""
    encrypted: int = 0

    @classmethod
    def load(cls, options: Sequence[str] = (), environment: dict[str, str] | None = None, ini: str = "") -> Settings:
        """options: --name=value words. An empty value in the file counts; an unknown option is a ValueError."""
        found: dict[str, str] = {}
        parser = configparser.ConfigParser()
        parser.read_string(ini or "[settings]")
        for section in parser.sections():
            found |= {k: v for k, v in parser[section].items() if k in cls.__dataclass_fields__}
        found |= {k: environment[f"LATTICA_{k.upper()}"] for k in cls.__dataclass_fields__ if environment and f"LATTICA_{k.upper()}" in environment}
        for word in options:
            m = re.fullmatch(r"--(\w+)=(.*)", word)
            if not m or m[1] not in cls.__dataclass_fields__:
                raise ValueError(f"unknown option {word!r}")
            found[m[1]] = m[2]
        return cls(**{f.name: int(found[f.name] or 0) if f.name == "encrypted" else found[f.name] for f in fields(cls) if f.name in found})

    @classmethod
    def from_command_line(cls, words: Sequence[str], environment: dict[str, str] | None = None, ini: str = "") -> Settings:
        """`load` for a program: -h or --help says what there is and exits with 0, an unknown option exits with 2; no words, no parsing."""
        if any(w in ("-h", "--help") for w in words):
            print("options: " + " ".join(f"--{f.name}=VALUE" for f in fields(cls)))
            raise SystemExit(0)
        try:
            return cls.load(words, environment, ini)
        except ValueError as e:
            print(e, file=sys.stderr)
            raise SystemExit(2) from e
