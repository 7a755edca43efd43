"""Sources: texts, PDF, CSV, JSON, TOML, corpora, questionnaires, concept files and built-in tables."""

from __future__ import annotations

import csv
import json
import os
import tomllib
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.fixed import CSV_ENCODINGS, CSV_SAMPLE_CHARS, CSV_SEPARATORS, DECLARED_VARIABLES, STOP_WORDS, TOP_LEVEL_CONCEPTS
from quarry.operators.generation import check_template


def has_pdf_suffix(path: str) -> bool:
    return path.lower().endswith(".pdf")


def is_pdf(path: Column) -> Column:
    return F.lower(path).endswith(".pdf")


@F.pandas_udf(T.StringType())
def pdf_text(content: pd.Series) -> pd.Series:
    """The pages' texts, one a line; needs the optional package pypdf on the workers."""
    from io import BytesIO

    from pypdf import PdfReader

    return content.map(lambda b: "\n".join(page.extract_text() or "" for page in PdfReader(BytesIO(b)).pages))


def read_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(source, text): whole UTF-8 files; files with the suffix .pdf by their pages."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    pdf = [p for p in paths if has_pdf_suffix(p)]
    plain = [p for p in paths if p not in pdf]
    out = None
    if plain:
        out = spark.read.text(plain, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))
    if pdf:
        files = spark.read.format("binaryFile").load(pdf).select(F.col("path").alias("source"), pdf_text("content").alias("text"))
        out = files if out is None else out.union(files)
    if out is None:
        raise ValueError("no input file")
    return out


def existing(paths: list[str]) -> tuple[list[str], list[str]]:
    """The local paths that are files, and those that are missing."""
    found = [p for p in paths if Path(p).is_file()]
    return found, [p for p in paths if p not in found]


def present(spark: SparkSession, paths: list[str]) -> tuple[list[str], list[str]]:
    """The paths that are there, in any store that Spark reaches, and those that are missing."""
    found = []
    for p in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(p)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            found.append(p)
    return found, [p for p in paths if p not in found]


def input_report(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, found): a row for each input that was asked for, so that missing ones are reported and not just skipped."""
    found, _ = present(spark, paths)
    return spark.createDataFrame([(p, p in found) for p in paths], "path string, found boolean")


def read_present(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(texts, report): :func:`read_texts` of the paths that are there, and :func:`input_report` of all."""
    found, _ = present(spark, paths)
    texts = read_texts(spark, found) if found else spark.createDataFrame([], "source string, text string")
    return texts, input_report(spark, paths)


def read_prompts(spark: SparkSession, folder: str) -> tuple[str, str]:
    """The system prompt and the user template of a folder, without white space at their ends; a template without its placeholder is an error."""
    texts = {r.source.rsplit("/", 1)[-1]: r.text.strip() for r in read_texts(spark, [f"{folder}/system_prompt.txt", f"{folder}/user_template.txt"]).collect()}  # two files
    return texts["system_prompt.txt"], check_template(texts["user_template.txt"])


def read_toml(path: str) -> dict:
    return tomllib.loads(Path(path).read_text(encoding="utf-8"))


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=True)


def read_corpus(spark: SparkSession, path: str, column: str, fmt: str = "parquet", order_by: str | None = None, most: int | None = None) -> DataFrame:
    """(text): one column of a stored corpus; ``most`` rows by ``order_by`` are taken before anything is filtered."""
    df = spark.read.format(fmt).load(path)
    if most:
        df = df.orderBy(order_by) if order_by else df
        df = df.limit(most)
    return df.select(F.col(column).alias("text"))


def read_corpus_stream(spark: SparkSession, path: str, column: str, schema, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(path).select(F.col(column).alias("text"))


def sniff_csv(sample: bytes, whole: bool) -> tuple[str, str]:
    """(encoding, separator) judged by the first characters of a file; ``whole`` if the sample is all of it."""
    for encoding in CSV_ENCODINGS:
        try:
            import codecs

            text = codecs.getincrementaldecoder(encoding)().decode(sample, final=whole)[:CSV_SAMPLE_CHARS]
            break
        except UnicodeDecodeError:
            continue
    else:
        raise ValueError("the encoding isn't known")
    try:
        return encoding, csv.Sniffer().sniff(text, delimiters=CSV_SEPARATORS).delimiter
    except csv.Error as e:
        raise ValueError("the separator isn't known") from e


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A table whose encoding and separator are found from a sample; all columns stay, types are inferred."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        raise FileNotFoundError(path)
    most = 4 * CSV_SAMPLE_CHARS
    stream = fs.open(where)
    try:
        sample = bytes(stream.readNBytes(most))
    finally:
        stream.close()
    encoding, sep = sniff_csv(sample, len(sample) < most)
    return spark.read.csv(path, sep=sep, encoding="UTF-8" if encoding == "utf-8-sig" else "ISO-8859-1", header=True, inferSchema=True, multiLine=True, escape='"')


BLOCKS = "map<string,struct<response_type:string,scale:string,items:array<struct<item_id:string,question:string>>>>"
CONCEPT = "struct<item_id:string,concept_proposed:string,category:string,relation:struct<predicate:string,target_concept:string>,evidence:string,synonyms:array<string>>"


def flatten_questionnaires(df: DataFrame, blocks: str = "blocks") -> DataFrame:
    """One row an item, with its block's response type and scale; ``place`` is its order."""
    per_block = df.select(F.posexplode(blocks).alias("_b", "questionnaire", "_block"))
    items = per_block.select("questionnaire", "_b", "_block.response_type", "_block.scale", F.posexplode("_block.items").alias("_i", "_item"))
    return items.select("questionnaire", "_item.item_id", "_item.question", "response_type", "scale", F.struct(F.col("_b").alias("block"), F.col("_i").alias("item")).alias("place"))


def read_questionnaires(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", BLOCKS).alias("blocks"))
    return flatten_questionnaires(text)


def verification_jobs(df: DataFrame, value: str = "value") -> DataFrame:
    """(dataset, item_id, concept) from concept JSON texts: an object of lists by dataset, or a list as "default".

    Blank concepts are dropped, and so are values of an object that aren't lists.
    """
    text = F.trim(F.col(value))
    as_map = F.from_json(text, "map<string,string>")
    lists = F.when(text.startswith("["), F.array(F.struct(F.lit("default").alias("key"), text.alias("value")))).otherwise(F.map_entries(as_map))
    rows = df.select(F.explode(lists).alias("e")).filter(F.trim("e.value").startswith("["))
    items = rows.select(F.col("e.key").alias("dataset"), F.explode(F.from_json("e.value", f"array<{CONCEPT}>")).alias("c"))
    concept = F.trim("c.concept_proposed")
    return items.select("dataset", F.coalesce("c.item_id", F.lit("")).alias("item_id"), concept.alias("concept")).filter(F.length("concept") > 0)


def declared_variables(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *v) for i, v in enumerate(DECLARED_VARIABLES)], "seq int, name string, type string, example string, description string")


def terminology_roots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, d, None, i) for i, (c, d) in enumerate(TOP_LEVEL_CONCEPTS)], "code string, display string, parent_code string, pos int")


def stop_words(path: str | None = None) -> list[str]:
    """The stop words of a file with one a line, or the built-in ones; none if the file is missing."""
    if path is None:
        return list(STOP_WORDS)
    try:
        return Path(path).read_text(encoding="utf-8").split()
    except OSError:
        return []


def read_blacklist(path: str) -> list[str]:
    """Terms of a JSON list, or of the list "blacklist" of an object."""
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    terms = data.get("blacklist") if isinstance(data, dict) else data
    if not isinstance(terms, list):
        raise ValueError("a blacklist is a list, or an object with a list named blacklist")
    return sorted({t.lower().strip() for t in terms})


def api_key(name: str = "TERMINOLOGY_API_KEY") -> str:
    """A secret from the driver's environment; it is never put into rows."""
    key = os.environ.get(name, "").strip()
    if not key:
        raise SystemExit(f"{name} isn't set")
    return key
