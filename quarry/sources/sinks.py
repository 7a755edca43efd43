"""Sinks: concept JSON and CSV, verification CSV, profiles, results and Turtle."""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.concepts import concept_struct
from quarry.operators.ontology import turtle_blocks
from quarry.functions.fixed import TURTLE_HEADER

BOM = "﻿"


def put_text(df_or_spark, path: str, text: str) -> None:
    """Write one small text to a path of any store that Spark reaches."""
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def write_texts(df: DataFrame, folder: str, name: str = "name", text: str = "text") -> int:
    """Each row as a UTF-8 file of its own, written by the tasks; gives their number. A null text is an empty file.

    A file is written under another name and then gets its own, so tasks that run again leave
    the same files. The folder is in a store that pyarrow opens.
    """

    def run(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        local = "://" not in folder and not folder.startswith("file:")
        where, path = (fs.LocalFileSystem(), folder) if local else fs.FileSystem.from_uri(folder)
        where.create_dir(path, recursive=True)
        for batch in batches:
            for own, value in zip(batch.column(name).to_pylist(), batch.column(text).to_pylist()):
                draft = f"{path}/.{own}.{uuid.uuid4().hex}"
                with where.open_output_stream(draft) as out:
                    out.write((value or "").encode())
                if where.get_file_info(f"{path}/{own}").type != fs.FileType.NotFound:
                    where.delete_file(f"{path}/{own}")
                where.move(draft, f"{path}/{own}")
            yield pa.RecordBatch.from_pydict({"n": [len(batch)]})

    return df.select(name, text).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_json_document(spark, path: str, data) -> None:
    """One UTF-8 JSON document, indented, with characters as they are."""
    put_text(spark, path, json.dumps(data, ensure_ascii=False, indent=2))


def by_source(concepts: DataFrame, group: str = "source", order: str = "seq") -> DataFrame:
    """(source, concepts): each source's concepts in order, as nested records."""
    rows = concepts.select(F.col(group).alias("source"), F.struct(F.col(order).alias("seq"), concept_struct().alias("c")).alias("x"))
    return rows.groupBy("source").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["c"]).alias("concepts"))


def write_by_source(concepts: DataFrame, path: str, group: str = "source", order: str = "seq") -> None:
    """A line of JSON a source."""
    by_source(concepts, group, order).write.mode("overwrite").json(path)


def concept_csv_rows(concepts: DataFrame) -> DataFrame:
    """The columns of a concept CSV, all text: the relation as "predicate -> target" or empty, synonyms joined by "; "."""
    relation = F.when(F.col("predicate").isNotNull(), F.concat_ws(" -> ", "predicate", "target")).otherwise("")
    return concepts.select("item_id", F.col("concept").alias("concept_proposed"), "category", relation.alias("relation"), "evidence", F.array_join(F.coalesce("synonyms", F.array().cast("array<string>")), "; ").alias("synonyms"))


def write_csv(df: DataFrame, path: str, bom: bool = True) -> None:
    """CSV with a header; ``bom`` puts a byte-order mark before the header's first name."""
    if bom:
        df = df.withColumnRenamed(df.columns[0], BOM + df.columns[0])
    df.write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="")


def verification_csv_rows(labelled: DataFrame) -> DataFrame:
    return labelled.select(
        F.col("dataset").alias("Source Dataset"), F.col("item_id").alias("Item ID"), F.col("concept").alias("Concept (A2)"), F.col("found").alias("Is in SNOMED"), F.col("semantic").alias("Semantic filter")
    )


def missing_items(items: DataFrame, concepts: DataFrame, key: str = "item_id") -> DataFrame:
    """The items without any concept left."""
    return items.join(concepts.select(key).distinct(), key, "left_anti")


def write_profile(profiled: DataFrame, dataset: str, dataset_id: str, folder: str) -> str:
    """``<folder>/<stem>_<id>/variables.json``, replaced if it is there; a profile is a row a column, so it is small."""
    stem = dataset.rsplit("/", 1)[-1].rsplit(".", 1)[0].replace(" ", "_")
    path = f"{folder}/{stem}_{dataset_id}/variables.json"
    fields = [r.asDict(recursive=True) for r in profiled.orderBy("pos").drop("pos").collect()]
    write_json_document(profiled.sparkSession, path, {"dataset": dataset.rsplit("/", 1)[-1], "dataset_id": dataset_id, "variables": fields})
    return path


def write_results(rows: DataFrame, prompt_id: str, folder: str, day: date | None = None, prompt: str | None = None) -> str:
    """Alignment rows as JSON lines in a folder named by day and prompt, each with its ``prompt`` if one is given."""
    path = f"{folder}/results_{(day or date.today()).isoformat()}_{prompt_id}"
    own = rows if prompt is None else rows.select(F.lit(prompt).alias("prompt"), *(F.col(f"`{c}`") for c in rows.columns if c != "prompt"))
    own.write.mode("overwrite").json(path)
    return path


def write_turtle(found: DataFrame, path: str) -> None:
    """Turtle as one text folder in order; the header is its first line. Without triples nothing is written."""
    if found.isEmpty():
        return
    spark = found.sparkSession
    head = spark.createDataFrame([(None, -1, TURTLE_HEADER)], f"seq {found.schema['seq'].dataType.simpleString()}, block int, value string")
    body = turtle_blocks(found).select("seq", "block", F.concat("text", F.lit("\n")).alias("value"))
    head.union(body).orderBy(F.col("seq").asc_nulls_first(), "block").select("value").write.mode("overwrite").text(path)
