"""File sources and sinks: opening hours in JSON, PDF through a pluggable parser, CSV, Markdown, appends."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.functions.text import clean_text

HOURS_SCHEMA = (
    "array<struct<unit_name: string, street_address: string, city: string, state: string, phone_number: string, "
    "calendar: struct<nextSevenDays: array<struct<day: string, date: string, hours: array<struct<label: string>>>>>>>"
)


def opening_hours(raw: Column, fallback: str = "Library Hours") -> Column:
    """The text of a unit's JSON: a line for each day, its address and its phone."""
    listed = F.when(F.startswith(F.ltrim(raw), F.lit("[")), raw).otherwise(F.concat(F.lit("["), raw, F.lit("]")))
    unit = F.get(F.from_json(listed, HOURS_SCHEMA), F.lit(0))
    name = F.when(F.coalesce(unit["unit_name"], F.lit("")) != "", unit["unit_name"]).otherwise(fallback)

    def line(day: Column) -> Column:
        label, date = F.coalesce(day["day"], F.lit("")), F.coalesce(day["date"], F.lit(""))
        labels = F.filter(F.transform(day["hours"], lambda h: h["label"]), lambda x: F.coalesce(x, F.lit("")) != "")
        times = F.coalesce(F.array_join(labels, "; "), F.lit(""))
        today = F.when(times != "", F.concat(name, F.lit(" is open right now and today's hours ("), date, F.lit(") are "), times, F.lit("."))).otherwise(
            F.concat(name, F.lit(" is closed right now, with no hours open today ("), date, F.lit(")."))
        )
        other = F.concat(name, F.lit(" hours on "), label, F.lit(" ("), date, F.when(times != "", F.concat(F.lit("): open "), times)).otherwise("): closed all day"))
        return F.when(label == "Today", today).otherwise(other)

    given = lambda *cs: F.filter(F.array(*cs), lambda x: F.coalesce(x, F.lit("")) != "")
    address = F.array_join(given(unit["street_address"], unit["city"], unit["state"]), ", ")
    head = F.array(F.concat(name, F.lit(" hours for the next seven days:")))
    days = F.coalesce(F.transform(unit["calendar"]["nextSevenDays"], line), F.array().cast("array<string>"))
    tail = given(F.when(address != "", F.concat(F.lit("Address: "), address)), F.when(F.coalesce(unit["phone_number"], F.lit("")) != "", F.concat(F.lit("Phone: "), unit["phone_number"])))
    return clean_text(F.array_join(F.concat(head, days, tail), "\n"))


def read_pdfs(spark: SparkSession, path: str, parse: Callable[[bytes], tuple[str, list[str]]]) -> DataFrame:
    """(url, title, text) of PDF files by a parser (bytes -> title, page texts), which no library here offers."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parsed = [parse(bytes(x)) for x in frame["content"]]
            yield pd.DataFrame({"url": frame["path"], "title": [t for t, _ in parsed], "text": ["\n\n".join(p) for _, p in parsed]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "url string, title string, text string")


def write_csv(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").option("header", True).csv(path)


def markdown_sections(counts: DataFrame) -> DataFrame:
    """(topic, section): a Markdown section for each topic of counts(topic, department, n)."""
    lines = F.sort_array(F.collect_list(F.struct("department", "n")))
    listed = counts.groupBy("topic").agg(F.count("*").alias("total"), lines.alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: F.concat(F.lit("- "), r["department"], F.lit(": "), r["n"].cast("string"))), "\n")
    return listed.select("topic", F.concat(F.lit("## "), "topic", F.lit(" ("), F.col("total").cast("string"), F.lit(" sources)\n"), body).alias("section"))


def write_markdown(sections: DataFrame, path: str) -> None:
    sections.orderBy("topic").select("section").write.mode("overwrite").text(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key of an append-only table."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("_n", place).filter("_n = 1").drop("_n")
