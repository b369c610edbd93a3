"""Readers and writers for the file kinds that the engine takes: texts, office files, packages, cases and result logs."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.shipping import ship

CASE_SCHEMA = """case_id string, metadata struct<domain: string, relation_type: string, complexity_level: int, source_status: string>,
representations struct<raw: string, annotated: string, compiled: string>, query string, gold_answer struct<full: string, minimal: string, required_relations: array<string>>,
local_probes array<struct<fragment_id: string, probe: string, expected_answer: string>>,
controls struct<necessary_fragments: array<string>, negative_control_query: string, negative_control_gold: string>, _corrupt_record string"""
RESULT_SCHEMA = "case_id string, model_spec string, condition string, query_type string, query_index int, rep int, response_text string, heuristic_label string, judge_label string, error string, _corrupt_record string"


def texts(spark: SparkSession, path: str) -> DataFrame:
    """IO1 for plain files: (filename, text), one row a file."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"[^/]+$", 0).alias("filename"), F.col("value").alias("text"))


def docx_text(raw: bytes) -> str | None:
    """The paragraphs of a word-processor file, headings as #; None if it is none."""
    try:
        xml = zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml").decode("utf-8", "replace")
    except (zipfile.BadZipFile, KeyError):
        return None
    out = []
    for p in re.findall(r"<w:p[ >].*?</w:p>", xml, re.S):
        text = "".join(re.findall(r"<w:t(?: [^>]*)?>(.*?)</w:t>", p, re.S))
        for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
            text = text.replace(a, b)
        level = re.search(r'<w:pStyle w:val="Heading(\d)"', p)
        out.append("#" * int(level[1]) + " " + text if level else text)
    return "\n\n".join(x for x in out if x.strip())


def office(spark: SparkSession, path: str) -> DataFrame:
    """IO1 for word-processor files: (filename, text); text is null for what cannot be read."""

    ship(spark)

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            yield b.assign(text=[docx_text(bytes(x)) for x in b["content"]])[["filename", "text"]]

    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"[^/]+$", 0).alias("filename"), "content")
    return files.mapInPandas(run, "filename string, text string")


def cases(spark: SparkSession, path: str) -> DataFrame:
    """IO26: one row per case file in file order; files that are not JSON are left out."""
    df = spark.read.schema(CASE_SCHEMA).option("mode", "PERMISSIVE").option("multiLine", True).json(path)
    return df.withColumn("file", F.regexp_extract(F.input_file_name(), r"[^/]+$", 0)).where("_corrupt_record IS NULL AND case_id IS NOT NULL").drop("_corrupt_record")


def results(spark: SparkSession, path: str) -> DataFrame:
    """IO28: a log of results as JSON lines, broken lines left out, with each one's task key."""
    df = spark.read.schema(RESULT_SCHEMA).option("mode", "PERMISSIVE").json(path).where("_corrupt_record IS NULL AND case_id IS NOT NULL").drop("_corrupt_record")
    return df.withColumn("task_key", F.concat_ws("|", "case_id", "model_spec", "condition", "query_type", F.col("query_index").cast("string"), F.col("rep").cast("string")))


def remaining(tasks: DataFrame, done: DataFrame) -> DataFrame:
    """The tasks of a plan that a log does not hold yet."""
    return tasks.join(done.select("task_key").distinct(), "task_key", "left_anti")


def write_jsonl(df: DataFrame, path: str) -> None:
    """IO27."""
    df.write.json(path)


def yaml(value, indent: int = 0) -> str:
    """IO21, HP11: nested dicts, lists and scalars as block YAML without line wrapping; strings are quoted when they need it."""
    pad = "  " * indent
    if isinstance(value, dict):
        if not value:
            return " {}\n"
        out = "" if indent == 0 else "\n"
        return out + "".join(f"{pad}{k}:{yaml(v, indent + 1)}" for k, v in value.items())
    if isinstance(value, (list, tuple)):
        if not value:
            return " []\n"
        out = "" if indent == 0 else "\n"
        for v in value:
            body = yaml(v, indent + 1)
            out += f"{pad}-{body}" if not isinstance(v, dict) or not v else f"{pad}- {body.lstrip()}"
        return out
    if value is None:
        return " null\n"
    if isinstance(value, bool):
        return f" {str(value).lower()}\n"
    if isinstance(value, (int, float)):
        return f" {value}\n"
    s = str(value)
    plain = re.fullmatch(r"[A-Za-z_][\w ./-]*", s) and s.lower() not in ("true", "false", "null", "yes", "no") and s == s.strip()
    return f" {s}\n" if plain else ' "' + s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"\n'


ANNOTATIONS = ("additionalProperties", "default", "description", "examples", "format", "maxItems", "maxLength", "maximum", "minItems", "minLength", "minimum", "pattern", "title", "$schema", "$id")


def slim_schema(schema):
    """EX9, HP12: a JSON schema without annotations: enumerations as their type, unions as their first type that is not null,
    required names only where the property is left."""
    if isinstance(schema, list):
        return [slim_schema(x) for x in schema]
    if not isinstance(schema, dict):
        return schema
    out = {k: slim_schema(v) for k, v in schema.items() if k not in ANNOTATIONS and k not in ("enum", "anyOf", "oneOf", "required")}
    for k in ("anyOf", "oneOf"):
        if k in schema:
            kept = [slim_schema(x) for x in schema[k] if x.get("type") != "null"]
            out |= kept[0] if kept else {"type": "string"}
    if isinstance(out.get("type"), list):
        out["type"] = next((t for t in out["type"] if t != "null"), "string")
    if "enum" in schema:
        out.setdefault("type", "string")
    if "required" in schema:
        names = [n for n in schema["required"] if n in out.get("properties", {})]
        if names:
            out["required"] = names
    return out
