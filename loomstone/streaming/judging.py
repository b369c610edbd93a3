"""BM16, HP19, HP23: logs of results scored again by a judge, as a table or as a stream of log files that is scored once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions.dialect import SPARK as D
from loomstone.functions.dialect import Dialect
from loomstone.operators import harness as BM
from loomstone.plans.attempts import attempts
from loomstone.sources.readers import RESULT_SCHEMA

#: Examples of each failure that a judge is shown.
EXAMPLES = (("composition_hallucination", 3), ("wrong_escalation", 2), ("refusal", 2))


def prompt(d: Dialect, query: str, full: str, minimal: str, examples: dict[str, str], response: str) -> str:
    """HP23: what a judge is asked: query, gold answers, examples of failures (an array each, blocks without any left out), response."""
    line = lambda x: f"{x} || chr(10)"
    parts = [line("'QUERY:'"), line(query), "chr(10)", line("'GOLD ANSWER (full):'"), line(full), "chr(10)", line("'GOLD ANSWER (minimal):'"), line(minimal), "chr(10)"]
    for name, n in EXAMPLES:
        if name in examples:
            a = f"coalesce({examples[name]}, {d.empty()})"
            shown = d.join(d.each(d.take(a, n), lambda v: f"'  - ' || {v}", "v"), chr(10))
            parts.append(f"CASE WHEN {d.size(a)} > 0 THEN 'Examples of {name} for this case:' || chr(10) || {shown} || chr(10) || chr(10) ELSE '' END")
    return " || ".join([*parts, line("'MODEL RESPONSE TO CLASSIFY:'"), line(response), "chr(10)", "'Output JSON only.'"])


def case_index(cases: DataFrame) -> DataFrame:
    """HP19: one row per case_id: of files that state the same id the last by name counts."""
    return cases.groupBy("case_id").agg(F.max_by(F.struct(*(c for c in cases.columns if c != "case_id")), "file").alias("c")).select("case_id", "c.*")


def rescored(results: DataFrame, cases: DataFrame, call: Callable, judge: str = "", budget: int = 3, wait: float = 1.0) -> DataFrame:
    """BM16: results with judge_label, judge_confidence, judge_error, heuristic_judge_agree and out_of_family.

    Probes, empty responses and results of unknown cases are not sent and keep nulls. A negative control is judged against its own
    gold. cases: (case_id, query, full, minimal, control_gold and an array for each kind of EXAMPLES). out_of_family: whether the
    judge is of another family than the model that it judges."""
    control = "CASE WHEN query_type = 'negative_control' THEN control_gold ELSE {} END"
    examples = {name: name for name, _ in EXAMPLES}
    known = cases.select("case_id", F.col("query").alias("asked"), "full", "minimal", "control_gold", *examples)
    sent = results.where("query_type <> 'local_probe' AND coalesce(response_text, '') <> ''").join(known, "case_id")
    asked = sent.select("task_key", F.expr(prompt(D, "asked", control.format("full"), control.format("minimal"), examples, "response_text")).alias("prompt"))
    from loomstone.plans.compile import hold, relation

    told = hold(attempts(asked, ["task_key"], "prompt", call, budget=budget, wait=wait))  # a judge is asked once
    parsed = results.sparkSession.sql(BM.judged(D, relation(told.where("error_class IS NULL")), "task_key", "result"))
    marks = told.select("task_key", F.col("error").alias("judge_error")).join(parsed.select("task_key", F.col("label").alias("new_label"), F.col("confidence").alias("judge_confidence")), "task_key", "left")
    out = results.drop("judge_label").join(marks, "task_key", "left").withColumnRenamed("new_label", "judge_label")
    families = f"{BM.family(D, *BM.spec(D, 'model_spec'))} <> {BM.family(D, *BM.spec(D, D.lit(judge)))}" if judge else "cast(NULL AS boolean)"
    return out.withColumn("heuristic_judge_agree", F.col("heuristic_label") == F.col("judge_label")).withColumn("out_of_family", F.expr(families))


def log(spark: SparkSession, path: str, files_per_trigger: int = 50) -> DataFrame:
    """A folder of result logs (JSON lines) as a stream with each line's task key; broken lines are left out."""
    rows = spark.readStream.schema(RESULT_SCHEMA).option("mode", "PERMISSIVE").option("maxFilesPerTrigger", files_per_trigger).json(path)
    key = F.concat_ws("|", "case_id", "model_spec", "condition", "query_type", F.col("query_index").cast("string"), F.col("rep").cast("string"))
    return rows.where("_corrupt_record IS NULL AND case_id IS NOT NULL").drop("_corrupt_record").withColumn("task_key", key)


def judge_log(stream: DataFrame, cases: DataFrame, call: Callable, out: str, checkpoint: str, **options):
    """Score each task of a log stream once and write it to folder out; returns the started query, which ends with what there is.

    A task key that the log holds already is dropped by state that the checkpoint keeps (one key a task). A batch is written
    to a folder of its own number and overwrites what a broken run left there, so a killed run that is started again gives
    the same table."""

    def put(batch: DataFrame, batch_id: int) -> None:
        rescored(batch, cases, call, **options).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    once = stream.dropDuplicates(["task_key"])
    return once.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
