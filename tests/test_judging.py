"""Calls with a budget, judged logs, and a stream of logs that is killed and started again."""

import json

import pytest

from loomstone.plans import attempts as A
from loomstone.streaming import judging as J

SCHEMA = {"type": "object", "properties": {"a": {"type": ["string", "null"], "description": "x"}}}


def scripted(*answers):
    """A callable that gives or raises one answer after the other."""
    left, asked = list(answers), []

    def call(text, schema):
        asked.append(schema)
        x = left.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    call.asked = asked
    return call


@pytest.mark.parametrize(
    ("answers", "want", "pauses"),
    [
        (["ok"], ("ok", 1, False, None, None), []),
        ([A.Refused(429), A.Refused(503), "ok"], ("ok", 3, False, None, None), [1, 2]),
        ([A.Refused(429)] * 3, (None, 3, False, "rate_limit", "429"), [1, 2]),
        ([A.Refused(401), "never"], (None, 1, False, "auth", "401"), []),
        ([A.Refused(402), "never"], (None, 1, False, "payment", "402"), []),
        ([A.Refused(400, "Schema with lots of properties"), "ok"], ("ok", 2, True, None, None), []),
        ([A.Refused(400, "schema with lots of")] * 2, (None, 2, True, "schema_too_complex", "400 schema with lots of"), []),
        ([A.Refused(400, "other"), ValueError("x"), "ok"], ("ok", 3, False, None, None), [1, 2]),
        ([ValueError("x")] * 3, (None, 3, False, "failure", "x"), [1, 2]),
    ],
)
def test_each_class_has_its_way(answers, want, pauses):
    slept = []
    call = scripted(*answers)
    assert A.attempt(call, "t", SCHEMA, 3, 1, slept.append) == want and slept == pauses
    if want[2]:
        assert call.asked[1] == {"type": "object", "properties": {"a": {"type": "string"}}}


def test_a_run_is_resumed(spark):
    df = spark.createDataFrame([(1, "fine"), (2, "auth"), (3, "late"), (4, None)], "k long, t string")

    def call(text, schema):
        from loomstone.plans.attempts import Refused

        if text == "auth":
            raise Refused(403)
        if text == "late":
            raise Refused(503, "busy")
        return text.upper()

    done = A.attempts(df, ["k"], "t", call, budget=2, wait=0)
    assert {tuple(r) for r in done.collect()} == {(1, "FINE", 1, False, None, None), (2, None, 1, False, "auth", "403"), (3, None, 2, False, "provider_error", "503 busy"), (4, None, 0, False, None, None)}
    assert [r["k"] for r in A.pending(df, done, ["k"]).collect()] == [3] and sorted(r["k"] for r in A.pending(df, done, ["k"], dead=True).collect()) == [2, 3]


CASES = [("c1", "May I?", "Yes, you may.", "yes", "No.", ["a", "b", "c", "d"], [], None), ("c2", "Who?", "The clerk.", "clerk", "Nobody.", None, ["e1", "e2", "e3"], ["r"])]
CASE = "case_id string, query string, full string, minimal string, control_gold string, composition_hallucination array<string>, wrong_escalation array<string>, refusal array<string>"


def line(case, kind="primary", rep=0, text="Yes.", label="correct", model="mock:yes"):
    return {"case_id": case, "model_spec": model, "condition": "raw", "query_type": kind, "query_index": 0, "rep": rep, "response_text": text, "heuristic_label": label}


def make_judge():
    def judge(text, schema):
        if "broken" in text:
            raise ValueError("no answer")
        return '{"label": "%s", "confidence": "high"}' % ("correct" if "Yes" in text.split("CLASSIFY:")[1] else "refusal")

    return judge


def test_prompt(spark):
    sql = J.prompt(J.D, "query", "full", "minimal", {n: n for n, _ in J.EXAMPLES}, "'Maybe.'")
    got = [r["p"] for r in spark.createDataFrame(CASES, CASE).selectExpr("case_id", f"{sql} AS p").orderBy("case_id").collect()]
    assert got[0] == "QUERY:\nMay I?\n\nGOLD ANSWER (full):\nYes, you may.\n\nGOLD ANSWER (minimal):\nyes\n\nExamples of composition_hallucination for this case:\n  - a\n  - b\n  - c\n\nMODEL RESPONSE TO CLASSIFY:\nMaybe.\n\nOutput JSON only."
    assert "Examples of wrong_escalation for this case:\n  - e1\n  - e2\n\nExamples of refusal for this case:\n  - r\n\nMODEL" in got[1]


def test_logs_are_scored_once_also_after_a_kill(spark, tmp_path):
    lines = [line("c1"), line("c1", "local_probe"), line("c2", text="I cannot say.", label="correct"), line("c1", "negative_control", text="Yes, sure."), line("c9"), line("c2", rep=1, text=""), line("c2", rep=2, text="broken")]
    files = [[json.dumps(x) for x in lines[:3]] + ["{broken"], [json.dumps(x) for x in lines[2:] + lines[:1]]]
    logs = tmp_path / "log"
    logs.mkdir()
    cases = spark.createDataFrame(CASES, CASE)
    for i, rows in enumerate(files):
        (logs / f"{i}.jsonl").write_text("\n".join(rows))

    def table(name, kill):
        out, at, calls = str(tmp_path / name), str(tmp_path / f"{name}-at"), []
        real = J.rescored

        def dying(batch, *a, **k):
            made = real(batch, *a, **k)
            calls.append(1)
            if kill and len(calls) == 2:
                made.write.mode("overwrite").parquet(f"{out}/batch=1")  # written, and killed before the batch counts as done
                raise RuntimeError("killed")
            return made

        J.rescored = dying
        try:
            for _ in range(2 if kill else 1):
                q = J.judge_log(J.log(spark, str(logs), files_per_trigger=1), cases, make_judge(), out, at, budget=1, judge="openai:judge")
                try:
                    q.awaitTermination()
                except Exception:  # noqa: BLE001
                    assert kill
        finally:
            J.rescored = real
        return sorted((r["task_key"], r["judge_label"], r["judge_error"], r["heuristic_judge_agree"], r["out_of_family"]) for r in spark.read.parquet(out).collect())

    whole = table("whole", False)
    assert len(whole) == len(lines) and {k: (label, e, agree) for k, label, e, agree, _ in whole} == {
        "c1|mock:yes|raw|primary|0|0": ("correct", None, True), "c1|mock:yes|raw|local_probe|0|0": (None, None, None), "c2|mock:yes|raw|primary|0|0": ("refusal", None, False), "c1|mock:yes|raw|negative_control|0|0": ("correct", None, True),
        "c9|mock:yes|raw|primary|0|0": (None, None, None), "c2|mock:yes|raw|primary|0|1": (None, None, None), "c2|mock:yes|raw|primary|0|2": (None, "no answer", None),
    }
    assert {x[-1] for x in whole} == {True} and table("killed", True) == whole


def test_case_index(spark):
    rows = [("a.json", "c1", "old"), ("b.json", "c1", "new"), ("a.json", "c2", "x")]
    assert {(r["case_id"], r["query"]) for r in J.case_index(spark.createDataFrame(rows, "file string, case_id string, query string")).collect()} == {("c1", "new"), ("c2", "x")}
