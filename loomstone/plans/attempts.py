"""EX7: calls of a service made from tasks, each with a budget: errors by class lead to a slimmer schema, a later try or the dead letters.

call(text, schema) -> text is any callable; it raises Refused(status, body) for what a service answers with an error, anything else counts
as a failure of its own. A row is never lost: it comes back with its result or with the class of its last error, so that the
table of a run says what a next run has to do (pending).
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.functions import patterns as P
from loomstone.shipping import ship
from loomstone.sources.readers import slim_schema

#: Classes for which another try is no use: the row is a dead letter until something else changes.
DEAD = ("auth", "payment", "schema_too_complex")


class Refused(Exception):
    """A service's answer that is an error."""

    def __init__(self, status: int, body: str = ""):
        super().__init__(f"{status} {body}".strip())
        self.status, self.body = status, body


def error_class(e: Exception) -> str:
    """HP16 of an exception."""
    if not isinstance(e, Refused):
        return "failure"
    if e.status in (401, 403):
        return "auth"
    if e.status in (429, 402):
        return "rate_limit" if e.status == 429 else "payment"
    return "schema_too_complex" if e.status == 400 and re.search(P.SCHEMA_ERROR, e.body) else "provider_error"


def attempt(call: Callable, text: str, schema, budget: int, wait: float, sleep=time.sleep) -> tuple[str | None, int, bool, str | None, str | None]:
    """(result, tries, whether the slim schema was used, class and message of the last error if there is no result).

    A schema that is too complex is slimmed once and tried again at once; other errors that may pass are tried again after
    wait, twice that, four times that and so on."""
    slim, pause = False, wait
    for n in range(1, budget + 1):
        try:
            return call(text, schema), n, slim, None, None
        except Exception as e:  # noqa: BLE001  the callable is foreign code
            kind, said = error_class(e), str(e)[:500]
        if kind == "schema_too_complex" and not slim and schema is not None:
            slim, schema = True, slim_schema(schema)
        elif kind in DEAD:
            break
        elif n < budget:
            sleep(pause)
            pause *= 2
    return None, n, slim, kind, said


def attempts(df: DataFrame, keys: list[str], text: str, call: Callable, schema=None, budget: int = 3, wait: float = 1.0) -> DataFrame:
    """(keys, result, tries, slim, error_class, error): each row's text through call, in Arrow batches. Null texts are not sent and have
    neither result nor error."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [attempt(call, t, schema, budget, wait) if t is not None else (None, 0, False, None, None) for t in b.column(text).to_pylist()]
            columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), *columns], [*keys, "result", "tries", "slim", "error_class", "error"])

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, text).mapInArrow(run, f"{kinds}, result string, tries int, slim boolean, error_class string, error string")


def pending(df: DataFrame, done: DataFrame, keys: list[str], dead: bool = False) -> DataFrame:
    """The rows that a run before has no result for; dead letters only with dead=True."""
    settled = done.where(F.col("error_class").isNull() | (F.col("error_class").isin(*DEAD) & F.lit(not dead)))
    return df.join(settled.select(*keys).distinct(), keys, "left_anti")
