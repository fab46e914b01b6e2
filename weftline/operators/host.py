"""A host's own kinds."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F

from weftline.operators.nodes import Step
from weftline.plans.values import Dyn, Value, json_text


def from_pandas(call: Callable[[dict], object]) -> Callable[[Step], Value]:
    """An operator from a Python function of a node's inputs, for what columns can't express.

    Inputs and results pass as JSON in Arrow batches. An exception is the run's error and stops no other run. A
    kind with side effects is to be written by a sink from `effects()` instead, for Spark may run a task twice.
    """

    @F.pandas_udf("value string, error string")
    def batch(inputs: pd.Series) -> pd.DataFrame:
        out = []
        for text in inputs:
            try:
                out.append((json.dumps(call(json.loads(text))), None))
            except Exception as e:  # the run's own failure
                out.append((None, str(e) or type(e).__name__))
        return pd.DataFrame(out, columns=["value", "error"])

    def operator(step: Step) -> Value:
        told = step.compiler.keep(batch(json_text(step.inputs)))
        step.abort(told["error"].isNotNull(), told["error"])
        return Dyn(F.parse_json(told["value"]))

    return operator
