"""python -m millrace.cli task=train|convert|predict key=value ..."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from millrace import params as P
from millrace.operators.metrics import auc, objective
from millrace.plans.bcd import train_bcd
from millrace.plans.lbfgs import train_lbfgs
from millrace.plans.model import load_model, predict, save_model
from millrace.plans.sgd import train_sgd
from millrace.session import local_session
from millrace.sources.readers import read
from millrace.sources.sinks import convert

LEARNERS = {"sgd": (P.SGDLearn, P.SGDUpdate, train_sgd), "lbfgs": (P.LBFGSLearn, P.LBFGSUpdate, train_lbfgs), "bcd": (P.BCDLearn, P.BCDUpdate, train_bcd)}


def main(words: list[str], spark: SparkSession | None = None) -> None:
    settings = P.parse(words)
    task, learner = settings.pop("task", "train"), settings.pop("learner", "sgd")
    given = P.Given(settings)
    spark = spark or SparkSession.getActiveSession() or local_session()
    if task == "convert":
        p = given.take(P.Convert)
        _warn(given)
        convert(spark, p)
    elif task == "train":
        if learner not in LEARNERS:
            raise ValueError(f"no such learner: {learner}")
        learns, updates, train = LEARNERS[learner]
        learn, update = given.take(learns), given.take(updates)
        _warn(given)
        if getattr(learn, "load_epoch", 0):
            raise ValueError("load_epoch: models are kept after the last epoch only; give that one as model_in")
        rows = read(spark, learn.data_in, learn.data_format)
        val = read(spark, learn.data_val, learn.data_format) if learn.data_val else None
        more = {"model": load_model(spark, learn.model_in).model} if learn.model_in else {}
        model = train(rows, learn, update, val, on_epoch=lambda k, r: print(k, r), **more)
        if learn.model_out:
            save_model(model, learn.model_out)
    elif task == "predict":
        learn = given.take(P.SGDLearn)
        out = settings.get("pred_out", "")
        given.left.discard("pred_out")
        _warn(given)
        scored = predict(read(spark, learn.data_in, learn.data_format), load_model(spark, learn.model_in), learn.loss)
        if out:
            scored.write.mode("overwrite").parquet(out)
        print(scored.agg(F.count(F.lit(1)).alias("rows"), objective().alias("loss")).first().asDict() | auc(scored).select("auc").first().asDict())
    else:
        raise ValueError(f"no such task: {task}")


def _warn(given: P.Given) -> None:
    if unused := P.UNUSED & (given.settings.keys() - given.left):
        print(f"of no effect here: {', '.join(sorted(unused))}", file=sys.stderr)
    if given.left:
        print(f"not known: {', '.join(sorted(given.left))}", file=sys.stderr)


if __name__ == "__main__":
    main(sys.argv[1:])
