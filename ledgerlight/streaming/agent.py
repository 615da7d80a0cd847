"""Sessions answered as their messages arrive: a micro-batch is a superstep for each turn that it holds, the batch form's own code.

State, answers and trace of batch n lie in folders named n, written over if the batch is run again after a failure, the state
last; batch n starts from the last state before it. So each message is answered once, and a lost driver costs one batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.agent import Catalog, no_state, superstep, told
from ..operators.state import kept
from ..sources.files import delete_folder
from ..sources.registry import versions


def answer_stream(messages: DataFrame, gazetteer: DataFrame, catalog: Catalog, path: str, k: int = 10, exploration: bool = False):
    """A stream writer for messages (session, turn, text); answers under path/answers, events under path/trace."""
    spark = messages.sparkSession

    def handle(batch: DataFrame, number: int) -> None:
        before = [n for n in versions(spark, path) if n < number]
        state = spark.read.parquet(f"{path}/versions/{before[-1]}") if before else no_state(spark)
        said = kept(told(batch, gazetteer))
        for turn in sorted(r["turn"] for r in said.select("turn").distinct().collect()):  # a session has ten turns at most
            state, answers, events = superstep(state, said.where(F.col("turn") == turn), catalog, turn, k, exploration)
            answers.write.mode("overwrite").parquet(f"{path}/answers/batch={number}/of={turn}")
            events.write.mode("overwrite").json(f"{path}/trace/batch={number}/of={turn}")
        state.write.mode("overwrite").parquet(f"{path}/versions/{number}")
        for old in before[:-1]:
            delete_folder(spark, f"{path}/versions/{old}")

    return messages.writeStream.foreachBatch(handle).option("checkpointLocation", f"{path}/checkpoint")
