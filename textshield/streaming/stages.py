"""Requests as a stream: every micro-batch through the pipeline, stage by stage.

Each stage's rows of a batch lie in a folder named by the batch, which a replay
writes anew; so a batch that runs twice, as after a failure, adds no row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..operators.audit import mirror, stage_tables, writes
from ..plans.pipeline import proofread

BATCH = "batch"
Hook = Callable[[DataFrame, int], None]


def write_batch(requests: DataFrame, batch: int, path: str, cfg: Config, now: Column | None = None, hooks: Sequence[Hook] = (), **options: Any) -> dict[str, bool]:
    """Run one batch and write its stage tables; which writes and hooks went well.

    The accepted rows are computed once.  Rejected rows are stored with their
    error.  Hooks get the final stage's stored rows; what one raises stops
    neither the others nor the stream.
    """
    if not writes(cfg)["guarded"]:
        return {}
    spark = requests.sparkSession
    put = lambda df, name: df.write.mode("overwrite").parquet(f"{path}/{name}/{BATCH}={batch}")
    accepted, rejected = proofread(requests, cfg, **options)
    put(accepted, "accepted")
    put(rejected.select("report_id", "error"), "rejected")
    accepted = spark.read.schema(accepted.schema).parquet(f"{path}/accepted/{BATCH}={batch}")
    done = {}
    for name, rows in stage_tables(accepted, now if now is not None else F.current_timestamp()).items():
        put(rows, name)
        done[name] = True
        if writes(cfg)["mirror"] and not name.startswith("html"):
            put(mirror(rows), f"{name}_mirror")
            done[f"{name}_mirror"] = True
    for k, hook in enumerate(hooks):
        try:
            hook(spark.read.parquet(f"{path}/final/{BATCH}={batch}"), batch)
            done[f"hook_{k}"] = True
        except Exception:
            done[f"hook_{k}"] = False
    return done


def stream_stages(requests: DataFrame, path: str, checkpoint: str, cfg: Config | None = None, now: Column | None = None, hooks: Sequence[Hook] = (), trigger: dict[str, Any] | None = None, **options: Any) -> StreamingQuery:
    """Start a stream of requests into stage tables; it goes on where its checkpoint ends."""
    cfg = cfg or Config()

    def run(batch: DataFrame, number: int) -> None:
        write_batch(batch, number, path, cfg, now, hooks, **options)

    return requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_stage(spark: SparkSession, path: str, name: str) -> DataFrame:
    """All batches of a stage."""
    return spark.read.option("mergeSchema", False).parquet(f"{path}/{name}")
