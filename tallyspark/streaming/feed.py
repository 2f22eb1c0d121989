"""Facts and verdicts as they arrive: late filings become versions, and turn the verdicts of the claims that read them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.facts import FACTS
from ..operators.store import Verdicts
from ..operators.verify import verify_claims


def stream_facts(spark, folder: str) -> DataFrame:
    """Facts from Parquet files as they land."""
    return spark.readStream.schema(FACTS).parquet(folder)


def append_facts(stream: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Append arriving facts to the store, once each within a batch by id; partitioned by tenant. No state is kept between batches."""

    def batch(df: DataFrame, epoch: int) -> None:
        df.dropDuplicates(["id"]).write.mode("overwrite").partitionBy("tenant_id").parquet(f"{store}/epoch={epoch}")  # a repeated batch replaces its rows

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def verify_stream(claims: DataFrame, store: str, metrics: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Verdicts of arriving claims against the store as it stands at each batch."""

    def batch(df: DataFrame, epoch: int) -> None:
        facts = df.sparkSession.read.schema(FACTS).parquet(store).select(*(c.split()[0] for c in FACTS.split(", ")))
        verify_claims(df, facts, metrics).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")  # a repeated batch replaces its rows

    return claims.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_facts(stream: DataFrame, kept: Verdicts, out: str, checkpoint: str, since: str | None = None) -> StreamingQuery:
    """Take arriving facts into a kept store; the claims that read them are verified again, and their new verdicts appended to ``out``.

    A batch costs what it touches: its parts of the store and its claims. It may come again: ids are taken once, and its folder is replaced.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        kept.add_facts(df, since).write.mode("overwrite").parquet(f"{out}/facts-epoch={epoch}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_claims(stream: DataFrame, kept: Verdicts, checkpoint: str) -> StreamingQuery:
    """Verify arriving claims against a kept store, and remember what they read, for facts that come later."""
    return stream.writeStream.foreachBatch(lambda df, _: kept.add_claims(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
