"""Hash-chained audit log: append, verify, export.

An event's hash covers its canonical JSON (sorted keys, no spaces) with the hash before it. Building the
chain is serial by nature: one tenant-independent chain per log, made by one task that streams a batch.
Verification is parallel: each event is joined to the one before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import canonical, escaped

GENESIS = "0" * 64
TYPES = ("ingest", "bind", "verdict", "edit", "override", "sign_off")
SEQ_PLACE = "\x00"  # stands for the number until it is known; JSON strings can't hold it
EVENTS = "seq long, timestamp string, actor string, type string, tenant_id string, payload string, prev_hash string, hash string"


def body(e: dict[str, Column]) -> tuple[Column, Column]:
    """Canonical JSON of an event before and after the value of ``prev_hash``; the payload is canonical JSON already."""
    head = F.concat(F.lit('{"actor":'), escaped(e["actor"]), F.lit(',"payload":'), e["payload"], F.lit(',"prev_hash":"'))
    tail = F.concat(F.lit('","seq":'), e["seq"].cast("string"), F.lit(',"tenant_id":'), escaped(e["tenant_id"]), F.lit(',"timestamp":'), escaped(e["timestamp"]), F.lit(',"type":'), escaped(e["type"]), F.lit("}"))
    return head, tail


def _body(df: DataFrame) -> tuple[Column, Column]:
    return body({c: F.col(c) for c in ("actor", "payload", "seq", "tenant_id", "timestamp", "type")})


def append(events: DataFrame, first_seq: int = 0, prev_hash: str = GENESIS) -> DataFrame:
    """Chained events from a batch with ``ord`` (its order), timestamp, actor, type, tenant_id and payload.

    The canonical text is made in parallel but for the number and the hash before; one task then reads the
    batch in order, row by row, and holds none of it.
    """
    events = events.withColumn("seq", F.lit(SEQ_PLACE))
    head, tail = _body(events)
    rows = events.select("ord", "timestamp", "actor", "type", "tenant_id", "payload", head.alias("head"), tail.alias("tail"))

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seq, last = first_seq, prev_hash
        for b in batches:
            links = []
            for before, after in zip(b["head"], b["tail"], strict=True):
                was, last = last, hashlib.sha256(f"{before}{last}{after.replace(SEQ_PLACE, str(seq), 1)}".encode()).hexdigest()
                links.append((seq, was, last))
                seq += 1
            made = pd.DataFrame(links, columns=["seq", "prev_hash", "hash"], index=b.index)
            yield b.drop(columns=["ord", "head", "tail"]).join(made)[[c.split()[0] for c in EVENTS.split(", ")]]

    return rows.repartition(1).sortWithinPartitions("ord").mapInPandas(chain, EVENTS)


def verify(chain: DataFrame) -> DataFrame:
    """One row: ``ok``, ``first_bad_seq`` and ``reason`` of the first break. Each event is joined to the one before it."""
    head, tail = _body(chain)
    own = chain.groupBy("seq").agg(F.count(F.lit(1)).alias("n"), F.min("prev_hash").alias("prev_hash"), F.min("hash").alias("hash"), F.min(F.sha2(F.concat(head, F.col("prev_hash"), tail), 256)).alias("due"))
    before = chain.groupBy((F.col("seq") + 1).alias("seq")).agg(F.min("hash").alias("before"))
    rows = own.join(before, "seq", "left").withColumn("before", F.when(F.col("seq") == 0, GENESIS).otherwise(F.col("before")))
    why = F.when((F.col("n") > 1) | F.col("before").isNull(), "sequence").when(F.col("prev_hash") != F.col("before"), "link").when(F.col("hash") != F.col("due"), "hash")
    bad = rows.select("seq", why.alias("why")).filter("why IS NOT NULL").agg(F.min_by(F.struct("seq", "why"), "seq").alias("b"))
    return bad.select(F.col("b").isNull().alias("ok"), F.col("b.seq").alias("first_bad_seq"), F.col("b.why").alias("reason"))


def export(chain: DataFrame, tenant: str | None = None) -> DataFrame:
    return chain if tenant is None else chain.filter(F.col("tenant_id") == tenant)


def verdict_events(verdicts: DataFrame, timestamp: str, actor: str = "engine") -> DataFrame:
    """A batch of verdict events, one for each claim, in claim order."""
    fields = {"claim_id": F.col("claim_id"), "displayed_text": F.col("displayed_text"), "document_id": F.col("document_id"), "metric": F.col("metric"), "period": F.col("period"), "source_ref": F.coalesce(F.col("provenance.ref"), F.lit("none")), "verdict": F.col("verdict")}
    payload = F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), escaped(v)) for k, v in sorted(fields.items()))), F.lit("}"))
    return verdicts.select(F.struct("document_id", "claim_id").alias("ord"), F.lit(timestamp).alias("timestamp"), F.lit(actor).alias("actor"), F.lit("verdict").alias("type"), "tenant_id", payload.alias("payload"))


def decision_event(spark, kind: str, tenant: str, actor: str, timestamp: str, payload_json: str) -> DataFrame:
    """An override or a sign-off: recorded, and no verdict changes."""
    if kind not in ("override", "sign_off", "edit", "ingest"):
        raise ValueError(kind)
    return spark.range(1).select(F.lit(0).alias("ord"), F.lit(timestamp).alias("timestamp"), F.lit(actor).alias("actor"), F.lit(kind).alias("type"), F.lit(tenant).alias("tenant_id"), F.lit(payload_json).alias("payload"))
