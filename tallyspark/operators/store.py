"""A kept fact store: one row a scope, brought up to date by each batch, and read by verdicts without moving it.

The store is a table of scopes: the latest version, the filed ones, and the ids that have been taken in. It is bucketed by scope, so that a join on scopes
finds it in place, and cut into ``PARTS`` by tenant, so that a batch rewrites only the parts that its tenants lie in. A batch is reduced to a row per scope first (partial
aggregates), then meets the stored rows in a join. A fact whose id is there already is left out: a batch that comes twice, or again after a failure, changes nothing.

A scope's versions are those of one figure of one company and period, a few.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .facts import _VERSION, SCOPE, is_filed
from .staging import new_folder, settled
from .verify import parsed, scopes_needed, verify_parsed

BUCKETS, PARTS = 32, 16
_V = "struct<as_of:string,ingest_seq:bigint,value:decimal(28,6),unit:string,quantum:decimal(28,6),source_type:string,source_ref:string,source_label:string,source_excerpt:string,source_url:string>"
_F = "struct<as_of:string,ingest_seq:bigint,value:decimal(28,6),unit:string>"
ROW = f"tenant_id string, entity string, metric string, period string, latest {_V}, filed array<{_F}>, ids array<string>, part int"


def _part(tenant: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(tenant), F.lit(parts)).cast("int")


class FactStore:
    """The table ``name`` with its files under ``folder`` (a new one in the shared folder if there is none)."""

    def __init__(self, spark: SparkSession, name: str | None = None, folder: str | None = None, buckets: int = BUCKETS, parts: int = PARTS):
        self.spark, self.name, self.parts = spark, name or f"facts_{uuid.uuid4().hex}", parts
        if not spark.catalog.tableExists(self.name):
            path = folder or new_folder(spark, self.name)
            keys = ", ".join(SCOPE)
            spark.sql(f"CREATE TABLE {self.name} ({ROW}) USING parquet PARTITIONED BY (part) CLUSTERED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{path}'")

    def scopes(self) -> DataFrame:
        """As ``fact_scopes`` gives them: each scope's ``latest`` version and the ``older`` filed ones."""
        last = F.struct(*(F.col("latest")[c].alias(c) for c in ("as_of", "ingest_seq", "value", "unit")))
        return self.spark.table(self.name).select(*SCOPE, "latest", F.filter("filed", lambda v: v != last).alias("older"))

    def _batch(self, facts: DataFrame) -> DataFrame:
        """A row per scope of the batch's facts, each id once."""
        version = F.struct(F.struct(*_VERSION).cast(_V).alias("v"), is_filed(F.col("source_type"), F.col("source_ref")).alias("filed"), "id")
        listed = facts.groupBy(*SCOPE).agg(F.collect_set(version).alias("versions"))  # one figure's
        first = F.filter("versions", lambda x: ~F.exists("versions", lambda y: (y["id"] == x["id"]) & (y < x)))
        return listed.select(*SCOPE, first.alias("versions"), _part(F.col("tenant_id"), self.parts).alias("part"))

    def merged(self, facts: DataFrame) -> DataFrame:
        """The parts that a batch touches, as they are after it. Stored scopes stay where they are; the batch moves to them."""
        batch = self._batch(facts)
        touched = batch.select("part").distinct()  # PARTS at most
        stored = self.spark.table(self.name).join(F.broadcast(touched), "part", "left_semi").withColumnRenamed("part", "_part")
        both = stored.join(batch, SCOPE, "full")
        ids, old = F.coalesce("ids", F.array().cast("array<string>")), F.coalesce("filed", F.array().cast(f"array<{_F}>"))
        fresh = F.filter(F.coalesce("versions", F.array().cast(batch.schema["versions"].dataType)), lambda x: ~F.array_contains(ids, x["id"]))
        both = both.withColumn("fresh", fresh)
        newest = F.array_max(F.concat(F.transform("fresh", lambda x: x["v"]), F.when(F.col("latest").isNotNull(), F.array("latest")).otherwise(F.array().cast(f"array<{_V}>"))))
        filed = F.transform(F.filter("fresh", lambda x: x["filed"]), lambda x: F.struct(*(x["v"][c].alias(c) for c in ("as_of", "ingest_seq", "value", "unit"))).cast(_F))
        return both.select(*SCOPE, newest.alias("latest"), F.array_sort(F.concat(old, filed)).alias("filed"), F.concat(ids, F.transform("fresh", lambda x: x["id"])).alias("ids"), F.coalesce("_part", "part").alias("part"))

    def add(self, facts: DataFrame) -> None:
        """Take in a batch: the touched parts are written beside the table, then put in place of the old ones."""
        rows = settled(self.merged(facts), "merged")
        key = "spark.sql.sources.partitionOverwriteMode"
        was = self.spark.conf.get(key)
        self.spark.conf.set(key, "dynamic")  # parts that aren't written stay
        try:
            rows.repartition(*SCOPE).sortWithinPartitions("part").write.mode("overwrite").insertInto(self.name)
        finally:
            self.spark.conf.set(key, was)
        self.spark.catalog.refreshTable(self.name)

    def verify(self, claims: DataFrame, metrics: DataFrame, tolerance: str = "0") -> DataFrame:
        """Verdicts of claims against the store as it stands."""
        return verify_parsed(parsed(claims, metrics), self.scopes(), claims.columns, tolerance)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


class Verdicts:
    """Verdicts kept beside a store, and the scopes that each claim reads: what arrives late is verified again, and nothing else.

    ``claims`` and ``verdicts`` are tables of one row a claim; ``index`` has a row for each scope that a claim reads, its own or an operand's. A batch of facts names
    scopes; the claims whose rows of the index meet them are verified against the store and take the place of their old verdicts. So a claim that comes before
    its facts is verified again when they come, and a restated operand turns a derived figure's verdict. With ``since``, claims seen before that day are settled for good.
    """

    def __init__(self, store: FactStore, metrics: DataFrame, tolerance: str = "0"):
        self.store, self.metrics, self.tolerance = store, metrics, tolerance
        self.claims = self.index = self.verdicts = None

    def _indexed(self, claims: DataFrame) -> DataFrame:
        need = scopes_needed(parsed(claims, self.metrics))
        return need.select(F.col("c.claim_id").alias("claim_id"), "c.document_id", *SCOPE).distinct()

    def add_claims(self, claims: DataFrame) -> None:
        """Claims that arrive: indexed, and verified against the store as it stands."""
        keys = ["tenant_id", "document_id", "claim_id"]
        grow = lambda old, new, name: settled(new if old is None else old.join(new.select(*keys).distinct(), keys, "left_anti").select(*new.columns).unionByName(new), name)
        claims = settled(claims, "claims")
        now = self.store.verify(claims, self.metrics, self.tolerance)
        self.verdicts, self.index, self.claims = grow(self.verdicts, now, "verdicts"), grow(self.index, self._indexed(claims), "index"), grow(self.claims, claims, "claims")

    def touched(self, facts: DataFrame, since: str | None = None) -> DataFrame:
        """Ids of the claims that a batch of facts may turn: those that read a scope of it."""
        keys = ["tenant_id", "document_id", "claim_id"]
        found = self.index.join(facts.select(*SCOPE).distinct(), SCOPE, "left_semi").select(*keys).distinct()
        return found if since is None else found.join(self.claims.filter(F.col("seen") >= since).select(*keys), keys, "left_semi")

    def add_facts(self, facts: DataFrame, since: str | None = None) -> DataFrame:
        """Facts that arrive: taken into the store, and the claims that read them verified again. Gives the new verdicts of those."""
        keys = ["tenant_id", "document_id", "claim_id"]
        facts = settled(facts, "arrived")
        self.store.add(facts)
        ids = settled(self.touched(facts, since), "touched")
        again = settled(self.store.verify(self.claims.join(ids, keys, "left_semi").select(*self.claims.columns), self.metrics, self.tolerance), "again")
        self.verdicts = settled(self.verdicts.join(ids, keys, "left_anti").select(*again.columns).unionByName(again), "verdicts")
        return again
