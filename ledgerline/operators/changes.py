"""Applying a stream of inserts, updates and deletes (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerline.functions.ids import heavy_keys, norm_id, skew_join
from ledgerline.sources.shared import materialize

CREATES = ["ASSET_REGISTERED", "FINDING_OPENED", "JOB_ENQUEUED"]
IGNORED = ["OBSERVATION_ADDED"]
FACTS = ["entity_id", "fact", "item"]


SETTLED = ["event_id", "sequence", "event_type", "entity_id", "payload_json"]


def settled_events(events: DataFrame | None, base: DataFrame | None = None) -> DataFrame:
    """Events whose payload matches its hash, one per event_id: that with the lowest sequence; with those of a base.

    The result is the base of a later batch: the minimum is commutative, associative and idempotent, so an event_id that
    is sent again with another sequence is settled in whatever batch it comes. All winners are kept, not only what they
    leave in the state: when one gives way to a lower sequence, what it had overwritten counts again.
    The minimum of a struct is combined on the map side, so an event sent very often is no hot key. Rows without an
    event_id or sequence can't be ordered and don't count.
    """
    good = None if base is None else base.select(*SETTLED)
    if events is not None:
        payload = F.when(~F.col("event_type").isin(IGNORED) & ~F.col("event_type").like("%\\_WITHDRAWN"), F.col("payload_json"))
        sound = events.where(F.sha2(F.col("payload_json"), 256) == F.col("payload_hash"))
        sound = sound.select(norm_id("event_id").alias("event_id"), "sequence", F.col("event_type").alias("event_type"), norm_id("entity_id").alias("entity_id"), payload.alias("payload_json")).where("event_id is not null and sequence is not null")
        good = sound if good is None else sound.unionByName(good)
    return good.groupBy("event_id").agg(F.min(F.struct(*SETTLED[1:])).alias("e")).select("event_id", "e.*")


def named_events(settled: DataFrame) -> DataFrame:
    """Settled events that have an entity and a type; the others win over repeats of theirs, but say nothing."""
    return settled.where("entity_id is not null and event_type is not null")


def sound_events(events: DataFrame) -> DataFrame:
    """The settled events of one table that have an entity and a type."""
    return named_events(settled_events(events))


def change_facts(events: DataFrame) -> DataFrame:
    """What each event says: facts (entity_id, fact, item, change) that a commutative fold can merge.

    `remove` - the entity went (one item); `create` - it was created (item: the sequence, as each creation may turn
    out to be the first after a removal that comes late); `field` - a top-level field was set (item: its name).
    change is struct(sequence, operation, value); the greater sequence wins.
    """
    live = events.where(~F.col("event_type").isin(IGNORED))
    change = lambda op, value: F.struct("sequence", F.lit(op).alias("operation"), value.cast("string").alias("value")).alias("change")
    gone = live.where(F.col("event_type").like("%\\_WITHDRAWN")).select("entity_id", F.lit("remove").alias("fact"), F.lit("").alias("item"), change("remove", F.lit(None)))
    made = live.where(F.col("event_type").isin(CREATES)).select("entity_id", F.lit("create").alias("fact"), F.col("sequence").cast("string").alias("item"), change("create", F.lit(None)))
    fields = live.where(~F.col("event_type").like("%\\_WITHDRAWN")).select("entity_id", "sequence", F.explode(F.from_json("payload_json", "map<string,string>")).alias("item", "value"))
    fields = fields.select("entity_id", F.lit("field").alias("fact"), "item", change("set", F.col("value")))
    return gone.unionByName(made).unionByName(fields)


def fold_changes(facts: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Merge facts, and the facts of a base table, by the maximum of struct(sequence, operation, value) per key.

    The fold is commutative, associative and idempotent: order, repetition and batching don't matter. Tombstones
    (`remove`) and creations stay in the result, so its output is the base of a later batch, however late that comes.
    It keeps no event_ids: where one may be sent again with another sequence, batches are merged by settled_events().
    """
    rows = facts.select(*FACTS, "change")
    if base is not None:
        rows = rows.unionByName(base.select(*FACTS, "change"))
    return rows.groupBy(*FACTS).agg(F.max("change").alias("change"))


def current_fields(folded: DataFrame) -> DataFrame:
    """Fields of the entities that exist: entity_id, field_name, sequence, value.

    An entity exists if it was created after its last removal; only fields set since that creation count.
    """
    seq = F.col("change.sequence")
    gone = folded.where("fact = 'remove'").select("entity_id", seq.alias("gone_at"))
    made = folded.where("fact = 'create'").select("entity_id", seq.alias("made_at"))
    heavy = heavy_keys(made, ["entity_id"], made.count())
    both = skew_join(made, gone.withColumnRenamed("entity_id", "g_id"), "entity_id", "g_id", heavy, "left")
    since = both.where("gone_at is null or made_at > gone_at").groupBy("entity_id").agg(F.min("made_at").alias("since"))
    fields = folded.where("fact = 'field'").select("entity_id", F.col("item").alias("field_name"), seq.alias("sequence"), F.col("change.value").alias("value"))
    return fields.join(since, "entity_id").where("sequence >= since").select("entity_id", "field_name", "sequence", "value")


def ledger_state(events: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Present fields of the ledger's entities; a field set to null is set. Empty inputs give no rows.

    base: settled_events() of the batches before.
    """
    return current_fields(materialize(fold_changes(change_facts(named_events(settled_events(events, base))))))
