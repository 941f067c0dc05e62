"""Who is told of a match: subscribers of an id, and those who want every match.

subscribers: subscriber_id, kind (how it is reached), sub_id (null: every match).  A subscriber of an id gets the event's
text once for each event that matches; one of every match gets {"id": ..., "event": ...} once for each matched id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Subscribers of every match that one delivery can have; they are broadcast.
LISTENERS = 100_000
#: Tasks that may share the matches of one rule; as many as a bigint has bits.
SALTS = 64


def subscribed(subscribers: DataFrame) -> DataFrame:
    """Subscribing again changes nothing."""
    return subscribers.select("subscriber_id", "kind", F.col("sub_id").cast("decimal(20,0)").alias("sub_id")).dropDuplicates()


def catch_all_payload(sub_id: Column, payload: Column) -> Column:
    """The event is embedded as it is if it was JSON, else as a string."""
    quoted = F.substring(F.to_json(F.struct(payload.alias("e"))), 6, 2147483647)
    quoted = F.substring(quoted, F.lit(1), F.length(quoted) - 1)
    event = F.when(F.startswith(F.ltrim(payload), F.lit("{")), payload).otherwise(quoted)
    return F.concat(F.lit('{"id":'), sub_id.cast("string"), F.lit(',"event":'), event, F.lit("}"))


def deliver(matches: DataFrame, events: DataFrame, subscribers: DataFrame) -> DataFrame:
    """subscriber_id, kind, event_id, sub_id, message.  matches: event_id, sub_id; events: event_id, payload."""
    own = subscribed(subscribers)
    told = matches.select("event_id", F.col("sub_id").cast("decimal(20,0)").alias("sub_id")).join(events.select("event_id", "payload"), "event_id")
    # one rule may match any share of the events: its matches are spread, and its subscribers sent to the salts that occur
    salted = told.withColumn("salt", F.pmod(F.xxhash64("event_id"), F.lit(SALTS)).cast("int"))
    asked = salted.groupBy("sub_id").agg(F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts")).join(own.where("sub_id IS NOT NULL"), "sub_id")
    asked = asked.withColumn("salt", F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit("salts", i) == 1))).drop("salts")
    one = salted.join(asked, ["sub_id", "salt"]).select("subscriber_id", "kind", "event_id", "sub_id", F.col("payload").alias("message"))
    # every match goes to every such subscriber: as many rows as messages are asked for
    every = F.collect_list(F.struct("subscriber_id", "kind"))
    listeners = own.where("sub_id IS NULL").agg(F.sort_array(every).alias("who")).withColumn("k", F.lit(1))
    listeners = listeners.where(F.assert_true(F.size("who") <= LISTENERS, F.lit("too many subscribers of every match")).isNull())
    all_ = told.withColumn("k", F.lit(1)).join(F.broadcast(listeners), "k").select("event_id", "sub_id", "payload", F.explode("who").alias("w"))
    all_ = all_.select("w.subscriber_id", "w.kind", "event_id", "sub_id", catch_all_payload(F.col("sub_id"), F.col("payload")).alias("message"))
    return one.unionByName(all_)
