"""Attributes as they were known at the time of an event.

Each event is joined with the attribute version that was the newest one known
at the event's time: among the versions of the same entity whose own date and
whose publication date both lie on or before the event date, the one with the
greatest own date, then publication date, then revision, then smallest id.

Plan
1. versions collapse to one row per (entity, day on which they became known).
   The best of a day is an algebraic maximum, so it combines before the
   shuffle, and afterwards an entity holds at most one row per calendar day,
   however many raw versions a hot entity has.
2. events collapse to distinct (entity, day), bounded in the same way.
3. entities are dealt into hash buckets; in each bucket an embedded DuckDB
   turns the day rows into current-state versions (a running maximum in order
   of availability, which resolves ties before the join) and answers the
   events with one ASOF LEFT JOIN.
4. the answers are joined back to the event rows on (entity, day); this is an
   ordinary equi-join that adaptive execution may split where a key is hot.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.session import plan_bytes, shuffle_partitions, spill_folder

#: Buckets per shuffle partition; a bucket is the unit handed to DuckDB.
BUCKETS_PER_PARTITION = 4
#: Bytes of input for which there is at least one bucket.
BUCKET_BYTES = 32 << 20
#: Memory that one embedded DuckDB may use before it spills.
DUCKDB_MEMORY = "384MB"

_ASOF_SQL = """
WITH current_state AS (
    SELECT entity_key, known_day,
           max({'own': own_day, 'pub': pub_day, 'rev': revision, 'nid': not_id})
               OVER (PARTITION BY entity_key ORDER BY known_day
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best
    FROM versions
), became_current AS (
    SELECT entity_key, known_day, best.nid AS nid
    FROM current_state
    QUALIFY lag(best.nid) OVER (PARTITION BY entity_key ORDER BY known_day) IS DISTINCT FROM best.nid
)
SELECT e.entity_key, e.event_day, c.nid
FROM events e ASOF LEFT JOIN became_current c
  ON e.entity_key = c.entity_key AND e.event_day >= c.known_day
"""

_ANSWER = "entity_key string, event_day date, nid bigint"
_ANSWER_ARROW = pa.schema([("entity_key", pa.string()), ("event_day", pa.date32()), ("nid", pa.int64())])
_connection = None


def _duckdb():
    """One connection for the life of a worker process."""
    global _connection
    if _connection is None:
        import duckdb

        _connection = duckdb.connect(config={"threads": "1", "memory_limit": DUCKDB_MEMORY, "temp_directory": spill_folder()})
    return _connection


def _answer_bucket(events: pa.Table, versions: pa.Table) -> pa.Table:
    if events.num_rows == 0 or versions.num_rows == 0:
        return _ANSWER_ARROW.empty_table()
    con = _duckdb()
    con.register("events", events)
    con.register("versions", versions)
    try:
        found = con.sql(_ASOF_SQL).to_arrow_table()
    finally:
        con.unregister("events")
        con.unregister("versions")
    return found.filter(pc.is_valid(found["nid"])).select(_ANSWER_ARROW.names).cast(_ANSWER_ARROW)


def entity(*parts: str):
    """An entity key that keeps its parts apart; null if any part is null.

    The length of every part but the last stands before it, so that no two
    different lists of parts give the same key.
    """
    cols = [F.col(p).cast("string") for p in parts]
    pieces = []
    for c in cols[:-1]:
        pieces += [F.length(c).cast("string"), F.lit(":"), c]
    return F.concat(*pieces, cols[-1])


def attach_known(
    events: DataFrame,
    versions: DataFrame,
    *,
    event_id: str,
    event_key: Sequence[str],
    event_day: str,
    version_id: str,
    version_key: Sequence[str],
    own_day: str,
    pub_day: str,
    revision: str,
    buckets: int | None = None,
) -> DataFrame:
    """(event_id, version_id) of each event for which a version was known.

    Keys may be column names of either table; extra or equally named columns
    do no harm, as both sides are projected first. An event with a null day or
    a null key part, and one without a known version, is left out. A version
    with a null own day, publication day, id or key part is never known. A null
    revision ranks below every revision. Event rows that repeat come out as
    often as they came in. Empty tables give an empty result.
    """
    ev = events.select(
        F.col(event_id).alias("event_id"), entity(*event_key).alias("entity_key"), F.col(event_day).cast("date").alias("event_day")
    ).where("entity_key is not null and event_day is not null")
    lowest = F.lit(-(2**63)).cast("long")
    ve = versions.select(
        entity(*version_key).alias("entity_key"),
        F.col(own_day).cast("date").alias("own_day"),
        F.col(pub_day).cast("date").alias("pub_day"),
        F.coalesce(F.col(revision).cast("long"), lowest).alias("revision"),
        # the complement reverses the order of ids without overflow
        F.bitwise_not(F.col(version_id).cast("long")).alias("not_id"),
    ).where("entity_key is not null and own_day is not null and pub_day is not null and not_id is not null")

    daily = (
        ve.groupBy("entity_key", F.greatest("own_day", "pub_day").alias("known_day"))
        .agg(F.max(F.struct("own_day", "pub_day", "revision", "not_id")).alias("best"))
        .select("entity_key", "known_day", "best.*")
    )
    asked = ev.select("entity_key", "event_day").distinct()

    # more data make more buckets, not larger ones
    n = buckets or max(BUCKETS_PER_PARTITION * shuffle_partitions(events.sparkSession), (plan_bytes(events) + plan_bytes(versions)) // BUCKET_BYTES)
    bucket = F.pmod(F.xxhash64("entity_key"), F.lit(n)).cast("int").alias("bucket")
    answers = (
        asked.select("entity_key", "event_day", bucket)
        .groupBy("bucket")
        .cogroup(daily.select("entity_key", "known_day", "own_day", "pub_day", "revision", "not_id", bucket).groupBy("bucket"))
        .applyInArrow(_answer_bucket, schema=_ANSWER)
    )
    out_type = versions.schema[version_id].dataType if version_id in versions.columns else T.LongType()
    return ev.join(answers, ["entity_key", "event_day"]).select(
        F.col("event_id").alias(event_id), F.bitwise_not("nid").cast(out_type).alias(version_id)
    )
