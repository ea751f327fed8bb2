"""Jobs over the driver's events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.plans.registry import query
from paperloom.sources.tables import table
from paperloom.streaming import jobs

_ASK = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in jobs.ASKS.items()) + " END"
_ALLOWED = "[" + ", ".join(f"'{a}>{b}'" for a, b in sorted(jobs.STEPS)) + "]"


#: The state machine as a recursion over a job's events.
@query(
    f"""WITH RECURSIVE e AS (SELECT user_id AS job, event_id, {_ASK} AS ask, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    r AS (SELECT job, 0::BIGINT AS k, '' AS state, 0 AS changes, 0 AS refused, -1::BIGINT AS last_event FROM (SELECT DISTINCT job FROM e)
      UNION ALL SELECT r.job, e.k, CASE WHEN list_contains({_ALLOWED}, state || '>' || coalesce(ask, '?')) THEN ask ELSE state END, changes + list_contains({_ALLOWED}, state || '>' || coalesce(ask, '?'))::INT, refused + (NOT list_contains({_ALLOWED}, state || '>' || coalesce(ask, '?')) AND coalesce(ask <> state, true))::INT, e.event_id FROM r JOIN e ON e.job = r.job AND e.k = r.k + 1)
    SELECT job, state, changes, refused, last_event FROM r QUALIFY row_number() OVER (PARTITION BY job ORDER BY k DESC) = 1"""
)
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.states_batch(table(spark, sf_dir, "events"))


_STAGE = "CASE event_id % 9 " + " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(jobs.STAGES)) + " ELSE 'OTHER' END"


@query(
    f"""WITH e AS (SELECT user_id AS job, list_position([{", ".join(f"'{s}'" for s in jobs.STAGES)}], {_STAGE}) AS r FROM events), m AS (SELECT job, max(r) AS r FROM e WHERE r > 0 GROUP BY job)
    SELECT job, [{", ".join(f"'{s}'" for s in jobs.STAGES)}][r] AS stage, (100 * (r - 1) // 5)::INT AS percent, r = 6 AS finished FROM m"""
)
def job_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = F.expr(_STAGE)
    return jobs.stages(table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), "event_id", stage.alias("stage")))


@query("SELECT event_id, ts, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def latest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing's limit is its feature."""
    return jobs.latest(table(spark, sf_dir, "events"), 80).select("event_id", "ts", "user_id", "event_type")


@query("WITH c AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) SELECT event_id, user_id, event_type FROM c WHERE before IS DISTINCT FROM event_type")
def progress_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.changes(table(spark, sf_dir, "events"))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.windowed(table(spark, sf_dir, "events"))


@query()
def recovered_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a restart makes of the jobs; the fold before it is job_states, which SQL checks."""
    return jobs.recovered(jobs.states_batch(table(spark, sf_dir, "events"))).groupBy("state", "error").agg(F.count("*").alias("jobs"))
