"""Queries of streams that stop and go on."""

from __future__ import annotations

from fluvia.plans.registry import table
from fluvia.storage import new_folder
from fluvia.streaming import resume

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Clicks land in three goes, by when they arrived.
LANDINGS = ("arrived_at < timestamp_ntz '2024-02-10'", "arrived_at >= timestamp_ntz '2024-02-10' and arrived_at < timestamp_ntz '2024-03-20'", "arrived_at is null or arrived_at >= timestamp_ntz '2024-03-20'")


def resumed_composite(spark, d):
    """Days and kinds of clicks, each click once, by a stream that is started anew for each landing. Clicks arrive
    within three days of their time, so none is later than the four days that the stream waits."""
    landed, folder = new_folder(spark, "landed"), new_folder(spark, "resumed")
    for which in LANDINGS:
        table(spark, d, "clicks").where(which).write.mode("append").parquet(landed)
        resume.advance(spark, landed, folder, "ts", "kind", "value", ["click_id"], "4 days")
    return resume.composites(spark, folder)


QUERIES["resumed_composite"] = resumed_composite
ORACLE_SQL["resumed_composite"] = """SELECT strftime(ts, '%Y-%m-%d') AS day, kind, count(*) AS n, round(avg(value), 6) AS mean
    FROM (SELECT DISTINCT ON (click_id) click_id, ts, kind, value FROM clicks WHERE ts IS NOT NULL) GROUP BY ALL"""
