"""Recent names in keyed state: equal to the batch view after each batch and after a restart; state of sessions that are over goes."""

import datetime

from pyspark.sql import functions as F

from quern.operators import sessions
from quern.streaming import recent

DAY = datetime.datetime(2024, 1, 1)
SCHEMA = "id bigint, session_id string, skill_name string, timestamp timestamp"


def test_against_the_log(spark, tmp_path):
    log = f"{tmp_path}/in"
    uses = [(i, f"s{i * 7 % 5}", f"n{i * i % 11}", DAY + datetime.timedelta(minutes=i)) for i in range(300)]
    state = []
    for a, z in ((0, 120), (120, 130), (130, 300)):
        spark.createDataFrame(uses[a:z], SCHEMA).coalesce(1).write.mode("append").parquet(log)
        stream = spark.readStream.schema(SCHEMA).parquet(log)
        query = recent.kept(stream, f"{tmp_path}/view", f"{tmp_path}/ck", n=3)
        query.awaitTermination(120)
        assert query.lastProgress["numInputRows"] in (0, z - a)  # the old log isn't read again; a last empty batch moves the watermark
        state.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        want = sessions.recent_skills(spark.createDataFrame(uses[:z], SCHEMA), 3)
        got = recent.recent_skills(spark, f"{tmp_path}/view")
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.select("session_id", "place", "skill_name", "id").collect()}
    assert state[-1] > 5


def test_sessions_that_are_over(spark, tmp_path):
    log, held = f"{tmp_path}/in", []
    batches = [
        [(i, f"s{i % 4}", f"n{i}", DAY + datetime.timedelta(minutes=i)) for i in range(40)],
        [(100, "s0", "later", DAY + datetime.timedelta(days=3))],
        [(101, "s1", "again", DAY + datetime.timedelta(days=3, hours=1)), (102, "s9", "far", DAY + datetime.timedelta(days=3, hours=2))],
    ]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(log)
        query = recent.kept(spark.readStream.schema(SCHEMA).parquet(log), f"{tmp_path}/view", f"{tmp_path}/ck", n=2)
        query.awaitTermination(120)
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert held[0] >= 40 and held[-1] < 15, held  # the forty names of the first day are gone
    got = {r.session_id: r.skill_name for r in recent.recent_skills(spark, f"{tmp_path}/view").where(F.col("place") == 1).collect()}
    assert got["s0"] == "later" and got["s1"] == "again" and got["s9"] == "far"
    assert recent.recent_skills(spark, f"{tmp_path}/view").where("session_id = 's1'").count() == 1  # it began anew
