import datetime as dt

from pyspark.sql import functions as F

from plotweld.plans import queries as engine
from plotweld.plans import surveying
from plotweld.streaming import reviews
from plotweld.streaming import versions as governing

DATA = "/root/testdata/sf0.001"


def drained(spark, df, mode, folder):
    query = df.writeStream.format("memory").queryName("drained").outputMode(mode).option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table("drained")


def test_stream_gives_the_rows_of_the_table(spark, tmp_path):
    table = spark.read.parquet(f"{DATA}/events.parquet")
    table.repartitionByRange(4, "ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    got = {tuple(r) for r in drained(spark, reviews.newest_status(stream), "complete", tmp_path / "a").collect()}
    assert got == {(r.user_id, r.status) for r in engine.QUERIES["review_actions_applied"](spark, DATA).collect()}
    got = {tuple(r) for r in drained(spark, reviews.action_counts(stream, late="100 days"), "complete", tmp_path / "b").collect()}
    want = table.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("s"), "event_type").count().collect()
    assert got == {tuple(r) for r in want}


def test_governed_stream_replays_the_table(spark, tmp_path):
    table = surveying.review_requests(spark.read.parquet(f"{DATA}/events.parquet"))
    ordered = table.orderBy("ts", "event_id").collect()
    for n in range(4):
        part = ordered[n * len(ordered) // 4 : (n + 1) * len(ordered) // 4]
        spark.createDataFrame(part + part[:20], table.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # some come twice
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted(map(tuple, drained(spark, governing.governed_stream(stream, "100 days"), "append", tmp_path / "c").collect()))
    assert got == sorted(map(tuple, governing.governed(table).collect())) and {r[-1] for r in got} == {True, False}


def test_late_events_are_dropped(spark, tmp_path):
    kind = "event_id bigint, parcel_id string, ts timestamp, requested string, role string"
    at = lambda day: dt.datetime(2024, 1, day)
    batches = [[(1, "p", at(10), "CANDIDATE", "SURVEYOR")], [(2, "p", at(12), "VALIDATED", "SURVEYOR"), (2, "p", at(12), "VALIDATED", "SURVEYOR")], [(3, "p", at(1), "REJECTED", "SURVEYOR"), (4, "p", at(13), "APPROVED", "AI_SERVICE")], [(5, "p", at(14), "APPROVED", "SURVEYOR"), (6, "p", at(14), None, None)]]
    for rows in batches:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.event_id: (r.status, r.version, r.accepted) for r in drained(spark, governing.governed_stream(stream, "1 day"), "append", tmp_path / "d").collect()}
    assert got == {1: ("CANDIDATE", 1, True), 2: ("VALIDATED", 2, True), 4: ("VALIDATED", 2, False), 5: ("APPROVED", 3, True), 6: ("APPROVED", 3, False)}
