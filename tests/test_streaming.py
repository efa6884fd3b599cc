from pyspark.sql import functions as F

from strandline.streaming import events


def test_stream_equals_batch(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    table.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in")
    forms = {
        "w": lambda d: events.sliding_sums(d, "ts", "value", "2 hours", "1 hour", "1 day", ["event_type"]).select("event_type", F.unix_micros("window.start").alias("t"), "n"),
        "s": lambda d: events.sessions(d, "ts", "value", "1 day", "1 day", ["user_id"]).select("user_id", F.unix_micros("session_window.start").alias("t"), "n"),
    }
    for name, form in forms.items():
        events.write_once(form(stream), f"{tmp_path}/out{name}", f"{tmp_path}/ck{name}").awaitTermination()
        whole = {tuple(r) for r in form(table).collect()}
        settled = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out{name}").collect()}
        # windows before the watermark are out, the last ones still wait
        assert settled and settled <= whole and len(settled) > 0.5 * len(whole)
    once = events.first_of_key(stream, "ts", ["user_id", "event_type"], "60 days")
    events.write_once(once, f"{tmp_path}/outd", f"{tmp_path}/ckd").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/outd").count() == table.select("user_id", "event_type").distinct().count()
