import datetime

from weftgraph.operators import logic
from weftgraph.streaming import gates as stream


def run_stream(spark, frame, build, mode="append"):
    query = build(frame).writeStream.format("memory").queryName("found").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table("found").collect()


def test_layer_of_gates_equals_the_batch_simulation(spark, tmp_path):
    gates = spark.createDataFrame([(0, "and2", "x", "a", "b", 2), (1, "xor2", "y", "b", "c", 1)], "gate long, fn string, out string, in1 string, in2 string, delay long")
    rows = [("a", 0, "0"), ("b", 0, "1"), ("c", 0, "1"), ("a", 3, "1"), ("c", 4, "0"), ("b", 6, "0"), ("a", 9, "0")]
    for k, part in enumerate((rows[:3], rows[3:5], rows[5:], [(n, 99, None) for n in "abc"])):
        spark.createDataFrame([(n, t, v, -1) for n, t, v in part], "net string, time long, value string, sender long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    events = spark.readStream.schema("net string, time long, value string, sender long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = run_stream(spark, events, lambda e: stream.run_gates(stream.routed(e, gates)))
    last = {}
    for r in sorted(got, key=lambda r: r.time):
        last[r.net] = r.value
    batch = logic.simulate(gates, spark.createDataFrame(rows, "net string, time long, value string"))
    assert last == {r.net: r.value for r in batch.collect() if r.net in "xy"}


def test_late_events_are_an_error():
    gate = {"fn": "buf", "out": "o", "delay": 1, "last": [-1], "value": ["X"], "wait": []}
    assert stream._step(gate, [(3, -1, 0, "1")]) == [(4, "1")]
    try:
        stream._step(gate, [(2, -1, 0, "0")])
    except ValueError:
        return
    raise AssertionError


def test_windows(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    rows = [(base + datetime.timedelta(minutes=7 * k), "ab"[k % 2]) for k in range(60)]
    spark.createDataFrame(rows, "ts timestamp, event_type string").write.parquet(f"{tmp_path}/ev")
    events = spark.readStream.schema("ts timestamp, event_type string").parquet(f"{tmp_path}/ev")
    got = run_stream(spark, events, stream.activity, "complete")
    assert sum(r.n for r in got) == 60
