"""Streams in several micro-batches: bounded state, corrections across windows, a keyed table that survives a restart."""

import datetime

from tallyscope.sources import sinks
from tallyscope.streaming import jobs

_START = datetime.datetime(2024, 1, 1)


def at(hours):
    return _START + datetime.timedelta(hours=hours)


def run(spark, batches, schema, build, folder):
    """Everything emitted, and the rows of state after each micro-batch; the last one only moves the watermark on."""
    states = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        out = build(spark.readStream.schema(schema).parquet(f"{folder}/in"))
        q = out.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        states.append(sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"]))
    return spark.read.schema(out.schema).parquet(f"{folder}/rows"), states


def test_transfers_are_corrected_without_kept_state(spark, tmp_path):
    schema = "fto string, account string, ts timestamp, amount double"
    pay = lambda fto, account, hour: (fto, account, at(hour), 10.0)
    batches = [
        # rapid; one account; no account; rapid until a payment of the third batch
        [pay("a", "x", 1), pay("a", "y", 2), pay("b", "x", 1), pay("b", "x", 3), pay("c", None, 1), pay("c", "x", 2), pay("d", "x", 5), pay("d", "y", 6)] + [pay(f"o{i}", "x", 1) for i in range(200)],
        # the second payment of e comes late, but in time; it lies in another window than the first
        [pay("e", "x", 47), pay("f", "x", 47.5)],
        [pay("e", "y", 48.5), pay("d", "z", 200), pay("g", "x", 200), pay("g", "y", 224)] + [pay(f"p{i}", "x", 200) for i in range(5)],
        [pay("end", "x", 9999)],
        [pay("end", "x", 9999)],
    ]
    parts, states = run(spark, batches, schema, lambda s: jobs.rapid_transfers(s, "fto", "account", "ts", "amount"), str(tmp_path))
    got = {r["fto"]: r for r in jobs.rapid_verdicts(parts, "fto").collect()}
    assert {k for k, r in got.items() if r["rapid"]} == {"a", "e", "g"}
    assert (got["d"]["payments"], got["d"]["span_hours"], got["d"]["total_amount"]) == (3, 195.0, 30.0)
    # orders of windows that have passed are gone
    assert states[0] == 204 and max(states[1:]) < 210 and states[-1] == 1
    # a compacted registry says the same
    folded = jobs.folded_transfers(parts, "fto")
    assert {r["fto"]: r for r in jobs.rapid_verdicts(folded, "fto").collect()} == got and folded.count() == len(got)


def test_hashes_are_found_across_windows(spark, tmp_path):
    schema = "h string, work string, ts timestamp"
    batches = [
        [("a", "w1", at(1)), ("b", "w1", at(1)), ("b", "w1", at(2)), ("c", "w1", at(3)), ("c", "w2", at(3)), (None, "w1", at(1)), (None, "w2", at(1))] + [("hot", "w1", at(1))] * 5000,
        [("a", "w2", at(3000)), ("b", "w1", at(3000))],
        [("end", "w", at(9999))],
        [("end", "w", at(9999))],
    ]
    seen, states = run(spark, batches, schema, lambda s: jobs.hash_sightings(s, "h", "work", "ts"), str(tmp_path))
    got = {tuple(r)[:3] for r in jobs.reused_hashes(seen, "h").collect()}
    assert got == {("a", "w1", "w2"), ("c", "w1", "w2")}
    assert states[0] == 4 and states[-1] == 1


def test_keyed_table_rewrites_touched_buckets_and_survives_a_restart(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, v string, note string").schema
    current = spark.range(100).selectExpr("id AS k", "'old' AS v", "'kept' AS note")
    table = sinks.KeyedTable(spark, f"{tmp_path}/table", ("k",), schema, 8)
    table.create(current)
    assert table.manifest() == (0, {b: 0 for b in range(8)})
    rows = "k long, v string, note string, seq long"
    stream = lambda: spark.readStream.schema(rows).parquet(f"{tmp_path}/in")

    def land(*values):
        spark.createDataFrame(values, rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        # a table object of its own each time, as after a restart
        again = sinks.KeyedTable(spark, f"{tmp_path}/table", ("k",), schema, 8)
        jobs.merge_stream(stream(), again, ["v"], ["seq"], f"{tmp_path}/state").awaitTermination()
        return again

    land((5, "first", "x", 1), (5, "second", "x", 2), (500, "new", "y", 1))
    second = land((5, "third", "x", 3))
    version, held = second.manifest()
    assert version == 2 and sum(v == 2 for v in held.values()) == 1 and sum(v == 1 for v in held.values()) <= 2
    got = {r["k"]: (r["v"], r["note"]) for r in second.read().collect()}
    assert got == {**{k: ("old", "kept") for k in range(100)}, 5: ("third", "kept"), 500: ("new", "y")}
    # a batch that was committed before a stop is run again, and changes nothing
    second.merge(spark.createDataFrame([(5, "replayed", "x", 9)], rows), ["v"], ["seq"], 2)
    assert second.manifest() == (version, held) and {r["v"] for r in second.read().filter("k = 5").collect()} == {"third"}
    # what a stopped writer left without a manifest is not seen, and is written over
    spark.range(3).selectExpr("id AS k", "'torn' AS v", "'torn' AS note", "0L AS bucket").write.partitionBy("bucket").parquet(f"{tmp_path}/table/data/version=3")
    assert second.read().filter("v = 'torn'").count() == 0
    second.merge(spark.createDataFrame([(6, "fourth", "x", 9)], rows), ["v"], ["seq"], 3)
    assert {(r["k"], r["v"]) for r in second.read().filter("v IN ('torn', 'fourth')").collect()} == {(6, "fourth")}
    empty = sinks.KeyedTable(spark, f"{tmp_path}/empty", ("k",), schema, 8)
    empty.create(current.limit(0))
    assert empty.read().count() == 0
    empty.merge(spark.createDataFrame([(1, "a", "b", 1)], rows), ["v"], ["seq"], 1)
    assert [tuple(r) for r in empty.read().collect()] == [(1, "a", "b")]
