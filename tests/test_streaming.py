"""A stream of events gives what the same table gives at once."""

from framelark import streaming

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_stream_equals_table(spark):
    table = spark.read.parquet(EVENTS)
    for name, make in (("counts", streaming.tumbling_counts), ("sessions", streaming.sessions)):
        stream = make(spark.readStream.schema(table.schema).parquet(f"{EVENTS}*"), lateness="400 days")
        query = stream.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        query.awaitTermination(120)
        got, want = spark.table(name), make(table)
        assert want.count() > 0
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
