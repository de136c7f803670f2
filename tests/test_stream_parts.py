from pyspark.sql import functions as F

from vettable.plans import catalog

SF = "/root/testdata/sf0.001"


def parts(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(4, F.xxhash64("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    return events, str(tmp_path)


def test_stream_reads_every_part_and_counts_late_rows(spark, tmp_path):
    events, sf = parts(spark, tmp_path)
    # The parts are shuffled, so rows of every day come after the watermark has passed it.
    got = {(r["window_start"], r["dataset_id"]): (r["rows"], r["missing_user_id"])
           for r in catalog.stream_quality(spark, sf).collect()}
    want = {}
    for day, kind, i, user in (events.select(F.expr("unix_date(cast(ts as date)) * 86400L"), "event_type", "event_id",
                                             "user_id").collect()):
        n, missing = want.get((day, kind), (0, 0))
        want[day, kind] = (n + 1, missing + (i % 23 == 0))
    assert got == want


def test_stream_gate_audits_every_part(spark, tmp_path):
    events, sf = parts(spark, tmp_path)
    got = catalog.stream_gate(spark, sf).collect()
    assert {r["batch_id"] for r in got} == {0, 1, 2, 3}
    assert sum(r["row_count"] for r in got) == events.count()


def test_a_table_of_one_file_is_one_batch(spark):
    got = catalog.stream_gate(spark, SF).collect()
    assert {r["batch_id"] for r in got} == {0}
