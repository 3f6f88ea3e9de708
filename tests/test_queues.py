import datetime

from lexmill.operators import queues


def test_queues_hold_all_rows_unless_limited(spark):
    rows = [(f"c{i % 12}", 2000, i, "pending" if i % 2 else "downloaded", "2020-01-01" if i % 4 else "2024-05-01", f"{1000 - i:04}" if i % 3 else None) for i in range(600)]
    cases = spark.createDataFrame(rows, "court string, yr int, number int, status string, dt string, pending_stamp string")
    stamped = sorted((r[5], r[2]) for r in rows if r[3] == "downloaded" and r[5])
    assert [r.number for r in queues.recheck_queue(cases).collect()] == [n for _, n in stamped] and len(stamped) > 50
    assert [r.number for r in queues.recheck_queue(cases, limit=5).collect()] == [n for _, n in stamped[:5]]
    assert {r.dt for r in queues.recheck_queue(cases, 0, 100, datetime.date(2024, 6, 1)).collect()} == {"2024-05-01"}
    pending = {r[2] for r in rows if r[3] == "pending"}
    assert {r.number for r in queues.pending_cases(cases).collect()} == pending == {r.number for r in queues.claim_batch(cases).collect()}
    assert {r.court for r in queues.pending_cases(cases, ["c1"]).collect()} == {"c1"}
    assert queues.claim_batch(cases, 100).count() == 100 and len(pending) > 100
