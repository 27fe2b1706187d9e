"""Owners of engines' states: reasons of a loss, idle states told once, and starts between rows."""

import datetime

from convlake.streaming import journal, owners

T0 = datetime.datetime(2024, 1, 1)
H = 3600


def told(spark, path, *batches, **options):
    """(engine, seconds, what, conv, tokens) of rows (engine, seconds, conv, started, requests, tokens, loaded), in a start for each batch."""
    seq = 0
    with owners.state_in_rocksdb(spark):
        for batch in batches:
            rows = [(e, None if s is None else T0 + datetime.timedelta(seconds=s), (seq := seq + 1), *r) for e, s, *r in batch]
            spark.createDataFrame(rows, owners.INPUT).coalesce(1).write.mode("append").parquet(f"{path}/in")
            found = owners.owners(spark.readStream.schema(owners.INPUT).parquet(f"{path}/in"), **options)
            journal.drain(found, f"{path}/progress", f"{path}/out")
    return sorted((r.engine, (r.at - T0).total_seconds(), r.what, r.conv, r.tokens) for r in spark.read.parquet(f"{path}/out").collect())


def test_reasons_of_a_loss(spark, tmp_path):
    big, look = 20_000, None
    own = lambda e, conv, s=0, tokens=10: (e, s, conv, 1, 5, tokens, True)
    rows = [
        own(1, 71), (1, 10, look, 1, 5, None, True), (1, 20, look, 1, 4, None, None), (1, 30, look, 1, 6, None, True), (1, 40, look, 2, 9, None, False),  # told once
        own(2, 72), (2, 10, look, 2, 5, None, True), own(3, 73), (3, 10, look, 1, 5, None, False), own(4, 2**60 + 1), own(4, 74, 20), (4, 30, look, 1, 7, None, True),
        (5, 0, look, 1, 5, None, False), (6, 0, 76, None, None, None, None), (6, 10, look, 3, 8, None, True), own(7, 77), (7, 5, look, 1, None, None, True),
        (None, 5, 70, 1, 5, big, True), (8, None, 70, 1, 5, big, True), own(9, 2**60 + 1), (9, 1, look, None, 5, None, True),
    ]
    expected = [(1, 30, "foreign request", 71, 10), (2, 10, "restarted", 72, 10), (3, 10, "unloaded", 73, 10), (4, 30, "foreign request", 74, 10), (7, 5, "foreign request", 77, 10), (9, 1, "restarted", 2**60 + 1, 10)]
    assert told(spark, tmp_path / "a", rows) == expected
    assert told(spark, tmp_path / "b", *([r] for r in rows[:4]), rows[4:]) == expected


def test_idle_states_are_told_once(spark, tmp_path):
    own = lambda e, s, conv, tokens=16_384: (e, s, conv, 1, 5, tokens, True)
    look = lambda e, s, requests=5: (e, s, None, 1, requests, None, True)
    first = [own(1, 0, 71), look(1, 200), look(1, 400), own(2, 0, 72), look(2, 179, 6), own(3, 0, 73, 16_383), look(3, 900), own(4, 0, 74), own(4, 180, 75), own(5, 0, 76), own(6, 100, 77), look(6, 150)]
    later = [look(6, 3 * H), look(3, 3 * H)]
    got = told(spark, tmp_path, first, later, [look(1, 4 * H)])
    # engines 4 and 5 fall silent: timers tell; no row is told twice
    assert got == [(1, 180, "idle", 71, 16_384), (2, 179, "foreign request", 72, 16_384), (4, 180, "idle", 74, 16_384), (4, 360, "idle", 75, 16_384), (5, 180, "idle", 76, 16_384), (6, 280, "idle", 77, 16_384)]


def test_the_sessions_provider_comes_back(spark):
    before = spark.conf.get(owners.PROVIDER, None)
    with owners.state_in_rocksdb(spark):
        assert spark.conf.get(owners.PROVIDER) == owners.ROCKSDB
    assert spark.conf.get(owners.PROVIDER, None) == before
