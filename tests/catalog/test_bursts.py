import random

from mediacat.operators import sequences
from mediacat.sources.store import Store
from mediacat.streaming import bursts

SCHEMA = "id long, parent_path string, date_taken long"


def made_up(draw, n):
    t, out = 1_000_000, []
    for i in range(n):
        t += draw.choice([0, 5, 1000, 3000, 3001, 9000])
        out.append((i, draw.choice("aab"), t))
    return [*out, (n, "a", 0), (n + 1, "a", 0)]


def plain(images, gap=3000):
    out, group, last = [], [], None
    for i, folder, t in sorted(images, key=lambda r: (r[2], r[0])):
        if last and folder == last[1] and t > 0 and last[2] > 0 and t - last[2] <= gap:
            group.append((i, folder, t))
        else:
            out.append(group)
            group = [(i, folder, t)]
        last = (i, folder, t)
    return sorted((g[0][0], len(g), g[0][1], g[0][2], g[-1][2]) for g in [*out, group] if len(g) > 1)


def test_any_split_gives_the_batch_result(spark, tmp_path):
    draw = random.Random(4)
    images = made_up(draw, 120)
    want = plain(images)
    assert sorted(map(tuple, sequences.bursts(spark.createDataFrame(images, SCHEMA)).collect())) == want and len(want) > 5
    delay = 20_000
    come = sorted(images, key=lambda r: r[2] + draw.randrange(delay // 2))  # out of order, by less than the delay
    store = bursts.burst_store(Store(spark, f"file://{tmp_path}/store"), buckets=2)
    cuts = [0, *sorted(draw.sample(range(1, len(come)), 4)), len(come)]
    held = []
    for number, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        with store.change("w", number) as change:
            bursts.advance(change, spark.createDataFrame(come[a:b], SCHEMA), delay)
        state = store.read("open").first()
        held += [r.date_taken > state.closed for r in store.read("pending").collect()]
        done = set(map(tuple, store.read("bursts").collect()))
        assert all(g in want for g in done if g[4] < state.closed - 3000)
    with store.change() as change:
        bursts.advance(change, None, delay, to_end=True)
    assert all(held) and store.read("pending").count() == 0
    assert sorted(map(tuple, store.read("bursts").collect())) == want and store.read("late").count() == 0


def test_late_images_are_named_and_change_nothing(spark, tmp_path):
    store = bursts.burst_store(Store(spark, f"file://{tmp_path}/store"), buckets=1)
    for number, batch in enumerate([[(1, "a", 1000), (2, "a", 2000), (3, "a", 90_000)], [(4, "a", 2500)], []]):
        with store.change("w", number) as change:
            bursts.advance(change, spark.createDataFrame(batch, SCHEMA), 10_000)
    assert [r.id for r in store.read("late").collect()] == [4]
    assert [tuple(r) for r in store.read("bursts").collect()] == [(1, 2, "a", 1000, 2000)]


def test_images_of_one_time_do_not_meet_in_one_task(spark):
    rows = spark.range(20_000).selectExpr("id", "'a' as parent_path", "1000L as date_taken")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sequences.burst_rows(rows)
        assert got.select("group").distinct().count() == 1
        ranges = rows.repartitionByRange("date_taken", "id").selectExpr("spark_partition_id() as p").groupBy("p").count().collect()
        assert len(ranges) > 1 and max(r["count"] for r in ranges) < 15_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ranges_have_a_bounded_number_of_images(spark, monkeypatch):
    """Adaptive execution does not join ranges, however few bytes they have."""
    monkeypatch.setattr(sequences, "RANGE_ROWS", 100)
    rows = spark.range(2000).selectExpr("id", "'a' as parent_path", "1000L as date_taken")
    got = sequences.burst_rows(rows).selectExpr("spark_partition_id() as p").groupBy("p").count().collect()
    assert sum(r["count"] for r in got) == 2000 and max(r["count"] for r in got) < 1000
