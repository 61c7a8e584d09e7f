"""The context of a day within its bounds; feed and links."""

from datetime import datetime, timedelta

from tessera.operators import feeds

NOW = datetime(2024, 1, 2, 12, 0)
CAPTURE = "scope string, id long, content string, created_at timestamp, processed boolean"
BATCH = "scope string, place long, content string, created_at timestamp"


def by_hand(captures, batch):
    out = {}
    for scope in {b[0] for b in batch}:
        prior = [c for c in captures if c[0] == scope and c[4] and c[3] >= NOW - timedelta(hours=24)]
        prior = sorted(prior, key=lambda c: (c[3], c[1]))[-80:]
        rows = [(c[2], c[3], "consolidated") for c in prior] + [(b[2], b[3], "pending") for b in sorted((b for b in batch if b[0] == scope), key=lambda b: b[1])]
        lines, used = [feeds.HEADER], 0
        for text, at, phase in rows:
            line = f"[{at:%Y-%m-%d %H:%M} · {phase}] {' '.join((text or '').split())}"
            if used + len(line) > 8000:
                lines.append(feeds.CUT)
                break
            lines.append(line)
            used += len(line)
        out[scope] = None if len(rows) <= 1 else "\n".join(lines)
    return out


def test_day_context(spark):
    captures = [("many", i, f"capture\n {i} ", NOW - timedelta(minutes=10 * i), True) for i in range(200)]
    captures += [("long", i, f"{i} " * 900, NOW - timedelta(minutes=i), True) for i in range(9)] + [("many", 500, "raw", NOW, False), ("old", 1, "x", NOW - timedelta(hours=25), True), ("edge", 1, None, NOW - timedelta(hours=24), True), ("unasked", 1, "x", NOW, True)]
    batch = [("many", 2, "second", NOW), ("many", 1, "first", NOW), ("long", 1, "never seen", NOW), ("old", 1, "alone", NOW), ("edge", 1, "with one", NOW), ("huge", 1, "y" * 9000, NOW), ("huge", 2, "z", NOW)]
    found = feeds.day_context(spark.createDataFrame(captures, CAPTURE), spark.createDataFrame(batch, BATCH), NOW)
    assert {r["scope"]: r["context"] for r in found.collect()} == by_hand(captures, batch)


def test_feed_and_resources(spark):
    rows = [(1, datetime(2024, 1, 1), None, None), (2, datetime(2024, 1, 2), "", NOW), (3, datetime(2024, 1, 2), "failed", NOW), (4, datetime(2023, 1, 1), "queued", None)]
    c = spark.createDataFrame(rows, "id long, created_at timestamp, status string, processed_at timestamp")
    assert [(r["id"], r["status"]) for r in feeds.feed(c).collect()] == [(3, "failed"), (2, "processed"), (1, "queued"), (4, "queued")]
    assert feeds.feed(c, -5).count() == 1
    links = spark.createDataFrame([(1, "u", 1, "a"), (2, "v", 2, "b"), (3, "w", 3, None)], "id long, url string, created_at int, entity_id string")
    e = spark.createDataFrame([("a", "A", "tool", None), ("b", "B", "tool", "a")], "id string, canonical_name string, type string, merged_into_id string")
    assert {(r["id"], r["entity_name"]) for r in feeds.resources(links, e, 2).collect()} == {(3, None), (2, None)} and feeds.resources(links, e).count() == 3
