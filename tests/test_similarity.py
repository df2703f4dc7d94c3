from __future__ import annotations

import datetime
import difflib
import re

from emberlog import queries


def sequential(events: list[tuple]) -> list[tuple]:
    """Clusters of the event log by a plain loop over its templates, in the order of their first line."""
    level = {"error": "ERROR", "purchase": "WARN", "view": "DEBUG"}
    tails = (" timed out, retrying", " refused by peer", " done")
    lines = []
    for n, kind, user, value in events:
        said = f"{kind} of user {user}{tails[user % 3]} after {int(value // 1)} ms"
        lines.append((n + 1, level.get(kind, "INFO"), re.sub(r"\b[0-9]+\b", "N", said), said))
    seen: dict[tuple, str] = {}
    known: dict[str, list[str]] = {}
    for _, lv, t, _ in sorted(lines):
        if (lv, t) not in seen:
            scored = [(-difflib.SequenceMatcher(None, t, k).ratio(), k) for k in known.get(lv, [])]
            best = min(scored, default=(0, t))
            seen[lv, t] = best[1] if -best[0] >= 0.85 else t
            if seen[lv, t] == t:
                known.setdefault(lv, []).append(t)
    groups: dict[tuple, list] = {}
    for row in sorted(lines):
        groups.setdefault((row[1], seen[row[1], row[2]]), []).append(row)
    ranked = sorted(groups.items(), key=lambda g: (g[1][0][0], g[0]))
    return [(k + 1, lv, t, rows[0][3], len(rows), rows[0][0], rows[-1][0]) for k, ((lv, t), rows) in enumerate(ranked)]


def test_similar_templates_meet_as_in_a_sequential_reader(spark, tmp_path):
    kinds = ("signup", "click", "view", "error", "purchase", "signups", "klick")
    at = datetime.datetime(2024, 1, 1)
    events = [(n, kinds[(n * 5 + n // 7) % 7], n * 13 % 101, float(n * 7 % 997) + 0.5) for n in range(300)]
    rows = [(n, at + datetime.timedelta(seconds=n), kind, user, value) for n, kind, user, value in events]
    spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, user_id long, value double").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(map(tuple, queries.similarity_clusters(spark, str(tmp_path)).collect()))
    assert got == sequential(events)
    # by exact templates there are more
    assert len(got) < queries.event_clusters(spark, str(tmp_path))[1].count()
