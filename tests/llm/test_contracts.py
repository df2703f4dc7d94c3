from __future__ import annotations

import os
import re

import duckdb
import pytest

from emberlog.llm import neardup, registry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({registry.ORACLE[name]})").fetchall()
    show = lambda rows: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)
    assert show(tuple(r) for r in got.select(cols).collect()) == show(want)


def test_near_copies_equal_all_pairs(spark):
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(base[: 60 - k] + [f"x{k}"] * k)) for k in range(12)] + [(30, None), (31, ""), (32, "a b"), (33, "A  b"), (34, "a b c")]
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = neardup.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(d, len(s), root[d], root[d] == d) for d, s in sets.items()}
