from __future__ import annotations

import difflib
import gzip
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from emberlog.functions import levels, text, times
from emberlog.operators import analysis, assemble, cluster, compare, evidence, filters, rules, timeline
from emberlog.plans import report, session
from emberlog.sources import lines as source
from emberlog.sources import packed

LOG = """2024-03-01 10:00:00.123 ERROR [db.pool] Failed to open '/var/x/y.db' id 0x7ff3
\tat com.acme.Pool.open(Pool.java:12)
Caused by: java.net.ConnectException: refused
2024-03-01 10:00:01 INFO [web] ok 12 items
  continued here

{"@timestamp":"2024-03-01T10:00:02Z","level":"error","service.name":"api","message":"boom","trace_id":"abcdef12","log":{"Level":"warn"},"error":{"message":"bad","type":"E1"}}
level=warn svc=x msg="db down" extra tail here
auth - login failed for 12
FATAL: all is lost
"""


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_lines_are_cut_like_splitlines(spark):
    body = "a\rb\r\nc\x0bd\x85e f\n"
    got = [r.raw for r in source.from_text(spark, body).orderBy("line_no").collect()]
    assert got == body.splitlines()


def test_entries_of_a_mixed_log(spark):
    e = {r.line_no: r for r in assemble.entries(source.from_text(spark, LOG)).collect()}
    assert (e[1].level, e[1].module, e[1].last_line_no, len(e[1].stack), e[1].next_start) == ("ERROR", "db.pool", 3, 2, 4)
    assert e[4].message_extra == ["continued here"] and e[4].full_message == "ok 12 items continued here"
    assert (e[7].level, e[7].module, e[7].correlation_id, e[7].stack) == ("ERROR", "api", "abcdef12", ["E1: bad"])
    assert (e[8].level, e[8].message) == ("WARN", "db down extra tail here")
    assert (e[9].level, e[9].module, e[9].message) == ("FAIL", "auth", "login failed for 12")
    assert (e[10].level, e[10].next_start) == ("ERROR", None)


def test_entries_do_not_depend_on_blocks(spark, monkeypatch):
    r = random.Random(5)
    kinds = ["2024-03-01 10:00:00 ERROR [a] head", "\tat x.y(Z.java:1)", "  more", "", "Caused by: E: z", "2024-03-01 10:00:01 INFO [b] other"]
    body = "\n".join(f"{r.choices(kinds, (2, 3, 3, 1, 2, 1))[0]} {k}" if r.random() < 0.9 else "" for k in range(300))
    lines = source.from_text(spark, "  before any start\n" + body).unionByName(source.from_text(spark, body, "b").withColumn("file_seq", F.lit(1)).withColumn("line_no", F.col("line_no") + 301))
    seen = []
    for size in (1 << 20, 1, 7, 64):
        monkeypatch.setattr(assemble, "BLOCK", size)
        for span in (False, True):
            seen.append(sorted((e.line_no, e.last_line_no, e.file_last_line_no, e.next_start or 0, e.level, e.message, tuple(e.message_extra), tuple(e.stack)) for e in assemble.entries(lines, span_files=span).collect()))
    assert seen[0::2] == [seen[0]] * 4 and seen[1::2] == [seen[1]] * 4 and seen[0] != seen[1]


def test_causes_and_verdicts(spark):
    result = session.analyze_text(spark, LOG)
    assert result.verdict()["can_conclude"]
    c = {r.summary[:6]: r for r in result.clusters.collect()}
    assert c["Failed"].confidence == "CONFIRMED" and c["Failed"].cause == "java.net.ConnectException: refused"
    plain = session.analyze_text(spark, "\n".join(f"2024-03-01 10:00:0{k} ERROR [m] connection refused timeout" for k in range(8)))
    assert not plain.verdict()["can_conclude"] and plain.verdict()["verdict"] in ("LIKELY", "INSUFFICIENT")


def test_reports(spark):
    result = session.analyze_text(spark, LOG)
    for kind in report.FORMATS:
        assert "Failed to open" in report.export(result, kind)
    with pytest.raises(ValueError):
        report.export(result, "pdf")


def sequential(kinds):
    out, open_ = [], None
    for k, kind in enumerate(kinds, 1):
        if kind == "B":
            continue
        if kind == "S":
            open_ = [k, k, 0, 0]
            out.append(open_)
        elif open_ is None:
            open_ = [k, k, 1, 0]
            out.append(open_)
            open_.append(True)
        else:
            open_[1] = k
            stack = kind == "K" or open_[2] > 0 or len(open_) > 4
            open_[2 if stack else 3] += 1
    return [tuple(x[:4]) for x in out]


def test_assembly_equals_a_sequential_reader(spark):
    r = random.Random(4)
    shape = {"S": "INFO x", "K": "\tat a.b(C.java:1)", "P": "  more", "B": ""}
    kinds = [r.choice("SSKPB") for _ in range(200)]
    e = assemble.entries(source.from_text(spark, "\n".join(shape[k] for k in kinds) + "\n"))
    got = sorted((x.line_no, x.last_line_no, len(x.stack), len(x.message_extra)) for x in e.collect())
    assert got == sequential(kinds)


def test_partitioning_does_not_change_entries(spark):
    l = source.from_text(spark, LOG * 3)
    read = lambda df: sorted(map(str, assemble.entries(df).collect()))
    assert read(l) == read(l.repartition(7, F.rand(3)))


@pytest.mark.parametrize(("raw", "seconds"), [("2024-03-01T10:00:02+02:00", 1709280002.0), ("2024-03-01 10:00:02,5", 1709287202.5), ("Mar  1 10:00:02", 951904802.0), ("20171223-22:15:29:606", 1514067329.606), ("123.5", 123.5), ("20240301", 1709251200.0), ("12:00:01", 946728001.0), ("01/Mar/2024:10:00:02", 1709287202.0), ("2024-13-01 10:00:00", None), ("soon", None)])
def test_times(spark, raw, seconds):
    got = one(spark, times.parse(F.lit(raw))).asDict().popitem()[1]
    assert got == seconds if seconds is None else abs(got - seconds) < 1e-6


def test_levels(spark):
    got = one(spark, *(levels.normalize(F.lit(x)).alias(str(k)) for k, x in enumerate(("[err]", "Warning:", " fatal error ", "w", "odd"))))
    assert list(got) == ["ERROR", "WARN", "ERROR", "WARN", "INFO"]


def test_masks(spark):
    said = ["open '/a/b' read/write 12 ms", "id deadbeef1 0xFF 1234567890", "u 123e4567-e89b-12d3-a456-426614174000 src/db/p.c"]
    assert list(one(spark, *(text.mask(F.lit(x)).alias(str(k)) for k, x in enumerate(said)))) == ["open S read/write N ms", "id H 0xH N", "u U P"]


def test_redaction(spark):
    got = one(spark, text.redact(F.lit("token=abc from 10.0.0.1:80 version 1.2.3.4 a@b.de 13812345678 https://u:p@h Bearer abcdefghij X9"), ("X[0-9]",)))[0]
    assert got == "token=[SECRET] from [IP] version 1.2.3.4 [EMAIL] [PHONE] https://[CRED]@h Bearer [SECRET] [CUSTOM]"
    with pytest.raises(Exception):
        text.redact(F.lit("x"), ("(",))


@pytest.mark.parametrize("threshold", [0.95, 0.85, 0.7, 0.4])
def test_founders_equal_a_plain_loop(threshold):
    r = random.Random(3)
    names = list(dict.fromkeys("".join(r.choice("abc \u00e9\u4e2d") for _ in range(r.randrange(0, 12))) for _ in range(240)))
    names += ["x" * 300 + "".join(r.choice("yz") for _ in range(40)) for _ in range(8)]
    names += [f"opened {c} of the connections in the pool" for c in "abcd"]
    known: list[str] = []
    found = cluster.Known(threshold)
    for n in names:
        scored = [(difflib.SequenceMatcher(None, n, k).ratio(), k) for k in known]
        best = max((s for s, _ in scored), default=0)
        expected = min(k for s, k in scored if s == best) if scored and best >= threshold else None
        assert found.lead(n) == expected
        if expected is None:
            known.append(n)
            found.add(n)
    assert 0 < len(known) < len(names)


def test_filters(spark):
    e = assemble.entries(source.from_text(spark, LOG))
    n = lambda f: e.filter(filters.in_time(f) & filters.matches(f)).count()
    assert n(filters.Filter()) == 4
    assert n(filters.Filter(levels=(), include=("JAVA.NET",))) == 1
    assert n(filters.Filter(levels=(), end=1.0)) == 3  # those without a timestamp stay
    with pytest.raises(Exception):
        filters.Filter(include_re=("(",))
    with pytest.raises(ValueError):
        filters.boolean("(a or b")


def test_evidence_shows_a_changed_byte(spark):
    l = source.from_text(spark, LOG, "app.log")
    ranges = spark.createDataFrame([(1, "app.log", 1, 3), (2, "app.log", 4, 5)], "key long, source string, start_line long, end_line long")
    refs = evidence.refs(l, ranges)
    assert evidence.verdict(evidence.verify(refs, l)).first().verdict == "VERIFIED"
    other = source.from_text(spark, LOG.replace("refused", "refuseD"), "app.log")
    checked = {r.start_line: r.status for r in evidence.verify(refs, other).collect()}
    assert checked == {1: "MISMATCH", 4: "MATCH"}
    assert evidence.verdict(evidence.verify(refs, other)).first().verdict == "TAMPERED"
    assert evidence.verdict(evidence.verify(refs, l.limit(0))).first().verdict == "UNVERIFIABLE"


def test_comparison(spark):
    a = spark.createDataFrame([("ERROR", "x", 4), ("ERROR", "old", 1)], "level string, template string, count long")
    b = spark.createDataFrame([("ERROR", "x", 6), ("ERROR", "fresh", 2)], "level string, template string, count long")
    got = [(r.status, r.template, r.count_a, r.count_b, r.change) for r in compare.ordered(compare.by_template(a, b)).collect()]
    assert got == [("new", "fresh", 0, 2, None), ("gone", "old", 1, 0, None), ("common", "x", 4, 6, 50.0)]
    ids = lambda t: spark.createDataFrame([("ERROR", t, "req-000001")], "level string, template string, correlation_id string")
    pair = compare.by_trace(compare.by_template(a, b), ids("old"), ids("fresh")).first()
    assert (pair.template_a, pair.template_b, pair.via) == ("old", "fresh", "req-000001")


def test_near_join_equals_all_pairs(spark):
    r = random.Random(7)
    xs = [(r.randrange(3), float(r.randrange(600))) for _ in range(80)]
    held = spark.createDataFrame([(c, t, k) for k, (c, t) in enumerate(xs)], "cluster_id int, ts double, line_no long")
    got = {(x.cluster_id, x.other): x.hits for x in timeline.cooccurrence(held).collect()}
    want = {(a, b): sum(abs(t - u) <= 60 for c, t in xs if c == a for d, u in xs if d == b) for a in range(3) for b in range(3) if a != b}
    assert got == {k: v for k, v in want.items() if v >= 2}


def test_packed_sources(spark, tmp_path):
    body = "INFO a\n" + "ERROR b\n"
    (tmp_path / "plain.log").write_bytes("é1\n".encode() + "中文\n".encode("gb18030") + b"end")
    with gzip.open(tmp_path / "renamed.log", "wb") as f:
        f.write(body.encode())
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("small.txt", "x")
        z.writestr("big.log", body * 3)
    (tmp_path / "wide.log").write_bytes(body.encode("utf-16"))
    paths = [str(tmp_path / n) for n in ("plain.log", "renamed.log", "z.zip", "wide.log")]
    got = packed.read_packed(spark, paths).orderBy("line_no").collect()
    assert [r.text for r in got] == ["é1", "中文", "end", "INFO a", "ERROR b", *["INFO a", "ERROR b"] * 3, "INFO a", "ERROR b"]
    assert [r.line_no for r in got] == list(range(1, 14))
    notes = {r.source: r for r in packed.decode_notes(spark, paths[:1]).collect()}
    assert notes[paths[0]].repaired == 1 and not notes[paths[0]].refused


def test_files_number_lines_on(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.log").write_text("".join(f"INFO {k} {i}\n" for i in range(5)))
    l = source.read_files(spark, [str(tmp_path / f"{k}.log") for k in (2, 0, 1)])
    got = [(r.line_no, r.text) for r in l.orderBy("line_no").collect()]
    assert got == [(5 * n + i + 1, f"INFO {k} {i}") for n, k in enumerate((2, 0, 1)) for i in range(5)]


def test_detection(spark):
    assert rules.detect(source.from_text(spark, "\n".join(f"[  {k}.5] [ERR ] [pll] bad" for k in range(9)))) == "embedded"
    assert rules.detect(source.from_text(spark, LOG)) == "generic"


def test_timeline_and_assess():
    assert analysis.timeline([(1, 2), (2, 3), (1, 4), (4, 5), (5, 6)], 1) == [1, 2, 4, 3, 5]


def test_kinds_that_share_an_id_are_paired_one_to_one(spark):
    r = random.Random(3)
    levels_ = ["ERROR", "FAIL", "WARN"]
    a = [(r.choice(levels_), f"a{k}", 2) for k in range(12)]
    b = [(r.choice(levels_), f"b{k}", 3) for k in range(12)] + [("INFO", "same", 1)]
    a += [("INFO", "same", 5)]
    ids = lambda kinds: [(x, t, f"id{r.randrange(9)}") for x, t, _ in kinds for _ in range(r.randrange(4))]
    ia, ib = ids(a), ids(b)
    want, free_a, free_b = [], {k[:2] for k in a} - {("INFO", "same")}, {k[:2] for k in b} - {("INFO", "same")}
    for via in sorted({i for *_, i in ib}):
        for bx in sorted({(t, x) for x, t, i in ib if i == via}):
            for ax in sorted({(t, x) for x, t, i in ia if i == via}):
                if ax[::-1] in free_a and bx[::-1] in free_b:
                    want.append((via, *ax[::-1], *bx[::-1]))
                    free_a.discard(ax[::-1]), free_b.discard(bx[::-1])
    df = lambda rows, s: spark.createDataFrame(rows, s)
    compared = compare.by_template(df(a, "level string, template string, count long"), df(b, "level string, template string, count long"))
    pairs = compare.by_trace(compared, df(ia, "level string, template string, correlation_id string"), df(ib, "level string, template string, correlation_id string"))
    assert sorted(map(tuple, pairs.select("via", "level_a", "template_a", "level_b", "template_b").collect())) == sorted(want) and len(want) > 3
    after = {(x.status, x.level, x.template) for x in compare.with_traces(compared, pairs).collect()}
    assert {k for k in after if k[0] == "gone"} == {("gone", *k) for k in free_a} and {k for k in after if k[0] == "new"} == {("new", *k) for k in free_b}
    assert len([k for k in after if k[0] == "common"]) == len(want) + 1


def test_fatal_hints_count_as_errors(spark):
    said = lambda name, x: one(spark, rules.PRESETS[name].infer_level(F.lit(x)))[0]
    assert said("embedded", "HardFault at 0x20") == said("embedded", "watchdog reset") == said("jenkins", "build aborted by user") == said("jenkins", "JVM terminated") == "ERROR"
