"""Written quantities as intervals, and their check against a record's evidence."""

import pytest

from tablewarden.operators import quantities

#: Sentences about a record: Run Time 754.25 s, Byte Rate 250000 B/s, Packet Count 8, Drift -2 s.
EVIDENCE = [("Run Time", "s", 754.25), ("Byte Rate", "B/s", 250000.0), ("Packet Count", "packets", 8.0), ("Drift", "s", -2.0)]
GROUNDED = [
    "It took 754.25 seconds.", "It took about 754 s.", "Some 754,250 milliseconds went by.", "754250msec and no more.", "754250000us.", "754250000μsecs in all.", "It took 12.57 minutes.", "It took 0.2095 hours.",
    "It took 12 minutes 34 seconds.", "It took 12 min 34 s.", "It took 12 minutes and 34.25 seconds.", "A 754.25-second run.", "It took 7.54e2 seconds.", "It took 7.5425E2 s.", "Byte Rate was 250000B/s.",
    "A rate of 250 kB/s with 8 packets.", "Byte Rate is 250000 bytes per second.", "0.25 MB/s is high.", "The 2nd and the 31st of them are short.", "Packet Count is 8pkts.", "It saw eight packets.", "Packet Count was 8.",
    "Run Time (in seconds) was 754.", "The values 754 and 8 stand out.", "It ran several minutes.".replace("several", "many"), "There was a negative drift of 2 seconds.", "Drift was -2 seconds.", "It went on for minutes.", "Model v7 of set A1b saw it.",
    "Nothing is said.", "", "The set is SAMPLE 1999.",
]
REFUSED = [
    ("It took 754.25 minutes.", "754.25 minutes"), ("It took 755 seconds.", "755 seconds"), ("It took 754.4 s.", "754.4 s"), ("It took 754250 seconds (about 8.7 days).", "8.7 days"), ("It took 12.5 minutes.", "12.5 minutes"),
    ("It took 12 minutes 35 seconds.", "12 minutes 35 seconds"), ("It took 7.55e2 seconds.", "7.55e2 seconds"), ("It took 754 million seconds.", "754 million seconds"), ("It took two years.", "two years"),
    ("It took roughly seventy-five hours.", "seventy-five hours"), ("It took a few minutes.", "a few minutes"), ("It went on for hours.", "for hours"), ("It moved 250kB.", "250kB"), ("Some 2Mbps.", "2Mbps"), ("It sent 8B of it.", "8B"),
    ("About 0.01pps.", "0.01pps"), ("It moved 250K bytes.", "250K bytes"), ("Packet Count was 754 packets.", "754 packets"), ("Byte Rate is 8B/s.", "8B/s"), ("Packet Count is 250000.", "250000"), ("It is in the 97th percentile.", "97th percentile"),
    ("It is the 3rd quartile.", "3rd quartile"), ("It came from 10.1.2.3 only.", "10.1.2.3"), ("I am 90% sure.", "90%"), ("A 12345 in it.", "12345"), ("It took 754.25 ns.", "754.25 ns"), ("It saw 9xy.", "9xy"),
    ("Byte Rate was 249999 bytes/s.", "249999 bytes/s"), ("It drifted 2 seconds.", "2 seconds"), ("Two hundred packets came.", "Two hundred packets"),
]


@pytest.fixture(scope="module")
def judged(spark):
    texts = GROUNDED + [t for t, _ in REFUSED]
    answers = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None), (None, "It took 5 s.")], "i long, t string")
    evidence = spark.createDataFrame([(i, *e) for i in [*range(len(texts)), 900] for e in EVIDENCE], "i long, feature string, unit string, value double")
    got = {}
    for r in quantities.ungrounded(answers.unionByName(answers), ["i"], "t", evidence, constants=(1999.0,)).collect():
        got.setdefault(r.i, []).append(r.number)
    return got


def test_borne_out(judged):
    assert {t: judged[i] for i, t in enumerate(GROUNDED) if i in judged} == {}


def test_refused(judged):
    got = {t: judged.get(len(GROUNDED) + k, []) for k, (t, _) in enumerate(REFUSED)}
    assert {t: n for t, n in REFUSED if n not in got[t]} == {}
    assert 900 not in judged and judged[None] == ["5 s"]


def test_intervals(spark):
    texts = ["1 hour, 2 minutes and 3.5 seconds", "15us and 0.5s", "two hundred thousand packets", "for days", "1,250.50 KiB", "3 Mbit/s", "101 seconds, 5 packets", "-1.5e-3 s", "12 34"]
    texts[4] = "1,250.50 KiB"
    rows = quantities.quantities(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), ["i"], "t").orderBy("i", "place").collect()
    got = [(r.i, r.dim, r.low, r.high) for r in rows]
    want = [
        (0, "s", 3723.45, 3723.55), (1, "s", 14.5e-6, 15.5e-6), (1, "s", 0.45, 0.55), (2, "packets", 150000.0, 250000.0), (3, "s", 172800.0, float("inf")), (4, "B", 1250.495 * 1024, 1250.505 * 1024),
        (5, "b/s", 2.5e6, 3.5e6), (6, "s", 100.5, 101.5), (6, "packets", 4.5, 5.5), (7, "s", -1.55e-3, -1.45e-3), (8, "", 11.5, 12.5), (8, "", 33.5, 34.5),
    ]
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(g[k] == pytest.approx(w[k]) for g, w in zip(got, want) for k in (2, 3))
