"""Claims, and what excuses them."""

from pyspark.sql import functions as F

from tablewarden.operators import claims

MADE = [
    ("Its totals proved it beyond question.", "CONFIRMATION_CLAIM"), ("Undoubtedly someone scanned the host.", "CONFIRMATION_CLAIM"), ("Nothing else fits, but the rate clearly indicates abuse.", "CONFIRMATION_CLAIM"),
    ("The flow is an attack of unusual length.", "ASSERTIVE_CLASSIFICATION"), ("It was a bot.", "ASSERTIVE_CLASSIFICATION"), ("I am 95 % sure of it.", "CONFIDENCE_CLAIM"),
    ("There is a high probability here.", "CONFIDENCE_CLAIM"), ("A length like that is physically impossible.", "UNSUPPORTED_DATA_QUALITY_CLAIM"), ("A UDP burst stands out.", "INVENTED_NETWORK_DETAIL"),
    ("Host 10.0.0.7 sent most of it.", "INVENTED_NETWORK_DETAIL"), ("We cannot see port 8080 in it.", "INVENTED_NETWORK_DETAIL"), ("That is abuse without a doubt.", "CONFIRMATION_CLAIM"),
    ("The verdict is certain here.", "CONFIRMATION_CLAIM"), ("Nothing was checked, yet this proves abuse.", "CONFIRMATION_CLAIM"), ("It is proven, although no capture exists.", "CONFIRMATION_CLAIM"),
    ("Certainly that shape is hostile, not harmless.", "CONFIRMATION_CLAIM"), ("Rather than wait, we confirm the finding.", "CONFIRMATION_CLAIM"), ("These hosts, rather than idling, confirm the plan.", "CONFIRMATION_CLAIM"),
    ("It was a port scan.", "ASSERTIVE_CLASSIFICATION"), ("This traffic is a brute force attempt.", "ASSERTIVE_CLASSIFICATION"), ("It is a DDoS, rather than a test.", "ASSERTIVE_CLASSIFICATION"), ("This is clearly a botnet.", "ASSERTIVE_CLASSIFICATION"),
    ("The model may have great confidence in it.", "CONFIDENCE_CLAIM"), ("Confidence is high even without captures.", "CONFIDENCE_CLAIM"), ("Rather than hedge, we are confident.", "CONFIDENCE_CLAIM"),
    ("The host used SYN packets, but payloads are not available.", "INVENTED_NETWORK_DETAIL"), ("No captures exist; the host used UDP.", "INVENTED_NETWORK_DETAIL"), ("Payloads are missing, however TCP was used.", "INVENTED_NETWORK_DETAIL"),
    ("Rather than UDP, TCP was used.", "INVENTED_NETWORK_DETAIL"), ("Rather than real traffic, we see corrupted rows.", "UNSUPPORTED_DATA_QUALITY_CLAIM"), ("There may be a measurement error.", "UNSUPPORTED_DATA_QUALITY_CLAIM"),
]
PASSES = [
    "Nobody says that it is not certain.", "A scan is possible.", "It might be a bot.", "There is no sign of corruption.", "These figures cannot prove intent.", "No confidence can be given.", "It hasn't been confirmed.",
    "More logs would be needed to confirm it.", "Proof would require a capture.", "Certain hosts send long flows.", "It is a possible attack, not a confirmed one.", "That can't be said with certainty.",
    "It is not necessarily an attack.", "It looks routine rather than confirmed.", "It looks routine, rather than a confirmed case.", "No details (payloads, TCP flags) are at hand.", "No details (e.g. UDP flags, payloads) are at hand.",
    "The record lacks payloads, TCP flags, and addresses.", "There are no addresses, ports, or details such as TCP or UDP.", "Payloads and SYN counts are not available.", "TCP flags are missing.", "", "The rate is high.",
]


def test_claims(spark):
    texts = [t for t, _ in MADE] + PASSES
    rows = claims.claim_flags(spark.createDataFrame([*enumerate(texts), (999, None)], "i int, t string"), "i", "t").groupBy("i").agg(F.collect_set("code").alias("c")).collect()
    found = {r.i: set(r.c) for r in rows}
    assert {t: code for i, (t, code) in enumerate(MADE) if code not in found.get(i, ())} == {}
    assert {texts[i]: c for i, c in found.items() if i >= len(MADE) and i < 999} == {} and 999 not in found


def test_quality_may_be_talked_of_where_a_note_was_given(spark):
    said = "It looks like a measurement error."
    noted = spark.createDataFrame([(1, said, True), (2, said, False), (2, said, False), (3, said, None)], "i int, t string, noted boolean")
    assert sorted(r.i for r in claims.claim_flags(noted, "i", "t", "noted").collect()) == [2, 3]


def test_long_texts_take_one_pass(spark):
    text = "no end of payloads, " * 20000 + "but it was a bot."
    got = claims.claim_flags(spark.createDataFrame([(1, text)], "i int, t string"), ["i"], "t").collect()
    assert [r.code for r in got] == ["ASSERTIVE_CLASSIFICATION"]
