"""Claims in texts: an automaton over tokens whose states hold the scopes of negation and hedging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a run of the automaton can report, a bit each.
CODES = ["CONFIRMATION_CLAIM", "CONFIDENCE_CLAIM", "ASSERTIVE_CLASSIFICATION", "INVENTED_NETWORK_DETAIL", "UNSUPPORTED_DATA_QUALITY_CLAIM"]
_CONFIRMED, _SURE, _CLASSED, _NETWORK, _QUALITY = (1 << i for i in range(5))

#: Classes of tokens. A token may be in several.
TOKENS = {
    "end": [".", ";", "!", "?"],
    "contrast": ["but", "however", "although", "though", "while", "whereas", "yet"],
    "starts": ["this", "it", "we", "i", "they", "these", "those", "the", "there"],
    "negates": ["no", "not", "cannot", "without", "lack", "lacks", "lacking", "never", "nor", "none", "nobody", "neither", "nothing"],
    "undoes": ["unavailable", "missing", "absent"],
    "shown": ["available", "provided", "visible", "known", "present", "included", "given", "recorded"],
    "hedges": ["would", "needed", "require", "requires", "required", "may", "might", "could", "possible", "possibly", "perhaps", "whether", "if"],
    "confirms": ["confirm", "confirms", "confirmed", "confirming", "prove", "proves", "proved", "proven", "definitely", "certainly", "undoubtedly", "unquestionably"],
    "sure": ["confidence", "probability", "confident"],
    "subject": ["this", "it", "traffic", "flow"],
    "be": ["is", "was", "are", "were", "am"],
    "article": ["a", "an"],
    "adverb": ["definitely", "certainly", "clearly", "undoubtedly", "simply"],
    "class": ["dos", "ddos", "attack", "bot", "botnet"],
    "class_head": ["port", "brute", "web"],
    "network": ["tcp", "udp", "syn", "payload", "payloads"],
    "quality": ["corrupt", "corrupted", "corruption"],
}
_BITS = {name: 1 << i for i, name in enumerate(TOKENS)}
_TOKEN = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[a-z]+(?:['’][a-z]+)?|[0-9]+(?:\.[0-9]+)?|%|[.;!?,]"


def _classes(token: Column) -> Column:
    """The classes of a token as bits; what ends in n't negates."""
    words: dict[str, int] = {}
    for name, own in TOKENS.items():
        for w in own:
            words[w] = words.get(w, 0) | _BITS[name]
    table = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    return F.coalesce(F.try_element_at(table, token), F.when(token.rlike("n['’]t$"), _BITS["negates"]).otherwise(0))


def _step(acc: Column, x: Column) -> Column:
    """One token: scopes open and close, claims outside them are reported, network details wait for the end of their clause."""
    t, p1, p2 = x["t"], acc["p1"], acc["p2"]
    is_a = lambda name: x["c"].bitwiseAND(F.lit(_BITS[name])) != 0
    after_comma = p1 == ","
    ends = is_a("end") | is_a("contrast") | (after_comma & (is_a("starts") | (t == "not")))
    fresh = lambda value, empty: F.when(ends, F.lit(empty)).otherwise(value)
    negated, hedged, rather, subject = fresh(acc["negated"], False), fresh(acc["hedged"], False) & (t != ","), fresh(acc["rather"], 0), fresh(acc["subject"], 0)
    waiting = fresh(acc["waiting"], 0)
    said = acc["said"].bitwiseOR(F.when(ends, acc["waiting"]).otherwise(0))
    doubt = (t == "doubt") & (p1 == "a") & (p2 == "without")
    excused = negated | (rather > 0)
    bit = lambda test, value: F.when(test, value).otherwise(0)
    own = (
        bit(((is_a("confirms") | ((t == "indicates") & (p1 == "clearly")) | ((t == "certain") & p1.isin(*TOKENS["be"]))) & ~excused & ~hedged) | doubt, _CONFIRMED)
        .bitwiseOR(bit((is_a("sure") | ((t == "sure") & p1.isin("%", "percent"))) & ~excused, _SURE))
        .bitwiseOR(bit((subject == 3) & (is_a("class") | ((t == "scan") & (p1 == "port")) | ((t == "force") & (p1 == "brute"))) & ~excused & ~hedged, _CLASSED))
        .bitwiseOR(bit((is_a("quality") | ((t == "impossible") & (p1 == "physically")) | (t.isin("error", "errors") & (p1 == "measurement"))) & ~excused, _QUALITY))
        .bitwiseOR(bit(t.rlike(r"^[0-9]+\.[0-9]+\.") | (t.rlike("^[0-9]+$") & (p1 == "port")), _NETWORK))
    )
    heard = F.when(is_a("undoes") | (is_a("shown") & negated), 0).otherwise(waiting.bitwiseOR(bit(is_a("network") & ~excused, _NETWORK)))
    moved = (
        F.when(is_a("subject"), 1).when((subject == 1) & is_a("be"), 2).when((subject == 2) & is_a("adverb"), 2).when((subject == 2) & is_a("article"), 3)
        .when((subject == 3) & is_a("class_head"), 3).otherwise(0)
    )
    return F.struct(
        (negated | is_a("negates")).alias("negated"), (hedged | is_a("hedges")).alias("hedged"),
        F.when((t == "than") & (p1 == "rather"), 3).when(t == ",", 0).otherwise(F.greatest(rather - 1, F.lit(0))).alias("rather"),
        moved.alias("subject"), heard.alias("waiting"), said.bitwiseOR(own).alias("said"), t.alias("p1"), p1.alias("p2"),
    )


def claim_flags(answers: DataFrame, key: str | list[str], text: str, noted: str | None = None) -> DataFrame:
    """key, code of the claims that a text makes outside the scopes of negation and hedging.

    A text is one pass of an automaton over its tokens. A negation reaches to the end of the clause: a full stop or the
    like, a word of contrast, a comma before a new subject or before "not"; commas of a list don't end it. A hedge ends at a comma; "rather
    than" excuses the next two words. Network details are excused by a negation before them and by one that follows in
    their clause ("payloads are not available"); addresses and numbered ports by none. Where noted (a boolean column) says that a
    note on data quality was supplied, talking of quality is no claim. Null and empty texts make no claims; rows come out once.
    """
    keys = [key] if isinstance(key, str) else key
    plain = F.regexp_replace(F.lower(text), r"\b(e\.g|i\.e|etc)\.", " ")
    tokens = F.transform(F.regexp_extract_all(plain, F.lit(_TOKEN), F.lit(0)), lambda t: F.struct(t.alias("t"), _classes(t).alias("c")))
    no, zero = F.lit(False), F.lit(0)
    numbers = [zero.alias(name) for name in ("rather", "subject", "waiting", "said")]
    start = F.struct(no.alias("negated"), no.alias("hedged"), *numbers, F.lit("").alias("p1"), F.lit("").alias("p2"))
    said = F.aggregate(tokens, start, _step, lambda acc: acc["said"].bitwiseOR(acc["waiting"]))
    excused = F.coalesce(F.col(noted), no) if noted else no
    rows = answers.select(*keys, F.when(excused, said.bitwiseAND(F.lit(~_QUALITY))).otherwise(said).alias("_said"))
    codes = F.array_compact(F.array(*[F.when(F.col("_said").bitwiseAND(F.lit(1 << i)) != 0, c) for i, c in enumerate(CODES)]))
    return rows.select(*keys, F.explode(codes).alias("code")).distinct()
