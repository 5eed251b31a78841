"""The structure of written answers (claims are in claims.py, numbers against evidence in quantities.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An answer is a JSON object of lists of text, but for explanation (text) and priority (null); fixed values.
LONGEST = 4000
#: Longest text of a field or of an element of its list.
FIELD_LONGEST = {"observations": 500, "explanation": 2000, "limitations": 500, "evidence_used": 100}
#: What the parts of an answer may be, as the schema of a parsed value says.
TYPES = {"observations": ("ARRAY<STRING>", "ARRAY<VOID>"), "explanation": ("STRING",), "limitations": ("ARRAY<STRING>", "ARRAY<VOID>"), "evidence_used": ("ARRAY<STRING>", "ARRAY<VOID>")}


def structure_errors(answers: DataFrame, key: str, content: str, known_evidence: list[str]) -> DataFrame:
    """key, code: a row per rule that an answer breaks.

    Text that isn't strictly one JSON object (NaN, infinity and trailing text are refused) is NOT_JSON and nothing else.
    KEY_MISSING:<key>, KEY_UNKNOWN, WRONG_TYPE:<key> (also lists that hold something else than text) and TOO_LONG:<key>
    tell of the form; a part of the wrong type counts as empty.
    """
    options = {"mode": "PERMISSIVE", "allowNonNumericNumbers": "false"}
    whole = F.trim(content)
    strict = whole.rlike(r"^\{(?s).*\}$") & F.try_parse_json(whole).isNotNull()
    parsed = answers.select(
        key, F.when(strict, F.from_json(whole, "map<string,string>", options)).alias("m"), F.when(strict, F.try_parse_json(whole)).alias("v"), F.length(content).alias("_n"),
    )
    part = lambda c: F.try_variant_get("v", f"$.{c}", "variant")
    kind = {c: F.schema_of_variant(part(c)) for c in TYPES}
    lists = [c for c in TYPES if c != "explanation"]
    typed = {c: F.when(kind[c].isin(*TYPES[c]), F.from_json(F.col("m")[c], "array<string>")) for c in lists}
    typed |= {"explanation": F.when(kind["explanation"] == "STRING", F.col("m")["explanation"]), "priority": F.col("m")["priority"]}
    parsed = parsed.select(key, "m", "_n", F.when(F.col("m").isNotNull(), F.struct(*[e.alias(c) for c, e in typed.items()])).alias("a"), *[k.alias(f"_{c}") for c, k in kind.items()])

    def empty_list(c: str):
        return F.coalesce(F.size(F.filter(f"a.{c}", lambda x: x.isNotNull() & (F.trim(x) != ""))), F.lit(0)) == 0

    used = F.col("a.evidence_used")
    codes = F.array_compact(
        F.array(
            F.when(empty_list("observations"), "OBSERVATIONS_EMPTY"),
            F.when(F.coalesce(F.trim("a.explanation"), F.lit("")) == "", "EXPLANATION_EMPTY"),
            F.when(empty_list("limitations"), "LIMITATIONS_EMPTY"),
            F.when(empty_list("evidence_used"), "EVIDENCE_USED_EMPTY"),
            F.when(F.size(F.array_distinct(used)) < F.size(used), "EVIDENCE_USED_DUPLICATE"),
            F.when(F.exists(used, lambda x: ~x.isin(*known_evidence)), "EVIDENCE_USED_UNKNOWN"),
            F.when(F.col("a.priority").isNotNull(), "PRIORITY_NOT_NULL"),
            F.when(F.col("_n") > LONGEST, "RESPONSE_LENGTH"),
            *[F.when(~F.map_contains_key("m", c), f"KEY_MISSING:{c}") for c in (*TYPES, "priority")],
            F.when(F.size(F.array_except(F.map_keys("m"), F.array(*map(F.lit, (*TYPES, "priority"))))) > 0, "KEY_UNKNOWN"),
            *[F.when(F.map_contains_key("m", c) & ~F.coalesce(F.col(f"_{c}").isin(*TYPES[c]), F.lit(False)), f"WRONG_TYPE:{c}") for c in TYPES],
            *[F.when(F.array_max(F.transform(f"a.{c}", F.length)) > FIELD_LONGEST[c], f"TOO_LONG:{c}") for c in lists],
            F.when(F.length("a.explanation") > FIELD_LONGEST["explanation"], "TOO_LONG:explanation"),
        )
    )
    return parsed.select(key, F.explode(F.when(F.col("a").isNull(), F.array(F.lit("NOT_JSON"))).otherwise(codes)).alias("code"))
