"""Quantities in texts: a grammar of written numbers and units that yields intervals, and their check against evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Small numbers in words, multipliers, seconds of units of time, vague counts as [least, greatest].
ONES = [
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine",
    "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen",
]
TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
MULTIPLIERS = {"hundred": 1e2, "thousand": 1e3, "million": 1e6, "billion": 1e9, "trillion": 1e12}
VAGUE = {
    "a couple of": (2.0, 2.0), "a few": (3.0, 9.0), "several": (3.0, 10.0), "dozens of": (24.0, 120.0),
    "some": (2.0, float("inf")), "many": (3.0, float("inf")), "for": (2.0, float("inf")),
}
TIME = {
    r"(?i)n(ano)?s(ec(ond)?s?)?": 1e-9, r"(?i)(u|micro)s(ec(ond)?s?)?": 1e-6, r"(?i)m(illi)?s(ec(ond)?s?)?": 1e-3, r"(?i)s(ec(ond)?s?)?": 1.0,
    r"(?i)min(ute)?s?": 60.0, r"(?i)h(r|our)?s?": 3600.0, r"(?i)days?": 86400.0, r"(?i)weeks?": 604800.0, r"(?i)months?": 2629746.0, r"(?i)years?": 31557600.0,
}
#: Prefixes of bytes and bits.
PREFIXES = {"": 1.0, "[kK]": 1e3, "M": 1e6, "G": 1e9, "T": 1e12, "Ki": 1024.0, "Mi": 1024.0**2, "Gi": 1024.0**3}

_PER = r"(?:\s?/\s?|\sper\s)s(?:ec(?:ond)?)?"
#: (pattern of the whole unit, dimension, scale); the first that fits counts. Bits are never turned to bytes.
UNITS = (
    [(p, "s", scale) for p, scale in TIME.items()]
    + [(f"{p}(B|\\s?[bB]ytes?){per}", "B" + rate, scale) for p, scale in PREFIXES.items() for per, rate in (("", ""), (_PER, "/s"))]
    + [(f"{p}Bps", "B/s", scale) for p, scale in PREFIXES.items()]
    + [(f"{p}(b|\\s?[bB]its?){per}", "b" + rate, scale) for p, scale in PREFIXES.items() for per, rate in (("", ""), (_PER, "/s"))]
    + [(f"{p}bps", "b/s", scale) for p, scale in PREFIXES.items()]
    + [(r"(?i)(pkts?|packets?)", "packets", 1.0), (rf"(?i)(pkts?|packets?){_PER}", "packets/s", 1.0), (r"(?i)pps", "packets/s", 1.0), ("%|(?i)per ?cent|(?i)percent", "%", 1.0)]
)
_TIME = r"(?:(?i:nano|micro|milli)(?i:sec(?:ond)?s?)|(?i:[num]?s(?:ec(?:ond)?s?)?)|(?i:min(?:ute)?s?|h(?:r|our)?s?|days?|weeks?|months?|years?))"
_DATA = rf"(?:[kKMGT]i?\s?)?(?:[bB]ytes?|[bB]its?|[bB])(?:ps|{_PER})?"
_PACKETS = rf"(?i:pkts?|packets?)(?:{_PER})?|(?i:pps)"
_UNIT = rf"(?:{_DATA}|{_PACKETS}|{_TIME}|%|(?i:per\s?cent))"
_NUMBER = r"-?[0-9]++(?:,[0-9]{3})*+(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+"
_MULTIPLIED = rf"(?:[\s-]?(?i:{'|'.join(MULTIPLIERS)}))"
_WORD = rf"(?i:(?:{'|'.join(TENS)})(?:[\s-](?:{'|'.join(ONES[1:10])}))?|{'|'.join(sorted(ONES, key=len, reverse=True))})"
_RANK = r"(?:percentile|quartile|decile|quantile)"
_END = r"(?![\w%])"
#: A quantity: a rank among others, an address of numbers, digits with a unit (durations in several parts together; whatever is glued
#: to them belongs to them, but for ordinals), words with a unit or multiplier, vague counts of a unit, units in the plural alone.
QUANTITY = (
    rf"(?<![\w.,-])(?:[0-9]+(?:st|nd|rd|th)\s+{_RANK}|[0-9]+(?:\.[0-9]+){{2,}}"
    rf"|{_NUMBER}[\s-]?{_TIME}{_END}(?:,?\s+(?:and\s+)?{_NUMBER}[\s-]?{_TIME}{_END})+"
    rf"|{_NUMBER}(?!(?i:st|nd|rd|th)\b){_MULTIPLIED}*(?:[\s-]?{_UNIT}{_END}|[A-Za-z/%]*)"
    rf"|{_WORD}(?:{_MULTIPLIED}+(?:[\s-]{_UNIT}{_END})?|[\s-]{_UNIT}{_END})"
    rf"|(?i:{'|'.join(v for v in VAGUE if v != 'for')})\s+{_UNIT}{_END}|(?i:for)\s+(?i:seconds|minutes|hours|days|weeks|months|years){_END})"
)
#: One part of a duration in several.
_PART = rf"{_NUMBER}[\s-]?{_TIME}{_END}"
_SENTENCE = r"[.!?]+(?:\s+|$)"
#: A number counts for digits it is written with: half a unit of the last one, and a little for the arithmetic.
_SLACK = 1e-9


def _unit_of(unit: Column) -> Column:
    """(dim, scale) of a unit as written; no unit has no dimension, an unknown one has a dimension of its own."""
    out = F.when(unit == "", F.struct(F.lit("").alias("dim"), F.lit(1.0).alias("scale")))
    for pattern, dim, scale in UNITS:
        out = out.when(unit.rlike(f"^(?:{pattern})$"), F.struct(F.lit(dim).alias("dim"), F.lit(scale).alias("scale")))
    return out.otherwise(F.struct(F.lit("?").alias("dim"), F.lit(1.0).alias("scale")))


def _multiplier(text: Column) -> Column:
    each = F.regexp_extract_all(F.lower(text), F.lit(rf"\b({'|'.join(MULTIPLIERS)})\b"), F.lit(1))
    values = F.create_map(*[F.lit(x) for pair in MULTIPLIERS.items() for x in pair])
    return F.aggregate(each, F.lit(1.0), lambda acc, m: acc * F.element_at(values, m))


def _words(text: Column) -> Column:
    """The value of a number in words."""
    values = F.create_map(*[F.lit(x) for pair in [*zip(ONES, map(float, range(20))), *zip(TENS, map(float, range(20, 100, 10)))] for x in pair])
    each = F.regexp_extract_all(F.lower(text), F.lit(rf"\b({'|'.join([*TENS, *ONES])})\b"), F.lit(1))
    return F.aggregate(each, F.lit(0.0), lambda acc, w: acc + F.element_at(values, w))


def _read(texts: Column) -> Column:
    """For each text of a quantity in one part: number as written, dim, scale, value, half, low, high.

    Step by step, so that each step's results are bound and not worked out again wherever they are used.
    """

    def split(t):
        vague = F.lower(F.regexp_extract(t, rf"^(?i:{'|'.join(VAGUE)})(?=\s)", 0))
        return F.struct(t.alias("t"), F.regexp_extract(t, f"^{_NUMBER}", 0).alias("number"), F.regexp_extract(t, f"^{_WORD}", 0).alias("word"), vague.alias("vague"))

    def rest(x):
        head = F.when(x["number"] != "", x["number"]).when(x["vague"] != "", x["vague"]).otherwise(x["word"])
        return F.struct(x.alias("x"), F.substr(x["t"], F.length(head) + 1).alias("rest"))

    def unit(y):
        known = _unit_of(F.trim(F.regexp_replace(y["rest"], rf"^{_MULTIPLIED}*[\s-]?", "")))
        return F.struct(y["x"].alias("x"), known.alias("u"), _multiplier(y["rest"]).alias("times"))

    def value(z):
        number = z["x"]["number"]
        decimals = F.length(F.regexp_extract(number, r"\.([0-9]+)", 1))
        power = F.coalesce(F.regexp_extract(number, r"[eE]([+-]?[0-9]+)$", 1).try_cast("int"), F.lit(0))
        plain = F.when(number != "", F.replace(number, F.lit(","), F.lit("")).try_cast("double")).otherwise(_words(z["x"]["word"]))
        scale = z["times"] * z["u"]["scale"]
        half = F.lit(0.5) * F.pow(F.lit(10.0), (power - decimals).cast("double"))
        return F.struct(z["x"].alias("x"), z["u"].alias("u"), scale.alias("scale"), (plain * scale).alias("value"), (half * scale).alias("half"))

    def interval(v):
        t, vague = v["x"]["t"], v["x"]["vague"]
        least = F.create_map(*[F.lit(x) for k, (a, _) in VAGUE.items() for x in (k, a)])
        most = F.create_map(*[F.lit(x) for k, (_, b) in VAGUE.items() for x in (k, b)])
        odd = t.rlike(r"^[0-9]+(?:st|nd|rd|th)\s|^[0-9]+(?:\.[0-9]+){2,}$")
        low = F.when(vague != "", F.try_element_at(least, vague) * v["scale"]).otherwise(v["value"] - v["half"])
        high = F.when(vague != "", F.try_element_at(most, vague) * v["scale"]).otherwise(v["value"] + v["half"])
        dim = F.when(odd, F.lit("?")).otherwise(v["u"]["dim"])
        return F.struct(F.trim(t).alias("number"), dim.alias("dim"), low.alias("low"), high.alias("high"), v["value"].alias("value"), v["half"].alias("half"), v["u"]["scale"].alias("scale"))

    for step in (split, rest, unit, value, interval):
        texts = F.transform(texts, step)
    return texts


def _whole(number: Column) -> Column:
    """The quantities of one match: a duration in parts that get smaller is one, other rows of parts are as many as they have."""
    several = number.rlike(rf"^{_PART}.*\s{_PART}$")
    texts = F.when(several, F.regexp_extract_all(number, F.lit(_PART), F.lit(0))).otherwise(F.array(number))

    def put_together(parts: Column) -> Column:
        shrinks = F.forall(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.get(parts, i)["scale"] < F.get(parts, i - 1)["scale"])
        last, total = F.element_at(parts, -1), F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x["value"])
        one = F.struct(F.trim(number).alias("number"), last["dim"].alias("dim"), (total - last["half"]).alias("low"), (total + last["half"]).alias("high"))
        each = F.transform(parts, lambda x: F.struct(x["number"].alias("number"), x["dim"].alias("dim"), x["low"].alias("low"), x["high"].alias("high")))
        return F.when((F.size(parts) > 1) & shrinks, F.array(one)).otherwise(each)

    return F.get(F.transform(F.array(_read(texts)), put_together), F.lit(0))


def quantities(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, sentence, place, n_in_sentence, number, dim, low, high: every quantity that a text names, as written and as an interval.

    low and high are in seconds, bytes, bits, packets or these per second; dim is "" for a bare number and "?" for a rank, an
    address or an unknown unit. A number stands for all that round to it as written; parts of a duration add up, the last one says how
    exactly. Ordinals are no quantities. Null and empty texts have none.
    """
    plain = F.regexp_replace(F.regexp_replace(F.col(text), "[µμ]", "u"), "−", "-")
    sentences = texts.select(*keys, F.posexplode(F.split(plain, _SENTENCE)).alias("_s", "sentence"))
    found = sentences.select(*keys, "sentence", "_s", F.flatten(F.transform(F.regexp_extract_all("sentence", F.lit(QUANTITY), F.lit(0)), _whole)).alias("_all"))
    each = found.select(*keys, "sentence", F.size("_all").alias("n_in_sentence"), "_s", F.posexplode("_all").alias("_q", "_one"))
    return each.select(*keys, "sentence", F.struct("_s", "_q").alias("place"), "n_in_sentence", "_one.*")


def ungrounded(answers: DataFrame, keys: list[str], text: str, evidence: DataFrame, constants: tuple[float, ...] = ()) -> DataFrame:
    """keys, number: each quantity of a text that no evidence of its record bears out.

    evidence has keys, feature, unit (dimension) and value, a row for each feature of a record. A quantity is borne out by a value of its
    dimension within its interval, a bare number by any value or one of constants. Where a sentence names just one feature
    and one quantity, it has to be that feature's. In a sentence that says negative, the sign may be left out. A
    record without evidence bears out constants only. Null keys match null keys. Rows come out once.
    """
    asked = quantities(answers, keys, text)
    right = evidence.select(*[F.col(k).alias(f"_e{i}") for i, k in enumerate(keys)], "feature", "unit", F.col("value").cast("double").alias("_v"))
    on = [F.col(k).eqNullSafe(F.col(f"_e{i}")) for i, k in enumerate(keys)]
    slack = F.lit(_SLACK) * F.greatest(F.abs("low"), F.lit(1e-12))
    inside = F.col("_v").between(F.col("low") - slack, F.col("high") + slack)
    turned = F.lower("sentence").contains("negative") & F.col("_v").between(-F.col("high") - slack, -F.col("low") + slack)
    fits = ((F.col("dim") == "") | (F.col("dim") == F.col("unit"))) & (inside | turned)
    named = F.contains(F.lower("sentence"), F.lower("feature"))
    met = asked.join(right, on, "left").withColumn("_fits", F.coalesce(fits, F.lit(False))).withColumn("_named", F.coalesce(named, F.lit(False)))
    figures = [
        F.count_distinct(F.when(F.col("_named"), F.col("feature"))).alias("_names"), F.max(F.col("_fits")).alias("_any"),
        F.max(F.col("_named") & F.col("_fits")).alias("_own"), F.max("n_in_sentence").alias("_n"),
    ]
    judged = met.groupBy(*keys, "sentence", "place", "number", "dim", "low", "high").agg(*figures)
    constant = F.lit(False)
    for c in constants:
        constant = constant | ((F.col("dim") == "") & F.lit(float(c)).between(F.col("low"), F.col("high")))
    good = F.when((F.col("_names") == 1) & (F.col("_n") == 1), F.col("_own")).otherwise(F.col("_any")) | constant
    return judged.filter(~good).select(*keys, "number").distinct()
