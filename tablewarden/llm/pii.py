"""Personal data in texts: fixed patterns, and looser candidates that gradient-boosted trees tell from ordinary text."""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewarden.llm.common import materialise, number_of_parts, table

#: Base patterns by kind, in the order in which spans are listed. Possessive, and begun only where a run begins (or
#: the last match ended), which finds the same spans in linear time and without recursion.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a base pattern to be tried.
NEEDED = {"email": "@", "ip": ".", "card": "", "phone": "+"}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
FOUR_BYTES = rf"^{BYTE}(?:\.{BYTE}){{3}}$"
CARD_DIGITS, PHONE_DIGITS = (13, 19), (9, 15)
#: Runs of other numbers of digits are no candidates.
NUMBER_DIGITS = (7, 19)

_AT = r"(?:\x20?[(\[{]\x20?at\x20?[)\]}]\x20?|\x20at\x20|\x20?@\x20?)"
_DOT = r"(?:\x20?[(\[{]\x20?dot\x20?[)\]}]\x20?|\x20dot\x20|\x20?\.\x20?)"
#: Generators of candidates: each proposes spans of 7 to 100 characters without overlap; spans of two may overlap.
GENERATORS = {
    "email_like": rf"(?i)(?<![a-z0-9._%+-])[a-z0-9][a-z0-9._%+-]{{0,29}}+{_AT}[a-z0-9-]{{1,20}}+(?:{_DOT}[a-z0-9-]{{2,12}}+){{1,3}}",
    "number_like": r"(?<![0-9A-Za-z])(?<![0-9][\x20./-])[(]?[0-9][0-9()\x20./-]{5,30}[0-9](?![A-Za-z]|[\x20./-]?[0-9])",
    "phone_like": r"(?<![0-9A-Za-z])(?:[0-9]{1,3}[\x20.-])?[(]?[0-9]{2,4}[)]?[\x20./-]{1,2}[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9A-Za-z])",
    "card_like": r"(?<![0-9A-Za-z])[0-9]{4}(?:[\x20._/-]?[0-9]{4}){2}[\x20._/-]?[0-9]{1,7}(?![0-9A-Za-z])",
    "ip_like": r"(?<![0-9])[0-9]{1,3}(?:(?:\x20?[(\[{]\x20?(?:\.|dot)\x20?[)\]}]\x20?|\x20dot\x20|\.)[0-9]{1,3}){3}(?![0-9])",
}
KINDS = (*BASE, *GENERATORS)
#: A candidate may overlap as many others as fit beside it; in order of start they lie within so many places.
REACH = 16 * len(GENERATORS)
#: Words before a span that say what it is.
CUES = ("mail|contact|write", "phone|tel|call|fax|mobile|ring", "card|visa|credit|pay|account", r"\bip\b|host|server|address|login")
CONTEXT = 24

#: Distinct feature vectors that one task of the training holds.
PART_ROWS = 100_000
ROUNDS, DEPTH, RATE = 20, 4, 0.3
#: A generator's spans are taken down to the last score, in steps of 1 / STEPS, at which base spans cover so large a share of each step's
#: candidates, and so many in all. The rest is mostly data written otherwise, so the share is no rate of errors.
PRECISION, LEAST_KNOWN, STEPS = 0.5, 10, 50
MOST = 31


def running(lengths: Column) -> Column:
    """Sums of what stands before each place of an array, by pieces, so that long arrays cost no square."""
    zero, none = F.lit(0).cast("long"), F.array().cast("array<bigint>")

    def sums(a):
        start = F.struct(zero.alias("s"), none.alias("out"))
        return F.aggregate(a, start, lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.array_append(acc["out"], acc["s"]).alias("out")), lambda acc: acc["out"])

    def add(a):
        return F.aggregate(a, zero, lambda acc, x: acc + x)

    piece = 64
    last = F.floor((F.size(lengths) - 1) / piece).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(lengths, k * piece + 1, F.lit(piece)))
    before = sums(F.transform(pieces, add))
    return F.flatten(F.zip_with(pieces, before, lambda p, b: F.transform(sums(p), lambda x: x + b)))


SPAN = "array<struct<start:bigint,end:bigint,text:string,before:string,after:string>>"


def _found(df: DataFrame, patterns: dict[str, str], needed: dict[str, str]) -> DataFrame:
    """For each pattern a column of its name: the matches in _text, leftmost and without overlap, with their places in code points."""
    text = F.col("_text")
    digits = F.col("_digits")
    matches = {}
    for name, pattern in patterns.items():
        use = F.contains(text, F.lit(needed[name])) if needed.get(name) else F.lit(True)
        use = use if name.startswith("email") else use & digits
        matches[name] = F.when(use, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    df = df.select("*", *(m.alias(f"_m_{n}") for n, m in matches.items()))
    df = df.select("*", *(F.when(F.size(f"_m_{n}") > 0, F.split(text, p, -1)).alias(f"_g_{n}") for n, p in patterns.items()))
    out = []
    for n in patterns:
        m, g = F.col(f"_m_{n}"), F.col(f"_g_{n}")
        steps = F.zip_with(F.slice(g, 1, F.size(m)), m, lambda a, b: (F.length(a) + F.length(b)).cast("long"))
        places = F.zip_with(running(steps), F.slice(g, 1, F.size(m)), lambda s, a: F.struct((s + F.length(a)).alias("start"), F.right(a, F.lit(CONTEXT)).alias("before")))
        withs = F.zip_with(places, m, lambda p, t: F.struct(p["start"].alias("start"), (p["start"] + F.length(t)).alias("end"), t.alias("text"), p["before"].alias("before")))
        spans = F.zip_with(withs, F.slice(g, F.lit(2), F.size(m)), lambda p, a: F.struct(p["start"], p["end"], p["text"], p["before"], F.left(a, F.lit(2)).alias("after")))
        out.append(F.coalesce(F.when(g.isNotNull(), spans), F.array()).cast(SPAN).alias(n))
    kept = [c for c in df.columns if not c.startswith(("_m_", "_g_"))]
    return df.select(*kept, *out)


def only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the last digit is the check digit of those before it."""

    def add(acc, i):
        d = F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _sound(kind: str):
    def card(x):
        d = only_digits(x["text"])
        return F.when(F.length(d).between(*CARD_DIGITS), luhn(d)).otherwise(False)

    return {
        "email": lambda x: F.lit(True), "ip": lambda x: x["text"].rlike(FOUR_BYTES), "card": card,
        "phone": lambda x: F.length(only_digits(x["text"])).between(*PHONE_DIGITS),
    }[kind]


def features(x: Column, generator: int) -> Column:
    """Format and context of a candidate as small integers; nothing tells a base pattern's own mark (@, +) from a way around it."""
    plain = F.regexp_replace(F.regexp_replace(x["text"], rf"(?i){_AT}", "@"), rf"(?i){_DOT}", ".") if generator == 0 else x["text"]
    if generator == 4:
        plain = F.regexp_replace(x["text"], r"[^0-9]+", ".")
    digits = only_digits(plain)
    groups = F.filter(F.split(plain, "[^0-9]+"), lambda g: g != "")
    head = F.regexp_extract(plain, "^[^@]*", 0)

    def count(symbols: str, of: Column = plain) -> Column:
        return F.length(F.regexp_replace(of, f"[^{symbols}]", ""))

    def side(c: Column) -> Column:
        return F.when((c == "") | c.rlike(r"^[\s+]$"), 0).when(c.rlike("^[A-Za-z]$"), 1).when(c.rlike("^[0-9]$"), 2).when(c.rlike(r"^[,;.!?]$"), 3).otherwise(4)

    cue = F.lit(0)
    for k, words in enumerate(CUES):
        cue = F.when(x["before"].rlike(f"(?i){words}"), k + 1).otherwise(cue)
    each = [
        F.lit(generator), F.length(plain), F.length(digits), F.size(groups),
        F.coalesce(F.length(F.get(groups, F.lit(0))), F.lit(0)), F.coalesce(F.length(F.get(groups, F.size(groups) - 1)), F.lit(0)),
        F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)), count("."), count("-"), count(" "), count("()"), count("A-Z"),
        F.length(head), count("0-9", head), F.length(F.regexp_extract(plain, r"[a-z0-9-]*$", 0)),
        F.when(F.length(digits).between(*CARD_DIGITS), luhn(digits)).otherwise(False).cast("int"),
        plain.rlike(FOUR_BYTES).cast("int"), F.length(F.regexp_extract(plain, "^0*", 0)),
        side(F.right(x["before"], F.lit(1))), side(F.left(x["after"], F.lit(1))), cue,
    ]
    return F.array(*(F.least(F.coalesce(e.cast("int"), F.lit(0)), F.lit(MOST)) for e in each))


CANDIDATE = "array<struct<start:bigint,end:bigint,kind:int,f:array<int>>>"


def proposed(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", with_row: bool = False) -> DataFrame:
    """(id, _base, _candidates) per row of docs, and with it, if asked, the row as a struct _row; no row leaves its place."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")] if with_row else []
    df = docs.select(F.col(id_col).alias("id"), *row, text.alias("_text"), text.rlike("[0-9]").alias("_digits"))
    df = _found(df, BASE | GENERATORS, NEEDED)

    def base_span(k: int):
        return lambda x: F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))

    def candidate(g: int):
        return lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(len(BASE) + g).alias("kind"), features(x, g).alias("f"))

    base = [F.transform(F.filter(n, _sound(n)), base_span(k)) for k, n in enumerate(BASE)]
    few = F.filter("number_like", lambda x: F.length(only_digits(x["text"])).between(*NUMBER_DIGITS))
    loose = [F.transform(few if n == "number_like" else n, candidate(g)) for g, n in enumerate(GENERATORS)]
    return df.select(
        "id", *(["_row"] if with_row else []),
        F.concat(*base).cast("array<struct<kind:int,start:bigint,end:bigint>>").alias("_base"),
        F.concat(*loose).cast(CANDIDATE).alias("_candidates"),
    )


def labelled(found: DataFrame) -> DataFrame:
    """(half, f, y, n): distinct feature vectors with how many candidates have them; y is 1 for what a base span covers, 0 for what none touches.

    half is 0 or 1 by a hash of all that was found in the document, so copies fall in one half.
    A candidate that only partly matches a base span (less than 70 % of what the two cover) says nothing and is left out.
    """
    half = F.pmod(F.xxhash64("_base", "_candidates"), F.lit(2)).cast("int").alias("half")
    marks = """array_sort(concat(transform(_base, x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind, 'f', cast(null as array<int>))),
      transform(_candidates, x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind, 'f', x.f))))"""
    shares = f"""filter(transform(_marks, (x, i) -> named_struct('f', x.f, 'share', CASE WHEN x.f IS NOT NULL THEN
      aggregate(slice(_marks, greatest(i - {REACH}, 0) + 1, 2 * {REACH} + 1), 0D, (acc, y) -> CASE WHEN y.f IS NOT NULL THEN acc ELSE
        greatest(acc, greatest(0, least(x.end, y.end) - greatest(x.start, y.start)) / (greatest(x.end, y.end) - least(x.start, y.start))) END) END)),
      x -> x.share = 0 OR x.share >= 0.7)"""
    each = found.filter(F.size("_candidates") > 0).select(half, F.expr(marks).alias("_marks")).select("half", F.expr(shares).alias("_shares"))
    each = each.select("half", F.explode("_shares").alias("c")).select("half", "c.f", (F.col("c.share") > 0).cast("int").alias("y"))
    return each.groupBy("half", "f", "y").agg(F.count("*").alias("n"))


def _tree_sql(node, f: str) -> str:
    if node.getClass().getSimpleName() == "LeafNode":
        return f"{float(node.prediction())!r}D"
    split = node.split()
    return f"IF({f}[{split.featureIndex()}] <= {float(split.threshold())!r}D, {_tree_sql(node.leftChild(), f)}, {_tree_sql(node.rightChild(), f)})"


def score_sql(model, f: str) -> str:
    """The trees of a fitted model as one SQL expression over an array of features: the chance of class 1."""
    trees = [f"{float(w)!r}D * {_tree_sql(t._call_java('rootNode'), f)}" for t, w in zip(model.trees, model.treeWeights, strict=True)]
    return f"1 / (1 + EXP(-2 * ({' + '.join(trees)})))"


def fit(found: DataFrame) -> tuple[str, dict[int, float]]:
    """(score as SQL over x.f, least score by kind), from all candidates: trees on one half of the documents, thresholds on the other.

    Every distinct feature vector of a half counts. Without candidates of both classes no score and no thresholds come out, and so
    no spans.
    """
    counted = materialise(labelled(found), "pii-labelled")
    rows = {r.half: r for r in counted.groupBy("half").agg(F.count("*").alias("n"), F.countDistinct("y").alias("classes")).collect()}  # two rows
    if {half: r.classes for half, r in rows.items()} != {0: 2, 1: 2}:
        return "0.0D", {}
    train = counted.filter("half = 0").withColumn("h", F.xxhash64(F.lit("pii"), "f"))
    train = train.repartition(number_of_parts(rows[0].n, PART_ROWS), "h").sortWithinPartitions("h", "f", "y")
    train = train.select(array_to_vector(F.col("f").cast("array<double>")).alias("features"), F.col("y").cast("double").alias("label"), (1 + F.log2("n")).alias("w"))
    # Spark ML takes its thresholds from maxBins ** 2 rows; features have MOST + 1 values at most, so with more bins each still gets its own.
    bins = max(MOST + 1, math.isqrt(rows[0].n) + 1)
    model = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, stepSize=RATE, maxBins=bins, seed=1, weightCol="w").fit(train)
    sql = score_sql(model, "x.f")
    scored = counted.filter("half = 1").select(F.struct("f").alias("x"), "y", "n").select(F.expr(sql).alias("score"), F.col("x.f")[0].alias("kind"), "y", "n")
    levels = scored.groupBy("kind", F.floor(F.col("score") * STEPS).alias("step"))
    levels = levels.agg(F.min("score").alias("score"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("good"))
    down = Window.partitionBy("kind").orderBy(F.desc("step"))
    levels = levels.select("kind", "score", F.min(F.col("good") / F.col("n")).over(down).alias("share"), F.sum("good").over(down).alias("good"))
    sure = levels.filter((F.col("share") >= PRECISION) & (F.col("good") >= LEAST_KNOWN)).groupBy("kind").agg(F.min("score").alias("least"))
    return sql, {len(BASE) + r.kind: r.least for r in sure.collect()}  # a row per generator


def chosen(found: DataFrame, model: tuple[str, dict[int, float]]) -> DataFrame:
    """found with _spans: base spans and the candidates that their score selects, by kind and start; the better of two that overlap."""
    sql, least = model
    limits = "CASE x.kind " + " ".join(f"WHEN {k} THEN {v!r}D" for k, v in least.items()) + " ELSE 2.0D END" if least else "2.0D"
    scored = F.expr(f"transform(_candidates, x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind, 'score', CASE WHEN {sql} >= {limits} THEN {sql} END))")
    base = F.expr("transform(_base, x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind, 'score', 2.0D))")
    all_spans = F.array_sort(F.concat(base, F.filter(scored, lambda x: x["score"].isNotNull())))
    better = """filter(_all, (x, i) -> x.score = 2 OR NOT exists(slice(_all, greatest(i - {r}, 0) + 1, 2 * {r} + 1), y ->
      y.start < x.end AND x.start < y.end AND (y.score > x.score OR (y.score = x.score AND
        (y.end - y.start > x.end - x.start OR (y.end - y.start = x.end - x.start AND (y.start < x.start OR (y.start = x.start AND y.kind > x.kind))))))))""".format(r=REACH)
    kept = F.when(F.size("_all") > F.size("_base"), F.expr(better)).otherwise(F.col("_all"))
    by_kind = F.array_sort(F.transform(kept, lambda x: F.struct(x["kind"], x["start"], x["end"])))
    return found.withColumn("_all", all_spans).withColumn("_spans", by_kind).drop("_all")


def _spelled(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row of docs: id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end, comma-joined).

    Places are code points, ends exclusive. Base spans follow the four fixed patterns with their checks. The others
    come from generators of looser candidates (addresses spelled out, numbers without a plus or with other separators): trees, trained on all of this
    table's candidates by whether a base span covers them, score format and context, and per generator the score counts from
    which down base spans cover PRECISION of each step of the calibration half. They never overlap a base span or one another (up to
    REACH neighbours). A null text is empty: no spans. A row comes out per row of docs, repeated rows and null ids as they are; other
    columns are left out; an empty table gives no rows. Long texts are searched whole, in linear time. Every text is
    read once, and no row is shuffled: what is grouped are feature vectors.
    """
    found = materialise(proposed(docs, text_col, id_col), "pii-found")
    spans = chosen(found, fit(found))
    counts = [F.size(F.expr(f"filter(_base, x -> x.kind = {k})")).cast("long").alias(f"n_{n}") for k, n in enumerate(BASE)]
    return spans.select(F.col("id").alias(id_col), *counts, F.sha2(_spelled("_base"), 256).alias("base_sha256"), _spelled("_spans").alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with every span of find_pii in the text replaced by its kind in brackets; of base spans that overlap, the first stays.

    All columns and rows come out, null texts as null. Texts are read twice: for the trees, then to be rewritten.
    """
    model = fit(materialise(proposed(docs, text_col, id_col), "pii-found"))
    df = chosen(proposed(docs, text_col, id_col, with_row=True), model)
    names = F.array(*map(F.lit, KINDS))
    text = F.col("_row").getField(text_col)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def put(acc, x):
        piece = F.concat(F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), F.lit("["), F.get(names, x["kind"]), F.lit("]"))
        return F.when(x["start"] < acc["at"], acc).otherwise(F.struct(x["end"].alias("at"), F.array_append(acc["out"], piece).alias("out")))

    by_start = F.array_sort(F.transform("_spans", lambda x: F.struct(x["start"], x["end"], x["kind"])))
    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
    clean = F.when(F.size("_spans") > 0, F.aggregate(by_start, start, put, rest)).otherwise(text)
    return df.select(*((clean if c == text_col else F.col("_row").getField(c)).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
