"""Secrets in texts: fixed patterns, and tokens that a battery of randomness tests tells from ordinary text."""

from __future__ import annotations

import hashlib
import math
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.llm.common import materialise, table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("pass", "secret", "token", "api")
ASSIGN_CHARS = 12
#: A run too short fails as a whole, so the length can stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "random")

TOKEN = re.compile(r"[A-Za-z0-9+/_-]{16,}")
_D, _L, _U = string.digits, string.ascii_lowercase, string.ascii_uppercase
#: Encodings by size of their alphabet; a token is read in the first that holds all its symbols.
ENCODINGS = {
    "hex": _D + "abcdef", "upper hex": _D + "ABCDEF", "base32": _U + "234567", "lower36": _D + _L,
    "upper36": _D + _U, "base62": _D + _U + _L, "base64": _U + _L + _D + "+/", "base64url": _U + _L + _D + "-_",
}
#: What the encodings leave out, each kind in strata of its own; a capitalised word is read without its case.
OTHERS = {"digits": _D, "lower26": _L, "upper26": _U, "capitalised": _L, "mixture": _D + _U + _L + "+/_-"}
_INDEX = {name: {s: i for i, s in enumerate(a)} for name, a in (ENCODINGS | OTHERS).items()}
_SETS = [(name, frozenset(a), {s: i for i, s in enumerate(a)}) for name, a in ENCODINGS.items()]
BASE = pa.list_(pa.string())
FOUND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("stratum", pa.string()), ("step", pa.int32())]))
#: False discoveries allowed among the tokens reported, in each stratum of encoding and length.
FALSE_DISCOVERY_RATE = 0.01
LENGTHS = (16, 24, 32, 48, 64, 128)
#: Scores (powers of ten of the evidence) are counted in steps of a tenth, from 0 to 100.
STEPS, MOST_POWER = 10, 100
#: Weight, in symbols, of the case and digit transitions beside the counted successors of a symbol.
BACKOFF = 20
#: Beside a stratum's own ordinary scores, what all strata and the model give counts as so many.
PRIOR = 10
#: Of that many random tokens, drawn for each stratum, this share is left to score like ordinary ones.
DRAWN, APART = 10_000, 0.001


_upper_normal = np.vectorize(lambda z: 0.5 * math.erfc(z / math.sqrt(2)), otypes=[float])


def infer_encoding(token: str) -> tuple[str, dict] | None:
    """The encoding with the smallest alphabet that holds the token; None for numbers, words (letters of one case) and mixtures."""
    if token.isdigit() or token.isalpha() and (token[1:].islower() or token.isupper()):
        return None
    own = set(token)
    return next(((name, index) for name, symbols, index in _SETS if own <= symbols), None)


def battery_rows(at: np.ndarray, size: int) -> np.ndarray:
    """Combined p value of the three tests for each row of symbol numbers, all rows of one length, under random symbols.

    Chi-squared uniformity over the alphabet, runs above and below the middle, and serial correlation of neighbours;
    the p values are combined by Fisher's method (chi-squared with six degrees of freedom).
    """
    m, n = at.shape
    k = size - 1
    counts = np.bincount((np.arange(m)[:, None] * size + at).ravel(), minlength=m * size).reshape(m, size)
    chi = np.maximum(size * (counts.astype(float) ** 2).sum(axis=1) / n - n, 1e-9)
    uniform = _upper_normal(((chi / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k)))
    high = 2 * at >= size
    a = high.sum(axis=1).astype(float)
    b = n - a
    changes = 1 + (high[:, 1:] != high[:, :-1]).sum(axis=1)
    mean = 2 * a * b / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    runs = np.where(var > 0, 2 * _upper_normal(np.abs(changes - mean) / np.sqrt(np.where(var > 0, var, 1))), 1.0)
    runs = np.where(a * b > 0, runs, 2.0 ** (1 - n))
    off = at - at.mean(axis=1, keepdims=True)
    total = (off * off).sum(axis=1)
    r = np.where(total > 0, (off[:, 1:] * off[:, :-1]).sum(axis=1) / np.where(total > 0, total, 1), 1.0)
    serial = 2 * _upper_normal(np.abs(r) * math.sqrt(n))
    half = -sum(np.log(np.maximum(q, 1e-300)) for q in (uniform, runs, serial))
    return np.exp(-half) * (1 + half + half * half / 2)


def battery(token: str, index: dict) -> float:
    """The battery's p value of one token."""
    return float(battery_rows(np.array([[index[s] for s in token]]), len(index))[0])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the fixed patterns, in code points, end exclusive, by start and kind."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def infer_kind(token: str) -> tuple[str, str]:
    """(encoding or kind that the encodings leave out, the token as it is read in that)."""
    if found := infer_encoding(token):
        return found[0], token
    if token.isdigit():
        return "digits", token
    if token.isalpha():
        return ("lower26", token) if token.islower() else ("upper26", token) if token.isupper() else ("capitalised", token.lower())
    return "mixture", token


def candidates(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, token as read) of all tokens."""
    return [(m.start(), m.end(), *infer_kind(m.group())) for m in TOKEN.finditer(text)]


def pair_counts(text: str) -> np.ndarray:
    """Counts of neighbouring symbols, at 128 * first + second; all symbols that aren't ASCII are one."""
    at = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    at = np.where(at < 128, at, 0).astype(np.int64)
    return np.bincount(at[:-1] * 128 + at[1:], minlength=128 * 128)


def likelihood_ratios(pairs: np.ndarray, own: int = 1) -> dict[str, np.ndarray]:
    """Per kind, [first, second]: log10 of the chance of a symbol if all are alike over its chance after the first in the corpus.

    The successors of a symbol are counted over the corpus, less own (the pair that is tested), beside the
    transitions between lower case, upper case, digits and the rest with the symbols' shares in their class. All are
    taken within the kind's alphabet.
    """
    pairs = np.asarray(pairs, float).reshape(128, 128)
    out = {}
    for kind, symbols in (ENCODINGS | OTHERS).items():
        at = [ord(s) for s in symbols]
        counted = pairs[np.ix_(at, at)]
        member = np.array([[s.islower(), s.isupper(), s.isdigit(), not s.isalnum()] for s in symbols], float)
        used = member.sum(0) > 0
        member = member[:, used]
        moves = member.T @ counted @ member + 1.0
        moves /= moves.sum(1, keepdims=True)
        single = counted.sum(0) + 1.0
        share = single / (member @ (member.T @ single))
        chance = np.maximum(counted - own, 0) + BACKOFF * (member @ moves @ member.T) * share
        chance /= chance.sum(1, keepdims=True)
        out[kind] = -np.log10(len(symbols) * chance)
    return out


def evidence(ratios: dict[str, np.ndarray], kind: str, at: np.ndarray) -> np.ndarray:
    """Steps of the evidence that each row of symbol numbers is random, 0 if there is none.

    Powers of ten of the likelihood ratio of random symbols against ordinary text, and of the battery's p value: a token
    that random symbols would hardly ever look like loses as much as it is unlikely.
    """
    ratio = ratios[kind][at[:, :-1], at[:, 1:]].sum(axis=1)
    battery_power = np.log10(np.maximum(battery_rows(at, len(ratios[kind])), 1e-300))
    return (STEPS * np.clip(ratio + battery_power, 0.0, MOST_POWER)).astype(int)


def score(ratios: dict[str, np.ndarray], kind: str, token: str) -> int:
    """The evidence of one token."""
    return int(evidence(ratios, kind, np.array([[_INDEX[kind][s] for s in token]]))[0])


def _stratum(kind: str, n: int) -> str:
    return f"{kind}/{max(x for x in LENGTHS if x <= n)}"


def ordinary_reach(ratios: dict[str, np.ndarray], stratum: str) -> int:
    """The step that random tokens of the stratum's least length hardly ever score less than. ratios are those of new tokens."""
    kind, n = stratum.split("/")
    at = np.random.default_rng(0).integers(0, len(ratios[kind]), (DRAWN, int(n)))
    return int(np.quantile(evidence(ratios, kind, at), APART, method="lower"))


def _spread(total: float, n: float, reach: float) -> float:
    """Mean of the exponential distribution whose values under reach have the mean total / n, reach at most."""
    mean = total / n
    low, high = min(mean, reach), float(reach)
    for _ in range(60):
        middle = math.sqrt(low * high)
        low, high = (middle, high) if middle - reach / math.expm1(min(reach / middle, 700.0)) < mean else (low, middle)
    return high


def thresholds(histogram: pd.DataFrame, reaches: dict[str, int], rate: float = FALSE_DISCOVERY_RATE) -> dict[str, int]:
    """Benjamini-Hochberg by stratum, from counts of tokens by step of score: the least step that is reported.

    Were ordinary tokens drawn from the corpus's symbol pairs, evidence of 10 ** x would have a chance of at most
    10 ** -x, since the battery only takes away from the ratio. They aren't quite, so the fall of the chance is taken from the stratum's ordinary tokens: those that score more
    than 0 and less than random ones do. It is never taken to be steeper than for symbol pairs, and as steep where random
    tokens may score 0 themselves, as numbers do.
    """
    model = STEPS / math.log(10)
    tails = {}
    for stratum, rows in histogram.groupby("stratum"):
        tail = rows[(rows.step > 0) & (rows.step < reaches[stratum])]
        if n := int(tail.n.sum()):
            tails[stratum] = (n, max(model, _spread(float((tail.n * (tail.step + 0.5)).sum()), n, reaches[stratum])))
    # Strata lend each other the spread in parts of the reach, since that says how well a stratum tells random from ordinary.
    pooled = sum(n * spread / reaches[x] for x, (n, spread) in tails.items()) / (sum(n for n, _ in tails.values()) + PRIOR)
    out = {}
    for stratum, rows in histogram.groupby("stratum"):
        n, spread = tails.get(stratum, (0, 0.0))
        spread = (n * spread + PRIOR * max(model, pooled * reaches[stratum])) / (n + PRIOR)
        tests, above = int(rows.n.sum()), 0
        for step, n in sorted(zip(rows.step, rows.n), reverse=True):
            above += n
            if math.exp(-step / spread) * tests <= rate * above:
                out[stratum] = int(step)
    return out


def find_secrets(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rate: float = FALSE_DISCOVERY_RATE) -> DataFrame:
    """Per row of docs: id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined).

    Spans of the kinds assign, access and hex follow fixed patterns, leftmost and without overlap per kind. A further
    span, random, is a token of 16 or more symbols whose evidence (the p value of a battery of chi-squared, runs and serial
    correlation tests under random symbols, times the likelihood ratio of random symbols against the corpus's own symbol pairs) has a
    chance among ordinary tokens that Benjamini-Hochberg reports within its encoding and length class, over all documents. Numbers, words of one case and mixtures of alphabets have strata of their own. Null is an empty text:
    no spans. A row comes out per row of docs, with its id as it is (null, repeated or of any type); other columns are
    left out; an empty table gives no rows. Every text is read whole, twice: pairs are counted, then tokens are scored; what leaves are counts,
    spans and scores. The pair counts (128 x 128) and the histogram (strata times steps) have fixed sizes.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(128 * 128, np.int64)
        for rows in batches:
            for text in rows["text"]:
                if text:
                    sums += pair_counts(text)
        at = np.flatnonzero(sums)
        yield pd.DataFrame({"pair": at, "n": sums[at]})

    sums = texts.select("text").mapInPandas(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()  # 128 x 128 rows
    pairs = np.zeros(128 * 128)
    pairs[sums.pair.to_numpy(int)] = sums.n.to_numpy(float)
    ratios, unseen = likelihood_ratios(pairs), likelihood_ratios(pairs, 0)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:  # ids stay in Arrow, so they come out as they are, nulls and large ones too
            base, found = [], []
            for text in rows.column("text"):
                text = text.as_py() or ""
                base.append([f"{KINDS[k]}:{a}:{b}" for a, k, b in base_spans(text)])
                found.append([{"start": a, "end": b, "stratum": _stratum(k, b - a), "step": score(ratios, k, t)} for a, b, k, t in candidates(text)])
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(base, BASE), pa.array(found, FOUND)], names=["id", "base", "found"])

    kind = docs.schema[id_col].dataType.simpleString()
    scanned = materialise(
        texts.mapInArrow(scan, f"id {kind}, base array<string>, found array<struct<start:long,end:long,stratum:string,step:int>>"),
        "secrets-scan",
    )
    steps = scanned.select(F.explode("found").alias("g")).select("g.stratum", "g.step")
    histogram = steps.groupBy("stratum", "step").agg(F.count("*").alias("n")).toPandas()
    least = thresholds(histogram, {x: ordinary_reach(unseen, x) for x in histogram.stratum.unique()}, rate)

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def spelled(base: pd.Series, found: pd.Series) -> pd.DataFrame:
        out = []
        for own, xs in zip(base, found, strict=True):
            more = [x for x in xs if x["step"] >= least.get(x["stratum"], 1 << 30)]
            spans = [*own, *(f"random:{x['start']}:{x['end']}" for x in more)]
            spans.sort(key=lambda s: (int(s.split(":")[1]), KINDS.index(s.split(":")[0])))
            kinds = [s.partition(":")[0] for s in own]
            out.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(",".join(own).encode()).hexdigest(), ",".join(spans)))
        return pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return scanned.select(F.col("id").alias(id_col), spelled("base", "found").alias("_s")).select(id_col, "_s.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
