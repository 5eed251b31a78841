"""Log-probabilities of texts under a smoothed n-gram model, by a weighted backoff automaton."""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import count

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.llm.common import number_of_parts, table

ORDER = 2
#: Strength of the lower order in each context, in pseudo-counts.
MU = 1000.0
FOLDS, HELD_OUT = 5, 1
#: Bytes of text whose documents are traversed together, and whose n-grams meet in one bucket. Both counts of groups
#: follow from the size of the table.
PART_BYTES = 12 << 20
BUCKET_BYTES = 32 << 20
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: The lowest two bits of a key tell what it is: a token, the start of a text, an n-gram of higher order.
TOKEN, START, GRAM = 1, 3, 0
SEED = 1
_START, _END = b"\t", b"\n"  # no word holds white space


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit keys."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tagged(x: np.ndarray, tag: int) -> np.ndarray:
    return (x & ~np.uint64(3)) | np.uint64(tag)


def _stream(texts) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The documents' tokens one after another, each document opened by a start and closed by an end.

    Returns the keys of the grams of order 1, 2, ... that end at each place (0 where there is none), the document
    number of each place, and whether a token stands there (not a start).
    """
    number: dict[bytes, int] = defaultdict(count().__next__)
    start = number[_START]
    words: list[bytes] = []
    sizes = []
    for text in texts:
        own = (text or "").encode("utf-8", "replace").translate(LOWER).split()
        words.append(_START)
        words += own
        words.append(_END)
        sizes.append(len(own) + 2)
    ids = np.fromiter((number[w] for w in words), np.int64, len(words))
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in number), np.uint64, len(number))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    is_token = ids != start
    h = hashes[ids]
    return h, doc, is_token


def _grams(h: np.ndarray, is_token: np.ndarray, order: int) -> list[np.ndarray]:
    first = _mix(h)
    out = [np.where(is_token, _tagged(first, TOKEN), _tagged(first, START))]
    full = first
    valid = np.ones(len(h), bool)
    for k in range(2, order + 1):
        longer = np.zeros_like(full)
        longer[1:] = _mix(full[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] + np.uint64(k))
        ok = np.zeros_like(valid)
        ok[1:] = valid[:-1] & is_token[1:]
        full, valid = longer, ok
        out.append(np.where(valid, _tagged(full, GRAM), np.uint64(0)))
    return out


def _distinct(grams: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sorted distinct keys of all orders and, per order, each place's index among them."""
    keys, inverse = np.unique(np.concatenate(grams), return_inverse=True)
    return keys, np.split(inverse, len(grams))


def _pack(sorted_keys: np.ndarray) -> bytes:
    """Sorted keys as the low bytes of their differences."""
    gaps = np.diff(sorted_keys, prepend=np.uint64(0))
    width = max(1, (int(gaps[1:].max()).bit_length() + 7) // 8) if len(gaps) > 1 else 1
    low = np.ascontiguousarray(gaps[1:]).view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + gaps[:1].tobytes() + low.tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    width = raw[0]
    gaps = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, width)
    wide = np.zeros((len(gaps) + 1, 8), np.uint8)
    wide[0] = np.frombuffer(raw, np.uint8, 8, 1)
    wide[1:, :width] = gaps
    return np.cumsum(wide.view(np.uint64).ravel(), dtype=np.uint64)


def _pack_counts(n: np.ndarray) -> bytes:
    return zlib.compress(n.astype("<i8").tobytes(), 1)


def _unpack_counts(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), "<i8")


class Automaton:
    """The weighted backoff automaton over the n-grams that a part's documents visit.

    Grams are known by their index; c has their training counts. A gram of under the full order with a count is a
    state, and there is the root. A gram of order 2 or more with a count is an arc, from the state of its context by
    its last token; the root has an arc for each token. A failure arc leads from a state to the context without its
    oldest token, at the cost of the weight which that shorter context has.
    """

    ROOT = -1

    def __init__(self, at: list[np.ndarray], real: np.ndarray, c: np.ndarray, root_arc: np.ndarray, mu: float):
        self.size, order = len(c), len(at)
        seen = real & (c > 0)
        logp, failure, source, last = root_arc.copy(), np.full(len(c), self.ROOT), np.zeros_like(c), np.zeros_like(c)
        self.arcs: dict[int, int] = {}
        full = np.zeros(len(c), bool)
        full[at[-1]] = True
        for k in range(1, order):
            place = np.flatnonzero(seen[at[k]])
            arc = at[k][place]
            source[arc], last[arc], failure[arc] = at[k - 1][place - 1], at[0][place], at[k - 1][place]
            own = np.zeros(len(c), bool)
            own[arc] = True
            arc = np.flatnonzero(own)
            context = c[source[arc]]
            logp[arc] = np.log10((c[arc] + mu * 10.0 ** logp[failure[arc]]) / (context + mu))
            self.arcs.update(zip((source[arc] * self.size + last[arc]).tolist(), arc.tolist()))
        # An arc ends in the longest state that its gram ends with: itself, or at full order its failure state.
        target = np.where(seen & ~full, np.arange(len(c)), failure)
        self.logp, self.failure, self.target = memoryview(logp), memoryview(failure), memoryview(target)
        self.cost = memoryview(np.log10(mu / (c + mu)))

    def walk(self, start: int, tokens: list[int]) -> float:
        """The log10 probability of the tokens behind a start, in one pass from left to right."""
        arcs, logp, failure, target, cost, size = self.arcs, self.logp, self.failure, self.target, self.cost, self.size
        state, total = target[start], 0.0
        for token in tokens:
            while state != self.ROOT:
                arc = arcs.get(state * size + token)
                if arc is not None:
                    break
                total += cost[state]
                state = failure[state]
            else:
                arc = token
            total += logp[arc]
            state = target[arc]
        return total


def score_texts(docs: DataFrame, train, text_col="text", id_col="doc_id", order: int = ORDER, mu: float = MU) -> DataFrame:
    """Per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    train is a boolean Column: rows that the counts are taken from (null: not). Tokens are the lower-cased words of a
    text and one end; a null or blank text has the end alone. Without training rows all tokens are unknown. A row comes
    out per row of docs, with its id as it is (it travels as text: null, repeated or large ids are exact); other columns
    are left out; an empty table gives no rows.

    The model: P(w | h) = (c(hw) + mu P(w | h')) / (c(h) + mu), h' being h without its oldest token, down to the
    smoothed share of the single token. As an automaton, each seen context is a state; a seen continuation is an arc
    with its log-probability; every state has a failure arc to its shorter context that costs log mu / (c(h) + mu).

    Nothing of the model is collected or broadcast. Documents are dealt to parts; a part sends the distinct keys of
    its n-grams with its training counts to buckets (ranges of the scrambled key, so no bucket is hot however common
    a word is); a bucket adds up the counts and answers each part in the order asked; then each part has just the
    states and arcs that its documents visit and goes through each document once, left to right.
    """
    trained = F.coalesce(train, F.lit(False))
    n_rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    weight = size + 64 * n_rows
    parts, buckets = number_of_parts(weight, PART_BYTES), number_of_parts(weight, BUCKET_BYTES)
    part = F.pmod(F.xxhash64(id_col, text_col), F.lit(parts)).cast("int")  # rows without an id are spread by their texts
    dealt = docs.select(
        part.alias("part"), F.col(id_col).cast("string").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), trained.alias("train")
    ).repartition(parts, "part")

    def ask(rows: pd.DataFrame) -> pd.DataFrame:
        h, doc, is_token = _stream(rows.text)
        keys, at = _distinct(_grams(h, is_token, order))
        trained = rows.train.to_numpy(bool)[doc]
        counts = np.zeros(len(keys), np.int64)
        for index in at:
            counts += np.bincount(index[trained], minlength=len(keys))
        counts[keys == 0] = 0  # where a place has no gram of that order
        bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        cuts = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(keys)]
        return pd.DataFrame(
            {
                "bucket": bucket[cuts[:-1]],
                "part": rows.part.iloc[0],
                "keys": [_pack(keys[a:b]) for a, b in zip(cuts, cuts[1:])],
                "counts": [_pack_counts(counts[a:b]) for a, b in zip(cuts, cuts[1:])],
            }
        )

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [_unpack(k) for k in rows["keys"]]
        flat, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([_unpack_counts(c) for c in rows["counts"]]), minlength=len(flat)).astype(np.int64)
        ends = np.cumsum([len(k) for k in keys])
        return pd.DataFrame({"part": rows.part, "bucket": rows.bucket, "counts": [_pack_counts(total[a]) for a in np.split(at, ends[:-1])]})

    def seen_tokens(rows: pd.DataFrame) -> pd.DataFrame:
        found, total = [], 0
        for raw, counts in zip(rows["keys"], rows["counts"], strict=True):
            keys, c = _unpack(raw), _unpack_counts(counts)
            known = ((keys & np.uint64(3)) == TOKEN) & (c > 0)
            found.append(keys[known])
            total += int(c[known].sum())
        return pd.DataFrame({"v": [len(np.unique(np.concatenate(found)))], "n": [total]})

    def traverse(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        h, doc, is_token = _stream(rows.text)
        keys, at = _distinct(_grams(h, is_token, order))
        c = np.concatenate([_unpack_counts(x) for x in answers.sort_values("bucket").counts])
        n, v = int(answers.n.iloc[0]), int(answers.v.iloc[0])
        root_arc = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))  # by key, of the single tokens
        automaton = Automaton(at, keys != 0, c, root_arc, mu)
        starts = np.flatnonzero(~is_token)
        score = [automaton.walk(at[0][i], at[0][i + 1 : j].tolist()) for i, j in zip(starts, np.r_[starts[1:], len(h)])]
        here = lambda x: np.bincount(doc[is_token], weights=x[is_token], minlength=len(rows))
        return pd.DataFrame(
            {
                "doc": rows.doc,
                "held_out": ~rows.train.to_numpy(bool),
                "n_tokens": here(np.ones(len(h))).astype(np.int64),
                "n_known": here((c[at[0]] > 0).astype(float)).astype(np.int64),
                "train_tokens": n,
                "base_score": here(root_arc[at[0]]),
                "score": score,
            }
        )

    # Both readings of asked use one exchange, as do both of dealt.
    asked = dealt.groupBy("part").applyInPandas(ask, "bucket long, part int, keys binary, counts binary").repartition(buckets, "bucket")
    sums = [F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("v", "n")]
    known = asked.groupBy("bucket").applyInPandas(seen_tokens, "v long, n long").agg(*sums)
    answered = asked.groupBy("bucket").applyInPandas(answer, "part int, bucket long, counts binary")
    answers = answered.withColumn("known", known.select(F.struct("v", "n")).scalar()).select("*", "known.v", "known.n").drop("known")
    scored = dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInPandas(
        traverse, "doc string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    kind = docs.schema[id_col].dataType
    return scored.select(F.col("doc").cast(kind).alias(id_col), *scored.columns[1:])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents. A row without an id is held out: nothing is learned from it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_texts(docs, F.crc32(F.col("doc_id").cast("string")) % FOLDS != HELD_OUT)
