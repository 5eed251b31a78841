"""SentencePiece encoding and decoding; long documents by a max-plus scan over chunks."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, StructField, StructType
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from tablewarden.llm.common import table

DEFAULT_MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Documents of more characters than this are split into chunks of so many.
CHUNK = 16_384
#: Segments remembered by a worker.
CACHE = 200_000
DOCS_AT_ONCE, CHUNKS_AT_ONCE = 1024, 128
#: Segments up to so many characters are searched many at once; segments are merged in lines of so many characters.
TOGETHER, LINE_CHARS = 48, 4_000
SEARCHED_AT_ONCE = 20_000
#: Numbered slots that steps from piece to piece are looked up in.
SLOTS = 1 << 19
BPE = 2
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNKNOWN_PENALTY = 10.0


class Pieces:
    """A model file's pieces: look-ups, places where a text falls apart, and the two ways to encode a segment."""

    def __init__(self, path: str):
        proto = model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not proto.trainer_spec.byte_fallback:
            raise ValueError("only models that leave characters as they are and fall back to bytes are read")
        self.kind, self.prefix = proto.trainer_spec.model_type, SPACE if norm.add_dummy_prefix else ""
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (NORMAL, USER)}
        self.score = [p.score for p in proto.pieces]
        self.unknown_score = min(p.score for p in proto.pieces if p.type == NORMAL) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.ids))
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.bytes = [
            bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else b"" if p.type == CONTROL else p.piece.replace(SPACE, " ").encode()
            for p in proto.pieces
        ]
        #: Every beginning of a piece, with the piece's id or -1: a look-up that fails ends the search at its place.
        self.begins = {piece[:k]: -1 for piece in self.ids for k in range(1, len(piece))} | self.ids
        known = {c for piece in self.ids for c in piece}
        self.known, self.singles = known, {c for c in known if c in self.ids}
        self._number_nodes()
        #: No piece has a space after another symbol: then every text falls apart before each run of spaces.
        self.by_space = not any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece in self.ids)
        self.lines = self.by_space and "\n" not in known
        self.segment = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+" if self.lines else "(?s).+")
        norm.add_dummy_prefix = False
        self.merging = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.narrow = "<u2" if len(self.bytes) <= 1 << 16 else "<i4"  # ids of chunks travel as narrow as they can
        self.pairs: dict[tuple[str, str], bool] = {}
        #: By ways: the numbers of the segments met, and for each way their ids, sizes and whether these spell them.
        self.met: dict[tuple[str, ...], tuple[dict[str, int], dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]]] = {}

    def _number_nodes(self) -> None:
        """The beginnings of pieces as numbered nodes, and the steps between them as sorted numbers."""
        node = {"": 0} | {begin: i + 1 for i, begin in enumerate(self.begins)}
        code = {c: i + 1 for i, c in enumerate(sorted(self.known))}
        self.code_of = np.zeros(0x110000, np.int64)
        self.code_of[[ord(c) for c in code]] = list(code.values())
        self.codes = len(code) + 1
        steps = sorted((node[b[:-1]] * self.codes + code[b[-1]], node[b]) for b in self.begins)
        self.step_keys, self.step_nodes = (np.array(x, np.int64) for x in zip(*steps))
        slots = _slot(self.step_keys)
        self.slot_key, self.slot_step, self.crowded = np.full(SLOTS, -1), np.zeros(SLOTS, np.int64), np.bincount(slots, minlength=SLOTS) > 1
        self.slot_key[slots], self.slot_step[slots] = self.step_keys, np.arange(len(slots))
        self.piece_of = np.full(len(node), -1, np.int64)
        for begin, piece in self.begins.items():
            self.piece_of[node[begin]] = piece
        self.scores = np.array(self.score)
        self.is_single = np.zeros(self.codes, bool)
        self.is_single[[code[c] for c in self.singles]] = True
        self.byte_length = np.array([len(b) for b in self.bytes], np.int64)
        self.byte_start = np.cumsum(self.byte_length) - self.byte_length
        self.byte_text = np.frombuffer(b"".join(self.bytes), np.uint8)

    def normalise(self, text: str) -> str:
        return self.prefix + text.replace(" ", SPACE) if text else ""

    def cut(self, text: str, at: int) -> bool:
        """Whether no piece can span the place before text[at]."""
        if at <= 0 or at >= len(text):
            return at == 0 or at == len(text)
        return (self.by_space and text[at] == SPACE and text[at - 1] != SPACE) or text[at] not in self.known or text[at - 1] not in self.known

    def lattice(self, text: str, start: int, limit: int) -> tuple[dict[int, float], dict[int, tuple[int, int]]]:
        """Best scores from start to each place, by pieces that begin before limit, and each place's last piece (begin, id).

        Of equal scores the piece that begins first, the longest, wins; -1 is an unknown symbol.
        """
        best, back = {start: 0.0}, {}
        begins, score = self.begins, self.score
        for at in range(start, min(limit, len(text))):
            if at not in best:
                continue
            base, single = best[at], False
            for end in range(at + 1, min(len(text), at + self.longest) + 1):
                piece = begins.get(text[at:end])
                if piece is None:
                    break
                if piece < 0:
                    continue
                single = single or end == at + 1
                total = base + score[piece]
                if end not in best or total > best[end]:
                    best[end], back[end] = total, (at, piece)
            if not single:
                total = base + self.unknown_score
                if at + 1 not in best or total > best[at + 1]:
                    best[at + 1], back[at + 1] = total, (at, -1)
        return best, back

    def trace(self, text: str, back: dict[int, tuple[int, int]], start: int, end: int) -> tuple[list[int], list[int]]:
        """(ids, places passed from end back to start) of the best path."""
        steps, places = [], [end]
        while end > start:
            begin, piece = back[end]
            steps.append([piece] if piece >= 0 else [self.byte_ids[b] for b in text[begin:end].encode()])
            end = begin
            places.append(end)
        return [i for step in reversed(steps) for i in step], places

    def search_together(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best paths of segments of one length (rows of symbol numbers) whose symbols are all pieces, place by place for
        all segments at once: ids one after another, and how many each segment has."""
        n, size = codes.shape
        hits: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}  # (end, length of the piece): segments, pieces
        row, begin = (x.ravel() for x in np.indices((n, size)))
        node = np.zeros(n * size, np.int64)
        for d in range(1, min(size, self.longest) + 1):
            inside = begin + d <= size
            row, begin, node = row[inside], begin[inside], node[inside]
            key = node * self.codes + codes[row, begin + d - 1]
            slot = _slot(key)
            there, at = self.slot_key[slot] == key, self.slot_step[slot]
            crowd = np.flatnonzero(self.crowded[slot] & ~there)  # steps that share a slot are looked up in order
            at[crowd] = np.minimum(np.searchsorted(self.step_keys, key[crowd]), len(self.step_keys) - 1)
            there[crowd] = self.step_keys[at[crowd]] == key[crowd]
            row, begin, node = row[there], begin[there], self.step_nodes[at[there]]
            if not len(row):
                break
            whole = self.piece_of[node] >= 0
            ends, rows, ids = begin[whole] + d, row[whole], self.piece_of[node[whole]]
            order = np.argsort(ends, kind="stable")
            cuts = np.searchsorted(ends[order], np.arange(size + 2))
            for end in range(d, size + 1):
                own = order[cuts[end] : cuts[end + 1]]
                if len(own):
                    hits[end, d] = rows[own], ids[own]
        best = np.full((size + 1, n), -np.inf)
        best[0] = 0
        length, piece = np.zeros((size + 1, n), np.int64), np.zeros((size + 1, n), np.int64)
        for end in range(1, size + 1):
            for d in range(min(end, self.longest), 0, -1):
                if (end, d) in hits:
                    rows, ids = hits[end, d]
                    total = best[end - d, rows] + self.scores[ids]
                    better = total > best[end, rows]
                    rows = rows[better]
                    best[end, rows], length[end, rows], piece[end, rows] = total[better], d, ids[better]
        place, every, steps = np.full(n, size), np.arange(n), []
        while (place > 0).any():
            steps.append(np.where(place > 0, piece[place, every], -1))
            place = place - np.where(place > 0, length[place, every], 0)
        path = np.array(steps[::-1]).T
        return path[path >= 0].astype("<i4"), (path >= 0).sum(axis=1)

    def segments_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Parts of texts in the model's symbols that no piece spans (a line feed may begin one): the parts of all texts as
        numbers in a list of the distinct parts, and how many each text has.

        Where spaces stand alone, splitting finds the parts; other spacing goes through the pattern.
        """
        odd = np.ones(len(texts), bool)
        if self.lines:
            texts = pc.replace_substring(pc.replace_substring(texts, "\n", " \n"), SPACE, f" {SPACE}")
            odd = pc.or_(pc.match_substring(texts, f"{SPACE} "), pc.ends_with(texts, SPACE)).to_numpy(zero_copy_only=False)
        if odd.any():
            whole = [t.replace(f" {SPACE}", SPACE).replace(" \n", "\n") if self.lines else t for t in texts.filter(pa.array(odd)).to_pylist()]
            texts = pc.replace_with_mask(texts, pa.array(odd), pa.array([" ".join(self.segment.findall(t)) for t in whole], texts.type))
        parts = pc.split_pattern(texts, " ")
        named = parts.flatten().dictionary_encode()
        return named.indices.to_numpy(), np.diff(parts.offsets.to_numpy()), named.dictionary.to_pylist()

    def _merged(self, segments: list[str], feeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments by the model's merges, one after another, and how many each has. feeds: which begin with a line feed."""
        if not self.lines:
            each = [self.merging.encode(s) for s in segments]
            return np.array([i for ids in each for i in ids], "<i4"), np.array([len(ids) for ids in each], np.int64)
        line = np.cumsum(np.fromiter(map(len, segments), np.int64, len(segments)) + 1) // LINE_CHARS
        at = np.r_[np.flatnonzero(np.diff(line, prepend=-1)), len(segments)].tolist()
        # A line feed merges with nothing, so it separates segments encoded in one go.
        ids = np.concatenate([np.array(self.merging.encode("\n".join(segments[i:j]) + "\n"), "<i4") for i, j in zip(at, at[1:])])
        ends = np.flatnonzero(ids == self.byte_ids[10])[np.cumsum(1 + feeds) - 1]
        return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1

    def _searched(self, segments: list[str], feeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same by the best path."""
        points = np.frombuffer("".join(segments).encode("utf-32-le"), "<u4")
        codes, lengths = self.code_of[points], np.fromiter(map(len, segments), np.int64, len(segments)) - feeds
        begins = np.cumsum(lengths + feeds) - lengths
        odd = np.r_[0, np.cumsum(~self.is_single[codes])]
        together = (lengths > 0) & (lengths <= TOGETHER) & (odd[begins + lengths] == odd[begins])
        sizes, found = feeds.astype(np.int64), []
        for n in np.unique(lengths[together]).tolist():
            rows = np.flatnonzero(together & (lengths == n))
            for some in np.array_split(rows, -(-len(rows) // SEARCHED_AT_ONCE)):
                found.append((some, *self.search_together(codes[begins[some][:, None] + np.arange(n)])))
        for i in np.flatnonzero(~together & (lengths > 0)).tolist():
            s = segments[i][int(feeds[i]) :]
            ids = self.trace(s, self.lattice(s, 0, len(s))[1], 0, len(s))[0]
            found.append((np.array([i]), np.array(ids, "<i4"), np.array([len(ids)])))
        for rows, _, n in found:
            sizes[rows] += n
        starts = np.cumsum(sizes) - sizes
        out = np.full(int(sizes.sum()), self.byte_ids.get(10, 0), "<i4")
        for rows, ids, n in found:
            out[_ranges(starts[rows] + feeds[rows], n)] = ids
        return out, sizes

    def _spelling(self, segments: list[str], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which segments their ids spell."""
        text = np.frombuffer("".join(segments).replace(SPACE, " ").encode(), np.uint8)
        ends = np.flatnonzero(np.r_[(text & 0xC0) != 0x80, True])[np.cumsum(np.fromiter(map(len, segments), np.int64, len(segments)))]
        lengths = self.byte_length[ids]
        got = np.r_[0, np.cumsum(lengths)][np.cumsum(sizes)]
        alike = np.diff(ends, prepend=0) == np.diff(got, prepend=0)
        spelled = self.byte_text[_ranges(self.byte_start[ids], lengths)]
        here, there = (_ranges(x[alike] - np.diff(x, prepend=0)[alike], np.diff(x, prepend=0)[alike]) for x in (ends, got))
        wrong = np.r_[0, np.cumsum(text[here] != spelled[there])]
        upto = np.cumsum(np.diff(ends, prepend=0)[alike])
        alike[alike] = np.diff(wrong[upto], prepend=0) == 0
        return alike

    def encode(self, texts: pa.Array, ways: tuple[str, ...]) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each way the ids of texts in the model's symbols, one after another, where each text's begin and end, and
        which texts their ids spell.

        Distinct segments are numbered; each is encoded, and spelled again, once for all texts at hand.
        """
        if ways not in self.met or len(self.met[ways][0]) > CACHE:
            self.met[ways] = defaultdict(count().__next__), {w: (np.zeros(0, "<i4"), np.zeros(0, np.int64), np.zeros(0, bool)) for w in ways}
        number, met = self.met[ways]
        had = len(number)
        codes, lengths, segments = self.segments_of(texts)
        codes = np.fromiter(map(number.__getitem__, segments), np.int64, len(segments))[codes]
        fresh = list(islice(number, had, None))
        feeds = np.array([s[:1] == "\n" for s in fresh], bool) & self.lines
        doc = np.repeat(np.arange(len(texts)), lengths)
        out = {}
        for way in ways:
            if fresh:
                ids, sizes = (self._merged if way == "merges" else self._searched)(fresh, feeds)
                more = ids, sizes, self._spelling(fresh, ids, sizes)
                met[way] = tuple(np.concatenate(x) for x in zip(met[way], more, strict=True))
            flat, sizes, sound = met[way]
            n = sizes[codes]
            ids = flat[_ranges((np.cumsum(sizes) - sizes)[codes], n)]
            bounds = np.r_[0, np.r_[0, np.cumsum(n)][np.cumsum(lengths)]]
            out[way] = ids, bounds, np.bincount(doc[~sound[codes]], minlength=len(texts)) == 0
        return out

    def spell(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, memoryview(ids).cast("i")))

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        text = self.spell(ids).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text

    def symbol_ids(self, piece: str) -> list[int]:
        """A piece's id; of a symbol that is no piece, its bytes' ids."""
        i = self.ids.get(piece, -1)
        return [i] if i >= 0 else [self.byte_ids[b] for b in piece.encode()]

    def fits(self, before: str, piece: str) -> bool:
        """Whether merging leaves the two as they are where they meet; with nothing before, whether it gives the piece.

        Merging takes the best pair first, so what happens within two neighbours is the same whether others stand beside
        them or not, as long as no pair merges across a border. A row of pieces is therefore what merging a text gives if,
        and only if, all its neighbours fit.
        """
        held = self.pairs.get((before, piece))
        if held is None:
            if len(self.pairs) > CACHE:
                self.pairs.clear()
            want = self.symbol_ids(before) + self.symbol_ids(piece) if before else self.symbol_ids(piece)
            held = self.pairs[before, piece] = self.merging.encode(before + piece) == want
        return held

    def ends(self, text: str, at: int) -> Iterator[int]:
        """Where the symbol at a place and the pieces that begin there end."""
        yield at + 1
        for end in range(at + 1, min(len(text), at + self.longest) + 1):
            piece = self.begins.get(text[at:end])
            if piece is None:
                return
            if piece >= 0 and end > at + 1:
                yield end

    def crossing(self, text: str, at: int) -> list[tuple[int, int]]:
        """(begin, end) of the pieces of a text that begin before a place and end there or behind: the states of a boundary."""
        return [(b, e) for b in range(max(0, at - self.longest), at) for e in self.ends(text, b) if e >= at]

    def follow(self, text: str, start: int, before: str, limit: int) -> dict[int, int]:
        """Each place that fitting pieces reach from start, where before ends, with the begin of the last piece. Pieces begin before limit.

        A place is reached in one way at most, since merging gives each text one row of pieces.
        """
        last, back = {start: before}, {}
        for at in range(start, limit):
            if at in last:
                for end in self.ends(text, at):
                    if end not in back and self.fits(last[at], text[at:end]):
                        last[end], back[end] = text[at:end], at
        return back

    def ids_back(self, text: str, back: dict[int, int], start: int, end: int) -> bytes:
        steps = []
        while end > start:
            steps.append(self.symbol_ids(text[back[end] : end]))
            end = back[end]
        return np.array([i for step in reversed(steps) for i in step], "<i4").tobytes()

    def cuts_within(self, text: str, low: int, high: int) -> tuple[int, int] | None:
        """The first and the last place from low to before high that no piece can span."""
        first = next((at for at in range(low, high) if self.cut(text, at)), None)
        return None if first is None else (first, next(at for at in range(high - 1, first - 1, -1) if self.cut(text, at)))

    def merge_transfer(self, text: str, begin: int, end: int) -> np.ndarray:
        """The transfer matrix of the chunk text[begin:end] for merging, in max-plus algebra.

        A boundary's states are the pieces that cross or end there. matrix[i, j] is 0 if fitting pieces lead from entry i
        to exit j, else -inf, so the path of weight 0 through all chunks is what merging gives.
        """
        enter, leave = self.crossing(text, begin) if begin else [(0, 0)], self.crossing(text, end)
        matrix = np.full((len(enter), len(leave)), -np.inf)
        exits = {x: j for j, x in enumerate(leave)}
        cuts = self.cuts_within(text, max(e for _, e in enter), end)
        tail = self.follow(text, cuts[1], "", end) if cuts else {}
        for i, (b, e) in enumerate(enter):
            if e >= end and begin:
                matrix[i, exits[b, e]] = 0
                continue
            back = self.follow(text, e, text[b:e], cuts[0] if cuts else end)
            if not cuts or e == cuts[0] or cuts[0] in back:
                for x, at in (tail if cuts else back).items():
                    if (at, x) in exits:
                        matrix[i, exits[at, x]] = 0
        return matrix

    def merge_trace(self, text: str, begin: int, end: int, enter: int, leave: int) -> tuple[bytes, str, bytes, int, int]:
        """Between two states: ids before the first cut, the text between the cuts, ids after the last, where all this begins and ends."""
        b, e = self.crossing(text, begin)[enter] if begin else (0, 0)
        _, x = self.crossing(text, end)[leave]
        if e >= end and begin:
            return b"", "", b"", e, e
        cuts = self.cuts_within(text, e, end)
        if not cuts:
            return self.ids_back(text, self.follow(text, e, text[b:e], end), e, x), "", b"", e, x
        head = self.ids_back(text, self.follow(text, e, text[b:e], cuts[0]), e, cuts[0])
        return head, text[cuts[0] : cuts[1]], self.ids_back(text, self.follow(text, cuts[1], "", end), cuts[1], x), e, x

    def best_trace(self, text: str, begin: int, end: int, enter: int, leave: int) -> tuple[bytes, str, bytes, int, int]:
        """The same for the best path, whose states are places behind the boundaries."""
        e, x = begin + enter, end + leave
        spot = lambda a, z: np.array(self.trace(text, self.lattice(text, a, z)[1], a, z)[0], "<i4").tobytes()
        cuts = self.cuts_within(text, e, x)
        if not cuts:
            return spot(e, x), "", b"", e, x
        return spot(e, cuts[0]), text[cuts[0] : cuts[1]], spot(cuts[1], x), e, x

    def transfer(self, text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
        """A chunk's boundary-state transfer matrix in max-plus algebra, and how ties between entries are settled.

        text is the chunk's size symbols and what follows them, as far as a piece can reach. State i at a boundary
        means that the first place a path passes there is i symbols on. matrix[i, j] is the best score from entry
        i to exit j (-inf: no path), up to a constant for the whole matrix: the stretch between two places that every
        path passes adds the same to all entries, so it is left out and no choice depends on it. order[i, j] ranks the
        entries of an exit: of equal totals, the path wins whose places, from the exit back, are the least, which is the
        choice of one search over the whole text.
        """
        m = self.longest
        matrix, order = np.full((m, m), -np.inf), np.zeros((m, m), np.int8)
        last = len(text) - size
        first_cut = next((at for at in range(min(m - 1, size), size + 1) if self.cut(text, at)), None) if size >= m else None
        if first_cut is None:
            paths: dict[tuple[int, int], list[int]] = {}
            for i in range(min(m, len(text) + 1)):
                if i >= size:
                    if i - size < m:
                        matrix[i, i - size], paths[i, i - size] = 0.0, [i]
                    continue
                best, back = self.lattice(text, i, size)
                for j in range(min(m, last + 1)):
                    if size + j in best:
                        matrix[i, j], paths[i, j] = best[size + j], self.trace(text, back, i, size + j)[1]
            for j in range(m):
                for rank, i in enumerate(sorted((i for i in range(m) if (i, j) in paths), key=lambda i: paths[i, j])):
                    order[i, j] = rank
            return matrix, order
        last_cut = next(at for at in range(size, first_cut - 1, -1) if self.cut(text, at))
        entry, heads = np.full(m, -np.inf), {}
        for i in range(m):
            best, back = self.lattice(text, i, first_cut)
            if first_cut in best:
                entry[i], heads[i] = best[first_cut], self.trace(text, back, i, first_cut)[1]
        best, _ = self.lattice(text, last_cut, size)
        leave = np.array([best.get(size + j, -np.inf) if j <= last else -np.inf for j in range(m)])
        for rank, i in enumerate(sorted(heads, key=heads.get)):
            order[i, :] = rank
        return entry[:, None] + leave[None, :], order


def _slot(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, so many as its size says, one after another."""
    upto = np.cumsum(sizes)
    return np.repeat(starts - upto + sizes, sizes) + np.arange(upto[-1] if len(upto) else 0)


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of transfer matrices; associative. Also for stacks of matrices."""
    return (a[..., :, :, None] + b[..., None, :, :]).max(axis=-2)


def scan(matrices: np.ndarray) -> np.ndarray:
    """All prefix products of a stack of matrices, by pairs: the products of neighbours, their scan, and the rest."""
    if len(matrices) == 1:
        return matrices
    half = len(matrices) // 2
    pairs = scan(combine(matrices[0 : 2 * half : 2], matrices[1 : 2 * half : 2]))
    out = np.empty_like(matrices)
    out[0] = matrices[0]
    out[1 : 2 * half : 2] = pairs
    if len(matrices) > 2:
        rest = np.arange(2, len(matrices), 2)
        out[rest] = combine(out[rest - 1], matrices[rest])
    return out


def boundary_states(matrices: list[np.ndarray], orders: list[np.ndarray] | None = None) -> list[int]:
    """The state of the best path at each boundary of a document's chunks, from its start (0) to its end.

    Matrices of fewer states than the widest are filled up with states that no path reaches.
    """
    size = max(max(m.shape) for m in matrices)
    wide = np.full((len(matrices), size, size), -np.inf)
    for k, m in enumerate(matrices):
        wide[k, : m.shape[0], : m.shape[1]] = m
    reach = scan(wide)[:, 0, :]
    states = [0 if orders else int(reach[-1].argmax())]
    for k in range(len(wide) - 1, 0, -1):
        total = reach[k - 1] + wide[k][:, states[-1]]
        best = np.flatnonzero(total == total.max())
        states.append(int(min(best, key=lambda i: orders[k][i, states[-1]])) if orders else int(best[0]))
    return [0, *reversed(states)]


def _chunks(docs: DataFrame, reach: int, chunk: int) -> DataFrame:
    """(key, chunk, lead, size, text): size symbols of a text with the lead before and what follows, reach symbols at most.

    Texts are cut within the tasks that read them; copies of a text have one key and give one row a chunk.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                key, text = batch.column("key")[row], batch.column("text")[row].as_py()
                starts = range(0, len(text), chunk)
                for some in (starts[i : i + 256] for i in range(0, len(starts), 256)):
                    lead = [min(reach, at) for at in some]
                    columns = [
                        pa.array([key.as_py()] * len(some), batch.schema.field("key").type),
                        pa.array([at // chunk for at in some], pa.int32()),
                        pa.array(lead, pa.int32()),
                        pa.array([min(chunk, len(text) - at) for at in some], pa.int32()),
                        pa.array([text[at - a : at + chunk + reach] for at, a in zip(some, lead, strict=True)], pa.string()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "chunk", "lead", "size", "text"])

    kind = docs.schema["key"].dataType.simpleString()
    rows = docs.mapInArrow(cut, f"key {kind}, chunk int, lead int, size int, text string")
    return rows.groupBy("key", "chunk").agg(*[F.any_value(c).alias(c) for c in ("lead", "size", "text")])


def encode_giants(docs: DataFrame, path: str, ways: tuple[str, ...] = ("merges", "lattice"), chunk: int = CHUNK) -> DataFrame:
    """(key, <way>_ids, <way>_spelled): long documents (key, text) encoded chunk by chunk. Keys name texts; ids are an array
    of the chunks' ids as bytes of narrow numbers, which widen joins.

    1. Each chunk, a row of its own on any executor, gives a transfer matrix for each way. 2. The matrices of a document
    (some kB a chunk, so bounded by the length of a string) are combined by an associative scan, which gives the state at
    each boundary. 3. Each chunk finds its own part of the path between its two states, on its own; parts are joined.
    Chunks are shuffled once: both readings use that exchange.
    """
    reach = load(path).longest
    narrow = load(path).narrow
    chunks = _chunks(docs, reach, chunk)
    kind = docs.schema["key"].dataType.simpleString()
    measured = {"merges": "binary", "entries": "int"} if "merges" in ways else {}
    measured |= {"lattice": "binary", "ties": "binary"} if "lattice" in ways else {}

    def placed(p: Pieces, number: int, lead: int, size: int, text: str) -> tuple[str, int, int]:
        """The text in the model's symbols, with the prefix where it begins, and the chunk's begin and end in it."""
        first = p.prefix if lead == number * chunk else ""
        begin = lead + len(first) if number else 0
        return first + text.replace(" ", SPACE), begin, lead + size + len(first)

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield from (rows.iloc[i : i + CHUNKS_AT_ONCE].reset_index(drop=True) for i in range(0, len(rows), CHUNKS_AT_ONCE))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = load(path)
        for rows in some(batches):
            out: dict[str, list] = {c: [] for c in measured}
            for row in zip(rows["chunk"], rows["lead"], rows["size"], rows["text"], strict=True):
                text, begin, end = placed(p, *row)
                if "merges" in ways:
                    matrix = p.merge_transfer(text, begin, end)
                    out["merges"].append(matrix.astype(np.float32).tobytes())
                    out["entries"].append(matrix.shape[0])
                if "lattice" in ways:
                    matrix, order = p.transfer(text[begin:], end - begin)
                    out["lattice"].append(matrix.tobytes())
                    out["ties"].append(order.tobytes())
            yield pd.DataFrame({"key": rows["key"], "chunk": rows["chunk"]} | out)

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        out = {"key": rows.key, "chunk": rows.chunk}
        for way in ways:
            if way == "merges":
                matrices = [np.frombuffer(m, np.float32).reshape(int(n), -1).astype(float) for m, n in zip(rows.merges, rows.entries, strict=True)]
                states = boundary_states(matrices)
            else:
                shaped = lambda raw, kind: [np.frombuffer(x, kind).reshape(reach, reach) for x in raw]
                states = boundary_states(shaped(rows.lattice, np.float64), shaped(rows.ties, np.int8))
            out |= {f"{way}_enter": states[:-1], f"{way}_leave": states[1:]}
        return pd.DataFrame(out)

    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = load(path)
        for rows in some(batches):
            out = {"key": rows["key"], "chunk": rows["chunk"]}
            for way in ways:
                find = p.merge_trace if way == "merges" else p.best_trace
                found, sources = [], []
                states = zip(rows["chunk"], rows["lead"], rows["size"], rows["text"], rows[f"{way}_enter"], rows[f"{way}_leave"], strict=True)
                for *row, enter, leave in states:
                    text, begin, end = placed(p, *row)
                    head, middle, tail, at, to = find(text, begin, end, int(enter), int(leave))
                    found.append((head, middle, tail))
                    sources.append(text[at:to])
                ids, at, sound = p.encode(pa.array([middle for _, middle, _ in found], pa.string()), (way,))[way]
                whole, spelled = [], []
                for (head, middle, tail), source, a, b, ok in zip(found, sources, at[:-1], at[1:], sound, strict=True):
                    whole.append(np.concatenate([np.frombuffer(head, "<i4"), ids[a:b], np.frombuffer(tail, "<i4")]).astype(narrow).tobytes())
                    ends = p.spell(head), p.spell(tail)
                    spelled.append(bool(ok) and ends[0] + middle.replace(SPACE, " ").encode() + ends[1] == source.replace(SPACE, " ").encode())
                out |= {f"{way}_ids": whole, f"{way}_spelled": spelled}
            yield pd.DataFrame(out)

    matrices = chunks.mapInPandas(measure, f"key {kind}, chunk int, {', '.join(f'{c} {k}' for c, k in measured.items())}")
    each = [f"{w}_{c} int" for w in ways for c in ("enter", "leave")]
    states = matrices.groupBy("key").applyInPandas(settle, f"key {kind}, chunk int, {', '.join(each)}")
    both = [f"{w}_ids binary, {w}_spelled boolean" for w in ways]
    parts = chunks.join(states, ["key", "chunk"]).mapInPandas(trace, f"key {kind}, chunk int, {', '.join(both)}")
    # Joined in the aggregate's own order of rows; a document's list of parts is at most as long as its text.
    parted = F.array_sort(F.collect_list(F.struct("chunk", *[f"{w}_ids" for w in ways]))).alias("parts")
    whole = parts.groupBy("key").agg(parted, *[F.bool_and(f"{w}_spelled").alias(f"{w}_spelled") for w in ways])
    return whole.select("key", *[c for w in ways for c in (F.col(f"parts.{w}_ids").alias(f"{w}_ids"), F.col(f"{w}_spelled"))])


def widen(rows: DataFrame, path: str) -> DataFrame:
    """rows with each array of chunks' ids as bytes of 32-bit numbers."""
    fields = [StructField(f.name, BinaryType()) if isinstance(f.dataType, ArrayType) else f for f in rows.schema]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        narrow = load(path).narrow
        for whole in batches:
            for at in range(whole.num_rows):
                batch = whole.slice(at, 1)
                columns = [
                    pa.array([np.frombuffer(b"".join(batch.column(f.name)[0].as_py()), narrow).astype("<i4").tobytes()], pa.binary())
                    if isinstance(f.dataType, ArrayType)
                    else batch.column(f.name)
                    for f in kinds
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kinds])

    kinds = list(rows.schema)
    return rows.mapInArrow(each, StructType(fields))


def encode(docs: DataFrame, path: str | None = None, ways: tuple[str, ...] | None = None, text_col: str = "text") -> DataFrame:
    """docs without text, with two columns for each way: <way>_ids (binary, 32-bit little-endian numbers) and
    <way>_round_trip (whether decoding them gives the text back).

    The ways are "merges" (the model's own ids where it is a BPE model) and "lattice" (best path of the pieces'
    scores, the model's own ids where it is a unigram model); by default the one of the model. Documents longer than
    CHUNK characters go through encode_giants, by either way; shorter ones are cut into segments that no piece can
    span, and each distinct segment at hand is encoded once. Null and empty texts have no ids. Equal rows give equal
    rows; columns of the names added are replaced and no other name is reserved. A text with the model's own space
    symbol doesn't come back: the symbol decodes as a space. An empty table gives no rows.
    """
    path = path or public_tokenizers.path(DEFAULT_MODEL)
    ways = tuple(ways or ("merges" if load(path).kind == BPE else "lattice",))
    others = [c for c in docs.columns if c.lower() not in {text_col.lower(), *(f"{w}_{x}" for w in ways for x in ("ids", "round_trip"))}]
    row = F.struct(*others) if others else F.struct(F.lit(0))
    rows = docs.select(row.alias("row"), F.col(text_col).alias("text"))
    giant = F.length("text") > CHUNK
    short, long = rows.filter(F.coalesce(~giant, F.lit(True))), rows.filter(giant)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(path)
        for whole in batches:
            for start in range(0, whole.num_rows, DOCS_AT_ONCE):  # what is held at once stays small, however large a batch is
                batch = whole.slice(start, DOCS_AT_ONCE)
                texts = pc.fill_null(batch.column("text"), "")
                marked = pc.match_substring(texts, SPACE).to_numpy(zero_copy_only=False)
                symbols = pc.binary_join_element_wise(pa.scalar(p.prefix), pc.replace_substring(texts, " ", SPACE), "")
                found = p.encode(pc.if_else(pc.equal(texts, ""), "", symbols), ways)
                columns = [batch.column("row")]
                for w in ways:
                    ids, at, sound = found[w]
                    buffers = [None, pa.py_buffer((at * 4).astype("<i4").tobytes()), pa.py_buffer(ids.tobytes())]
                    columns += [pa.Array.from_buffers(pa.binary(), len(texts), buffers), pa.array(sound & ~marked)]
                yield pa.RecordBatch.from_arrays(columns, names=["row", *[f"{w}_{c}" for w in ways for c in ("ids", "round_trip")]])

    schema = StructType([short.schema["row"]] + [StructField(f"{w}_{c}", BinaryType() if c == "ids" else BooleanType()) for w in ways for c in ("ids", "round_trip")])
    out = short.mapInArrow(each, schema)
    keyed = long.select("row", F.sha2("text", 256).alias("key"), F.contains("text", F.lit(SPACE)).alias("marked"))
    found = encode_giants(long.select(F.sha2("text", 256).alias("key"), "text"), path, ways)
    sound = [c for w in ways for c in (F.col(f"{w}_ids"), (F.col(f"{w}_spelled") & ~F.col("marked")).alias(f"{w}_round_trip"))]
    out = out.unionByName(widen(keyed.join(found, "key").select("row", *sound), path))
    return out.select(*[F.col("row")[c].alias(c) for c in others], *out.columns[1:])


def decode(ids: DataFrame, path: str | None = None, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """ids with the decoded text added; null ids are empty."""
    path = path or public_tokenizers.path(DEFAULT_MODEL)

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            p = load(path)
            yield pd.Series([p.decode(bytes(x or b"")) for x in rows], dtype="object")

    return ids.withColumn(out, decoded(F.col(ids_col)))


def encode_stage(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs without text, with the model's own ids (binary, 32-bit numbers), n_tokens and round_trip.

    Columns of these three names, in any case, are replaced; all others come out as they are, those of encode's own names
    too. A row comes out per row of docs; null and empty texts have no ids and 0 tokens; an empty table gives no rows.
    """
    others = [c for c in docs.columns if c.lower() not in ("text", "ids", "n_tokens", "round_trip")]
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(0))
    rows = encode(docs.select(row.alias("user"), "text"), path)
    way = rows.columns[-1].removesuffix("_round_trip")
    return rows.select(
        *[F.col("user")[c].alias(c) for c in others],
        F.col(f"{way}_ids").alias("ids"),
        (F.octet_length(f"{way}_ids") / 4).cast("long").alias("n_tokens"),
        F.col(f"{way}_round_trip").alias("round_trip"),
    )


def query(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Per document: the model's own ids (n_tokens, ids_sha256, round_trip) and the best path (lattice_tokens,
    lattice_sha256, lattice_round_trip)."""
    rows = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, ("merges", "lattice"))
    return rows.select(
        "doc_id",
        (F.octet_length("merges_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("merges_ids", 256).alias("ids_sha256"),
        F.col("merges_round_trip").alias("round_trip"),
        (F.octet_length("lattice_ids") / 4).cast("long").alias("lattice_tokens"),
        F.sha2("lattice_ids", 256).alias("lattice_sha256"),
        "lattice_round_trip",
    )
