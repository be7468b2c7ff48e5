"""SentencePiece encoding and decoding with samples: Gumbel top-k without replacement.

All segmentations of a text into pieces form a lattice; transition probabilities make every path's probability
exact. Perturbing the log-probabilities of all paths with Gumbel noise and keeping the largest ``k`` draws ``k``
distinct segmentations without replacement. The search is top-down and best-first: a region of the lattice has
the Gumbel maximum of its paths as its bound, which is known before any path is. The best region is opened by
drawing one path in it; what remains of it splits at every step of that path into smaller regions, whose maxima
are Gumbel variables truncated at the region's own. The largest bound left after ``k`` paths is the threshold
from which a path's inclusion probability follows.

The vocabulary file gives ranks, not probabilities; pieces get Zipf probabilities of their ranks, bytes that of
the last rank. Pieces do not cross word starts, so lattices are kept by word and all texts of a slice are
drawn together. Every random number is a hash of the row's key and of its place, so results do not depend on
batches, partitions or retries.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillflow.llm.batches import bounded
from tillflow.llm.units import BASES, U64, mix, prefix, span

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES, SEED = 2, 11
MARK = "▁"
#: Stands for the mark where a text itself holds it; no valid text holds a lone surrogate.
OWN_MARK = "\ud800"
#: Edges of cached word lattices before the cache starts anew, and letters of texts drawn together.
CACHE_EDGES, SLICE_CHARS = 2_000_000, 1 << 18
#: Bits of a piece's hash by which it is looked up first.
HEAD = 18
ZIPF_OFFSET = 10.0
#: Shares are cut to multiples of 1 / GRID, and logs added as multiples of 1 / FIXED: sums and comparisons are
#: then exact, whatever texts and words stand beside.
GRID, FIXED = float(1 << 30), float(1 << 32)

SCHEMA = ("id long, sample int, log_prob double, perturbed double, inclusion double, pieces array<int>")
_ARROW = pa.schema([("id", pa.int64()), ("sample", pa.int32()), ("log_prob", pa.float64()),
                    ("perturbed", pa.float64()), ("inclusion", pa.float64()), ("pieces", pa.list_(pa.int32()))])


class Vocabulary:
    """Pieces, their log-probabilities, byte pieces, and what each id stands for in bytes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.byte_ids = [0] * 256
        self.ids: dict[str, int] = {}
        self.out = np.empty(size, object)
        for number in range(size):
            piece = model.id_to_piece(number)
            self.out[number] = b""
            if model.is_byte(number):
                self.byte_ids[int(piece[3:5], 16)] = number
                self.out[number] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(number) or model.is_unknown(number)):
                self.ids[piece] = number
                self.out[number] = piece.replace(MARK, " ").encode()
        ranked = sorted(self.ids.values())
        weight = [1.0 / (rank + ZIPF_OFFSET) for rank in range(1, len(ranked) + 1)]
        total = sum(weight) + 256 * weight[-1]
        by_id = {number: math.log(w / total) for number, w in zip(ranked, weight)}
        self.log_prob = {piece: by_id[number] for piece, number in self.ids.items()}
        self.byte_log_prob = math.log(weight[-1] / total)
        starts = sorted({piece[:n] for piece in self.ids for n in range(1, len(piece) + 1)})
        letters, ends = _letters("".join(starts)), np.cumsum([len(p) for p in starts])
        hashes = span(_letter_sums(letters), ends - np.array([len(p) for p in starts]), ends, BASES[0])
        order = np.argsort(hashes)
        #: Hashes of all beginnings of pieces; their ids, -1 where they are no pieces, and log-probabilities.
        self.hashes = hashes[order]
        #: Where the hashes of each value of their first ``HEAD`` bits begin; few share one.
        heads = np.arange(1 << HEAD, dtype=U64) << U64(64 - HEAD)
        self.heads = np.minimum(np.searchsorted(self.hashes, heads), len(order) - 1)
        self.piece = np.array([self.ids.get(p, -1) for p in starts])[order]
        self.weight = np.array([self.log_prob.get(p, 0.0) for p in starts])[order]
        inner = {c for piece in self.ids if len(piece) > 1 for c in piece}
        alone = "".join(re.escape(c) for c in "\n\r\t\x0b\x0c" if c not in inner)
        crossing = [p for p in self.ids if MARK in p.lstrip(MARK)]
        if crossing:
            raise ValueError(f"pieces cross word starts: {crossing[:5]}")
        self.words = re.compile(f"[{alone}]|{MARK}*[^{MARK}{alone}]+|{MARK}+" if alone else f"{MARK}*[^{MARK}]+|{MARK}+")

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Where each hash stands among those of beginnings, -1 for others."""
        at = _climb(self.hashes, self.heads[hashes >> U64(64 - HEAD)], hashes, np.less, len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def split(self, text: str) -> list[str]:
        """The words of a text, which together are the text with a mark before it and for each space."""
        if not text:
            return []
        return self.words.findall(MARK + text.replace(MARK, OWN_MARK).replace(" ", MARK))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Grown:
    """A NumPy array that grows at its end."""

    def __init__(self, kind: type):
        self.room, self.size = np.empty(1 << 12, kind), 0

    def extend(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.room):
            room = np.empty(max(need, 2 * len(self.room)), self.room.dtype)
            room[:self.size] = self.all
            self.room = room
        self.room[self.size:need] = values
        self.size = need

    @property
    def all(self) -> np.ndarray:
        return self.room[:self.size]


def _climb(values: np.ndarray, at: np.ndarray, wanted: np.ndarray, below, last: int) -> np.ndarray:
    """The first place from ``at`` on whose value is not ``below`` what is wanted, ``last`` at most.

    Places are near where the search begins, so a few steps take less time than bisection of all values.
    """
    at = at.copy()
    on = np.flatnonzero(below(values[at], wanted) & (at < last))
    while len(on):
        at[on] += 1
        here = at[on]
        on = on[below(values[here], wanted[on]) & (here < last)]
    return at


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _letter_sums(letters: np.ndarray) -> np.ndarray:
    return prefix(mix(letters.astype(U64) + U64(1)), BASES[0])


class Lattices:
    """The word lattices of one task, laid end to end: a state per letter, with its edges in order.

    An edge has its cumulative share behind its state's number (``reach``), its log share, the log share of
    its state's other edges, the state it leads to (-1 where the word ends), and the pieces it emits.
    """

    def __init__(self, words: Vocabulary):
        self.words = words
        self.clear()

    def clear(self) -> None:
        self.start: dict[str, int] = {}
        self.states = 0
        self.reach, self.share, self.others = Grown(np.float64), Grown(np.float64), Grown(np.float64)
        self.target, self.state = Grown(np.int32), Grown(np.int32)
        self.emit_at, self.emit_size, self.emit = Grown(np.int32), Grown(np.int32), Grown(np.int32)
        self.first = Grown(np.int64)

    def numbers(self, words: list[str]) -> np.ndarray:
        """The first state of every word's lattice."""
        start = self.start
        new = [word for word in dict.fromkeys(words) if word not in start]
        if new:
            self.add(new)
        return np.fromiter(map(start.__getitem__, words), np.int64, len(words))

    def _edges(self, letters: np.ndarray, end: np.ndarray):
        """``(state, length, log_prob, piece)`` of all edges by state and length; piece -1 is spelled in bytes."""
        sums = _letter_sums(letters)
        active = np.arange(len(letters))
        parts, single = [], np.zeros(len(letters), bool)
        size = 1
        while len(active):
            entry = self.words.find(span(sums, active, active + size, BASES[0]))
            known = entry >= 0
            active, entry = active[known], entry[known]
            piece = self.words.piece[entry]
            full = piece >= 0
            parts.append((active[full], np.full(int(full.sum()), size), self.words.weight[entry[full]], piece[full]))
            if size == 1:
                single[active[full]] = True
            active = active[active + size < end[active]]
            size += 1
        spelled = np.flatnonzero(~single)
        code = letters[spelled]
        width = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        # Parts stand by length, so that a stable order by state is one by state and length.
        parts.insert(0, (spelled, np.ones(len(spelled), np.int64), width * self.words.byte_log_prob,
                         np.full(len(spelled), -1)))
        state, length, weight, piece = (np.concatenate([p[k] for p in parts]) for k in range(4))
        order = np.argsort(state, kind="stable")
        return state[order], length[order], weight[order], piece[order]

    def add(self, words: list[str]) -> None:
        """Build the lattices of new words together."""
        letters = _letters("".join(words))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        end = np.repeat(ends, sizes)
        state, length, weight, piece = self._edges(letters, end)
        goal = state + length
        final = goal == end[state]
        # Log masses of the paths from each state to its word's end, from the ends backwards.
        left = end - np.arange(len(letters))
        # Small numbers are sorted by counting.
        narrow = np.uint16 if int(left.max()) < 1 << 16 else np.int64
        by_left = np.argsort(left[state].astype(narrow), kind="stable")
        steps = np.searchsorted(left[state][by_left], np.arange(1, int(left.max()) + 2))
        mass = np.zeros(len(letters))
        for low, high in zip(steps[:-1], steps[1:]):
            edge = by_left[low:high]
            value = weight[edge] + np.where(final[edge], 0.0, mass[np.minimum(goal[edge], len(mass) - 1)])
            owner = state[edge]
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            mass[owner[first]] = np.logaddexp.reduceat(value, first)
        share = weight + np.where(final, 0.0, mass[np.minimum(goal, len(mass) - 1)]) - mass[state]
        first = np.searchsorted(state, np.arange(len(letters) + 1))
        degree = np.diff(first)
        place = np.arange(len(state)) - first[state]
        # One row of edges per state: sums before and after an edge, without differences of near-equal numbers.
        table = np.zeros((len(letters), int(degree.max())))
        table[state, place] = np.exp(share)
        upto = np.cumsum(table, axis=1)
        beyond = np.cumsum(table[:, ::-1], axis=1)[:, ::-1]
        before = np.where(place > 0, upto[state, np.maximum(place - 1, 0)], 0.0)
        after = np.where(place + 1 < degree[state], beyond[state, np.minimum(place + 1, table.shape[1] - 1)], 0.0)
        with np.errstate(divide="ignore"):
            others = np.log(before + after)
        reach = np.floor(upto[state, place] / upto[:, -1][state] * GRID) / GRID
        reach[first[1:] - 1] = 1.0
        base, edges = self.states, self.reach.size
        spelled = np.flatnonzero(piece < 0)
        codes = [[self.words.byte_ids[b] for b in (MARK if c == OWN_MARK else c).encode()]
                 for c in map(chr, letters[state[spelled]])]
        emit_size = np.ones(len(piece), np.int64)
        emit_size[spelled] = [len(c) for c in codes]
        emit_at = np.cumsum(emit_size) - emit_size
        emit = np.empty(int(emit_size.sum()), np.int32)
        emit[emit_at[piece >= 0]] = piece[piece >= 0]
        for at, code in zip(emit_at[spelled], codes):
            emit[at:at + len(code)] = code
        for grown, values in ((self.first, edges + first[:-1]), (self.reach, base + state + reach), (self.share, share),
                              (self.others, others), (self.target, np.where(final, -1, base + goal)),
                              (self.state, base + state), (self.emit_at, self.emit.size + emit_at),
                              (self.emit_size, emit_size)):
            grown.extend(values)
        self.emit.extend(emit)
        self.start.update(zip(words, (base + ends - sizes).tolist()))
        self.states += len(letters)

    def walk(self, at: np.ndarray, key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draw a path from each state in ``at`` to its word's end: ``(walker, edge)`` in order of steps.

        Random numbers are hashes of ``key``, ``place`` and the step.
        """
        reach, target, first = self.reach.all, self.target.all, self.first.all
        walker = np.arange(len(at))
        walkers, edges = [], []
        step = 0
        while len(walker):
            draw = np.floor(uniform(key[walker], place[walker], step) * GRID) / GRID
            edge = _climb(reach, first[at], at + draw, np.less_equal, len(reach) - 1)
            walkers.append(walker)
            edges.append(edge)
            at = target[edge]
            on = at >= 0
            walker, at = walker[on], at[on]
            step += 1
        if not walkers:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        walkers, edges = np.concatenate(walkers), np.concatenate(edges)
        order = np.argsort(walkers, kind="stable")
        return walkers[order], edges[order]


def uniform(key: np.ndarray, place: np.ndarray, stream: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on nothing but the arguments."""
    hashed = mix(key ^ mix(place.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(stream + 1)))
    return ((hashed >> U64(12)).astype(np.float64) + 0.5) / float(1 << 52)


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ranges ``first, first + 1, ...`` of the given sizes, end to end."""
    return np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)


def truncated(place: np.ndarray, limit: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Gumbel variables at ``place`` that stay below ``limit``."""
    with np.errstate(over="ignore", divide="ignore"):
        return -np.log(np.exp(-limit) - np.exp(-np.maximum(place, -700.0)) * np.log(draw)) \
            + np.where(np.isneginf(place), -np.inf, 0.0)


class Paths:
    """One drawn path per text: edges end to end, the word of each, and the regions its steps leave.

    ``bound[i]`` is the Gumbel maximum of the paths that follow this one up to step ``i`` and leave it there;
    ``closed`` names, by text, the step before which regions belong to another path.
    """

    def __init__(self, lattices: Lattices, bounds: np.ndarray, edge: np.ndarray, word: np.ndarray,
                 top: np.ndarray, closed: np.ndarray, shut: list[set[int]], key: np.ndarray, stream: int):
        self.bounds, self.edge, self.word, self.top, self.closed, self.shut = bounds, edge, word, top, closed, shut
        size = np.diff(bounds)
        share = np.rint(lattices.share.all[edge] * FIXED).astype(np.int64)
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(share)])
        before = (total[:-1] - np.repeat(total[bounds[:-1]], size)) / FIXED
        self.log_prob = (total[bounds[1:]] - total[bounds[:-1]]) / FIXED
        place = np.arange(len(edge)) - np.repeat(bounds[:-1], size)
        rest = before + lattices.others.all[edge]
        for text in np.flatnonzero(closed >= 0):
            at = bounds[text] + closed[text]
            left = _rest(lattices, int(edge[at]), shut[text])
            rest[at] = before[at] + math.log(sum(w for _, w in left)) if left else -math.inf
        rest[place < np.repeat(closed, size)] = -np.inf
        draw = uniform(np.repeat(key, size), place, stream)
        self.bound = truncated(rest, np.repeat(top, size), draw)
        self.best = np.full(len(size), -np.inf)
        full = np.flatnonzero(size)
        if len(full):
            self.best[full] = np.maximum.reduceat(self.bound, bounds[full])


def _rest(lattices: Lattices, edge: int, shut: set[int]) -> list[tuple[int, float]]:
    """The edges beside ``edge`` that are not shut, with their shares."""
    state = int(lattices.state.all[edge])
    first = int(lattices.first.all[state])
    end = int(lattices.first.all[state + 1]) if state + 1 < lattices.first.size else lattices.reach.size
    return [(e, math.exp(lattices.share.all[e])) for e in range(first, end) if e not in shut]


def draw_samples(lattices: Lattices, texts: list[str], key: np.ndarray, samples: int):
    """For each text, up to ``samples`` distinct segmentations by falling perturbed log-probability.

    Yields ``(rows, log_prob, perturbed, emit_bounds, pieces)`` per round; then the thresholds by text.
    """
    split = [lattices.words.split(text) for text in texts]
    sizes = np.array([len(s) for s in split], np.int64)
    at = lattices.numbers([word for s in split for word in s])
    word_bounds = np.concatenate([[0], np.cumsum(sizes)])
    rows = np.arange(len(texts))
    place = np.arange(len(at)) - np.repeat(word_bounds[:-1], sizes)
    walker, edge = lattices.walk(at, np.repeat(key, sizes), place)
    top = -np.log(-np.log(uniform(key, np.zeros(len(key)), 999)))
    bounds = np.searchsorted(walker, word_bounds)
    paths = [(rows, Paths(lattices, bounds, edge, place[walker] if len(walker) else walker, top,
                          np.full(len(rows), -1), [set()] * len(rows), key, 1000))]
    found = [(rows, paths[0][1])]
    best = np.full((samples, len(texts)), -np.inf)
    best[0] = paths[0][1].best
    for number in range(1, samples + 1):
        from_path = best.argmax(axis=0)
        threshold = best.max(axis=0)
        if number == samples:
            return found, threshold
        open_rows = np.flatnonzero(np.isfinite(threshold))
        if not len(open_rows):
            return found, threshold
        # Open each text's best region: the step, the edge taken there instead, and the prefix before it.
        prefix_edges, prefix_words, closed, shut, alternative, alt_word = [], [], [], [], [], []
        choice = uniform(key[open_rows], np.full(len(open_rows), number), 998)
        for k, row in enumerate(open_rows):
            owner_rows, path = paths[from_path[row]]
            local = int(np.searchsorted(owner_rows, row))
            low, high = path.bounds[local], path.bounds[local + 1]
            step = int(path.bound[low:high].argmax())
            old = int(path.edge[low + step])
            gone = {old} | (path.shut[local] if step == path.closed[local] else set())
            left = _rest(lattices, old, gone)
            goal, taken = choice[k] * sum(w for _, w in left), left[-1][0]
            for e, w in left:
                goal -= w
                if goal <= 0:
                    taken = e
                    break
            path.bound[low + step] = -np.inf
            best[from_path[row], row] = path.bound[low:high].max()
            prefix_edges.append(path.edge[low:low + step])
            prefix_words.append(path.word[low:low + step])
            closed.append(step)
            shut.append(gone | {taken})
            alternative.append(taken)
            alt_word.append(int(path.word[low + step]))
        closed, alternative, alt_word = (np.array(x, np.int64) for x in (closed, alternative, alt_word))
        # Draw the rest of the word that was left, then all later words.
        after = lattices.target.all[alternative]
        later = sizes[open_rows] - alt_word - 1
        own = np.repeat(np.arange(len(open_rows)), later)
        which = _spread(word_bounds[open_rows] + alt_word + 1, later)
        inside = np.flatnonzero(after >= 0)
        start = np.concatenate([after[inside], at[which]])
        text_of = np.concatenate([inside, own])
        word_of = np.concatenate([alt_word[inside], place[which]])
        walker, edge = lattices.walk(start, key[open_rows][text_of], word_of + (number << 40))
        counts = np.array([len(p) for p in prefix_edges])
        parts_text = np.concatenate([np.repeat(np.arange(len(open_rows)), counts), np.arange(len(open_rows)),
                                     text_of[walker]])
        parts_word = np.concatenate([*prefix_words, alt_word, word_of[walker]])
        parts_edge = np.concatenate([*prefix_edges, alternative, edge])
        # Stable by text: the prefix, the edge taken, the rest of its word, the later words.
        order = np.argsort(parts_text, kind="stable")
        bounds = np.searchsorted(parts_text[order], np.arange(len(open_rows) + 1))
        path = Paths(lattices, bounds, parts_edge[order], parts_word[order], threshold[open_rows], closed,
                     shut, key[open_rows], 1000 + number)
        paths.append((open_rows, path))
        found.append((open_rows, path))
        best[number, open_rows] = path.best
    return found, best.max(axis=0)


def encode_samples(df: DataFrame, text: str = "text", key: str = "doc_id", samples: int = SAMPLES,
                   seed: int = SEED, model: str = MODEL) -> DataFrame:
    """Up to ``samples`` distinct segmentations of every text, the most perturbed first: one row per sample.

    Returns ``key, sample`` (from 1), ``log_prob, perturbed, inclusion`` and ``pieces``, the piece ids. Fewer
    rows come back only where a text has fewer segmentations. A null or empty text has one, without pieces.
    Rows with equal ids and texts get equal samples; null ids are kept. Other columns are not read.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(vocabulary(model))
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1).to_numpy().view(U64)
            texts = batch.column(2).to_pylist()
            first = 0
            while first < len(texts):
                last, letters = first, 0
                while last < len(texts) and (last == first or letters + len(texts[last]) <= SLICE_CHARS):
                    letters += len(texts[last])
                    last += 1
                if lattices.reach.size > CACHE_EDGES:
                    lattices.clear()
                found, threshold = draw_samples(lattices, texts[first:last], keys[first:last], samples)
                for number, (rows, path) in enumerate(found):
                    emit_size = lattices.emit_size.all[path.edge]
                    pieces = lattices.emit.all[_spread(lattices.emit_at.all[path.edge], emit_size)]
                    ends = np.concatenate([[0], np.cumsum(emit_size)])[path.bounds]
                    with np.errstate(over="ignore"):
                        inclusion = -np.expm1(-np.exp(path.log_prob - threshold[rows]))
                    yield pa.RecordBatch.from_arrays([
                        ids.take(pa.array(rows + first)), pa.array(np.full(len(rows), number + 1, np.int32)),
                        pa.array(path.log_prob), pa.array(path.top), pa.array(inclusion),
                        pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(pieces))], schema=_ARROW)
                first = last

    return bounded(df).select(F.col(key).cast("long").alias("id"), F.xxhash64(F.lit(seed), F.col(key)).alias("seed"),
                              body.alias("text")).mapInArrow(run, SCHEMA).withColumnRenamed("id", key)


def decode_pieces(pieces: pa.Array, model: str = MODEL) -> pa.Array:
    """The texts that lists of piece ids stand for; the leading mark of a text is not part of it."""
    out = vocabulary(model).out
    offsets = pieces.offsets.to_numpy()
    parts = out[pieces.values.to_numpy()[:offsets[-1]]] if len(pieces) else []
    texts = []
    for low, high in zip(offsets[:-1], offsets[1:]):
        text = b"".join(parts[low:high])
        texts.append(text[1:].decode("utf-8", "replace"))
    return pa.array(texts, pa.string())


def decode(df: DataFrame, pieces: str = "pieces", text: str = "text", model: str = MODEL) -> DataFrame:
    """``df`` with the decoded text of its column of piece ids; a null list decodes to an empty text."""

    @F.arrow_udf("string")
    def decoded(lists: pa.Array) -> pa.Array:
        return decode_pieces(lists, model)

    return bounded(df).withColumn(text, decoded(F.coalesce(F.col(pieces), F.array().cast("array<int>"))))
