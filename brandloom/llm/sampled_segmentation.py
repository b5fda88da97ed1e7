"""SentencePiece encoding by sampled segmentations, without replacement, and decoding.

Model. The pieces of a vocabulary span a lattice over the text (white space as U+2581, one put in front, as the library
normalises). A piece of merge rank r weighs (r + 2)^-theta, Zipf's law over the ranks; characters without a piece pass
through their byte pieces. A segmentation's probability is the product of its pieces' weights over the sum for all
segmentations. No piece holds U+2581 behind another character, so the lattice is a chain of lattices of words, and a word's
backward sums give exact edge probabilities; they are computed once per distinct word and remembered up to a bound.

Search. Gumbel top-k: every segmentation would get a Gumbel variate of location log p, and the k largest are the sample.
The A-star search never lists them: a region is "paths that share a prefix and leave it at this node by an edge not used
yet"; its bound is the maximum of its Gumbels, drawn from its exact mass and truncated at its parent's. The best
region is popped, its maximal path is drawn edge by edge (the bound is exact, so nothing is searched twice), and
every node of the new path opens a region. Popped paths are distinct and come in descending order of their Gumbels.
With the (k+1)-th bound as threshold kappa, a sample's inclusion score is 1 - exp(-exp(log p - kappa)).

Draws are hashes of (seed, row key, sample, word, step): they do not depend on partitions, order or retries.

Defined cases: null and empty texts have one segmentation, empty, of probability 1; a text with fewer than k
segmentations yields all it has, with inclusion 1; equal rows with equal keys yield equal samples; U+2581 in a text passes
as bytes, so that decoding is exact; a null key counts as -1; empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import small_batches
from .shingles import mix64

MODEL = "piece_bpe_32k.model"
SAMPLES = 2
THETA = 1.0
SEED = 11
SPACE = "▁"
#: Nodes of remembered words in a worker: 8 bytes each and 24 for each of some 3 edges.
ARENA_NODES = 2_000_000
#: Words longer than this are forgotten after their batch.
LONG_WORD = 64
#: Characters of text that are searched together.
BATCH_CHARS = 300_000
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_HOLE = ""  # stands for a literal U+2581 while a text is split


def tokenizer_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """The vocabulary: piece -> (id, log weight), byte ids, and each id's bytes for decoding."""

    def __init__(self, path: str, theta: float = THETA):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.weight: dict[str, tuple[int, float]] = {}
        self.byte_ids = [0] * 256
        self.raw: list[bytes] = []
        ranks = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.raw.append(b"")
            else:
                ranks.append((piece, i, -model.get_score(i)))
                self.raw.append(piece.replace(SPACE, " ").encode())
        total = math.log(sum((r + 2) ** -theta for _, _, r in ranks))
        self.weight = {p: (i, -theta * math.log(r + 2) - total) for p, i, r in ranks}
        self.longest = max(map(len, self.weight))
        self.sizes = np.array([len(b) for b in self.raw])
        self.at = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        self.byte_weight = min(w for _, w in self.weight.values()) - 1.0

    def decode(self, ids) -> str:
        data = b"".join(map(self.raw.__getitem__, ids))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")

    def decoded(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all rows' ids, one row behind the other, and the rows' offsets in them."""
        sizes = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return self.bytes[_ranges(self.at[ids], self.at[ids] + sizes)], ends[offsets]


@functools.cache
def load(path: str, theta: float) -> Lattices:
    return Lattices(Pieces(path, theta))


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    b = np.empty(max(n, 2 * len(a)), a.dtype)
    b[: len(a)] = a
    return b


class Lattices:
    """Words' lattices in one arena. Node n has edges first[n] .. first[n + 1]; a word's last node has none.

    New words are built together: substrings are looked up by a polynomial hash, one length at a time and only while
    some piece begins that way; backward sums run over all words at once, from their ends.
    """

    BASE = np.uint64(0x9E3779B97F4A7C15)
    EDGE_ARRAYS = ("cum", "log", "target", "piece")
    BUCKET_BITS = 20

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        known: dict[int, tuple[int, float]] = {}
        for piece, (i, w) in pieces.weight.items():
            h = 0
            for n, c in enumerate(piece, 1):
                h = (h * int(self.BASE) + ord(c) + 1) & (2**64 - 1)
                if n < len(piece):
                    known.setdefault(h, (-1, -math.inf))
            if known.get(h, (-1,))[0] >= 0:
                raise ValueError("two pieces with one hash")
            known[h] = (i, w)
        listed = np.fromiter(known, np.uint64, len(known))
        order = np.argsort(mix64(listed))
        self.hashes = mix64(listed)[order]
        self.ids = np.array([i for i, _ in known.values()], np.int64)[order]
        self.weights = np.array([w for _, w in known.values()])[order]
        # scrambled hashes are uniform, so few share a bucket
        top = self.hashes >> np.uint64(64 - self.BUCKET_BITS)
        self.buckets = np.searchsorted(top, np.arange(2**self.BUCKET_BITS, dtype=np.uint64))
        self.bucket_size = int(np.unique(top, return_counts=True)[1].max())
        self.clear()

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each scrambled hash among the known ones, or of some other one where it is unknown."""
        last = len(self.hashes) - 1
        at = np.minimum(self.buckets[h >> np.uint64(64 - self.BUCKET_BITS)], last)
        for _ in range(self.bucket_size - 1):
            at = np.minimum(at + (self.hashes[at] < h), last)
        return at

    def clear(self) -> None:
        self.words: dict[str, int] = {}
        self.long_word = False
        self.nodes = self.edges = 0
        self.first = np.zeros(1024, np.int64)
        self.cum, self.log = np.empty(1024), np.empty(1024)
        self.target, self.piece = np.empty(1024, np.int32), np.empty(1024, np.int32)

    def build(self, words: list[str]) -> None:
        """Append the lattices of new words."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        literal = codes == ord(_HOLE)
        chars = codes.astype(np.uint64) + np.uint64(1)
        m, longest = len(codes), self.pieces.longest
        ends = np.repeat(np.cumsum(sizes), sizes)  # past-last character of each position's word
        live = np.flatnonzero(~literal)
        h = np.zeros(len(live), np.uint64)
        single = np.zeros(m, bool)
        found = []  # (place, length - 1, log weight, piece), shorter pieces first
        for n in range(longest):
            h = h * self.BASE + chars[live + n]
            mixed = mix64(h)
            at = self.find(mixed)
            hit = self.hashes[at] == mixed
            live, h, at = live[hit], h[hit], at[hit]
            whole = np.flatnonzero(self.ids[at] >= 0)
            found.append((live[whole], np.full(len(whole), n), self.weights[at[whole]], self.ids[at[whole]]))
            if n == 0:
                single[live[whole]] = True
            more = live + n + 1 < ends[live]
            more[more] = ~literal[live[more] + n + 1]
            live, h = live[more], h[more]
            if not len(live):
                break
        bare = np.flatnonzero(~single)  # characters without a piece pass as bytes
        code = codes[bare].astype(np.int64)
        code[literal[bare]] = ord(SPACE)
        n_bytes = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        found.insert(0, (bare, np.zeros(len(bare), np.int64), n_bytes * self.pieces.byte_weight, np.full(len(bare), -1)))
        # edges in the order of nodes, a node's longest piece, which is mostly its likeliest, first
        rows, lengths, weight, ident = (np.concatenate(x) for x in zip(*found[::-1]))
        order = np.argsort(rows, kind="stable")
        rows, lengths, weight, ident = rows[order], lengths[order], weight[order], ident[order]
        degree = np.bincount(rows, minlength=m)
        node_first = np.cumsum(degree) - degree

        # backward sums, by the distance from the word's end
        word_no = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(m) + word_no  # with one more node a word, for its end
        goal_of = place[rows] + lengths + 1
        beta = np.zeros(m + len(words) + 1)
        distance = ends - np.arange(m)
        order = np.argsort(distance, kind="stable")
        levels = np.searchsorted(distance[order], np.arange(1, distance.max(initial=0) + 2))
        for d in range(1, len(levels)):
            idx = order[levels[d - 1] : levels[d]]
            edges = _ranges(node_first[idx], node_first[idx] + degree[idx])
            terms = weight[edges] + beta[goal_of[edges]]
            heads = np.cumsum(degree[idx]) - degree[idx]
            top = np.maximum.reduceat(terms, heads)
            beta[place[idx]] = top + np.log(np.add.reduceat(np.exp(terms - np.repeat(top, degree[idx])), heads))

        logs = np.where(degree[rows] > 1, weight + beta[goal_of] - beta[place[rows]], 0.0)
        shares = np.exp(logs)
        run = np.cumsum(shares)
        cum = run - (run - shares)[node_first[rows]]
        cum[node_first + degree - 1] = 1.0
        inner = np.concatenate([[0], np.cumsum(n_bytes - 1)])
        base, edge = self.nodes, self.edges
        target, ids = base + goal_of, ident
        tail = base + m + len(words)  # inner nodes of byte passages stand behind all words
        late_targets, late_ids = [], []
        if len(bare):
            edge_of = node_first[bare] + degree[bare] - 1  # the shortest of a node's edges comes last
            for b, c, e, k in zip(bare.tolist(), code.tolist(), edge_of.tolist(), inner.tolist()):
                raw = chr(c).encode("utf-8", "surrogatepass")
                ids[e] = self.pieces.byte_ids[raw[0]]
                goal = base + place[b] + 1
                target[e] = tail + k if len(raw) > 1 else goal
                for n, byte in enumerate(raw[1:], 1):
                    late_ids.append(self.pieces.byte_ids[byte])
                    late_targets.append(tail + k + n if n < len(raw) - 1 else goal)
        n_late = len(late_ids)
        starts = np.full(m + len(words), -1, np.int64)
        starts[place] = edge + node_first
        word_at = np.cumsum(sizes + 1) - (sizes + 1)
        ends_at = word_at + sizes
        starts[ends_at] = np.where(np.cumsum(sizes) < m, edge + node_first[np.minimum(np.cumsum(sizes), m - 1)], edge + len(rows))
        firsts = np.concatenate([starts, edge + len(rows) + np.arange(n_late)])
        end_n, end_e = base + len(firsts), edge + len(rows) + n_late
        self.first = _grown(self.first, end_n + 1)
        self.first[base:end_n] = firsts
        self.first[end_n] = end_e
        none = np.zeros(n_late)
        for name, values in zip(self.EDGE_ARRAYS, (np.r_[cum, none + 1], np.r_[logs, none], np.r_[target, late_targets], np.r_[ids, late_ids])):
            array = _grown(getattr(self, name), end_e)
            array[edge:end_e] = values
            setattr(self, name, array)
        self.nodes, self.edges = end_n, end_e
        self.long_word |= bool(sizes.max(initial=0) > LONG_WORD)
        self.words.update(zip(words, (base + word_at).tolist()))

    def starts(self, words: list[str]) -> np.ndarray:
        found = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = dict.fromkeys([words[i] for i in missing.tolist()])
            self.build(list(new))
            found[missing] = [self.words[words[i]] for i in missing.tolist()]
        return found

    def forget(self, most: int = ARENA_NODES) -> None:
        """Between batches: drop everything when the arena is full or holds a very long word."""
        if self.nodes > most or self.long_word:
            self.clear()


def split_words(text: str | None) -> list[str]:
    if not text:
        return []
    if SPACE in text or _HOLE in text:
        text = text.replace(SPACE, _HOLE)
    return _WORD.findall(SPACE + text.replace(" ", SPACE))


def _uniform(keys: np.ndarray, words, steps) -> np.ndarray:
    """Hash draws in (0, 1)."""
    x = mix64(keys ^ (np.asarray(words).astype(np.uint64) << np.uint64(24)) ^ np.asarray(steps).astype(np.uint64))
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def _stream(keys: np.ndarray, number: int) -> np.ndarray:
    return mix64(keys ^ mix64(np.full(1, number, np.uint64)))


def _walk(lat: Lattices, nodes, words, steps, keys, in_row):
    """Draw a path from each node to its word's end: arrays (word, step, node, edge). `words` number the batch's words."""
    out = []
    lo, hi = lat.first[nodes], lat.first[nodes + 1]
    live = np.flatnonzero(lo < hi)
    nodes, words, steps, lo, hi = nodes[live], words[live], steps[live], lo[live], hi[live]
    while len(nodes):
        edge = lo.copy()
        branching = np.flatnonzero(hi - lo > 1)
        u = _uniform(keys[words[branching]], in_row[words[branching]], steps[branching])
        while len(branching):
            over = u > lat.cum[edge[branching]]
            branching, u = branching[over], u[over]
            edge[branching] += 1
        out.append((words, steps, nodes, edge))
        nodes = lat.target[edge].astype(np.int64)
        lo, hi = lat.first[nodes], lat.first[nodes + 1]
        more = np.flatnonzero(lo < hi)
        nodes, words, steps, lo, hi = nodes[more], words[more], steps[more] + 1, lo[more], hi[more]
    return [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 4


def _ranges(first: np.ndarray, past: np.ndarray) -> np.ndarray:
    """All numbers of each range first .. past, one range behind the other."""
    sizes = past - first
    return np.arange(sizes.sum()) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)


def _truncated(location: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbels of the locations, given that they are at most `top`."""
    with np.errstate(over="ignore", divide="ignore"):
        return np.where(np.isneginf(location), -np.inf, location - np.log(np.exp(np.minimum(location - top, 700)) - np.log(u)))


class _Found:
    """One sample of every row of a batch: its paths in order, with row offsets and log probabilities."""

    def __init__(self, lat: Lattices, parts: list, word_rows: np.ndarray, n_rows: int):
        words, steps, nodes, edges = parts
        lengths = np.bincount(words, minlength=len(word_rows)) if len(words) else np.zeros(len(word_rows), np.int64)
        at = (np.cumsum(lengths) - lengths)[words] + steps if len(words) else words
        self.words = np.repeat(np.arange(len(word_rows)), lengths)
        self.rows = word_rows[self.words] if len(words) else self.words
        self.steps, self.nodes, self.edges = np.empty_like(steps), np.empty_like(nodes), np.empty_like(edges)
        self.steps[at], self.nodes[at], self.edges[at] = steps, nodes, edges
        self.offsets = np.searchsorted(self.rows, np.arange(n_rows + 1))
        total = np.concatenate([[0.0], np.cumsum(lat.log[self.edges])])
        self.before = total[:-1] - total[self.offsets[self.rows]]
        self.log_prob = total[self.offsets[1:]] - total[self.offsets[:-1]]


def sample_batch(lat: Lattices, texts: list[str | None], keys: list[int], k: int, seed: int) -> list[dict]:
    """For every text, up to k samples: one dict per rank with the rows that have it, ids, log_prob, gumbel, inclusion."""
    n = len(texts)
    split = [split_words(t) for t in texts]
    flat = [w for words in split for w in words]
    counts = np.fromiter(map(len, split), np.int64, n)
    base = lat.starts(flat)
    word_rows = np.repeat(np.arange(n), counts)
    word_first = np.cumsum(counts) - counts
    in_row = np.arange(len(flat)) - word_first[word_rows]
    keyed = mix64(np.array(keys, np.int64).view(np.uint64) ^ mix64(np.full(n, seed, np.uint64)))

    def stream(kind: int, s: int) -> np.ndarray:
        return _stream(keyed, kind * 1000 + s)

    every = np.arange(len(flat))
    found = [_Found(lat, _walk(lat, base, every, np.zeros(len(flat), np.int64), stream(1, 0)[word_rows], in_row), word_rows, n)]
    values = [-np.log(-np.log(_uniform(stream(0, 0), 0, 0)))]  # the greatest Gumbel of all, location log 1
    bounds: list[np.ndarray] = []
    used: dict[tuple[int, int], list[int]] = {}  # (sample, position) -> edges taken there

    def open_regions(s: int, new_from: np.ndarray) -> np.ndarray:
        """Bounds of the regions that leave sample s at each of its own nodes."""
        f = found[s]
        g = np.full(len(f.rows), -np.inf)
        with np.errstate(divide="ignore"):
            location = f.before + np.log1p(-np.exp(np.minimum(lat.log[f.edges], 0.0)))
        own = np.flatnonzero((np.arange(len(g)) >= new_from[f.rows]) & (location > -np.inf))
        u = _uniform(stream(2, s)[f.rows[own]], in_row[f.words[own]], f.steps[own])
        g[own] = _truncated(location[own], values[s][f.rows[own]], u)
        return g

    def best() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per row: the greatest bound, its sample and its position there."""
        value, owner, place = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for s, (f, g) in enumerate(zip(found, bounds)):
            filled = np.flatnonzero(f.offsets[1:] > f.offsets[:-1])
            if len(filled):
                most = np.full(n, -np.inf)
                most[filled] = np.maximum.reduceat(g, f.offsets[filled])
                at = np.flatnonzero(g == most[f.rows])[::-1]
                here = np.zeros(n, np.int64)
                here[f.rows[at]] = at
                better = np.flatnonzero(most > value)
                value[better], owner[better], place[better] = most[better], s, here[better]
        return value, owner, place

    bounds.append(open_regions(0, found[0].offsets[:-1]))
    for s in range(1, k):
        value, owner, place = best()
        rows = np.flatnonzero(value > -np.inf)
        if not len(rows):
            break
        parts: list[list] = []
        new_from, at_step, at_word = (np.zeros(n, np.int64) for _ in range(3))
        for o, f in enumerate(found):
            mine = rows[owner[rows] == o]
            at_step[mine], at_word[mine] = f.steps[place[mine]], f.words[place[mine]]
            new_from[mine] = place[mine] - f.offsets[mine]
            kept = _ranges(f.offsets[mine], place[mine])
            parts.append([f.words[kept], f.steps[kept], f.nodes[kept], f.edges[kept]])
        pick_u = _uniform(stream(3, s), in_row[at_word], at_step).tolist()
        rest_u = _uniform(stream(4, s), in_row[at_word], at_step)
        picks, nodes, left_over, before = [], [], [], []
        for r, o, b in zip(rows.tolist(), owner[rows].tolist(), place[rows].tolist()):
            f = found[o]
            node = int(f.nodes[b])
            taken = used.setdefault((o, b), [int(f.edges[b])])
            rest = [e for e in range(int(lat.first[node]), int(lat.first[node + 1])) if e not in taken]
            shares = [math.exp(lat.log[e]) for e in rest]
            u = pick_u[r] * sum(shares)
            pick = rest[-1]
            for e, p in zip(rest, shares):
                if u <= p:
                    pick = e
                    break
                u -= p
            taken.append(pick)
            picks.append(pick)
            nodes.append(node)
            left_over.append(sum(p for e, p in zip(rest, shares) if e != pick))
            before.append(f.before[b])
        with np.errstate(divide="ignore"):
            rests = _truncated(np.array(before) + np.log(np.array(left_over)), value[rows], rest_u[rows])
        for o, g in enumerate(bounds):
            mine = owner[rows] == o
            g[place[rows[mine]]] = rests[mine]
        w, step, edges = at_word[rows], at_step[rows], np.array(picks)
        parts.append([w, step, np.array(nodes), edges])
        last = word_first[rows] + counts[rows]
        s_words = _ranges(w, last)
        starts, s_steps, heads = base[s_words], np.zeros(len(s_words), np.int64), np.cumsum(last - w) - (last - w)
        starts[heads], s_steps[heads] = lat.target[edges], step + 1
        parts.append(_walk(lat, starts, s_words, s_steps, stream(1, s)[word_rows], in_row))
        found.append(_Found(lat, [np.concatenate(x) for x in zip(*parts)], word_rows, n))
        values.append(np.where(value > -np.inf, value, np.nan))
        # the node that branched is shared with its owner, whose region goes on holding the rest
        bounds.append(open_regions(s, found[s].offsets[:-1] + new_from + 1))
    kappa = best()[0]
    out = []
    for s, (f, v) in enumerate(zip(found, values)):
        with np.errstate(over="ignore", invalid="ignore"):
            inclusion = np.where(np.isneginf(kappa), 1.0, -np.expm1(-np.exp(np.minimum(f.log_prob - kappa, 700))))
        rows = np.flatnonzero(~np.isnan(v))
        out.append({"rows": rows, "sample": s + 1, "ids": lat.piece[f.edges], "offsets": f.offsets, "log_prob": f.log_prob, "gumbel": v, "inclusion": inclusion})
    return out


SAMPLED = "doc_id long, sample int, n_pieces int, ids array<int>, log_prob double, gumbel double, inclusion double, round_trip boolean"


def sample_segmentations(docs: DataFrame, k: int = SAMPLES, seed: int = SEED, theta: float = THETA, path: str | None = None, tell_copies: bool = False, arena_nodes: int = ARENA_NODES, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """docs(doc_id, text) -> up to k rows of SAMPLED per document; round_trip says that decoding the ids gives the text.

    With `tell_copies`, equal rows (of doc_id and text) draw as further copies: their key takes their number. They are brought together by a hash of both first, and stand next to each
    other there, so how the rows lay before makes no difference. `arena_nodes` and `batch_chars` trade a worker's memory for time; samples do not depend on them, scores but for rounding.
    """
    small_batches(docs.sparkSession)
    path = path or tokenizer_path()
    names = [c.split()[0] for c in SAMPLED.split(", ")]

    def run(batches):
        lat = load(path, theta)
        last, copy = None, 0
        for batch in batches:
            keys = [-1 if x is None else x for x in batch.column(0).to_pylist()]
            if tell_copies:
                for i, (key, marks) in enumerate(zip(keys, zip(*(c.to_pylist() for c in batch.columns[2:])))):
                    last, copy = (key, marks), copy + 1 if (key, marks) == last else 0
                    keys[i] = int(mix64(np.array([key ^ ((copy & 0x7FFF) << 48)], np.int64).view(np.uint64)).view(np.int64)[0]) if copy else key
            texts, begin, chars = [], 0, 0
            for i, text in enumerate(batch.column(1)):
                texts.append(text.as_py() or "")
                chars += len(texts[-1])
                if chars >= batch_chars or i == batch.num_rows - 1:
                    yield from _sampled_rows(lat, texts, batch.column(0).slice(begin, len(texts)), keys[begin : i + 1], k, seed, names, arena_nodes)
                    texts, begin, chars = [], i + 1, 0

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if tell_copies:
        # 128 bits tell texts apart, null from empty among them
        marks = [F.xxhash64(F.col("text").isNull(), "text").alias("mark1"), F.xxhash64("text", F.length("text")).alias("mark2")]
        rows = rows.select("doc_id", "text", *marks).repartition("doc_id", "mark1", "mark2").sortWithinPartitions("doc_id", "mark1", "mark2")
    return rows.mapInArrow(run, SAMPLED)


def _round_trips(lat: Lattices, texts: list[str], ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each row's ids decode to its text (white space in front, as the library puts it)."""
    data, at = lat.pieces.decoded(ids, offsets)
    wanted = [b" " + t.encode() if t else b"" for t in texts]
    ends = np.cumsum([0, *map(len, wanted)])
    if not np.array_equal(at, ends):
        return np.array([data[at[i] : at[i + 1]].tobytes() == w for i, w in enumerate(wanted)])
    bad = np.flatnonzero(data != np.frombuffer(b"".join(wanted), np.uint8))
    good = np.ones(len(texts), bool)
    good[np.searchsorted(ends, bad, side="right") - 1] = False
    return good


def _sampled_rows(lat: Lattices, texts, doc_ids, keys, k, seed, names, arena_nodes):
    for s in sample_batch(lat, texts, keys, k, seed):
        rows, offsets = s["rows"], s["offsets"]
        lengths = (offsets[1:] - offsets[:-1])[rows]
        ids = s["ids"]
        good = _round_trips(lat, texts, ids, offsets)[rows]
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        columns = [
            doc_ids.take(pa.array(rows)),
            pa.array(np.full(len(rows), s["sample"], np.int32)),
            pa.array(lengths.astype(np.int32)),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32))),
            *(pa.array(s[c][rows]) for c in ("log_prob", "gumbel", "inclusion")),
            pa.array(good, pa.bool_()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names)
    lat.forget(arena_nodes)


def decode(encoded: DataFrame, ids: str = "ids", theta: float = THETA, path: str | None = None) -> DataFrame:
    """encoded + text: the ids decoded; null ids give null."""
    path = path or tokenizer_path()

    def run(batches):
        lat = load(path, theta)
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            texts = [None if x is None else lat.pieces.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "_decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{schema}, _decoded string").withColumnRenamed("_decoded", "text")
