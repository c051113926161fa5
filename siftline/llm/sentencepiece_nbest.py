"""Operator 6, SentencePiece encoding and decoding: the N best segmentations over the piece lattice.

A forward Viterbi pass gives the best score of every prefix. A backward A-star search from the end
extends paths leftwards; the prefix scores are its exact heuristics, so complete paths leave the queue
best first. Pieces hold the blank mark at their beginning only, and no piece holds a line end: the
lattice falls into words there. Viterbi passes both ways give each word's best segmentation and what its
second best costs; these are cached. The N best of a text are among the changes of the N - 1 words whose
second best costs least (each of these changes alone beats any that touches another word), so only these
words are searched for their N best.

The distinct words of a batch are worked on together: a trie of the pieces is walked from all their
characters at once, a character at a time, and the Viterbi passes go over all words abreast. Where no
piece spans a place between two characters the lattice falls apart, so passes are as long as the
longest run that pieces tie together, not as the longest word.

The public model is one of merges: its scores are minus the ranks of its merges, whose sums mean nothing.
A piece of rank r therefore has the log-probability of the Zipf-Mandelbrot law, -ln((r + ``SHIFT``) H),
where H makes the probabilities of all pieces one; nothing is trained. A character that no piece holds
becomes its UTF-8 byte pieces, each ``UNKNOWN`` below the worst piece. Beside it stands what the model's own
merges make of the text. Scores are whole numbers of ``UNIT``; each piece costs a 4096th of that, so that of
equal scores the one with fewer pieces comes first, and all comparisons are exact.

Defined results: a null text is an empty one; it has one segmentation, of no piece, with score 0. Texts
decode to themselves, but for the blank mark U+2581, which decodes to a blank, as in SentencePiece itself.
Repeated rows give repeated results; a null doc_id is passed on.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, chain, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, dropped_by, in_batches

MODEL = "piece_bpe_32k.model"
MARK = "▁"
N_BEST = 4
UNKNOWN = 10.0
SHIFT = 100
UNIT = 1e-5
#: Values of edges and paths are scores in units times this, less one for each piece.
FINE = 4096
CACHE_WORDS = 100_000
#: So many words' N best are kept.
CACHE_SEARCHED = 20_000
LONG_WORD = 64
#: So many characters of words are worked on together.
TOGETHER = 400_000
SEGMENT = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
FAR = np.int64(-(1 << 62))
#: So many nodes have a cube of 63 bits.
MOST_NODES = 1 << 21


@lru_cache(maxsize=1024)
def chosen(sizes: tuple[int, ...], n: int) -> list[tuple[int, ...]]:
    """Choices from words with so many segmentations, best first, of which the n best can be: any other has n before it, no worse in any word."""
    return [choice for choice in product(*map(range, sizes)) if math.prod(c + 1 for c in choice) <= n]


class Trie:
    """The pieces' characters as states: 0 is none, and a step is found by (state, character class)."""

    def __init__(self, pieces: dict[str, tuple[int, int]]):
        kinds = {c: k + 1 for k, c in enumerate(sorted(set(chain.from_iterable(pieces))))}
        self.width = len(kinds) + 1
        self.kind = np.zeros(0x110000, np.int32)
        self.kind[[ord(c) for c in kinds]] = list(kinds.values())
        prefixes = {p[:k] for p in pieces for k in range(1, len(p) + 1)}
        state = {p: k + 1 for k, p in enumerate(sorted(prefixes))} | {"": 0}
        steps = sorted((state[p[:-1]] * self.width + kinds[p[-1]], s) for p, s in state.items() if p)
        self.keys = np.array([k for k, _ in steps] + [1 << 62], np.int64)
        self.next = np.array([s for _, s in steps] + [0], np.int64)
        self.first = np.zeros(self.width, np.int64)
        self.first[[kinds[p] for p in state if len(p) == 1]] = [s for p, s in state.items() if len(p) == 1]
        self.piece = np.full(len(state), -1, np.int64)
        self.value = np.zeros(len(state), np.int64)
        for p, (k, v) in pieces.items():
            self.piece[state[p]], self.value[state[p]] = k, v

    def step(self, state: np.ndarray, kind: np.ndarray) -> np.ndarray:
        key = state * self.width + kind
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.next[at], 0)


@dataclass
class Edges:
    """The lattices of some words, end to end: nodes lie between characters, and each word has a node before its first."""

    start: np.ndarray
    end: np.ndarray
    value: np.ndarray
    #: The piece, or minus the number of bytes of a character without one.
    piece: np.ndarray
    word: np.ndarray
    first: np.ndarray
    last: np.ndarray
    points: np.ndarray


class Lattice:
    """The pieces of a model, and segmentations by them."""

    def __init__(self, path: str | None, n: int):
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(MODEL)
        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n = n
        #: id and value of each piece
        self.pieces: dict[str, tuple[int, int]] = {}
        self.bytes = [0] * 256
        self.text = [b""] * model.get_piece_size()
        ranks: dict[int, float] = {}
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                self.bytes[int(piece[1:-1], 16)] = k
                self.text[k] = bytes([int(piece[1:-1], 16)])
            elif not model.is_control(k) and not model.is_unknown(k):
                ranks[k] = max(0.0, -model.get_score(k))
                self.text[k] = piece.encode()
        total = sum(1 / (r + SHIFT) for r in ranks.values())
        units = {k: round(-math.log((r + SHIFT) * total) / UNIT) for k, r in ranks.items()}
        self.pieces = {model.id_to_piece(k): (k, u * FINE - 1) for k, u in units.items()}
        self.longest = max(map(len, self.pieces))
        #: the value of each byte of a character without a piece
        self.unknown = (min(units.values()) - round(UNKNOWN / UNIT)) * FINE - 1
        self.trie = Trie(self.pieces)
        self.cache: dict[str, tuple[int, int, bytes, bytes]] = {}
        self.searched: dict[str, list[tuple[int, bytes]]] = {}

    def edges(self, words: list[str]) -> Edges:
        """Every piece in some words, in no order."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), sizes)
        stop = np.cumsum(sizes)[word]
        trie, kind = self.trie, self.trie.kind[points]
        at, state = np.arange(len(points)), trie.first[kind]
        bare = np.flatnonzero(trie.piece[state] < 0)
        wide = 1 + (points[bare] >= 0x80).astype(np.int64) + (points[bare] >= 0x800) + (points[bare] >= 0x10000)
        found = [(bare, bare + 1, wide * self.unknown, -wide)]
        size = 1
        at, state = at[state > 0], state[state > 0]
        while len(at):
            whole = trie.piece[state] >= 0
            found.append((at[whole], at[whole] + size, trie.value[state[whole]], trie.piece[state[whole]]))
            goes = at + size < stop[at]
            at, state = at[goes], state[goes]
            state = trie.step(state, kind[at + size])
            at, state = at[state > 0], state[state > 0]
            size += 1
        start, end, value, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        own = word[start]
        first = np.cumsum(sizes + 1) - sizes - 1
        return Edges(start + own, end + own, value, piece, own, first, first + sizes, points)

    def best(self, words: list[str]) -> list[tuple[int, int, bytes]]:
        """(what the second best segmentation costs, the best one's value, its ids) of each word, in values."""
        e = self.edges(words)
        nodes = int(e.last[-1]) + 1
        spans = np.bincount(e.start + 1, minlength=nodes + 1) - np.bincount(e.end, minlength=nodes + 1)
        apart = np.cumsum(spans)[:nodes] == 0  # no piece spans these nodes: a run of pieces begins there, or a word does
        begin = np.maximum.accumulate(np.where(apart, np.arange(nodes), 0))
        run = begin[e.start]
        reach = e.end - run
        # one number sorts three times as fast; it is below the cube of nodes, and no two edges have the same
        order = np.argsort((reach * nodes + e.end) * nodes + e.start) if nodes < MOST_NODES else np.lexsort((e.start, e.end, reach))
        start, end, value, piece, word, run, reach = (x[order] for x in (e.start, e.end, e.value, e.piece, e.word, run, reach))
        slices = np.searchsorted(reach, np.arange(1, int(reach[-1]) + 2)).tolist()
        ahead, come = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)

        def before(node: np.ndarray) -> np.ndarray:  # within a run, paths count from its beginning
            return np.where(apart[node], 0, ahead[node])

        for a, b in zip(slices, slices[1:], strict=False):
            ends, total = end[a:b], before(start[a:b]) + value[a:b]
            heads = np.flatnonzero(np.append(True, ends[1:] != ends[:-1]))
            top = np.maximum.reduceat(total, heads)
            sizes = np.diff(np.append(heads, len(ends)))
            ahead[ends[heads]] = top
            hit = np.flatnonzero(total == np.repeat(top, sizes))
            come[ends[hit[::-1]]] = a + hit[::-1]  # of equal ones the longest piece, which stands first
        behind = np.where(apart, 0, FAR)
        for a, b in reversed(list(zip(slices, slices[1:], strict=False))):
            to = end[a:b]
            rest = value[a:b] + np.where(apart[to], 0, behind[to])
            held = start[a:b]
            inner = ~apart[held]
            behind[held[inner]] = np.maximum(behind[held[inner]], rest[inner])
        used = np.zeros(len(start), bool)
        at = np.flatnonzero(apart)
        at = at[~np.isin(at, e.first)]
        while len(at):  # back from the end of every run
            edge = come[at]
            used[edge] = True
            at = start[edge]
            at = at[~apart[at]]
        own = np.flatnonzero(used)
        own = own[np.argsort(end[own], kind="stable")]
        run_best, whole = np.zeros(nodes, np.int64), np.zeros(len(words), np.int64)
        np.add.at(run_best, run[own], value[own])
        np.add.at(whole, word[own], value[own])
        gap = np.full(len(words), -FAR)
        other = np.flatnonzero(~used)
        through = before(start[other]) + value[other] + np.where(apart[end[other]], 0, behind[end[other]])
        np.minimum.at(gap, word[other], run_best[run[other]] - through)
        sizes = np.maximum(1, -piece[own])
        ids, at = np.repeat(piece[own], sizes), np.cumsum(sizes) - sizes
        for k in np.flatnonzero(piece[own] < 0).tolist():
            raw = self.raw(int(e.points[start[own[k]] - word[own[k]]]))
            ids[at[k] : at[k] + len(raw)] = raw
        counts = np.bincount(word[own], sizes, minlength=len(words)).astype(np.int64)
        cuts = [0, *(4 * np.cumsum(counts)).tolist()]
        coded = ids.astype("<u4").tobytes()
        return [(g, v, coded[a:b]) for g, v, a, b in zip(gap.tolist(), whole.tolist(), cuts, cuts[1:], strict=False)]

    def raw(self, point: int) -> list[int]:
        """The byte pieces of a character."""
        return [self.bytes[x] for x in chr(point).encode("utf-8", "surrogatepass")]

    def searched_words(self, words: list[str]) -> list[list[tuple[int, bytes]]]:
        """The N best segmentations of each of some words."""
        e = self.edges(words)
        word = e.word
        order = np.argsort(word, kind="stable")
        own = e.first[word[order]]
        edges = list(zip(*((x[order] - o).tolist() for x, o in ((e.start, own), (e.end, own), (e.value, 0), (e.piece, 0))), strict=True))
        cuts = np.searchsorted(word[order], np.arange(len(words) + 1)).tolist()
        return [self.segmentations(w, edges[a:b]) for w, a, b in zip(words, cuts, cuts[1:], strict=False)]

    def segmentations(self, word: str, edges: list[tuple[int, int, int, int]]) -> list[tuple[int, bytes]]:
        """The N best (value, ids as little-endian 32-bit integers) of a word with these edges, best first."""
        ends: list[list[tuple[int, int, tuple[int, ...]]]] = [[] for _ in range(len(word) + 1)]
        for start, end, value, piece in edges:
            ends[end].append((start, value, (piece,) if piece >= 0 else tuple(self.raw(ord(word[start])))))
        best = [0] * len(ends)
        for end in range(1, len(ends)):
            best[end] = max(best[start] + value for start, value, _ in ends[end])
        # (minus the value of the whole path, position, order of birth, value from there on, path): of equal paths
        # the one that has come further goes on, so no more than N times a path's length is popped
        queue: list[tuple] = [(-best[-1], len(word), 0, 0, None)]
        born = 0
        out = []
        while queue and len(out) < self.n:
            _, at, _, behind, path = heapq.heappop(queue)
            if at == 0:
                ids: list[int] = []
                while path is not None:
                    ids += path[0]
                    path = path[1]
                out.append((behind, np.array(ids, "<u4").tobytes()))
                continue
            for start, value, ids in ends[at]:
                born += 1
                total = behind + value
                heapq.heappush(queue, (-(total + best[start]), start, born, total, (ids, path)))
        return out

    def merged(self, words: list[str]) -> list[bytes]:
        """What the model's own merges make of words; no merge reaches over a word's ends."""
        marked = [w.startswith(MARK) and w != MARK for w in words]
        # the model puts a mark before whatever it is given; a line end keeps it from a word without one
        given = [(w[1:] if m else "\n" + w).replace(MARK, " ") for w, m in zip(words, marked, strict=True)]
        ids = self.model.encode(given, num_threads=1)
        coded = np.fromiter(chain.from_iterable(ids), "<u4", sum(map(len, ids))).tobytes()
        cuts = [0, *accumulate(4 * len(x) for x in ids)]
        return [coded[a if m else a + 8 : b] for a, b, m in zip(cuts, cuts[1:], marked, strict=False)]

    def looked_up(self, words: list[str]) -> list[tuple[int, int, bytes, bytes]]:
        """What ``best`` and ``merged`` say of each of some distinct words."""
        if len(self.cache) > CACHE_WORDS:  # words that aren't met again are forgotten
            self.cache = {w: self.cache[w] for w in words if w in self.cache}
        cache = self.cache
        fresh: dict[str, tuple[int, int, bytes, bytes]] = {}
        new = [w for w in words if w not in cache]
        size = at = 0
        for k, w in enumerate([*new, ""]):
            if size >= TOGETHER or k == len(new) > at:
                some = new[at:k]
                fresh.update((x, (*b, m)) for x, b, m in zip(some, self.best(some), self.merged(some), strict=True))
                at, size = k, 0
            size += len(w)
        cache.update((w, x) for w, x in fresh.items() if len(w) <= LONG_WORD)
        return [cache.get(w) or fresh[w] for w in words]

    def choices(self, words: set[str]) -> dict[str, list[tuple[int, bytes]]]:
        """The N best segmentations of each word; those of short ones are kept."""
        if len(self.searched) > CACHE_SEARCHED:
            self.searched = {w: self.searched[w] for w in words if w in self.searched}
        new = sorted(words.difference(self.searched))
        found = dict(zip(new, self.searched_words(new), strict=True)) if new else {}
        self.searched.update((w, x) for w, x in found.items() if len(w) <= LONG_WORD)
        return {w: found.get(w) or self.searched[w] for w in words}

    def encoded(self, texts: list[str]) -> Iterator[tuple[list[tuple[float, int, list[bytes]]], bytes]]:
        """For each text the N best (score, number of ids, ids in parts), and the ids that merges make."""
        parts = [SEGMENT.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        coded = pa.array(chain.from_iterable(parts), pa.string()).dictionary_encode()
        found = self.looked_up(coded.dictionary.to_pylist())
        codes = coded.indices.to_numpy()
        gap = np.fromiter((x[0] for x in found), np.int64, len(found))[codes]
        value = np.fromiter((x[1] for x in found), np.int64, len(found))[codes]
        sums = np.concatenate([[0], np.cumsum(value)])
        stops = np.cumsum([0, *map(len, parts)]).tolist()
        loose = [self.loosest(gap[a:b]) for a, b in zip(stops, stops[1:], strict=False)]
        choices = self.choices({own[k] for own, some in zip(parts, loose, strict=True) for k in some})
        ids, merged = [x[2] for x in found], [x[3] for x in found]
        for own, some, a, b in zip(parts, loose, stops, stops[1:], strict=False):
            here = codes[a:b].tolist()
            best = self.ranked([choices[own[k]] for k in some], some, [ids[k] for k in here], int(sums[b] - sums[a]))
            yield best, b"".join([merged[k] for k in here])

    def loosest(self, gap: np.ndarray) -> list[int]:
        """The places of the N - 1 words whose second best segmentations cost least."""
        most = self.n - 1
        places = np.argpartition(gap, most - 1)[:most] if 0 < most < len(gap) else np.arange(min(most, len(gap)))
        return sorted(k for k in places.tolist() if gap[k] < -FAR)

    def ranked(self, words: list[list[tuple[int, bytes]]], places: list[int], ids: list[bytes], whole: int) -> list[tuple[float, int, list[bytes]]]:
        """The N best of a text with these ids and value, by the segmentations of the words at ``places``."""
        lost = ((sum(w[0][0] - w[c][0] for w, c in zip(words, choice, strict=True)), choice) for choice in chosen(tuple(map(len, words)), self.n))
        between = [b"".join(ids[a:b]) for a, b in zip([0, *(k + 1 for k in places)], [*places, len(ids)], strict=True)]
        out = []
        for less, choice in heapq.nsmallest(self.n, lost):
            runs = [between[0]]
            for w, c, after in zip(words, choice, between[1:], strict=True):
                runs += [w[c][1], after]
            size = sum(map(len, runs)) // 4
            out.append(((whole - less + size) // FINE * UNIT, size, runs))
        return out

    def encode(self, text: str) -> list[tuple[float, bytes]]:
        """The N best (score, ids) of a whole text."""
        return [(score, b"".join(runs)) for score, _, runs in next(self.encoded([text]))[0]]

    def decode(self, ids: bytes | list[int]) -> str:
        numbers = np.frombuffer(ids, "<u4").tolist() if isinstance(ids, bytes) else ids
        text = b"".join(map(self.text.__getitem__, numbers)).decode("utf-8", "surrogatepass").replace(MARK, " ")
        return text[1:]


@lru_cache(maxsize=4)
def lattice(path: str | None, n: int) -> Lattice:
    return Lattice(path, n)


dropped_by(lambda: lattice.cache_clear())


def encode_nbest(docs: DataFrame, n: int = N_BEST, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens and score of the best segmentation, the N best as an array, whether the best decodes to the
    text, and the number and crc32 of the ids that the model's own merges make.

    Each of the N best has its score, number of tokens, the crc32 of its ids and, if asked for, the ids.
    """
    item = pa.struct(
        [("score", pa.float64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
        + ([("ids", pa.list_(pa.int32()))] if with_ids else [])
    )
    names = ["doc_id", "n_tokens", "score", "nbest", "round_trip", "merge_tokens", "merge_crc32"]

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        tool = lattice(path, n)
        made = []
        texts = as_text(batch.column(1))
        for text, (found, merged) in zip(texts, tool.encoded(texts), strict=True):
            listed = []
            for score, size, runs in found:
                crc = 0
                for x in runs:
                    crc = zlib.crc32(x, crc)
                listed.append({"score": score, "n_tokens": size, "ids_crc32": crc})
                if with_ids:
                    listed[-1]["ids"] = np.frombuffer(b"".join(runs), "<u4").tolist()
            fine = tool.decode(b"".join(found[0][2])) == text.replace(MARK, " ")
            made.append((found[0][1], found[0][0], listed, fine, len(merged) // 4, zlib.crc32(merged)))
        columns = list(zip(*made, strict=True))
        kinds = [pa.int64(), pa.float64(), pa.list_(item), pa.bool_(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    fields = "score: double, n_tokens: bigint, ids_crc32: bigint" + (", ids: array<int>" if with_ids else "")
    schema = f"doc_id long, n_tokens long, score double, nbest array<struct<{fields}>>, round_trip boolean, merge_tokens long, merge_crc32 long"
    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), rows, schema)


def decode_ids(encoded: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """doc_id and the text that an array of ids stands for; a null array stands for an empty text."""

    def rows(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        tool = lattice(path, N_BEST)
        texts = [tool.decode(x or []) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return in_batches(encoded.select("doc_id", F.col(ids).cast("array<int>").alias("ids")), rows, "doc_id long, text string")
