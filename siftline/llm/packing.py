"""Operator 8, packing: lexical retrieval over a sharded BM25 index.

A document is its token ids and one end id. What fills whole windows of ``WINDOW`` tokens is cut off as
full sequences; the rest of each document goes to a shard. A shard holds about ``SHARD_TOKENS`` tokens
and an inverted index of its documents, weighted by BM25 with document frequencies counted over all
whole documents. The first unused document seeds a window; unused neighbours fill it, best first, whole
where they fit; the best that doesn't fit is cut to fill the window, and its rest seeds the next one. Documents
without a neighbour left are taken in order. What a shard has left in the end is cut into sequences
of powers of two, so that no sequence needs padding.

Shards are ranges of a min-hash sketch of the ids, so documents that share words meet, and
equal documents beyond one shard's size run on into the next. A shard's size is bounded in tokens, not
by any key, and a task holds one shard at a time, however many fall to it. Word ids come from a cache: the tokenizer never joins text across white space.

Defined results: a null text is an empty one, which is its end id alone. Repeated rows and repeated
ids are packed row by row; a null doc_id is passed on; special tokens in a text become what the
tokenizer makes of them. An empty table gives no rows.
"""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, begin, dropped_by, pieces_of, stored

WINDOW = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
SHARD_TOKENS = 1_500_000
#: Beyond so many partitions a task packs several shards, one after the other.
MOST_PARTITIONS = 20_000
K1, B = 1.2, 0.75
#: Terms of more than one in so many documents of a shard are kept as rows over all documents.
OFTEN = 10
CACHE_WORDS = 600_000
#: So much text is tokenized at a time.
PART_BYTES = 8 << 20

CUT_SCHEMA = (
    "doc_id long, start long, length long, crc long, doc_tokens long, sketch long, ids binary, term int, df long"
)
PIECE_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

_known: dict[object, Known] = {}
_unchanging: dict[object, object] = {}
_tokenizers: dict[str, object] = {}
_ending: dict[object, np.ndarray] = {}


def tokenizer(path: str | None):
    """The tokenizer at ``path``, or the public one of this name; loaded once in a process."""
    key = path or TOKENIZER
    if key not in _tokenizers:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        _tokenizers[key] = Tokenizer.from_file(path)
        _known.clear()
    return _tokenizers[key]


@dropped_by
def drop_words() -> None:
    """Forget tokenizers and words."""
    for kept in (_known, _unchanging, _tokenizers, _ending):
        kept.clear()


#: Lower-case letters that the tokenizer's normalizer leaves alone: such a word is one run of letters to it.
PLAIN = "[a-z\u00df-\u00f6\u00f8-\u00ff]+"
#: After such letters these make a run of their own. An apostrophe may belong to what follows it.
SIGNS = string.punctuation.replace("'", "")


def ending(tool) -> np.ndarray:
    """Which ids end a run of letters."""
    if tool not in _ending:
        found = np.zeros(tool.get_vocab_size(), bool)
        found[[k for token, k in tool.get_vocab().items() if token.endswith("</w>")]] = True
        _ending[tool] = found
    return _ending[tool]


def encoded_plain(words: list[str], tool) -> tuple[np.ndarray, np.ndarray]:
    """(ids, how many each word has) of words of PLAIN letters. Many go through the tokenizer as one text; an id that ends a run ends a word."""
    if tool not in _unchanging:
        _unchanging[tool] = type(tool).from_str(tool.to_str())
        _unchanging[tool].normalizer = None
    texts = [" ".join(words[at : at + 500]) for at in range(0, len(words), 500)]
    found = [np.array(x.ids, "<u4") for x in _unchanging[tool].encode_batch_fast(texts, add_special_tokens=False)]
    ids = np.concatenate([np.zeros(0, "<u4"), *found])
    return ids, np.diff(np.flatnonzero(ending(tool)[ids]), prepend=-1)


def encoded(words: list[str], tool) -> tuple[np.ndarray, np.ndarray]:
    """(ids, how many each word has). Many words go through the tokenizer as one text, told apart by their offsets."""
    ids, counts = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
    for at in range(0, len(words), 500):
        some = words[at : at + 500]
        found = tool.encode(" ".join(some), add_special_tokens=False)
        starts = np.fromiter((a for a, _ in found.offsets), np.int64, len(found.ids))
        sizes = np.fromiter(map(len, some), np.int64, len(some)) + 1
        edges = np.searchsorted(starts, np.cumsum(sizes) - sizes, side="left")
        ids.append(np.array(found.ids, "<u4"))
        counts.append(np.diff(edges, append=len(starts)))
    return np.concatenate(ids), np.concatenate(counts)


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of ``values``, one after the other."""
    return values[np.arange(int(sizes.sum())) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)]


class Known:
    """Distinct words with their ids: those of word k are the ``sizes[k]`` from ``starts[k]`` on in ``ids``."""

    def __init__(self, words: pa.Array, ids: np.ndarray, sizes: np.ndarray):
        self.words, self.ids, self.sizes = words, ids, sizes
        self.starts = np.cumsum(sizes) - sizes


def stems_and_tails(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Each word in two parts, which the tokenizer takes apart too: PLAIN letters and the signs after them, or all and nothing."""
    stems = pc.ascii_rtrim(words, characters=SIGNS)
    stems = pc.if_else(pc.match_substring_regex(stems, f"^(?:{PLAIN})$"), stems, words)
    ends = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset)[1:].astype(np.int64)
    sizes = (pc.binary_length(words).to_numpy() - pc.binary_length(stems).to_numpy()).astype(np.int64)
    data = words.buffers()[2] or b""
    tails = gathered(np.frombuffer(data, np.uint8), ends - sizes, sizes)
    edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return stems, pa.StringArray.from_buffers(len(words), pa.py_buffer(edges), pa.py_buffer(tails))


def looked_up(words: pa.Array, tool) -> Known:
    """The ids of some distinct words.

    Arrow finds stems that were met before. They are kept up to a number of words; beyond it only these words' stay,
    so that what is frequent stays and memory is bounded.
    """
    stems, tails = (x.dictionary_encode() for x in stems_and_tails(words))
    distinct = stems.dictionary
    known = _known.get(tool)
    if known is None:
        known = Known(distinct.slice(0, 0), np.zeros(0, "<u4"), np.zeros(0, np.int64))
    at = pc.fill_null(pc.index_in(distinct, known.words), -1).to_numpy().copy()
    fresh = distinct.filter(pa.array(at < 0))
    plain = pc.match_substring_regex(fresh, f"^(?:{PLAIN})$")
    others = fresh.filter(pc.invert(plain))
    # the plain ones first, then the others, after those known
    rank = np.argsort(~plain.to_numpy(zero_copy_only=False), kind="stable")
    place = np.empty(len(rank), at.dtype)
    place[rank] = len(known.words) + np.arange(len(rank))
    at[at < 0] = place
    made = [encoded_plain(fresh.filter(plain).to_pylist(), tool)]
    made.append(encoded([w.decode("utf-8", "replace") for w in others.view(pa.binary()).to_pylist()], tool))
    known = Known(
        pa.concat_arrays([known.words, fresh.filter(plain), others]),
        np.concatenate([known.ids, *(ids for ids, _ in made)]),
        np.concatenate([known.sizes, *(sizes for _, sizes in made)]),
    )
    if len(known.words) > CACHE_WORDS:
        known = Known(distinct, gathered(known.ids, known.starts[at], known.sizes[at]), known.sizes[at])
        at = np.arange(len(distinct))
    _known[tool] = known
    signs, counts = encoded(tails.dictionary.to_pylist(), tool)
    stem, tail = at[stems.indices.to_numpy()], tails.indices.to_numpy()
    starts = np.stack([known.starts[stem], len(known.ids) + (np.cumsum(counts) - counts)[tail]], axis=1).ravel()
    sizes = np.stack([known.sizes[stem], counts[tail]], axis=1)
    return Known(words, gathered(np.concatenate([known.ids, signs]), starts, sizes.ravel()), sizes.sum(1))


def ids_of(texts: list[bytes], path: str | None = None) -> list[bytes]:
    """Each text's ids and the end id, as little-endian unsigned 32-bit integers.

    Arrow splits texts and tells distinct words; only these meet what is known and the tokenizer.
    """
    tool = tokenizer(path)
    # special tokens are matched before lower case is made
    lowered = pa.array([x if b"<|" in x else x.lower() for x in texts], pa.binary())
    words = pc.ascii_split_whitespace(lowered.view(pa.string()))
    coded = words.flatten().dictionary_encode()
    known = looked_up(coded.dictionary, tool)
    codes = coded.indices.to_numpy()
    size = known.sizes[codes]
    found = gathered(known.ids, known.starts[codes], size)
    edges = np.concatenate([[0], np.cumsum(size)])[words.offsets.to_numpy()].tolist()
    end = np.array([END_ID], "<u4").tobytes()
    return [found[a:b].tobytes() + end for a, b in zip(edges, edges[1:], strict=False)]


def sketch(distinct: np.ndarray) -> int:
    """Min-hash of a document's distinct ids."""
    mixed = (distinct.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    return int(mixed.min())


def cut(batches: Iterator[pa.RecordBatch], path: str | None, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Rows of (doc_id, text) -> full windows (sketch, ids null), rests with their ids, and document frequencies."""
    schema = pa.schema(
        [pa.field(n, pa.int64()) for n in ("doc_id", "start", "length", "crc", "doc_tokens", "sketch")]
        + [pa.field("ids", pa.binary()), pa.field("term", pa.int32()), pa.field("df", pa.int64())]
    )
    begin(__name__)
    df = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for part in pieces_of(batch, PART_BYTES):
            out: list[tuple] = []
            ids_here = part.column(0).to_pylist()
            for doc_id, ids in zip(ids_here, ids_of(as_bytes(part.column(1)), path), strict=True):
                numbers = np.frombuffer(ids, "<u4")
                n = len(numbers)
                distinct = np.unique(numbers)
                if distinct[-1] >= len(df):
                    df = np.pad(df, (0, int(distinct[-1]) + 1 - len(df)))
                df[distinct] += 1
                full = n - n % WINDOW
                for at in range(0, full, WINDOW):
                    window = ids[4 * at : 4 * (at + WINDOW)]
                    out.append((doc_id, at, WINDOW, zlib.crc32(window), n, None, window if with_ids else None))
                if full < n:
                    out.append((doc_id, full, n - full, None, n, sketch(distinct), ids[4 * full :]))
            columns = list(zip(*out, strict=True))
            arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=False)]
            arrays += [pa.nulls(len(out), pa.int32()), pa.nulls(len(out), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)
    terms = np.flatnonzero(df).astype(np.int32)
    if len(terms):
        arrays = [pa.nulls(len(terms), f.type) for f in list(schema)[:-2]] + [pa.array(terms), pa.array(df[terms])]
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)


class Shard:
    """Rests of documents that are packed together. Rests are (doc_id, start, doc_tokens, ids)."""

    def __init__(self, rests: list[tuple], idf: np.ndarray, mean_length: float):
        self.rests = rests
        n = len(rests)
        self.begin = np.zeros(n, np.int64)
        self.end = np.array([len(r[3]) // 4 for r in rests], np.int64)
        # text by text, so that no array of all tokens with their documents is sorted
        found = [np.unique(np.frombuffer(r[3], "<u4"), return_counts=True) for r in rests]
        self.first = np.cumsum([0, *(len(x) for x, _ in found)])
        doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.first))
        self.term = term = np.concatenate([x for x, _ in found])
        tf = np.concatenate([x for _, x in found])
        del found
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * self.end[doc] / mean_length))
        order = np.argsort(term, kind="stable")
        doc, weight = doc[order], weight[order]
        self.terms, at = np.unique(term[order], return_index=True)
        at = np.append(at, len(order))
        # terms of many documents are rows with a weight for each document, others are postings
        often = np.diff(at) * OFTEN > n
        self.rows: dict[int, np.ndarray] = {}
        for k in np.flatnonzero(often).tolist():
            self.rows[k] = np.bincount(doc[at[k] : at[k + 1]], weight[at[k] : at[k + 1]], n)
        rare = ~np.repeat(often, np.diff(at))
        self.posted, self.posted_weight = doc[rare], weight[rare]
        self.at = np.concatenate([[0], np.cumsum(rare)])[at]
        self.unused = np.ones(n, bool)
        self.columns = np.arange(n)

    def neighbours(self, seed: int) -> np.ndarray:
        """Unused documents that share one of the seed's words, best first, scored by all words of the seed."""
        if 4 * int(self.unused.sum()) < 3 * len(self.columns):  # used documents leave the index
            keep = self.unused[self.posted]
            self.at = np.concatenate([[0], np.cumsum(keep)])[self.at]
            self.posted, self.posted_weight = self.posted[keep], self.posted_weight[keep]
            keep = self.unused[self.columns]
            self.columns = self.columns[keep]
            self.rows = {k: row[keep] for k, row in self.rows.items()}
        places = np.searchsorted(self.terms, self.term[self.first[seed] : self.first[seed + 1]])
        starts, sizes = self.at[places], self.at[places + 1] - self.at[places]
        within = np.arange(int(sizes.sum())) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
        score = np.bincount(self.posted[within], self.posted_weight[within], len(self.rests)).astype(float)  # of nothing it is whole numbers
        common = np.zeros(len(self.columns))
        for k in places.tolist():
            if k in self.rows:
                common += self.rows[k]
        score[self.columns] += common
        score[~self.unused] = 0
        score[seed] = 0
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]

    def take(self, k: int, most: int) -> tuple:
        """The next ``most`` ids of a rest, or all it has: (doc_id, start, length, crc, doc_tokens, ids)."""
        doc_id, start, doc_tokens, ids = self.rests[k]
        a = int(self.begin[k])
        b = min(int(self.end[k]), a + most)
        piece = ids[4 * a : 4 * b]
        self.begin[k] = b
        self.unused[k] = b < self.end[k]
        return doc_id, start + a, b - a, zlib.crc32(piece), doc_tokens, piece

    def sequences(self) -> Iterator[list[tuple]]:
        left = int(self.end.sum())
        next_in_order, seed = 0, None
        while left:
            size = WINDOW if left >= WINDOW else 1 << left.bit_length() - 1
            if seed is None or not self.unused[seed]:
                while not self.unused[next_in_order]:
                    next_in_order += 1
                seed = next_in_order
            filled = [self.take(seed, size)]
            gap = size - filled[0][2]
            last = seed
            if gap:
                ranked = self.neighbours(seed)
                sizes = self.end[ranked] - self.begin[ranked]
                at, over = 0, None
                while gap and at < len(ranked):
                    fits = sizes[at:] <= gap
                    step = int(fits.argmax())
                    if over is None and not fits[0]:
                        over = int(ranked[at])
                    if not fits[step]:
                        break
                    at += step
                    filled.append(self.take(int(ranked[at]), gap))
                    gap -= filled[-1][2]
                    at += 1
                while gap:
                    if over is None or not self.unused[over]:
                        while not self.unused[next_in_order]:
                            next_in_order += 1
                        over = next_in_order
                    piece = self.take(over, gap)
                    filled.append(piece)
                    gap -= piece[2]
                    last = over
            seed = last
            left -= size
            yield filled


def packed(batches: Iterator[pa.RecordBatch], idf: np.ndarray, mean_length: float, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Full windows and rests of one partition -> pieces with their sequence and offset."""
    begin(__name__)
    sequence = TaskContext.get().partitionId() << 36
    kinds = [pa.int64()] * 7 + ([pa.binary()] if with_ids else [])
    names = PIECE_COLUMNS + (["ids"] if with_ids else [])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names=names
        )

    def pack(rests: list[tuple]) -> Iterator[pa.RecordBatch]:
        nonlocal sequence
        rows: list[tuple] = []
        for pieces in Shard(rests, idf, mean_length).sequences():
            offset = 0
            for piece in pieces:
                rows.append((*piece[:5], sequence, offset, piece[5]))
                offset += piece[2]
            sequence += 1
        yield made(rows)

    rests: list[tuple] = []
    tokens = 0
    for batch in batches:
        rows = batch.to_pydict()
        full: list[tuple] = []
        for row in zip(*(rows[c] for c in ("doc_id", "start", "length", "crc", "doc_tokens", "sketch", "ids")), strict=True):
            if row[5] is None:
                full.append((*row[:5], sequence, 0, row[6]))
                sequence += 1
                continue
            rests.append((row[0], row[1], row[4], row[6]))
            tokens += row[2]
            if tokens >= 2 * SHARD_TOKENS:
                yield from pack(rests)
                rests, tokens = [], 0
        if full:
            yield made(full)
    if rests:
        yield from pack(rests)


def pack(docs: DataFrame, tokenizer_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids if asked for."""
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = stored(given.mapInArrow(lambda x: cut(x, tokenizer_path, with_ids), CUT_SCHEMA), "cut")
    # the vocabulary of the tokenizer bounds the terms, whatever the corpus
    df = pieces.filter("term is not null").groupBy("term").agg(F.sum("df").alias("df")).collect()
    sizes = pieces.filter("term is null").agg(
        F.count_if(F.expr("start + length = doc_tokens")),
        F.sum(F.when(F.col("sketch").isNotNull(), F.col("length"))),
    )
    n, tokens = (x or 0 for x in sizes.first())
    counts = np.zeros(max([r["term"] for r in df], default=0) + 1)
    for r in df:
        counts[r["term"]] = r["df"]
    idf = spark.sparkContext.broadcast(np.log1p((n - counts + 0.5) / (counts + 0.5)))
    mean_length = max(1.0, tokens / max(n, 1))
    # full windows carry no sketch: a hash deals them out
    order = F.coalesce("sketch", F.pmod(F.xxhash64("doc_id", "start"), F.lit(1 << 31)))
    dealt = (
        pieces.filter("term is null")
        .select("doc_id", "start", "length", "crc", "doc_tokens", "sketch", "ids")
        .withColumn("place", order)
        .withColumn("tie", F.xxhash64("doc_id", F.crc32("ids")))
        .repartitionByRange(min(MOST_PARTITIONS, max(1, -(-tokens // SHARD_TOKENS))), "place", "tie")
        .sortWithinPartitions("place", "tie", "doc_id", "start", "crc")
    )
    schema = ", ".join(f"{c} long" for c in PIECE_COLUMNS) + (", ids binary" if with_ids else "")
    return dealt.mapInArrow(lambda x: packed(x, idf.value, mean_length, with_ids), schema)
