"""Operator 1, language-model scoring: a gated recurrent network with a class-factored output.

Word counts come from all training documents (crc32 of the id, modulo 10, is not 0). The most frequent
``VOCABULARY`` words have vectors and share classes of about equal mass; every rarer word belongs to a
class by its last two bytes, and within that class has the probability its count gives it, with one
place for words never seen. So P(word) = P(class | state) * P(word | class, state), where the last
factor needs the state for vocabulary words only.

Training goes over every training document once, in rounds over growing disjoint shares of them: in a
round each task takes the current parameters, learns from its documents by back-propagation within
windows of 16 tokens, and the mean of the tasks' parameters, weighted by tokens, is what the next round
starts from. Scoring carries the state from window to window through the whole document.

What grows with the corpus stays in Spark: counts are grouped there, and rare words of documents meet
their counts in a join. Only the ``HEAD`` most frequent words, the class masses and the parameters, all
of fixed size, reach the driver and are broadcast.

Defined results: a null text is an empty one, whose only token is its end. A null doc_id is passed on
and belongs to the training documents or not by the crc32 of the empty text. Rows are scored one by
one, repeated rows too (they also count twice in training). Without any training token all
probabilities follow from counts of zero, and the network stays as it starts.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import pieces_of, remainder, remainder_column, stored

HELD_OUT_MODULUS = 10
ALPHA = 0.1
HEAD = 65_536
VOCABULARY = 4_096
WORD_CLASSES, RARE_CLASSES = 48, 64
#: Tenths of the training documents, by a hash of their id, that each round learns from.
ROUNDS = ((0, 1), (1, 4), (4, 10))
#: The end of a document, as a word; no other word is empty.
END = b""
LONG = 4_096
CHUNK_TOKENS = 500_000
#: Documents of so many tokens wait to be scored abreast.
SCORED_TOKENS = 4_000_000
PARTS = 16
#: Words of so many bytes of rows are counted together.
COUNTED_BYTES = 32 << 20


def split(texts: pa.Array) -> pa.ListArray:
    """Each text's words, of lower-case letters A-Z, and the end."""
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    # what the last space is followed by is the end, an empty word
    texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(texts, "", " "))
    return pc.ascii_split_whitespace(texts)


def rare_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % RARE_CLASSES


@functools.cache
def class_tables() -> tuple[np.ndarray, np.ndarray]:
    """Classes by a word's only byte, and by its last two as a number."""
    one = [rare_class(bytes([a])) for a in range(256)]
    two = [rare_class(bytes([a, b])) for a in range(256) for b in range(256)]
    return np.array(one, np.int32), np.array(two, np.int32)


def rare_classes(words: pa.StringArray) -> np.ndarray:
    """The class of each word."""
    edges = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset)
    data = np.frombuffer(words.buffers()[2] or b"\0", np.uint8)
    sizes, last = np.diff(edges), np.maximum(edges[1:] - 1, 0)
    one, two = class_tables()
    out = two[256 * data[np.maximum(last - 1, 0)].astype(np.int32) + data[last]]
    return np.where(sizes > 1, out, np.where(sizes == 1, one[data[last]], rare_class(END))).astype(np.int32)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (word, class) in texts, summed as far as memory allows."""
    waiting: list[pa.Array] = []
    held = 0

    def out() -> pa.RecordBatch:
        counts = pa.concat_arrays(waiting).value_counts()
        words = counts.field("values")
        return pa.RecordBatch.from_arrays([words, pa.array(rare_classes(words)), counts.field("counts")], names=["word", "class", "n"])

    for batch in batches:
        for part in pieces_of(batch):
            waiting.append(split(part.column(0)).flatten())
            held += part.nbytes
            if held >= COUNTED_BYTES:
                yield out()
                waiting, held = [], 0
    if waiting:
        yield out()


class Vocabulary:
    """What scoring knows of counts without the join: the head's counts, class masses, corpus totals."""

    def __init__(self, head: list[tuple[bytes, int]], classes: dict[int, tuple[int, int]], tokens: int, types: int):
        if all(w != END for w, _ in head[:VOCABULARY]):
            # the end has a vector in any case
            n = dict(head).get(END, 0)
            rest = [x for x in head if x[0] != END]
            head = sorted([*rest[: VOCABULARY - 1], (END, n)], key=lambda x: (-x[1], x[0])) + rest[VOCABULARY - 1 :]
            if n:
                mass, kinds = classes[rare_class(END)]
                classes[rare_class(END)] = (mass - n, kinds - 1)
            for word, moved in rest[VOCABULARY - 1 : VOCABULARY]:
                mass, kinds = classes.get(rare_class(word), (0, 0))
                classes[rare_class(word)] = (mass + moved, kinds + 1)
        top = head[:VOCABULARY]
        size = len(top)
        of_class = [classes.get(c, (0, 0)) for c in range(RARE_CLASSES)]
        self.rare_mass = np.array([mass + ALPHA * (kinds + 1) for mass, kinds in of_class])
        word_mass = np.array([n + ALPHA for _, n in top])
        share = np.cumsum(np.sqrt(word_mass))
        groups = min(WORD_CLASSES, size)
        of = np.minimum((share / share[-1] * groups).astype(int), groups - 1)
        self.shape = gru.Shape(np.append(np.unique(of, return_index=True)[1], size), RARE_CLASSES)
        self.mass = np.concatenate([word_mass, self.rare_mass])
        # by place in the head: the model's id, the count, and log10 of the count with alpha, of the word within its class
        self.words = pa.array([w for w, _ in head], pa.binary()).view(pa.string())
        self.end = [w for w, _ in head].index(END)
        self.id = np.array([k if k < size else size + rare_class(w) for k, (w, _) in enumerate(head)], np.int32)
        self.count = np.array([n for _, n in head], np.int64)
        self.log = np.log10(self.count + ALPHA)

    def places(self, words: pa.StringArray) -> np.ndarray:
        """Where each word stands in the head; -1 for rare words."""
        return pc.fill_null(pc.index_in(words, self.words), -1).to_numpy().astype(np.int64)

    def numbers(self, words: pa.StringArray, places: np.ndarray) -> np.ndarray:
        """What the model reads: a vocabulary word's id, or the class of another word."""
        return np.where(places < 0, self.shape.words + rare_classes(words), self.id[places])


def shifted(numbers: np.ndarray, end: int) -> np.ndarray:
    """What the network reads before each token: an end, then the tokens up to the last but one."""
    return np.concatenate([[end], numbers[:-1]]).astype(np.int32)


def learn(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, p: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's parameters after its documents: rows (part, tokens, values), values already times tokens."""
    like = gru.start(vocabulary.shape, vocabulary.mass)
    trainer = gru.Trainer(gru.shaped(p, like), vocabulary.shape)
    waiting: list[np.ndarray] = []
    held = 0
    end = vocabulary.end

    def go() -> None:
        first = np.zeros(held, bool)
        first[np.cumsum([0, *(len(x) for x in waiting[:-1])])] = True
        trainer.learn(np.concatenate([shifted(x, end) for x in waiting]), np.concatenate(waiting), first)
        waiting.clear()

    for batch in batches:
        for numbers in batch.column(0):
            waiting.append(np.frombuffer(numbers.as_buffer(), NUMBER).astype(np.int32))
            held += len(waiting[-1])
            if held >= CHUNK_TOKENS:
                go()
                held = 0
    if held:
        go()
    if trainer.tokens:
        values = np.array_split(gru.flat(trainer.p).astype(np.float64) * trainer.tokens, PARTS)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(PARTS), pa.int32()),
                pa.array([TaskContext.get().partitionId()] * PARTS, pa.int64()),
                pa.array([trainer.tokens] * PARTS, pa.int64()),
                pa.array([v.tobytes() for v in values], pa.binary()),
            ],
            names=["part", "task", "tokens", "parameters"],
        )


def summed(table: pa.Table) -> pa.Table:
    total = np.zeros(0)
    for chunk in table.column("parameters").chunks:
        for x in chunk:
            value = np.frombuffer(x.as_buffer(), np.float64)
            total = value.copy() if not len(total) else total + value
    return pa.table(
        {
            "part": table.column("part")[:1],
            "task": pa.array([table.column("task")[0].as_py() // 64], pa.int64()),
            "tokens": pa.array([sum(table.column("tokens").to_pylist())], pa.int64()),
            "parameters": pa.array([total.tobytes()], pa.binary()),
        }
    )


def averaged(learned: DataFrame) -> np.ndarray | None:
    """The tasks' parameters in the mean, weighted by tokens: summed 64 at a time, in parts, over two levels."""
    schema = "part int, task long, tokens long, parameters binary"
    for _ in range(2):
        learned = learned.withColumn("bucket", F.floor(F.col("task") / 64)).groupBy("part", "bucket").applyInArrow(summed, schema)
    rows = learned.groupBy("part").applyInArrow(summed, schema).collect()
    if not rows:
        return None
    return np.concatenate([np.frombuffer(r["parameters"], np.float64) / r["tokens"] for r in sorted(rows, key=lambda r: r["part"])])


#: A word's number in the model, as it is stored between passes.
NUMBER = "<i2"
META = ["row", "doc_id", "held_out", "n_tokens", "head_known", "head_log", "within"]
META_SCHEMA = "row long, doc_id long, held_out boolean, n_tokens long, head_known long, head_log double, within double"
META_TYPES = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]


def encode(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    """Rows of META, and of each text what the network reads, and its rare words, those outside the head, with counts.

    head_log sums log10(count + alpha) of the head's words; within sums what words without a vector have within their
    class. Rare words wait for the join: both lack their log10(count + alpha).
    """
    first = vocabulary.shape.words
    row = TaskContext.get().partitionId() << 40
    rare_log = np.log10(vocabulary.rare_mass)
    names = [*META, "numbers", "rare_words", "rare_counts"]
    for batch in batches:
        for part in pieces_of(batch):
            texts = split(part.column(1))
            # all that depends on the word alone is worked out for distinct words
            coded = texts.flatten().dictionary_encode()
            words, codes = coded.dictionary, coded.indices.to_numpy()
            places = vocabulary.places(words)
            numbers = vocabulary.numbers(words, places)
            head, log = places >= 0, vocabulary.log[places]
            # a word of the head without a vector has all that its class leaves open; a rare one lacks its count
            within = np.where(places >= first, log, 0)
            within[numbers >= first] -= rare_log[numbers[numbers >= first] - first]
            edges = texts.offsets.to_numpy() - texts.offsets[0].as_py()
            sizes = np.diff(edges)

            def by_text(values: np.ndarray, codes=codes, edges=edges) -> np.ndarray:
                return np.add.reduceat(values[codes], edges[:-1])  # no text is without its end

            at = np.flatnonzero(~head[codes])
            pairs, times = np.unique(np.repeat(np.arange(len(sizes)) * len(words), sizes)[at] + codes[at], return_counts=True)
            rare_edges = pa.array(np.searchsorted(pairs, np.arange(len(sizes) + 1) * len(words)), pa.int32())
            read = numbers.astype(NUMBER)[codes].tobytes()
            starts = (2 * edges).astype(np.int32)
            doc_ids = part.column(0)
            arrays = [
                pa.array(row + np.arange(len(sizes)), pa.int64()),
                doc_ids,
                pa.array([remainder(x, HELD_OUT_MODULUS) == 0 for x in doc_ids.to_pylist()], pa.bool_()),
                pa.array(sizes, pa.int64()),
                pa.array(by_text((head & (vocabulary.count[places] > 0)).astype(np.int64))),
                pa.array(by_text(np.where(head, log, 0))),
                pa.array(by_text(within)),
                pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(starts), pa.py_buffer(read)]),
                pa.ListArray.from_arrays(rare_edges, words.take(pa.array(pairs % max(1, len(words))))),
                pa.ListArray.from_arrays(rare_edges, pa.array(times, pa.int32())),
            ]
            row += len(sizes)
            yield pa.RecordBatch.from_arrays(arrays, names=names)


def score(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, p: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of META and numbers -> rows of META and model_log, log10 of what the network gives, without within."""
    shape = vocabulary.shape
    parameters = gru.shaped(p, gru.start(shape, vocabulary.mass))

    def done(waiting: list[tuple]) -> pa.RecordBatch:
        targets = [w[-1] for w in waiting]
        found = gru.score_documents(parameters, shape, [shifted(x, vocabulary.end) for x in targets], targets) / math.log(10)
        columns = [*list(zip(*waiting, strict=True))[:-1], found]
        types = [*META_TYPES, pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[*META, "model_log"])

    kinds: dict[bool, list[tuple]] = {False: [], True: []}  # long documents wait for each other: they are scored abreast
    held = {False: 0, True: 0}
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns[:-1]]
        for *meta, numbers in zip(*columns, batch.column(len(META)), strict=True):
            item = np.frombuffer(numbers.as_buffer(), NUMBER).astype(np.int32)
            long = len(item) > LONG
            kinds[long].append((*meta, item))
            held[long] += len(item)
            if held[long] >= SCORED_TOKENS:
                yield done(kinds[long])
                kinds[long], held[long] = [], 0
    for waiting in kinds.values():
        if waiting:
            yield done(waiting)


def most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """Words and counts of the highest counts, ``most`` at most, most frequent first.

    Counts are cut into 64 steps for each power of two; whole steps are taken from the top as long as they fit, so
    that no more than these words are sent to the driver.
    """
    step = F.floor(F.log2("n") * 64)
    sizes = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()
    least, held = None, 0
    for r in sorted(sizes, key=lambda r: -r["step"]):
        held += r["words"]
        if held > most:
            break
        least = r["step"]
    if least is None:
        return []
    found = counts.filter(step >= least).select("word", "n").collect()
    return sorted(((r["word"].encode(), r["n"]) for r in found), key=lambda x: (-x[1], x[0]))


def lm_scores(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    training = given.filter(remainder_column(F.col("doc_id"), HELD_OUT_MODULUS) != 0)

    counts = training.select("text").mapInArrow(count_words, "word string, class int, n long")
    counts = stored(counts.groupBy("word", "class").agg(F.sum("n").alias("n")), "word-counts")
    tokens, types = (x or 0 for x in counts.agg(F.sum("n"), F.count("*")).first())
    head = most_frequent(counts, HEAD)
    top = [w.decode() for w, _ in head[:VOCABULARY]]
    top_words = spark.createDataFrame([(w,) for w in top], "word string")
    classes = counts.join(F.broadcast(top_words), "word", "left_anti").groupBy("class").agg(F.sum("n"), F.count("*")).collect()
    if not any(w == END for w, _ in head):
        n = counts.filter("word = ''").first()
        head.append((END, n["n"] if n else 0))
    vocabulary = Vocabulary(head, {r[0]: (r[1], r[2]) for r in classes}, tokens, types)
    shared = spark.sparkContext.broadcast(vocabulary)

    encoded_schema = f"{META_SCHEMA}, numbers binary, rare_words array<string>, rare_counts array<int>"
    encoded = stored(given.mapInArrow(lambda x: encode(x, shared.value), encoded_schema), "encoded")

    p = gru.flat(gru.start(vocabulary.shape, vocabulary.mass))
    tenth = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1))), F.lit(10))
    for low, high in ROUNDS:
        sent = spark.sparkContext.broadcast(p)
        part = encoded.filter((~F.col("held_out")) & (tenth >= low) & (tenth < high)).select("numbers")
        learned = part.mapInArrow(
            lambda x, sent=sent: learn(x, shared.value, sent.value), "part int, task long, tokens long, parameters binary"
        )
        found = averaged(learned)
        p = p if found is None else found
    final = spark.sparkContext.broadcast(p.astype(np.float32))

    scored = encoded.select(*META, "numbers").mapInArrow(
        lambda x: score(x, shared.value, final.value), f"{META_SCHEMA}, model_log double"
    )
    rare = encoded.select("row", F.explode(F.arrays_zip("rare_words", "rare_counts")).alias("w")).select(
        "row", F.col("w.rare_words").alias("word"), F.col("w.rare_counts").alias("times")
    )
    joined = rare.join(counts.select("word", "n"), "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + ALPHA)).alias("rare_log"),
    )
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    share = math.log10(tokens + ALPHA * (types + 1))
    return scored.join(joined, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("head_log") + rare_log - F.col("n_tokens") * F.lit(share)).alias("base_score"),
        (F.col("model_log") + F.col("within") + rare_log).alias("score"),
    )
