"""Language-model scores by a weighted backoff automaton over word trigrams.

Model: hierarchical Dirichlet smoothing over counts of the training fold.  With c the counts of n-grams,

    p(w)       = (c(w) + 0.5) / (N + 0.5 (V + 1))                      the base score's estimate
    p(w | v)   = (c(v w) + PAIR p(w)) / (c(v) + PAIR)
    p(w | u v) = (c(u v w) + TRIPLE p(w | v)) / (c(u v) + TRIPLE)

so each distribution sums to one over the vocabulary and one unknown word, and the counts are all that is gathered.  As an automaton: the
root, the words and the word pairs seen in training are states.  An n-gram seen in training is an arc, from the state of its context to the state of
its last two words.  A state's failure arc leads to that of its last word alone, or to the root, at the cost log(TRIPLE / (c(u v) + TRIPLE)) or
log(PAIR / (c(v) + PAIR)); the root has an arc for every word.  One left-to-right traversal carries the state: it follows
failure arcs until the state has an arc for the word, takes it, and adds up all weights on the way.

Scale.  No task holds the model.  Documents are written as blocks of about ``BLOCK`` tokens, coded by a vocabulary of their own.
Blocks send their distinct words (64-bit hashes) to shards, which number them, frequent ones first, and count them; then their
distinct pairs, and in a third round triples, as word numbers, with their own training counts, to shards of about ``SHARD`` tokens, which add
up and answer in the order asked.  What has a part that occurs in no other block (its count there is its count everywhere) needn't be asked for: its
own count is exact.  A message has at least one n-gram, and a block asks for an n-gram once, so messages grow with the corpus and not faster.
An n-gram's shard follows from its middle word, or where that is a frequent word, from more of its words: no shard depends on one word.
From the answers a block builds the part of the automaton that its documents can reach.

Cases.  Null text: as empty: one token, the end.  A null doc_id is the empty text to the fold.  Any bytes can be words.  Repeated rows count and are
scored each.  Empty table: no rows; no training rows: base probabilities of an empty corpus.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm._util import fold_of, materialize, release, remove, shared_dir

#: Tokens of a block and of a shard.
BLOCK = SHARD = 1 << 20
#: Pseudo-counts of the shorter context; of the powers of ten and their threefolds tried, those with the best held-out scores on a corpus of invented prose.
PAIR, TRIPLE = 1000.0, 10.0
#: Tokens that a lane of the traversal scores.
LANE = 256
#: Numbers of no word (a pair's missing first word) and of the start; words are numbered from 2.
NONE, START, FIRST = 0, 1, 2
END = xxhash.xxh64_intdigest(b"\x00end")
BLOCKS = "block long, n_tokens long, train_docs long, doc_ids array<long>, text binary, vocab binary"
#: Blocks with their words' numbers and training counts in place of the words.
TEXTS = "block long, doc_ids array<long>, text binary, words binary"
ASK = "shard int, block long, body binary"
ANSWER = "block long, shard int, body binary, tokens long, types long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Local(dict):
    """word -> number in order of appearance; 0 is the end."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = len(self) + 1
        return value


def packed(*arrays: np.ndarray) -> bytes:
    """Whole numbers from 0, by byte planes as many as the largest needs, compressed."""
    out = []
    for x in arrays:
        x = np.ascontiguousarray(x, dtype="<u8")
        width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
        out += [len(x).to_bytes(8, "little"), bytes([width]), np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()]
    return zstandard.compress(b"".join(out), 1)


def unpacked(raw: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(raw), 0, []
    while at < len(raw):
        n, width = int.from_bytes(raw[at : at + 8], "little"), raw[at + 8]
        x = np.zeros((n, 8), dtype=np.uint8)
        x[:, :width] = np.frombuffer(raw, dtype=np.uint8, count=n * width, offset=at + 9).reshape(width, n).T
        out.append(x.view("<i8").ravel())
        at += 9 + n * width
    return out


def batch_of(rows: list[tuple], schema: str, table: bool = False):
    """Rows as a record batch, or as a table, of a schema in Spark's words."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
    names, types = zip(*(x.split(" ") for x in schema.split(", ")), strict=True)
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return (pa.Table if table else pa.RecordBatch).from_arrays([pa.array(c, kinds[t]) for c, t in zip(cols, types, strict=True)], names=list(names))


def mix64(*parts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of tuples of whole numbers."""
    x = np.zeros(len(parts[0]), dtype=np.uint64)
    for part in parts:
        x = (x ^ part.astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def write_blocks(docs: DataFrame, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        local, parts, doc_ids, held = Local(), [], [], 0

        def block() -> pa.RecordBatch:
            vocab = np.fromiter((END, *map(xxhash.xxh64_intdigest, local)), dtype=np.uint64, count=len(local) + 1)
            text = packed(np.array([len(p) for p in parts]), np.concatenate(parts))
            return batch_of([(first, held, sum(fold_of(d) != 1 for d in doc_ids), doc_ids, text, vocab.tobytes())], BLOCKS)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or b"").lower().split()
                ids = np.zeros(len(words) + 1, dtype=np.int64)
                ids[:-1] = np.fromiter(map(local.__getitem__, words), dtype=np.int64, count=len(words))
                parts.append(ids)
                doc_ids.append(doc)
                held += len(ids)
                if held >= BLOCK:
                    yield block()
                    local, parts, doc_ids, held, first = Local(), [], [], 0, first + 1
        if doc_ids:
            yield block()

    return materialize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, BLOCKS), path)


class Text:
    """A block's documents as local word numbers."""

    def __init__(self, doc_ids: list, text: bytes):
        self.doc_ids = doc_ids
        self.lens, self.ids = unpacked(text)
        self.starts = np.concatenate(([0], np.cumsum(self.lens)[:-1]))
        self.held_out = np.array([fold_of(d) == 1 for d in doc_ids])
        self.train = ~np.repeat(self.held_out, self.lens)


class Asked:
    """Things in the order in which their shards are asked and answer; those not asked for keep their own counts."""

    def __init__(self, shard: np.ndarray, own: np.ndarray, ask: np.ndarray):
        self.shard, self.own = shard, own
        which = np.flatnonzero(ask)
        self.order = which[np.argsort(shard[which], kind="stable")]

    def questions(self, *keys: np.ndarray) -> Iterator[tuple[int, bytes]]:
        for shard, some in runs(self.shard, self.order):
            yield shard, packed(*(k[some] for k in keys), self.own[some])

    def counts(self, answers: list[bytes]) -> np.ndarray:
        out = self.own.copy()
        if answers:
            out[self.order] = np.concatenate([unpacked(a)[0] for a in answers])
        return out


def words_asked(text: Text, vocab: np.ndarray, shards: int) -> Asked:
    own = np.bincount(text.ids[text.train], minlength=len(vocab))
    return Asked((vocab % np.uint64(shards)).astype(np.int64), own, np.ones(len(vocab), dtype=bool))


def shard_of(middle, first, last, often_middle, often_first, shards: int) -> np.ndarray:
    """By the middle word; where that is frequent, by the first word too; where both are, by all three."""
    return (mix64(middle, np.where(often_middle, first, 0), np.where(often_middle & often_first, last, 0)) % np.uint64(shards)).astype(np.int64)


def runs(shard: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, its elements) for each shard that has any; ``order`` sorts by shard."""
    if len(order):
        at = np.flatnonzero(np.diff(shard[order])) + 1
        for some in np.split(order, at):
            yield int(shard[some[0]]), some


class Pairs:
    """A block's distinct pairs.  A pair's context counts as the middle word, and it has no first one."""

    def __init__(self, text: Text, words: bytes, shards: int, tokens: int):
        number, self.count = unpacked(words)
        self.text, self.shards, self.size = text, shards, len(number) + 1  # the last local word is the start
        before = np.empty_like(text.ids)
        before[1:] = text.ids[:-1]
        before[text.starts] = len(number)
        self.keys, self.at, self.train = distinct(text.ids * self.size + before, text.train)
        self.word, self.context = self.keys // self.size, self.keys % self.size
        self.number, self.often = np.append(number, START), np.append(self.count * 8 * shards >= tokens, True)
        only_here = np.append(self.count == np.bincount(text.ids[text.train], minlength=len(number)), False)
        v, w = self.number[self.context], self.number[self.word]
        self.key = (v, np.full_like(v, NONE), w)
        everywhere = np.ones(len(v), dtype=bool)
        self.asked = Asked(shard_of(*self.key, self.often[self.context], everywhere, shards), self.train, ~only_here[self.context] & ~only_here[self.word])


class Triples:
    """A block's distinct triples: a pair, and the pair that ends where the triple does."""

    def __init__(self, p: Pairs, pair_count: np.ndarray):
        inner = np.ones(len(p.text.ids), dtype=bool)
        inner[p.text.starts] = False
        inner = np.flatnonzero(inner)  # places with two words before them, the start included
        keys, _, train = distinct(p.at[inner - 1] * p.size + p.text.ids[inner], p.text.train[inner])
        self.pair, self.last = keys // p.size, keys % p.size
        self.ends = np.searchsorted(p.keys, self.last * p.size + p.word[self.pair])
        first, middle = p.context[self.pair], p.word[self.pair]
        self.key = (p.number[middle], p.number[first], p.number[self.last])
        only_here = pair_count == p.train
        self.asked = Asked(shard_of(*self.key, p.often[middle], p.often[first], p.shards), train, ~only_here[self.pair] & ~only_here[self.ends])


def distinct(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, places of the given ones among them, their training occurrences)."""
    found, at = np.unique(keys, return_inverse=True)
    return found, at, np.bincount(at[train], minlength=len(found))


def count_words(asked: DataFrame, shards: int) -> DataFrame:
    """Answers (numbers, counts); and for each shard the tokens and the types of the training fold."""

    def run(t: pa.Table) -> pa.Table:
        shard, blocks, bodies = t["shard"][0].as_py(), t["block"].to_pylist(), [unpacked(b.as_py()) for b in t["body"]]
        _, at = np.unique(np.concatenate([b[0] for b in bodies]), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([b[1] for b in bodies])).astype(np.int64)
        number = np.empty(len(total), dtype=np.int64)
        number[np.argsort(-total, kind="stable")] = FIRST + np.arange(len(total)) * shards + shard
        ends = np.cumsum([0, *(len(b[0]) for b in bodies)])
        rows = [(block, shard, packed(number[at[a:b]], total[at[a:b]]), None, None) for block, a, b in zip(blocks, ends, ends[1:], strict=False)]
        return batch_of([*rows, (None, shard, None, int(total.sum()), int((total > 0).sum()))], ANSWER, True)

    return asked.groupBy("shard").applyInArrow(run, ANSWER)


def count_grams(asked: DataFrame) -> DataFrame:
    """Answers (counts).  N-grams of a shard, about a million, are told apart by 64-bit hashes."""

    def run(t: pa.Table) -> pa.Table:
        shard, blocks = t["shard"][0].as_py(), t["block"].to_pylist()
        keys, train = [], []
        for body in t["body"]:
            v, u, w, n = unpacked(body.as_py())
            keys.append(mix64(v, u, w))
            train.append(n)
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(train)).astype(np.int64)
        ends = np.cumsum([0, *map(len, keys)])
        return batch_of([(block, shard, packed(total[at[a:b]]), None, None) for block, a, b in zip(blocks, ends, ends[1:], strict=False)], ANSWER, True)

    return asked.groupBy("shard").applyInArrow(run, ANSWER)


class Automaton:
    """States, arcs and failure arcs that a block's documents can reach; weights are log10 probabilities.

    State 0 is the root, 1 to ``words`` are words (the start last), later ones pairs.  Arcs are kept by state * words + word, sorted.
    """

    def __init__(self, unigram: np.ndarray, word_count: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], triples: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]):
        self.words = n = len(word_count)
        context, word, pair_count = pairs
        pair, last, ends, triple_count = triples
        word_state = np.where(word_count > 0, np.arange(1, n + 1), 0)
        pair_state = np.where(pair_count > 0, n + 1 + np.arange(len(word)), word_state[word])
        p_pair = (pair_count + PAIR * unigram[word]) / (word_count[context] + PAIR)
        p_triple = (triple_count + TRIPLE * p_pair[ends]) / (pair_count[pair] + TRIPLE)
        seen, seen3 = np.flatnonzero(pair_count), np.flatnonzero(triple_count)
        keys = np.concatenate((np.arange(len(unigram)), (context[seen] + 1) * n + word[seen], (n + 1 + pair[seen3]) * n + last[seen3]))
        by = np.argsort(keys)
        self.keys = keys[by]
        self.weight = np.log10(np.concatenate((unigram, p_pair[seen], p_triple[seen3])))[by]
        self.target = np.concatenate((word_state[: len(unigram)], pair_state[seen], pair_state[ends[seen3]]))[by]
        self.fail_to = np.concatenate((np.zeros(n + 1, dtype=np.int64), word_state[word]))
        self.fail_weight = np.log10(np.concatenate(([1.0], PAIR / (word_count + PAIR), TRIPLE / (pair_count + TRIPLE))))

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(new states, weights) of one word read in each of many states."""
        state, weight, todo = state.copy(), np.zeros(len(state)), np.arange(len(state))
        while len(todo):
            key = state[todo] * self.words + word[todo]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            weight[todo[hit]] += self.weight[at[hit]]
            state[todo[hit]] = self.target[at[hit]]
            todo = todo[~hit]
            weight[todo] += self.fail_weight[state[todo]]
            state[todo] = self.fail_to[state[todo]]
        return state, weight

    def traverse(self, ids: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Log probability of each text, read from the start's state.

        Long texts are read in lanes of ``LANE`` words side by side.  A lane other than a text's first reads the two words before it
        from the root: the state then is the one that a single pass has there, as states are what the last two words leave.
        """
        lanes = -(-lens // LANE)
        text = np.repeat(np.arange(len(lens)), lanes)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        low, high = starts[text] + nth * LANE, np.minimum(starts[text] + (nth + 1) * LANE, (starts + lens)[text])
        state = np.where(nth == 0, self.words, 0)  # the start is the last word
        for back in (2, 1):
            later = np.flatnonzero(nth > 0)
            state[later], _ = self.step(state[later], ids[low[later] - back])
        total = np.zeros(len(text))
        for k in range(int((high - low).max()) if len(text) else 0):
            on = np.flatnonzero(low + k < high)
            state[on], weight = self.step(state[on], ids[low[on] + k])
            total[on] += weight
        return np.bincount(text, weights=total, minlength=len(lens))


def score_block(p: Pairs, pairs: list[bytes], triples: list[bytes], tokens: int, types: int, train_docs: int) -> list[tuple]:
    text, count, pair_count = p.text, p.count, p.asked.counts(pairs)
    t = Triples(p, pair_count)
    unigram = (count + 0.5) / (tokens + 0.5 * (types + 1))
    machine = Automaton(unigram, np.append(count, train_docs), (p.context, p.word, pair_count), (t.pair, t.last, t.ends, t.asked.counts(triples)))
    scores = machine.traverse(text.ids, text.starts, text.lens)
    known = np.add.reduceat((count[text.ids] > 0).astype(np.int64), text.starts)
    base = np.add.reduceat(np.log10(unigram)[text.ids], text.starts)
    return list(zip(text.doc_ids, text.held_out.tolist(), text.lens.tolist(), known.tolist(), [tokens] * len(known), base.tolist(), scores.tolist(), strict=True))


def _rows(t, *names: str) -> Iterator[tuple]:
    return zip(*(t[n].to_pylist() for n in names), strict=True)


def _answers(t: pa.Table, part: int) -> list[bytes]:
    """A block's answers of one round, in the shards' order."""
    return [body for _, body in sorted((shard, body) for shard, body, p in _rows(t, "shard", "body", "part") if p == part)]


def score_corpus(docs: DataFrame) -> DataFrame:
    """Scores of all documents by the model of those whose crc32(doc_id) mod 5 is not 1.

    What a round leaves behind goes before the next one: files that later rounds don't read, and shuffled rows.
    """
    spark = docs.sparkSession
    home = shared_dir(spark)
    blocks = write_blocks(docs, f"{home}/blocks")
    tokens, train_docs = (x or 0 for x in blocks.agg(F.sum("n_tokens"), F.sum("train_docs")).first())
    shards = max(8, math.ceil(tokens / SHARD))

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, doc_ids, text, vocab in _rows(batch, "block", "doc_ids", "text", "vocab"):
                vocab = np.frombuffer(vocab, dtype=np.uint64)
                yield batch_of([(shard, block, body) for shard, body in words_asked(Text(doc_ids, text), vocab, shards).questions(vocab)], ASK)

    words = materialize(count_words(blocks.select("block", "doc_ids", "text", "vocab").mapInArrow(ask_words, ASK), shards), f"{home}/words")
    release(spark)
    tokens, types = (x or 0 for x in words.agg(F.sum("tokens"), F.sum("types")).first())

    def numbered(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for block, doc_ids, text, vocab in _rows(left, "block", "doc_ids", "text", "vocab"):
            vocab = np.frombuffer(vocab, dtype=np.uint64)
            found = np.zeros((2, len(vocab)), dtype=np.int64)
            found[:, words_asked(Text(doc_ids, text), vocab, shards).order] = np.concatenate([np.stack(unpacked(body)) for _, body in sorted(_rows(right, "shard", "body"))], axis=1)
            rows.append((block, doc_ids, text, packed(*found)))
        return batch_of(rows, TEXTS, True)

    answered = words.where("block is not null").select("block", "shard", "body")
    texts = materialize(blocks.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(numbered, TEXTS), f"{home}/texts")
    for old in ("blocks", "words"):
        remove(spark, f"{home}/{old}")
    release(spark)

    def pairs_of(t) -> Iterator[tuple[int, Pairs]]:
        for block, doc_ids, text, numbers in _rows(t, "block", "doc_ids", "text", "words"):
            yield block, Pairs(Text(doc_ids, text), numbers, shards, tokens)

    def ask_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, p in pairs_of(batch):
                yield batch_of([(shard, block, body) for shard, body in p.asked.questions(*p.key)], ASK)

    def ask_triples(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for block, p in pairs_of(left):
            t = Triples(p, p.asked.counts(_answers(right, 2)))
            rows += [(shard, block, body) for shard, body in t.asked.questions(*t.key)]
        return batch_of(rows, ASK, True)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = [row for _, p in pairs_of(left) for row in score_block(p, _answers(right, 2), _answers(right, 3), tokens, types, train_docs)]
        return batch_of(rows, SCORES, True)

    by_block = texts.groupBy("block")
    answers = materialize(count_grams(texts.mapInArrow(ask_pairs, ASK)), f"{home}/pairs").select("block", "shard", "body", F.lit(2).alias("part"))
    release(spark)
    triples = materialize(count_grams(by_block.cogroup(answers.groupBy("block")).applyInArrow(ask_triples, ASK)), f"{home}/triples")
    release(spark)
    answers = answers.unionByName(triples.select("block", "shard", "body", F.lit(3).alias("part")))
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(score, SCORES)
