"""Text probability by a unigram model over all segmentations into subwords.

Vocabulary: the pieces of an existing subword model, as bytes, and each single byte,
so that every word has a segmentation.  The vocabulary's own scores (higher: earlier
rank) give the first piece probabilities; expectation steps over all distinct
training words re-estimate them.  The weight of a word's segmentations is summed by
the forward recursion in log space, run over many words of one length at once.

A word that the training texts hold c times is a segment of its own too, of weight
(c - d) / N; all its other segmentations share the weight d V / N that this takes
from the V known words (absolute discounting), so that the probabilities of all words
and of the end mark sum to one.  A text's probability is the product over its words
and an end mark.

Base score: sum over tokens (words and one end) of log10((c + 1) / (N + V + 1)).  The
counts of the most frequent words go to all tasks, a list of bounded size; those of
all other words are joined, so no hot word is shuffled.

Null text: empty, which has the end token alone.  Rows without a key are learnt from.
Repeated keys give a row each and are learnt from each time.  Without training rows N
and V are 0, all pieces keep their first probabilities, and a text ends after each
word with probability one half.  An empty table gives no
rows.  Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from rarelane.llm.tables import keyed_text, text_batches
from rarelane.session import stage_table

#: Most frequent words that every task holds, and the length in bytes they may have.
HEAD, HEAD_BYTES = 100_000, 64
#: Expectation steps, what each piece is counted beside its expectation, and d.
STEPS, EXTRA, DISCOUNT = 1, 0.1, 0.75
#: Words scored together, and words a task remembers.
TOGETHER, MEMO = 1 << 14, 400_000

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_LOG10 = float(np.log(10))


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Distinct pieces as bytes, a leading space for a word's beginning, and their first log probabilities."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ranks: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            ranks.setdefault(bytes([int(model.id_to_piece(i)[1:-1], 16)]), float(model.get_piece_size()))
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            piece = model.id_to_piece(i).replace("▁", " ")
            if " " not in piece[1:]:
                ranks[piece.encode()] = min(float(model.get_piece_size()), -model.get_score(i))
    for byte in range(256):
        ranks.setdefault(bytes([byte]), float(model.get_piece_size()))
    weight = 1.0 / (np.array(list(ranks.values())) + 10.0)
    return list(ranks), np.log(weight / weight.sum())


def words_of(text: str) -> list[bytes]:
    """Words between white space, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


class Lattice:
    """Forward and backward recursions over words of bytes."""

    def __init__(self, pieces: list[bytes], logs: np.ndarray):
        self.longest = max(map(len, pieces))
        self.logs = np.append(logs, -np.inf)
        self.powers = np.array([pow(int(_BASE), i, 1 << 64) for i in range(self.longest + 1)], U64)
        hashes = np.zeros(len(pieces), U64)
        for i, piece in enumerate(pieces):
            value = 0
            for byte in piece:
                value = (value * int(_BASE) + byte + 1) & 0xFFFFFFFFFFFFFFFF
            hashes[i] = value
        # a piece lies in the first table where its slot is free; later tables hold the few left over
        self.tables = []
        left, draw = np.arange(len(pieces)), np.random.default_rng(5)
        while len(left):
            factor = U64(int(draw.integers(1 << 63)) * 2 + 1)
            shift = U64(64 - max(10, (32 * len(left)).bit_length()))
            found, first = np.unique((hashes[left] * factor) >> shift, return_index=True)
            table = np.full(1 << int(U64(64) - shift), len(pieces), np.int32)
            table[found] = left[first]
            self.tables.append((factor, shift, table))
            left = np.delete(left, first)
        self.hashes = np.append(hashes, U64(0))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of pieces; the place behind the last for what is none."""
        out = np.full(len(hashes), len(self.hashes) - 1, np.int32)
        for factor, shift, table in self.tables:
            at = table[(hashes * factor) >> shift]
            np.copyto(out, at, where=self.hashes[at] == hashes)
        return out

    def edges(self, rows: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """Piece places of rows[:, i:j] for each stretch that is a piece in some row."""
        count, size = rows.shape
        sums = np.zeros((size + 1, count), U64)
        for i in range(size):
            sums[i + 1] = sums[i] * _BASE + rows[:, i] + U64(1)
        out = {}
        for j in range(1, size + 1):
            for i in range(max(0, j - self.longest), j):
                at = self.find(sums[j] - sums[i] * self.powers[j - i])
                if (at < len(self.hashes) - 1).any():
                    out[i, j] = at
        return out

    def forward(self, rows: np.ndarray, edges: dict) -> np.ndarray:
        alpha = np.full((rows.shape[1] + 1, len(rows)), -np.inf)
        alpha[0] = 0.0
        into: dict[int, list[int]] = {}
        for i, j in edges:
            into.setdefault(j, []).append(i)
        for j, begins in sorted(into.items()):
            ways = np.stack([alpha[i] + self.logs[edges[i, j]] for i in begins])
            top = ways.max(axis=0)
            alpha[j] = top + np.log(np.exp(ways - top).sum(axis=0))
        return alpha

    def backward(self, rows: np.ndarray, edges: dict) -> np.ndarray:
        size = rows.shape[1]
        beta = np.full((size + 1, len(rows)), -np.inf)
        beta[size] = 0.0
        out_of: dict[int, list[int]] = {}
        for i, j in edges:
            out_of.setdefault(i, []).append(j)
        for i, ends in sorted(out_of.items(), reverse=True):
            ways = np.stack([beta[j] + self.logs[edges[i, j]] for j in ends])
            top = ways.max(axis=0)
            beta[i] = top + np.log(np.exp(ways - top).sum(axis=0))
        return beta

    def scores(self, words: list[bytes]) -> np.ndarray:
        """Log10 probability of each word, led by a space."""
        out = np.empty(len(words))
        for places, rows in _by_length(words):
            out[places] = self.forward(rows, self.edges(rows))[-1]
        return out / _LOG10

    def expect(self, words: list[bytes]) -> np.ndarray:
        """Expected uses of each piece in the words, each taken once."""
        total = np.zeros(len(self.hashes))
        for _, rows in _by_length(words):
            edges = self.edges(rows)
            alpha, beta = self.forward(rows, edges), self.backward(rows, edges)
            for (i, j), at in edges.items():
                share = np.exp(alpha[i] + self.logs[at] + beta[j] - alpha[-1])
                total += np.bincount(at, share, minlength=len(total))
        return total[:-1]


def _by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, bytes) of words of one length, led by a space, in bounded lots."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    begin = 0
    while begin < len(order):
        size = int(sizes[order[begin]])
        lot = max(1, min(TOGETHER, (1 << 20) // (size + 1)))
        end = min(begin + lot, int(np.searchsorted(sizes[order], size, "right")))
        places = order[begin:end]
        data = b"".join([b" " + words[i] for i in places.tolist()])
        yield places, np.frombuffer(data, np.uint8).reshape(len(places), size + 1)
        begin = end


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is not learnt from: the checksum of its key leaves 2 when divided by 7."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` (binary), ``n`` over all texts of ``docs`` (doc_id, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for _, texts in text_batches(batches):
            for text in texts:
                found.update(words_of(text))
            if len(found) > MEMO:
                yield _counted(found)
                found = Counter()
        if found:
            yield _counted(found)

    return docs.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(found: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "word": pa.array(found.keys(), pa.binary()), "n": pa.array(found.values(), pa.int64())
    })


def learn_pieces(words: DataFrame, pieces: list[bytes], logs: np.ndarray) -> np.ndarray:
    """Log probabilities of the pieces, by expectation steps over all distinct words."""
    context = words.sparkSession.sparkContext
    for _ in range(STEPS):
        sent = context.broadcast((pieces, logs))

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            lattice, total = Lattice(*sent.value), np.zeros(len(sent.value[0]))
            for batch in batches:
                total += lattice.expect(batch.column("word").to_pylist())
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({
                "piece": pa.array(used, pa.int32()), "uses": pa.array(total[used], pa.float64())
            })

        summed = words.select("word").mapInArrow(expect, "piece int, uses double")
        uses = np.full(len(pieces), EXTRA)
        for row in summed.groupBy("piece").agg(F.sum("uses").alias("uses")).collect():  # one row a piece at most
            uses[row["piece"]] += row["uses"]
        if uses.sum() > EXTRA * len(uses) * 1.001:
            logs = np.log(uses / uses.sum())
        sent.unpersist()
    return logs


def _head(counts: DataFrame) -> dict[bytes, int]:
    """The most frequent words, at most ``HEAD``: all from some count upwards, found by a histogram."""
    size = F.floor(F.log2("n") * 8).alias("size")
    sizes = sorted(counts.groupBy(size).count().collect(), reverse=True)  # a few hundred rows at most
    total, least = 0, None
    for row in sizes:
        total += row["count"]
        if total > HEAD:
            break
        least = row["size"]
    if least is None:
        return {}
    return {bytes(r["word"]): r["n"] for r in counts.where(F.floor(F.log2("n") * 8) >= least).collect()}


def text_scores(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each row.

    ``model``: path of the subword model whose vocabulary is used.
    """
    rows = keyed_text(docs)
    training = rows.where(~held_out())
    counts = stage_table(word_counts(training), "words")
    texts = training.count()
    row = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tokens, kinds = row["n"] + texts, row["v"] + bool(texts)
    floor = float(np.log10(tokens + kinds + 1))
    known = _head(counts.where(F.length("word") <= HEAD_BYTES))
    pieces, logs = vocabulary(model)
    logs = learn_pieces(counts, pieces, logs)
    end = float(np.log10(texts / tokens)) if tokens else float(np.log10(0.5))
    share = DISCOUNT * row["v"] / tokens if row["v"] else 0.5 if not tokens else EXTRA / tokens
    share = float(np.log10(share))
    sent = counts.sparkSession.sparkContext.broadcast((pieces, logs, known))
    names = (
        "row long, doc_id long, n_tokens long, n_known long, logs double, score double, "
        "rare array<struct<word:binary,times:long,log:double>>"
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, logs, known = sent.value
        lattice = Lattice(pieces, logs)
        memo: dict[bytes, tuple[float | None, float]] = {}

        def learn(words: list[bytes]) -> Iterator[tuple]:
            """A head word's log of its count plus one (none for others), and its score without further counts."""
            for word, log in zip(words, (lattice.scores(words) + share).tolist()):
                n = known.get(word)
                yield word, (None, log) if n is None else (
                    float(np.log10(n + 1)), float(np.log10((n - DISCOUNT) / tokens + 10.0**log))
                )

        at = TaskContext.get().partitionId() << 33
        for keys, texts_now in text_batches(batches):
            found = [Counter(words_of(t)) for t in texts_now]
            used = set().union(*found)
            missing = list(used - memo.keys())
            if len(memo) + len(missing) > MEMO:
                memo = {w: memo[w] for w in used if w in memo}
            memo.update(learn(missing))
            columns = [[] for _ in range(7)]
            for key, own in zip(keys, found):
                rare, known_times, base, value = [], 0, 0.0, end
                for word, times in own.items():
                    log, single = memo[word]
                    value += times * single
                    if log is None:
                        rare.append((word, times, single))
                    else:
                        base += times * log
                        known_times += times
                for column, x in zip(columns, (at, key, own.total() + 1, known_times, base, value, rare)):
                    column.append(x)
                at += 1
            yield _scored(columns)

    scored = stage_table(rows.mapInArrow(score, names), "scored")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times", "r.log")
    whole = F.log10((F.col("n") - DISCOUNT) / F.lit(float(max(1, tokens))) + F.pow(F.lit(10.0), "log"))
    joined = rare.join(counts, "word").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare_logs"), F.sum("times").alias("rare_known"),
        F.sum(F.col("times") * (whole - F.col("log"))).alias("rare_score"),
    )
    zero = F.lit(0)
    ended = F.lit(float(np.log10(texts + 1)))
    return scored.drop("rare").join(joined, "row", "left").select(
        "doc_id", held_out().alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", zero) + F.lit(int(texts > 0))).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("rare_logs", zero) + ended - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", zero)).alias("score"),
    )


def _scored(columns: list[list]) -> pa.RecordBatch:
    *plain, rare = columns
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rare])])
    flat = [x for r in rare for x in r]
    words, times, logs = zip(*flat) if flat else ((), (), ())
    struct = pa.StructArray.from_arrays(
        [pa.array(words, pa.binary()), pa.array(times, pa.int64()), pa.array(logs, pa.float64())],
        ["word", "times", "log"],
    )
    kinds = [pa.int64()] * 4 + [pa.float64()] * 2
    return pa.RecordBatch.from_arrays(
        [*(pa.array(c, k) for c, k in zip(plain, kinds)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)],
        ["row", "doc_id", "n_tokens", "n_known", "logs", "score", "rare"],
    )
