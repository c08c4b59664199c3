"""Language-model scores from a log-bilinear neural model trained by noise-contrastive estimation.

The base is the smoothed unigram of the whole training fold: counts of all its words, gathered by a
shuffle. The neural model is factored by classes, whose number grows with the vocabulary: an end, the most
frequent words one by one (the root of the number of distinct words, `model_words` at least), and as many
classes as that root which share all other words by a hash. A context vector is the sum of position-wise
transformed embeddings of the classes of the last two tokens, and its product with each class's embedding plus
a bias is the class's score. Neighbouring classes form groups, as many as a group has classes, with embeddings
and biases of their own. A class's probability is that of its group, normalised over all groups, times its
own, normalised over the classes of the group; both are matrix products over many tokens at once, and a token
costs the root of the number of classes. A word that shares its class is then told apart by its smoothed share
of the class, whatever the context, so each text has a proper probability, whatever its words.

Training goes over every position of the training fold, in executors: in each of a few rounds every task steps
through its next share of texts, with noise classes and noise groups drawn from the unigram of all training
documents, and what the tasks learnt is averaged by a shuffle. The driver holds the parameters alone.
Counts of the `known_words` most frequent words - a fixed number, or the root of the number of distinct words
where that is more - are sent to the executors; all rarer words meet their counts in a shuffle join.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import byte_view, cut_words, durable, lean, modest, read, remainder

MODEL_WORDS, KNOWN_WORDS = 1000, 50_000
WIDTH, NOISE, ROUNDS, BATCH, SEED = 24, 64, 4, 2000, 7


def words(data: memoryview | bytes) -> list[bytes]:
    """Lower-cased (A-Z) words between white space bytes."""
    return bytes(data).lower().split()


def count_words(batches):
    """(word, n) of the task's texts, and (null, n) for their ends, counted for about 16 MB of texts at a time."""
    import pyarrow as pa

    def rows(held):
        lengths = np.concatenate([np.diff(offsets) for _, offsets in held])
        at, each, _ = cut_words(b"".join(raw for raw, _ in held).lower(), np.r_[0, np.cumsum(lengths)])
        n = np.r_[np.bincount(at, minlength=len(each)), len(lengths)]
        return pa.RecordBatch.from_arrays([pa.array([*each, None], pa.binary()), pa.array(n, pa.int64())], ["word", "n"])

    held, size = [], 0
    for batch in (b.slice(at, 500) for b in batches for at in range(0, len(b), 500)):
        data, offsets = byte_view(batch["text"])
        held.append((data.tobytes(), offsets))
        size += len(data)
        if size > 16 << 20:
            yield rows(held)
            held, size = [], 0
    if held:
        yield rows(held)


def most_frequent(table: DataFrame, most: int) -> list:
    """Rows (word, n) of the most frequent words, the largest counts first: all over some count, `most` rows at most.

    The count comes from sizes of classes of counts, so no task and no driver holds more than `most` words.
    """
    size = F.floor(F.log2("n") * 64).cast("int")
    sizes = sorted(((r["c"], r["k"]) for r in table.groupBy(size.alias("c")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    least, taken = None, 0
    for c, k in sizes:
        if taken + k > most:
            break
        least, taken = c, taken + k
    if least is None:
        return []
    return sorted(table.filter(size >= least).collect(), key=lambda r: (-r["n"], bytes(r["word"])))


def group_size(classes: int) -> int:
    """Classes of a group: the root of their number, so that there are about as many groups."""
    return math.isqrt(max(0, classes - 1)) + 1


def sums(gradient: np.ndarray, order: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The rows of gradient in this order, added up from each head to the next."""
    if gradient.shape[1] == 1:
        return np.add.reduceat(gradient[:, 0].take(order), heads)[:, None]  # a flat row of numbers is summed faster
    rows = gradient.take(order, axis=0)
    if rows.dtype == np.float32 and rows.shape[1] % 2 == 0:  # two columns at once
        return np.add.reduceat(rows.view(np.complex64), heads, axis=0).view(np.float32)
    return np.add.reduceat(rows, heads, axis=0)


class Net:
    """Parameters of the log-bilinear model and noise-contrastive steps on them.

    values: embeddings of classes as last token and as the token before (each times its position's transform),
    then embeddings and biases as target, of classes and after them of groups. A step is divided by the root of
    the row's mean squares so far (Adagrad, one sum for each row of each part). seen counts how often the steps
    met the rows of each part.
    """

    def __init__(self, frequency: np.ndarray, width: int, seed: int = SEED):
        self.v, self.size, self.width = len(frequency), group_size(len(frequency)), width
        q = (frequency + 0.5) / (frequency + 0.5).sum()
        of_groups = np.add.reduceat(q, np.arange(0, self.v, self.size))
        self.log_q = np.log(np.concatenate([q, of_groups])).astype(np.float32)
        self.cumulative = np.cumsum(q), np.cumsum(of_groups)
        rng, rows = np.random.default_rng(seed), (self.v, self.v, len(self.log_q))
        self.values = [*(rng.normal(0, 0.1, (n, width)).astype(np.float32) for n in rows), self.log_q[:, None].copy()]
        self.squares = [np.full(len(x), 1e-2, np.float32) for x in self.values]
        self.seen = [np.zeros(len(x), np.float32) for x in self.values]
        self.code = code_type(len(self.log_q))

    def step(self, rows: np.ndarray, *gradients: tuple[int, np.ndarray]) -> None:
        """Each (part, gradient of these rows), added up by row."""
        rows = rows.astype(self.code)  # narrow numbers are sorted by radix
        order = np.argsort(rows, kind="stable")
        rows = rows.take(order)
        heads = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        at, met = rows.take(heads).astype(np.int64), np.diff(np.r_[heads, len(rows)])
        for part, gradient in gradients:
            g = sums(gradient, order, heads)
            squares = self.squares[part].take(at) + np.einsum("nw,nw->n", g, g) / g.shape[1]
            self.seen[part][at] += met
            self.squares[part][at] = squares
            g *= (0.1 / np.sqrt(squares))[:, None]
            self.values[part][at] += g

    def contrast(self, r: np.ndarray, targets: np.ndarray, level: int, noise: int, rng: np.random.Generator) -> tuple:
        """Targets and noise of classes (level 0) or groups (1), gradients of their embeddings and biases, and that of r."""
        cumulative, base, n = self.cumulative[level], self.v * level, len(targets)
        drawn = np.minimum(np.searchsorted(cumulative, rng.random(noise)), len(cumulative) - 1)
        at = np.concatenate([targets, drawn]) + base
        e, shift = self.values[2].take(at, axis=0), self.values[3][:, 0].take(at) - self.log_q.take(at) - np.float32(np.log(noise))
        right = 1 / (1 + np.exp(np.clip(np.einsum("nw,nw->n", r, e[:n]) + shift[:n], -30, 30)))  # label minus the probability of being data
        wrong = r @ -e[n:].T
        wrong -= shift[n:]
        with np.errstate(over="ignore"):  # the share of an infinite one is 0
            np.exp(wrong, out=wrong)
        wrong += 1
        np.divide(-1, wrong, out=wrong)
        to_r = wrong @ e[n:]
        np.multiply(right[:, None], r, out=e[:n])
        np.matmul(wrong.T, r, out=e[n:])
        to_r += right[:, None] * self.values[2].take(at[:n], axis=0)
        return at, e, np.concatenate([right, wrong.sum(0)])[:, None], to_r

    def learn(self, contexts: np.ndarray, targets: np.ndarray, noise: int, rng: np.random.Generator) -> None:
        """A step on these positions, against `noise` classes and a third as many groups drawn from the unigram for all of them together."""
        r = self.values[0].take(contexts[:, 0], axis=0) + self.values[1].take(contexts[:, 1], axis=0)
        of_class, of_group = self.contrast(r, targets, 0, noise, rng), self.contrast(r, targets // self.size, 1, max(1, noise // 3), rng)
        g_r = of_class[3] + of_group[3]
        self.step(contexts[:, 0], (0, g_r))
        self.step(contexts[:, 1], (1, g_r))
        for at, to_embedding, to_bias, _ in (of_class, of_group):
            self.step(at, (2, to_embedding), (3, to_bias))

    def model(self) -> dict:
        target = np.concatenate(self.values[2:], axis=1)  # embedding, then bias
        return {"context": self.values[:2], "class": target[: self.v], "group": target[self.v :], "size": self.size}


def fit(contexts: np.ndarray, targets: np.ndarray, frequency: np.ndarray, width: int = WIDTH, noise: int = NOISE, epochs: int = 1, seed: int = SEED, batch: int = BATCH) -> dict:
    """The model of positions that are at hand: what fit_all() does in a single task.

    contexts: (n, 2) class numbers, the last one first; targets: (n,); frequency: of each class in all
    training texts, the noise distribution and the start of the biases.
    """
    net, rng = Net(frequency, width, seed), np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(targets))
        for start in range(0, len(order), batch):
            pick = order[start : start + batch]
            net.learn(contexts[pick], targets[pick], noise, rng)
    return net.model()


def fit_all(encoded: DataFrame, frequency: np.ndarray, total: int, width: int = WIDTH, noise: int = NOISE, rounds: int = ROUNDS, seed: int = SEED) -> tuple[dict, int]:
    """(model, positions learnt from) by `rounds` rounds over all training positions; the driver holds parameters alone.

    encoded: (c, turn) the class numbers of each training text as bytes of code_type(), and the round that
    takes it (0 to rounds - 1). In a round each task starts from the shared parameters and takes each position
    of the round's texts once. Then each part of a row becomes the mean of what the tasks made of it, weighted
    by how often they met it; the sums go by row through a shuffle.
    """
    spark = encoded.sparkSession
    net, code = Net(frequency, width, seed), code_type(len(frequency))
    v, rows = len(frequency), len(net.log_q)
    batch_size = max(100, min(BATCH, total // 2000))  # small inputs take smaller steps, so that they take enough of them
    firsts = np.cumsum([0, v, v, rows])  # the rows of all parts are numbered in a row

    def train(shared, turn):
        def part(batches):
            import pyarrow as pa

            mine = Net(frequency, width, seed)
            mine.values, mine.squares = ([x.copy() for x in y] for y in shared.value)
            rng, held, n, positions = None, [], 0, 0

            def flush():
                nonlocal rng, held, n
                c, t = (np.concatenate(x) for x in zip(*held, strict=True))
                rng = rng or np.random.default_rng([seed, turn, len(t), int(t.sum())])
                order = rng.permutation(len(t))
                for start in range(0, len(order), batch_size):
                    pick = order[start : start + batch_size]
                    mine.learn(c.take(pick, axis=0), t.take(pick), noise, rng)
                held, n = [], 0

            for batch in batches:
                for raw in batch["c"].to_pylist():
                    classes = np.frombuffer(raw, code).astype(np.int64)
                    held.append((contexts_of(classes), classes))
                    n, positions = n + len(classes), positions + len(classes)
                    if n >= 100_000:
                        flush()
            if held:
                flush()
            if positions:
                yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([np.array([positions], np.float64).tobytes()], pa.binary())], ["row", "data"])
            for values, squares, seen, first in zip(mine.values, mine.squares, mine.seen, firsts.tolist(), strict=True):
                met = np.flatnonzero(seen)
                w = seen[met, None]
                data = np.concatenate([values[met] * w, squares[met, None] * w, w], axis=1).astype(np.float64)
                for at in range(0, len(met), 4000):
                    some = slice(at, at + 4000)
                    yield pa.RecordBatch.from_arrays([pa.array(met[some] + first, pa.int32()), pa.array([x.tobytes() for x in data[some]], pa.binary())], ["row", "data"])

        return part

    def add(batches):
        import pyarrow as pa

        sums: dict = {}
        for batch in batches:
            for row, raw in zip(batch["row"].to_pylist(), batch["data"].to_pylist(), strict=True):
                x = np.frombuffer(raw)
                sums[row] = sums[row] + x if row in sums else x
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["row", "data"])

    positions = 0
    for turn in range(rounds if total else 0):
        shared = spark.sparkContext.broadcast((net.values, net.squares))
        made = encoded.filter(F.col("turn") == turn).select("c").mapInArrow(lean(train(shared, turn)), "row int, data binary")
        for r in made.repartition("row").mapInArrow(lean(add), "row int, data binary").collect():  # the parameters
            x = np.frombuffer(r["data"])
            if r["row"] < 0:
                positions += int(x[0])
            else:
                part = int(np.searchsorted(firsts, r["row"], "right")) - 1
                at = r["row"] - firsts[part]
                net.values[part][at], net.squares[part][at] = x[:-2] / x[-1], x[-2] / x[-1]
        shared.destroy()
    return net.model(), positions


def log_softmax(scores: np.ndarray, at: np.ndarray, reach: float = math.inf) -> np.ndarray:
    """log of the softmax of each row at one place of it; scores is overwritten. reach: no score is further from 0, if that is known."""
    picked = scores.take(np.arange(len(at)) * scores.shape[1] + at)
    if scores.size and reach > 60 and (scores.max() > 60 or scores.min() < -60):  # else no row's sum can overflow or vanish
        most = scores.max(1)
        scores -= most[:, None]
        picked -= most
    return picked - np.log(np.exp(scores, out=scores) @ np.ones(scores.shape[1], scores.dtype))


def furthest(r: np.ndarray, target: np.ndarray) -> float:
    """A bound of the scores of contexts r (a 1 last) and targets (the bias last), by the lengths of both."""
    longest = [math.sqrt(np.einsum("nw,nw->n", x[:, :-1], x[:, :-1]).max(initial=0.0)) for x in (r, target)]
    return longest[0] * longest[1] + float(np.abs(target[:, -1]).max(initial=0.0))


def log_probabilities(model: dict, contexts: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log-probability of each target class after its context (last token, token before), by matrix products."""
    a, b = model["context"]
    size, width = model["size"], a.shape[1]
    out = np.empty(len(targets), np.float32)
    for at in range(0, len(targets), 65536):  # so many tokens at once
        c, t = contexts[at : at + 65536], targets[at : at + 65536]
        order = np.argsort(t.astype(code_type(len(a))), kind="stable")  # narrow numbers are sorted by radix
        t, c = t.take(order), c.take(order, axis=0)
        r = np.ones((len(t), width + 1), np.float32)
        np.add(a.take(c[:, 0], axis=0), b.take(c[:, 1], axis=0), out=r[:, :width])
        group = t // size
        logs = np.empty(len(t), np.float32)
        reach = furthest(r, model["group"]), furthest(r, model["class"])
        for begin in range(0, len(t), 4096):
            some = slice(begin, begin + 4096)
            logs[some] = log_softmax(r[some] @ model["group"].T, group[some], reach[0])
        heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]).tolist() if len(t) else []
        for begin, end in zip(heads, [*heads[1:], len(t)], strict=True):
            first = int(group[begin]) * size
            own = model["class"][first : first + size]
            for k in range(begin, end, 4096):
                some = slice(k, min(end, k + 4096))
                logs[some] += log_softmax(r[some] @ own.T, t[some] - first, reach[1])
        out[at : at + 65536][order] = logs
    return out


def code_type(classes: int) -> np.dtype:
    """The narrowest type that holds the class numbers."""
    return np.dtype(np.uint16 if classes <= 1 << 16 else np.int32)


class Scorer:
    """Token numbers: 0 a text's end (and what is before its start), 1 a word without a number, then the known words.

    Classes: 0 the end, 2 to model_words + 1 the most frequent words, 1 and those over model_words + 1 the shared classes.
    """

    def __init__(self, known: list[bytes], counts: np.ndarray, model_words: int, shared: int):
        self.model_words, self.shared = min(model_words, len(known)), shared
        self.index: dict = {w: i + 2 for i, w in enumerate(known)}
        self.index[None] = 0
        self.counts = counts
        self.of = np.arange(len(known) + 2)
        self.of[self.model_words + 2 :] = self.shared_classes(known[self.model_words :])

    def shared_classes(self, words: list[bytes]) -> np.ndarray:
        """The shared class of each word, by its hash."""
        k = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % self.shared
        return np.where(k > 0, self.model_words + 1 + k, 1)

    def class_of(self, word: bytes) -> int:
        return int(self.shared_classes([word])[0])

    def class_at(self, k: int) -> int:
        return self.model_words + 1 + k if k else 1

    def numbers(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Token numbers and classes of all texts in a row, each text's number of tokens, and the words without a number in order."""
        at, each, counts = cut_words(b"".join(texts).lower(), np.cumsum([0, *map(len, texts)]))
        sizes = counts + 1
        number = np.fromiter(map(self.index.get, each, itertools.repeat(1)), np.int64, len(each))  # looked up once a call
        of, unknown = self.of[number], np.flatnonzero(number == 1)
        of[unknown] = self.shared_classes([each[k] for k in unknown.tolist()])
        is_word = np.ones(len(at) + len(texts), bool)
        is_word[np.cumsum(sizes) - 1] = False
        numbers, classes = np.zeros(len(is_word), np.int64), np.zeros(len(is_word), np.int64)
        numbers[is_word], classes[is_word] = number[at], of[at]
        return numbers, classes, sizes, [each[k] for k in at[number[at] == 1].tolist()]


def contexts_of(classes: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
    """The classes of the last token and the one before for each token of a text, or of texts of these sizes in a row."""
    padded = np.concatenate([[0, 0], classes])
    out = np.stack([padded[1:-1], padded[:-2]], axis=1)
    if sizes is not None:  # a text's first token follows two ends, its second the first token and an end
        starts = np.cumsum(sizes) - sizes
        out[starts] = 0
        out[starts[sizes > 1] + 1, 1] = 0
    return out


def texts_of(batch) -> list[bytes]:
    data, offsets = byte_view(batch["text"])
    raw, ends = data.tobytes(), offsets.tolist()
    return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def score_texts(docs: DataFrame, training: DataFrame, key: str = "doc_id", model_words: int = MODEL_WORDS, known_words: int = KNOWN_WORDS, neural: bool = True) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of each row of docs (columns key, text).

    training: (key, text) of the training fold. Null texts count as empty: one token, the end. Rows that repeat
    a key are scored one by one, and come out as often as they went in. With an empty training fold every
    token is unknown and the model knows its end alone. Without `neural` no model is trained and score is left
    out; the other columns come from the same counts and the same pass.
    """
    spark = docs.sparkSession
    modest(spark)
    table = durable(training.select("text").mapInArrow(lean(count_words), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    whole = table.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct")).first()
    total, distinct = whole["total"] or 0, whole["distinct"] or 0
    ends = (table.filter(F.col("word").isNull()).agg(F.sum("n")).first()[0]) or 0
    distinct -= ends == 0 and distinct > 0
    word_count = max(0, distinct - (ends > 0))
    root = math.isqrt(word_count)
    frequent = most_frequent(table.filter(F.col("word").isNotNull()), max(known_words, root))
    facts = [bytes(r["word"]) for r in frequent], np.array([ends, 0, *[r["n"] for r in frequent]], np.int64), max(model_words, root), root + 1
    scorer = Scorer(*facts)
    m = scorer.model_words
    frequency, sharing = np.zeros(m + 2 + root), np.zeros(m + 2 + root)  # tokens and distinct words of each class
    bucket = F.crc32("word") % F.lit(scorer.shared)
    for r in table.filter(F.col("word").isNotNull()).groupBy(bucket.alias("k")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect():
        frequency[scorer.class_at(r["k"])], sharing[scorer.class_at(r["k"])] = r["n"], r["words"]
    own = scorer.shared_classes(facts[0][:m])  # these have classes of their own
    np.subtract.at(frequency, own, scorer.counts[2 : m + 2])
    np.subtract.at(sharing, own, 1)
    frequency[0], frequency[2 : m + 2] = ends, scorer.counts[2 : m + 2]
    log_share = np.log10(frequency + 0.5 * (sharing + 1))

    shared = spark.sparkContext.broadcast(facts)

    code = code_type(len(frequency))

    def encode(batches):
        import pyarrow as pa

        s, done = Scorer(*shared.value), 0
        for batch in (b.slice(at, 500) for b in batches for at in range(0, len(b), 500)):
            _, classes, sizes, _ = s.numbers(texts_of(batch))
            raw, ends = classes.astype(code).tobytes(), (np.cumsum(sizes) * code.itemsize).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], pa.binary()), pa.array((done + np.arange(len(batch))) % ROUNDS, pa.int32())], ["c", "turn"])
            done += len(batch)

    if neural:
        encoded = durable(training.select("text").mapInArrow(lean(encode), "c binary, turn int"))
        shared_model = spark.sparkContext.broadcast(fit_all(encoded, frequency, total)[0])
    denominator = total + 0.5 * (distinct + 1)

    def part(batches):
        import pyarrow as pa

        s, net = Scorer(*shared.value), shared_model.value if neural else None
        log_base = np.log10((s.counts + 0.5) / denominator)
        log_rare = np.log10(s.counts + 0.5) - log_share[s.of]
        log_rare[: m + 2] = 0.0
        log_base[1] = log_rare[1] = 0.0  # words without a number get theirs after the join
        have = s.counts > 0
        have[1] = False
        names = ["_row", "key", "n_tokens", "n_known", "base", "model", "word", "tf"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int64()]
        for batch in (b.slice(at, 500) for b in batches for at in range(0, len(b), 500)):
            numbers, classes, sizes, others = s.numbers(texts_of(batch))
            starts = np.cumsum(sizes) - sizes
            logs = log_probabilities(net, contexts_of(classes, sizes), classes) / np.log(10) + log_rare[numbers] if neural else np.zeros(len(numbers))
            each = lambda x, starts=starts: np.add.reduceat(x, starts)
            main = [batch["_row"], batch["key"], pa.array(sizes), pa.array(each(have[numbers].astype(np.int64))), pa.array(each(log_base[numbers])), pa.array(each(logs.astype(np.float64)))]
            yield pa.RecordBatch.from_arrays([*main, *(pa.nulls(len(batch), k) for k in kinds[6:7]), pa.array(np.zeros(len(batch), np.int64))], names)
            lacking, at, rows = each((numbers == 1).astype(np.int64)).tolist(), 0, batch["_row"].to_numpy()
            met, many, tf = [], [], []
            for n in lacking:
                counts = Counter(others[at : at + n])
                met += counts
                tf += counts.values()
                many.append(len(counts))
                at += n
            if met:
                n, zero = np.array(tf, np.int64), np.zeros(len(tf), np.int64)
                spare = [np.repeat(rows, many), pa.nulls(len(tf), kinds[1]), zero, zero, zero.astype(float), -n * log_share[s.shared_classes(met)], met, n]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(spare, kinds, strict=True)], names)

    source = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).cast("long").alias("key"), "text")
    out = source.mapInArrow(lean(part), "_row long, key long, n_tokens long, n_known long, base double, model double, word binary, tf long")
    # a row without a word gets a key of its own, else all of them would meet in one task
    lone = F.concat(F.lit(" "), F.col("_row").cast("string")).cast("binary")
    rare = table.filter(F.col("word").isNotNull()).select(F.col("word").alias("_key"), F.col("n").alias("_n"))
    joined = out.withColumn("_key", F.coalesce("word", lone)).join(rare, "_key", "left")
    count = F.coalesce("_n", F.lit(0)).cast("double")
    is_word, tf = F.col("word").isNotNull(), F.col("tf")
    joined = joined.select(
        "_row", "key", "n_tokens",
        F.when(is_word & (count > 0), tf).otherwise(F.col("n_known")).alias("n_known"),
        F.when(is_word, tf * F.log10((count + 0.5) / F.lit(denominator))).otherwise(F.col("base")).alias("base"),
        F.when(is_word, F.col("model") + tf * F.log10(count + 0.5)).otherwise(F.col("model")).alias("model"),
    )
    scored = joined.groupBy("_row").agg(
        F.max("key").alias(key), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        F.sum("base").alias("base_score"), F.sum("model").alias("score"),
    ).drop("_row")
    return scored if neural else scored.drop("score")


def fold_scores(spark: SparkSession, sf_dir: str, neural: bool = True) -> DataFrame:
    """All `documents` scored by what the fold crc32(doc_id as text) mod 5 <> 1 teaches (a null id: not used)."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scores = score_texts(docs, docs.filter(remainder("doc_id", 5) != 1), neural=neural)
    return scores.withColumn("held_out", F.coalesce(remainder("doc_id", 5) == 1, F.lit(False)))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_scores(spark, sf_dir)
