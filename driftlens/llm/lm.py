"""LM scoring by a log-bilinear neural model, trained in numpy by noise-contrastive estimation.

The model predicts a token in two steps. Classes are the most frequent words, one
class each, buckets of all other words by their endings, and the end of a text;
within a bucket the members are its fairly frequent words, and the rest as one.
A score is the inner product of a vector of the class, or the member, and a sum of
the context words' vectors, each scaled by weights of its place, plus a bias.
Batched matrix products over all classes, then over a bucket's members, give
normalised log-probabilities; within the rest of a bucket a word has its add-one
share of the training counts, so that probabilities of words add up to one as
well. How many words have vectors of their own follows the training texts: all
that occur ``least_own`` times, at most ``most_own``.

Counts cover all training texts: combined on the map side, then summed by word.
Texts are then turned into codes once and written, two bytes a token. Training
passes over those of all training texts, in two rounds on disjoint halves: every
task starts from the shared model, and the task models, a row each, are averaged
by tokens in a tree of sums. So the score depends, in its third digit or so, on
how the texts are dealt to tasks; the counts and the base score don't. The counts
of the most frequent words (at most ``most_words`` of at most ``LONGEST`` bytes)
are broadcast; other words meet their counts in a join.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

END = b""
WORDS, BUCKETS, DIM, CONTEXT = 127, 64, 32, 3
UNITS = WORDS + BUCKETS + 1
LONGEST = 64


def bucket(word: bytes) -> int:
    """The class of a word without one of its own."""
    return WORDS + zlib.crc32(word[-3:]) % BUCKETS


@dataclass
class Members:
    """The words within buckets. A code is a class (a bucket then stands for its rest), or UNITS + k for the k-th own word."""

    unit: np.ndarray  # the class of each code
    member: np.ndarray  # the member of each code, -1 for classes of one word
    begin: np.ndarray  # of each class's members
    end: np.ndarray
    mass: np.ndarray  # of each member, at least one

    @staticmethod
    def of(own_bucket: np.ndarray, own_mass: np.ndarray, rest_mass: np.ndarray) -> Members:
        n = len(own_bucket)
        unit, member = np.concatenate([np.arange(UNITS), own_bucket]).astype(np.int64), np.full(UNITS + n, -1, np.int64)
        begin, end, mass = np.zeros(UNITS, np.int64), np.zeros(UNITS, np.int64), []
        for b in range(WORDS, WORDS + BUCKETS):
            mine = np.flatnonzero(own_bucket == b)
            begin[b] = len(mass)
            member[UNITS + mine] = len(mass) + np.arange(len(mine))
            member[b] = len(mass) + len(mine)
            mass += [*own_mass[mine].tolist(), float(rest_mass[b])]
            end[b] = len(mass)
        return Members(unit, member, begin, end, np.maximum(1.0, np.array(mass)))

    @property
    def log_share(self) -> np.ndarray:
        """Of each member within its bucket."""
        total = np.concatenate([np.full(self.end[b] - self.begin[b], self.mass[self.begin[b] : self.end[b]].sum()) for b in range(WORDS, WORDS + BUCKETS)])
        return np.log(self.mass / total).astype(np.float32)


@dataclass
class Vocabulary:
    """Totals, the frequent words, and the classes' and buckets' sizes."""

    tokens: int
    distinct: int
    index: dict[bytes, int]  # frequent words, and the end of a text at place 0
    counts: np.ndarray
    codes: np.ndarray
    inside: np.ndarray  # log10 of the denominator within each bucket's rest, 0 for other classes
    unigram: np.ndarray  # of classes
    members: Members

    def places(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Places in the index (-1 for rare words), codes, and the rare words in order."""
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        codes, rare_at = self.codes[at], np.flatnonzero(at < 0)
        rare = [words[k] for k in rare_at.tolist()]
        codes[rare_at] = [bucket(w) for w in rare]
        return at, codes, rare


@dataclass
class Model:
    members: Members
    out: np.ndarray  # UNITS x DIM
    bias: np.ndarray
    into: np.ndarray  # a row for each code, and one for what comes before the text
    place: np.ndarray  # CONTEXT x DIM
    own: np.ndarray  # members x DIM
    own_bias: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [self.out, self.bias, self.into, self.place, self.own, self.own_bias]

    def packed(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()]).astype(np.float32)

    @staticmethod
    def unpacked(flat: np.ndarray, members: Members) -> Model:
        codes, n = len(members.unit), len(members.mass)
        shapes, out, at = [(UNITS, DIM), (UNITS,), (codes + 1, DIM), (CONTEXT, DIM), (n, DIM), (n,)], [], 0
        for s in shapes:
            size = int(np.prod(s))
            out.append(flat[at : at + size].reshape(s).astype(np.float32))
            at += size
        return Model(members, *out)

    @staticmethod
    def fresh(unigram: np.ndarray, members: Members, seed: int = 3) -> Model:
        r = np.random.default_rng(seed)
        normal = lambda *s: (r.standard_normal(s) * 0.1).astype(np.float32)
        codes, n = len(members.unit), len(members.mass)
        return Model(members, normal(UNITS, DIM), np.log(unigram).astype(np.float32), normal(codes + 1, DIM), np.ones((CONTEXT, DIM), np.float32), np.zeros((n, DIM), np.float32), members.log_share.copy())

    def hidden(self, context: np.ndarray, batch: int = 4096) -> np.ndarray:
        placed = [self.into * self.place[k] for k in range(CONTEXT)]
        q = np.empty((len(context), DIM), np.float32)
        for lo in range(0, len(context), batch):
            part, at = q[lo : lo + batch], context[lo : lo + batch]
            np.take(placed[0], at[:, 0], 0, part, "clip")
            for k in range(1, CONTEXT):
                part += placed[k].take(at[:, k], 0)
        return q

    @staticmethod
    def _turned(vectors: np.ndarray, bias: np.ndarray, longest: float) -> tuple[np.ndarray, bool]:
        """Vectors as columns with the bias below, of which the highest becomes zero; and whether a score may be over 80."""
        most = longest * np.einsum("ij,ij->i", vectors, vectors).max(initial=0)
        return np.vstack([vectors.T, bias - bias.max()]), bool(not most < 80**2)

    def log_probabilities(self, context: np.ndarray, target: np.ndarray, batch: int = 1024) -> np.ndarray:
        """Natural logs of codes, normalised over all classes and within them."""
        out, unit = np.empty(len(target)), self.members.unit[target]
        q = np.ones((len(target), DIM + 1), np.float32)  # the last column meets the bias
        q[:, :DIM] = self.hidden(context)
        longest = np.einsum("ij,ij->i", q, q).max(initial=0)
        turned, high = self._turned(self.out, self.bias, longest)
        ones, scores = np.ones(UNITS, np.float32), np.empty((batch, UNITS), np.float32)
        for lo in range(0, len(target), batch):
            part = q[lo : lo + batch]
            s = np.matmul(part, turned, out=scores[: len(part)])
            if high:
                np.minimum(s, 80, out=s)  # exp stays finite
            own = s[np.arange(len(s)), unit[lo : lo + batch]]
            np.exp(s, out=s)
            out[lo : lo + batch] = own - np.log(np.maximum(s @ ones, 1e-30))
        member = self.members.member[target]
        inside = np.flatnonzero(member >= 0)
        inside = inside[np.argsort(unit[inside].astype(np.uint16), kind="stable")]
        cuts = np.searchsorted(unit[inside], np.arange(WORDS, UNITS))
        for b, lo, hi in zip(range(WORDS, WORDS + BUCKETS), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if lo < hi and self.members.end[b] - self.members.begin[b] > 1:
                rows, first, last = inside[lo:hi], self.members.begin[b], self.members.end[b]
                turned, high = self._turned(self.own[first:last], self.own_bias[first:last], longest)
                s = q.take(rows, 0) @ turned
                if high:
                    np.minimum(s, 80, out=s)
                own = s[np.arange(len(rows)), member[rows] - first]
                np.exp(s, out=s)
                out[rows] += own - np.log(np.maximum(s.sum(1), 1e-30))
        return out


class Trainer:
    """Noise-contrastive estimation with AdaGrad; a batch shares its noise classes, members have noise of their own bucket."""

    def __init__(self, model: Model, unigram: np.ndarray, seed: int, noise: int = 32, own_noise: int = 1, rate: float = 0.08):
        self.m, self.rate, self.noise, self.own_noise = model, np.float32(rate), noise, own_noise
        self.r, self.cut = np.random.default_rng(seed), np.cumsum(unigram)
        self.log_noise = np.log(unigram).astype(np.float32)
        self.seen = [np.full(a.shape, 1e-2, np.float32) for a in model.arrays()]
        of = model.members
        self.own_cut, self.own_log = np.concatenate([[0.0], np.cumsum(of.mass)]), of.log_share + np.float32(np.log(own_noise))

    def step(self, context: np.ndarray, target: np.ndarray) -> None:
        m, of, n, per = self.m, self.m.members, np.float32(len(target)) ** np.float32(0.5), 8.0  # each token counts as seen against 8 noise classes
        unit, member = of.unit[target], of.member[target]
        drawn = np.minimum(np.searchsorted(self.cut, self.r.random(self.noise) * self.cut[-1]), UNITS - 1)
        before = [m.into.take(context[:, k], 0) for k in range(CONTEXT)]
        q = before[0] * m.place[0]
        for k in range(1, CONTEXT):
            q += before[k] * m.place[k]
        shift, real, noise = np.float32(np.log(per)), m.out.take(unit, 0), m.out.take(drawn, 0)
        own = np.einsum("ij,ij->i", q, real) + (m.bias - self.log_noise - shift).take(unit)
        other = q @ noise.T + (m.bias[drawn] - self.log_noise[drawn] - shift)
        g_own, g_other = _sigmoid(own) - 1, _sigmoid(other) * np.float32(per / self.noise)
        real *= g_own[:, None]
        g_q = real
        g_q += g_other @ noise
        self._update((0, 1), np.concatenate([unit, drawn]), (np.concatenate([g_own[:, None] * q, g_other.T @ q]), np.concatenate([g_own, g_other.sum(0)])), n)

        # a token of a bucket against other members of it; buckets of one member have nothing to learn
        some = np.flatnonzero((member >= 0) & (of.end[unit] - of.begin[unit] > 1))
        if len(some):
            k, b, p = member[some], unit[some], q[some]
            lo, hi = self.own_cut[of.begin[b]], self.own_cut[of.end[b]]
            d = np.searchsorted(self.own_cut, lo[:, None] + self.r.random((len(some), self.own_noise)) * (hi - lo)[:, None], "right") - 1
            d = np.clip(d, of.begin[b][:, None], of.end[b][:, None] - 1)
            mine, others = m.own[k], m.own[d]
            h_own = _sigmoid(np.einsum("ij,ij->i", p, mine) + m.own_bias[k] - self.own_log[k]) - 1
            h_other = _sigmoid(np.einsum("ij,ikj->ik", p, others) + m.own_bias[d] - self.own_log[d])
            g_q[some] += h_own[:, None] * mine + np.einsum("ik,ikj->ij", h_other, others)
            vectors = np.concatenate([h_own[:, None] * p, (h_other[:, :, None] * p[:, None, :]).reshape(-1, DIM)])
            self._update((4, 5), np.concatenate([k, d.ravel()]), (vectors, np.concatenate([h_own, h_other.ravel()])), n)

        g_place = np.stack([np.einsum("ij,ij->j", g_q, x) for x in before])
        self._update((2,), context.T.ravel(), (np.concatenate([g_q * m.place[k] for k in range(CONTEXT)]),), n)
        self._update((3,), np.arange(CONTEXT), (g_place,), n)

    def _update(self, which: tuple[int, ...], rows: np.ndarray, whats: tuple[np.ndarray, ...], n: np.float32) -> None:
        """An AdaGrad step of the rows that occur, by the sums of their gradients; the arrays of which share the rows."""
        order = np.argsort(rows.astype(np.uint16), kind="stable")  # codes fit two bytes, and those sort in linear time
        rows = rows.take(order)
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        rows = rows.take(first)
        for at, what in zip(which, whats, strict=True):
            g = np.add.reduceat(what.take(order, 0), first, axis=0) / n
            a, seen = self.m.arrays()[at], self.seen[at]
            s = seen[rows] + g * g
            seen[rows] = s
            a[rows] -= self.rate * g / np.sqrt(s)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def contexts(units: np.ndarray, starts: np.ndarray, before: int) -> np.ndarray:
    """The CONTEXT codes before each; texts begin at starts and don't see each other, but the code before."""
    n = len(units)
    out = np.full((n, CONTEXT), before, np.int64, "F")  # read by column
    since = np.arange(n) - np.repeat(starts, np.diff(np.r_[starts, n]))
    for k in range(CONTEXT):
        seen = since > k
        out[seen, k] = units[np.flatnonzero(seen) - k - 1]
    return out


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


def _counts(limit: int):
    def rows(given):
        held: Counter = Counter()
        for (text,) in given:
            held.update(text.lower().split())
            held[END] += 1
            if len(held) > limit:
                yield from held.items()
                held = Counter()
        yield from held.items()

    return rows


def _sizes(known):
    def rows(given):
        sums: dict[int, list[int]] = {}
        for word, c in given:
            if word not in known.value:
                s = sums.setdefault(bucket(word), [0, 0])
                s[0] += c
                s[1] += 1
        for b, (n, v) in sums.items():
            yield b, n, v

    return rows


def count_words(texts: DataFrame, limit: int = 400_000) -> DataFrame:
    """(word binary, c): texts has the column text in bytes."""
    made = common.arrow_pass(texts.select("text"), _counts(limit), "word binary, c long")
    return common.written(made.groupBy("word").agg(F.sum("c").alias("c")), "word-counts")


def vocabulary(counts: DataFrame, most_words: int, least_own: int = 50, most_own: int = 2048) -> Vocabulary:
    spark = counts.sparkSession
    tokens, distinct, end = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.length("word") == 0, F.col("c"))), F.lit(0))).first()
    short = counts.where(F.length("word").between(1, LONGEST))
    # the smallest count that at most most_words words reach
    sizes = sorted(short.groupBy(F.floor(F.log2("c") * 8).cast("int").alias("k")).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect(), key=lambda r: -r["k"])
    least, total = 2**62, 0
    for r in sizes:
        total += r["n"]
        if total > most_words:
            break
        least = r["least"]
    got = sorted(((bytes(w), c) for w, c in short.where(F.col("c") >= least).collect()), key=lambda x: (-x[1], x[0]))
    words, c = [END, *(w for w, _ in got)], np.array([end, *(c for _, c in got)], np.int64)
    own = min(most_own, int((c[WORDS + 1 :] >= least_own).sum()))
    known = spark.sparkContext.broadcast(frozenset(words[: WORDS + 1 + own]))
    inside, rest, mass = np.zeros(UNITS), np.zeros(UNITS), np.ones(UNITS)
    for b, n, v in common.arrow_pass(counts, _sizes(known), "b int, n long, v long").groupBy("b").agg(F.sum("n"), F.sum("v")).collect():
        inside[b], rest[b] = np.log10(n + v + 1), n
        mass[b] += n
    own_bucket = np.array([bucket(w) for w in words[WORDS + 1 : WORDS + 1 + own]], np.int64)
    own_mass = c[WORDS + 1 : WORDS + 1 + own].astype(float)
    np.add.at(mass, own_bucket, own_mass)
    codes = np.array([UNITS - 1, *(k if k < WORDS else UNITS + k - WORDS if k < WORDS + own else bucket(w) for k, w in enumerate(words[1:]))], np.int64)
    for k in range(min(WORDS + 1, len(words))):
        mass[codes[k]] += c[k]
    return Vocabulary(tokens, distinct, {w: k for k, w in enumerate(words)}, c, codes, inside, mass / mass.sum(), Members.of(own_bucket, own_mass, rest))


def _encode(vocab: Broadcast, size: int = 65_536):
    """Rows (doc_id, held_out, half, text) to ENCODED."""

    def rows(given):
        import uuid

        v, rid = vocab.value, uuid.uuid4().int >> 66
        log_c = np.log10(v.counts + 1.0)

        def block(held, words, starts):
            nonlocal rid
            at, codes, rare = v.places(words)
            known = at > 0 if not v.counts[0] else at >= 0
            base = np.where(at >= 0, log_c[at], 0.0)
            rest = (codes >= WORDS) & (codes < UNITS - 1)
            inner = np.where(rest, base - v.inside[np.minimum(codes, UNITS - 1)], 0.0)
            sums = [np.add.reduceat(x, starts).tolist() for x in (known.astype(np.int64), base, inner, (at < 0).astype(np.int64))]
            raw, ends, lo = codes.astype("<u2").tobytes(), [*starts[1:], len(words)], 0
            for row, start, end, n_known, b, i, n_rare in zip(held, starts, ends, *sums, strict=True):
                few = Counter(rare[lo : lo + n_rare])
                lo += n_rare
                yield rid, *row, end - start, n_known, b, i, raw[2 * start : 2 * end], [{"word": w, "n": k} for w, k in few.items()]
                rid += 1

        held, words, starts = [], [], []
        for *row, text in given:
            held.append(row)
            starts.append(len(words))
            words += text.lower().split()
            words.append(END)
            if len(words) >= size:
                yield from block(held, words, starts)
                held, words, starts = [], [], []
        if held:
            yield from block(held, words, starts)

    return rows


ENCODED = "rid long, doc_id long, held_out boolean, half int, n_tokens long, known long, base double, inner double, units binary, rare array<struct<word: binary, n: long>>"


def _blocks(given, size: int):
    """(rows without their units, all units, places where texts begin) of about size tokens."""
    held, parts, n = [], [], 0
    for *row, units in given:
        held.append(row)
        parts.append(units)
        n += len(units) // 2
        if n >= size:
            yield held, *_joined(parts)
            held, parts, n = [], [], 0
    if held:
        yield held, *_joined(parts)


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), "<u2").astype(np.int64), np.cumsum([0, *(len(p) // 2 for p in parts[:-1])])


def _train(vocab: Broadcast, shared: Broadcast, batch: int):
    def rows(given):
        trainer, seen = None, 0
        for _, codes, starts in _blocks(given, 16 * batch):
            if trainer is None:  # noise differs between tasks and is the same when a task runs again
                members = vocab.value.members
                trainer = Trainer(Model.unpacked(shared.value, members), vocab.value.unigram, zlib.crc32(codes[:999].tobytes()))
            context = contexts(codes, starts, len(members.unit))
            for lo in range(0, len(codes), batch):
                trainer.step(context[lo : lo + batch], codes[lo : lo + batch])
            seen += len(codes)
        if trainer is not None:
            yield seen, trainer.m.packed().tobytes()

    return rows


def _average(given):
    """Rows (tokens, model) to one: the tokens' sum, the models' average by tokens."""
    total, flat = 0, None
    for n, raw in given:
        x = np.frombuffer(raw, np.float32).astype(np.float64) * n
        total, flat = total + n, x if flat is None else flat + x
    if flat is not None:
        yield total, (flat / total).astype(np.float32).tobytes()


def train(encoded: DataFrame, vocab: Broadcast, batch: int = 4096) -> Model:
    """encoded has the columns units and half (0 or 1); a round passes over each half."""
    spark, members = encoded.sparkSession, vocab.value.members
    flat = Model.fresh(vocab.value.unigram, members).packed()
    for half in (0, 1):
        shared = spark.sparkContext.broadcast(flat)
        models = common.written(common.arrow_pass(encoded.where(F.col("half") == half).select("units"), _train(vocab, shared, batch), "n long, model binary", 1), "models")
        many = models.count()
        while many > 8:  # a row a task; each round of sums leaves an eighth of the rows
            many = -(-many // 8)
            summed = common.written(common.arrow_pass(models.repartition(many), _average, "n long, model binary", 1), "models")
            common.discard(models)
            models = summed
        got = list(_average((r["n"], r["model"]) for r in models.collect()))
        flat = np.frombuffer(got[0][1], np.float32) if got else flat
        common.discard(models)
        shared.unpersist()
    return Model.unpacked(flat, members)


def _score(vocab: Broadcast, flat: Broadcast):
    def rows(given):
        members = vocab.value.members
        m = Model.unpacked(flat.value, members)
        for held, codes, starts in _blocks(given, 131_072):
            sums = np.add.reduceat(m.log_probabilities(contexts(codes, starts, len(members.unit)), codes) / np.log(10), starts).tolist()
            for (*row, inner), x in zip(held, sums, strict=True):
                yield *row, x + inner

    return rows


SCORED = "rid long, doc_id long, held_out boolean, n_tokens long, known long, base double, model double"


@dataclass
class Learned:
    """What scoring needs: counts by word, the vocabulary, all texts in codes, and the model."""

    counts: DataFrame
    vocab: Vocabulary
    encoded: DataFrame
    model: Model


def learn(docs: DataFrame, most_words: int = 200_000, least_own: int = 50, most_own: int = 2048) -> Learned:
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), common.utf8().alias("text"))
    counts = count_words(rows.where(~F.col("held_out")))
    vocab = vocabulary(counts, most_words, least_own, most_own)
    sent = spark.sparkContext.broadcast(vocab)
    half = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(2)).cast("int")
    encoded = common.arrow_pass(rows.select("doc_id", "held_out", half.alias("half"), "text"), _encode(sent), ENCODED, 256)
    encoded = common.written(encoded, "encoded")
    return Learned(counts, vocab, encoded, train(encoded.where(~F.col("held_out")), sent))


def score_texts(docs: DataFrame, most_words: int = 200_000) -> DataFrame:
    """Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, a row for each row of docs.

    A null or empty text is its end alone. A null doc_id counts as the empty
    text, whose remainder is 0, so it is in training. Rows that repeat train and
    are scored each for itself. Other columns are ignored. Without training texts
    all counts are zero. An empty table gives an empty result.
    """
    return scored(learn(docs, most_words))


def scored(learned: Learned) -> DataFrame:
    encoded, vocab, counts = learned.encoded, learned.vocab, learned.counts
    context = encoded.sparkSession.sparkContext
    score = _score(context.broadcast(vocab), context.broadcast(learned.model.packed()))
    scored = common.arrow_pass(encoded.select("rid", "doc_id", "held_out", "n_tokens", "known", "base", "inner", "units"), score, SCORED)
    rare = encoded.select("rid", F.explode("rare").alias("r")).select("rid", F.col("r.word").alias("word"), F.col("r.n").alias("n"))
    least = int(vocab.counts[1:].min(initial=2**62))
    few = counts.where(((F.col("c") < least) | (F.length("word") > LONGEST)) & (F.length("word") > 0))
    found = rare.join(few, "word").groupBy("rid").agg(F.sum("n").alias("known_rare"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("log_rare"))
    found = common.written(found, "rare-words")
    zero = F.lit(0.0)
    out = scored.join(found, "rid", "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("known_rare", F.lit(0))).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("log_rare", zero) - F.col("n_tokens") * F.lit(float(np.log10(vocab.tokens + vocab.distinct + 1)))).alias("base_score"),
        (F.col("model") + F.coalesce("log_rare", zero)).alias("score"),
    )


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(common.table(spark, sf_dir, "documents"))
