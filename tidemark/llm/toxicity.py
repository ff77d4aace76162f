"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

Channel.  A word's characters span a lattice: a leetspeak symbol may stand for several letters, a
run of three or more equal letters for one or two, separators between single characters for
nothing, and in a run of single characters between blanks each blank for itself or for nothing.  Where a reading
gives no evidence, a doubled letter may also stand for one.  A Viterbi pass picks the
reading with the highest probability under a character trigram model counted over *all* documents.
Plain words have one reading and are their own restoration.

Score.  The evidence is a set of words and word beginnings that a training sample finds far more
often in toxic documents (log-odds of document frequencies).  Copies of one document must not make
each of its words evidence: a term counts if few others share most of its documents, as words of
their own do, or if a greedy cover keeps it, which explains documents that no better term has
explained.  A logistic curve over the summed log-odds gives the score.  Labels are read
only from rows whose crc32(doc_id) mod 4 is not 2 and only for at most ``SAMPLE_DOCS`` documents;
labels, lang, source and doc_id are never inputs of a score.

Scale.  Labels are reduced to a bounded, broadcast set of sample ids, so texts are never shuffled;
scoring runs in the scan's own tasks; the model is some thousand numbers.

In a run of spaced characters a word of evidence counts where it stands between word breaks: the best
decoding of the run with a break at its ends (a beginning: before it) must be about as likely as the
best of all.  Decoding takes linear time in a run's length.

Defined results: null and empty texts score like a text without evidence; without both classes
among the training labels every score is 0; labels that contradict each other for one doc_id count
as toxic; null labels and ids are not learned from; rows without a doc_id count as fold 0.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.common import crc_fold, documents, in_places

SAMPLE_DOCS = 10_000
FEATURES = 2_000
BITMAP = 32_768  # bits of Spark's bitmap aggregate
CACHE = 150_000
SPACED_RUN = 4
BREAKS = 4.0  # nats that the breaks around a word of evidence may cost in a spaced run
THRESHOLD = 0.3

# Letters that a symbol may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c"}
EDGES = ".,;:!?\"'()[]{}<>«»„“”’‘…"
SEPARATED = re.compile(r"[^\W_]([.\-_*~'][^\W_])+")
DOUBLED = re.compile(r"([^\W\d_])\1")
SYMBOLS = 28  # boundary, a-z, any other letter


def _byte_classes() -> np.ndarray:
    table = np.zeros(256, dtype=np.int64)
    for k in range(26):
        table[97 + k] = table[65 + k] = 1 + k
    table[128:] = 27
    return table


BYTE_CLASS = _byte_classes()


def letter(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Character trigrams of all texts; a task sends at most SYMBOLS ** 3 sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS ** 3, dtype=np.int64)
        for b in batches:
            texts = b.column("text").to_pylist()
            for k in range(0, len(texts), 64):
                x = BYTE_CLASS[np.frombuffer(b"  ".join([b"", *texts[k:k + 64], b""]), dtype=np.uint8)]
                total += np.bincount(x[:-2] * SYMBOLS ** 2 + x[1:-1] * SYMBOLS + x[2:], minlength=SYMBOLS ** 3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["t", "n"])

    rows = (documents(docs).select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "t long, n long")
            .groupBy("t").agg(F.sum("n").alias("n")).collect())  # at most SYMBOLS ** 3 rows
    counts = np.zeros(SYMBOLS ** 3)
    for r in rows:
        counts[r.t] = r.n
    return counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


class Channel:
    """Viterbi decoding of obfuscated words under the trigram model."""

    def __init__(self, counts: np.ndarray):
        two, one = counts.sum(axis=0), counts.sum(axis=(0, 1))
        p1 = (one + 1) / (one.sum() + SYMBOLS)
        p2 = (two + 20 * p1) / (two.sum(axis=1, keepdims=True) + 20)
        p3 = (counts + 20 * p2[None]) / (counts.sum(axis=2, keepdims=True) + 20)
        self.log = np.log(p3)

    def lattice(self, word: str, doubled: bool = False) -> list[list[tuple[str, float]]]:
        """Readings of each run of equal characters with their channel costs; ``doubled``: two letters may be one."""
        if SEPARATED.fullmatch(word):
            word = re.sub(r"[.\-_*~']", "", word)
        out = []
        for c, run in groupby(word):
            n = len(list(run))
            if c.isalpha():
                out.append([(c, -0.5), (c * 2, -1.0)] if n > 2 else [(c * 2, 0.0), (c, -2.5)] if n == 2 and doubled else [(c * n, 0.0)])
            elif c in LEET:
                out.append([(x * k, -1.0 - 0.5 * (n != k)) for x in LEET[c] for k in {1, min(n, 2)}])
            else:
                out.append([("", -1.0)])
        return out

    def _steps(self, best: dict, lattice: list, blanks: bool) -> dict:
        """Viterbi: the best way to each pair of last letters, from the ways in ``best`` through the lattice."""
        log = self.log
        for options in lattice:
            if blanks:  # there may be a word break before it
                options = options + [(" " + text, cost) for text, cost in options]
            new: dict[tuple[int, int], tuple] = {}
            for (a, b), before in best.items():
                for text, cost in options:
                    x, y, s = a, b, before[0] + cost
                    for c in text:
                        k = letter(c)
                        s += log[x, y, k]
                        x, y = y, k
                    if (x, y) not in new or new[x, y][0] < s:
                        new[x, y] = (s, before, text)
            best = new
        return best

    def decode(self, lattice: list, blanks: bool = False) -> tuple[str, float]:
        """The most probable reading, and its log probability with the break after it."""
        best = self._steps({(0, 0): (0.0, None, "")}, lattice, blanks)  # score, step before, letters
        score, step = max(((v[0] + self.log[a, b, 0], v) for (a, b), v in best.items()), key=lambda e: e[0])
        said = []
        while step[1] is not None:
            said.append(step[2])
            step = step[1]
        return "".join(reversed(said)), score

    def restore(self, word: str, doubled: bool = False) -> str:
        return self.decode(self.lattice(word, doubled))[0]

    def standing(self, letters: str, at: int, stop: int) -> float:
        """Log probability of letters[at:stop] as one word after a break at ``at``, with the break behind it."""
        a, b = letter(letters[at - 1]) if at else 0, 0
        total = 0.0
        for c in letters[at:stop]:
            k = letter(c)
            total += self.log[a, b, k]
            a, b = b, k
        return total + self.log[a, b, 0]

    def ways(self, letters: str) -> tuple[list[float], list[float]]:
        """For each place of a run of plain letters: the best log probability up to a word break there, and from it on."""
        log, n = self.log, len(letters)
        k = [letter(c) for c in letters]
        ahead, best = [0.0], {(0, 0): 0.0}
        for i in range(n):
            new: dict[tuple[int, int], float] = {}
            for (a, b), s in best.items():
                t = s + log[a, b, k[i]]
                if new.get((b, k[i]), -math.inf) < t:
                    new[b, k[i]] = t
            # the break at place i: only one way goes on from it, with letter i the next
            t = ahead[i] + log[0 if i == 0 else k[i - 1], 0, k[i]] if i else -math.inf
            if new.get((0, k[i]), -math.inf) < t:
                new[0, k[i]] = t
            best = new
            ahead.append(max(s + log[a, b, 0] for (a, b), s in best.items()))
        back = [-math.inf] * (n + 1)
        back[n] = 0.0
        # tail[i][(a)]: best from place i on, letters i-2 (a) and i-1 before it; breaks allowed
        follow: list[dict[int, float]] = [{} for _ in range(n + 1)]

        def onward(a: int, b: int, i: int) -> float:
            """From place i on, after the symbols a and b; with the break at the end."""
            if i == n:
                return log[a, b, 0]
            said = log[a, b, k[i]] + follow[i + 1].get(b, -math.inf)
            return max(said, log[a, b, 0] + back[i]) if b else said

        for i in range(n, 0, -1):
            # before place i stands letter i-1; before that letter i-2 or a break
            for a in {k[i - 2] if i > 1 else 0, 0}:
                follow[i][a] = onward(a, k[i - 1], i)
            # a break at place i-1, then letter i-1
            before = k[i - 2] if i > 1 else 0
            back[i - 1] = log[before, 0, k[i - 1]] + follow[i][0]
        return ahead, back


class Scorer:
    """Evidence of a text's restored words, and its score."""

    def __init__(self, channel: Channel, words: dict[str, float], starts: dict[str, float], slope: float, base: float):
        self.channel, self.words, self.starts, self.slope, self.base = channel, words, starts, slope, base
        self.sizes = sorted({len(s) for s in starts})
        self.known: dict[str, tuple[tuple[str, float] | None, bool]] = {}
        self.spelt = {DOUBLED.sub(r"\1", w) for w in words} | {DOUBLED.sub(r"\1", w) for w in starts}
        self.spelt_sizes = sorted({len(w) for w in self.spelt})

    def _weigh(self, word: str) -> tuple[str, float] | None:
        w = self.words.get(word, 0.0)
        best = (word, w)
        for n in self.sizes:
            v = self.starts.get(word[:n], 0.0)
            if v > best[1]:
                best = (word[:n], v)
        return best if best[1] > 0 else None

    def _doubled(self, plain: str) -> tuple[str, float] | None:
        """Evidence of a plain word whose doubled letters may be single; others are not decoded."""
        single = DOUBLED.sub(r"\1", plain)
        if len(single) == len(plain) or not any(single[:n] in self.spelt for n in self.spelt_sizes):
            return None
        return self._weigh(self.channel.restore(plain, True))

    def _word(self, token: str) -> tuple[str, float] | None:
        plain = token.strip(EDGES)
        if plain.isalpha() and not any(a == b == c for a, b, c in zip(plain, plain[1:], plain[2:])):
            return self._weigh(plain) or self._doubled(plain)
        found = None
        for piece in {plain, token} if plain != token and any(c in LEET for c in token) else {plain}:
            if any(c.isalpha() for c in piece):
                found = found or self._weigh(self.channel.restore(piece)) or (self._weigh(self.channel.restore(piece, True)) if DOUBLED.search(piece) else None)
        if found is None and ("-" in plain or "/" in plain):
            for piece in re.split(r"[-/]", plain):
                found = found or (self._weigh(piece) if piece.isalpha() else None)
        return found

    def _spaced(self, tokens: list[str]) -> list[tuple[str, float]]:
        """Words spelt with blanks between their characters."""
        out = []
        for single, run in groupby(tokens, key=lambda t: len(t.strip(EDGES) or t) == 1):
            if single:
                letters = "".join(t.strip(EDGES) or t for t in run)
                if SPACED_RUN <= len(letters) and len(set(letters)) > 1:
                    for said in {self.channel.restore(letters), self.channel.restore(letters, True)}:
                        out += self._standing(said)
        return out

    def _standing(self, said: str) -> list[tuple[str, float]]:
        """Words and beginnings of evidence that stand between word breaks of a run of letters."""
        terms = [(w, v, False) for w, v in self.words.items() if len(w) >= SPACED_RUN and w in said]
        terms += [(w, v, True) for w, v in self.starts.items() if w in said]
        if not terms:
            return []
        ahead, back = self.channel.ways(said)
        out = {}
        for w, v, start in terms:
            at = said.find(w)
            while at >= 0:
                best = max(self.channel.standing(said, at, stop) + ahead[at] + (back[stop] if stop < len(said) else 0.0)
                           for stop in ([at + len(w)] if not start else range(at + len(w), min(len(said), at + 2 * len(w)) + 1)))
                if best >= ahead[-1] - BREAKS:
                    out[w] = max(v, out.get(w, 0.0))
                at = said.find(w, at + 1)
        longest = [w for w, _, start in terms if not start and w in out]
        return [(w, v) for w, v in out.items() if w not in self.starts or w in self.words or not any(x.startswith(w) and out[x] >= v for x in longest)]

    def evidence(self, text: str) -> float:
        tokens = text.lower().split()
        known, found, singles = self.known, {}, set()
        if len(known) > CACHE:
            known.clear()
        for t in set(tokens):
            if t in known:
                hit, single = known[t]
            else:
                hit, single = known[t] = self._word(t), len(t.strip(EDGES) or t) == 1
            if hit is not None:
                found[hit[0]] = hit[1]
            if single:
                singles.add(t)
        if singles and sum(map(singles.__contains__, tokens)) >= SPACED_RUN:
            for w, v in self._spaced(tokens):
                found[w] = max(v, found.get(w, v))
        return math.fsum(sorted(found.values()))

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.slope * self.evidence(text) + self.base))))


def _terms(text):
    """Distinct words of a text, and their beginnings of five to seven letters marked with a dash."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), "[^\\p{L}]+"), lambda w: F.char_length(w) >= 3))
    starts = [F.transform(F.filter(words, lambda w, n=n: F.char_length(w) > n), lambda w, n=n: F.concat(F.substring(w, 1, n), F.lit("-"))) for n in (5, 6, 7)]
    return F.concat(words, F.array_distinct(F.concat(*starts)))


def _cover(rows, fewest: int = 5) -> dict[str, float]:
    """Greedy cover: terms in the order of documents that they newly explain times log-odds.

    ``docs`` is a bit set of the sample's documents.
    """
    left = {r.term: r.docs if isinstance(r.docs, int) else int.from_bytes(r.docs, "little") for r in rows}
    odds = {r.term: r.odds for r in rows}
    kept: dict[str, float] = {}
    while left:
        term = max(left, key=lambda t: (left[t].bit_count() * odds[t], t))
        new = left.pop(term)
        if new.bit_count() < fewest:
            continue
        kept[term] = odds[term]
        left = {t: rest for t, d in left.items() if (rest := d & ~new).bit_count() >= fewest}
    return kept


def _apart(rows, fewest: int = 8, odds: float = 3.0, company: int = 5, shared: float = 0.8) -> dict[str, float]:
    """Terms with at most ``company`` others (a word's beginnings too) in most of their documents, each in ``fewest`` or more."""
    if not rows:
        return {}
    raw = [r.docs.to_bytes(BITMAP // 8, "little") if isinstance(r.docs, int) else bytes(r.docs) for r in rows]
    bits = np.unpackbits(np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(len(rows), -1), axis=1)
    bits = bits[:, bits.any(axis=0)].astype(np.float32)
    size = bits.sum(axis=1)
    beside = (bits @ bits.T >= shared * size[:, None]).sum(axis=1) - 1
    return {r.term: r.odds for r, n, k in zip(rows, size, beside) if n >= fewest and k <= company and r.odds >= odds and not r.term.endswith("-")}


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, features: int = FEATURES) -> Scorer | None:
    """The model, or None where training rows lack one of the classes."""
    if sample_docs > BITMAP:
        raise ValueError(f"at most {BITMAP} documents can teach")
    named = documents(docs)
    wanted = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
              .where("doc_id is not null and toxic is not null").where(crc_fold(F.col("doc_id"), 4) != 2)
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs))
    # whole texts of a bounded sample; exact copies teach once
    sample = (named.join(F.broadcast(wanted), "doc_id").withColumn("twin", F.xxhash64("text", "toxic")).dropDuplicates(["twin"]).persist())
    try:
        n = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        if not n.get(0) or not n.get(1):
            return None
        terms = sample.select("doc_id", "toxic", F.explode(_terms(F.col("text"))).alias("term"))
        odds = (F.log((F.col("n1") + 0.5) / (n[1] + 1)) - F.log((F.col("n0") + 0.5) / (n[0] + 1))).alias("odds")
        rows = (terms.groupBy("term").agg(
                    F.count_if(F.col("toxic") == 1).alias("n1"), F.count_if(F.col("toxic") == 0).alias("n0"))
                .where("n1 >= 5").select("term", "n1", odds)
                .where((F.col("odds") >= 3.0) | ((F.col("odds") >= 2.0) & (F.col("n1") >= 50)))
                .orderBy((F.col("n1") * F.col("odds")).desc(), "term").limit(features))
        # toxic documents of the sample by number, at most BITMAP of them: a bit set of 4 KB a term
        number = F.row_number().over(Window.orderBy("doc_id")) - 1
        numbers = sample.where("toxic = 1").select("doc_id").distinct().withColumn("number", number)
        rows = (terms.where("toxic = 1").join(F.broadcast(numbers), "doc_id").join(F.broadcast(rows), "term")
                .groupBy("term").agg(F.max("odds").alias("odds"), F.bitmap_construct_agg(F.col("number").cast("long")).alias("docs")).collect())
        kept = {**_apart(rows), **_cover(rows)}
        words = {t: v for t, v in kept.items() if not t.endswith("-")}
        starts = {t[:-1]: v for t, v in kept.items() if t.endswith("-")}
        scorer = Scorer(Channel(trigram_counts(docs)), words, starts, 1.0, 0.0)
        seen = _evidence(sample.select("doc_id", "toxic", "text"), scorer).collect()  # the bounded sample again
        scorer.slope, scorer.base = _logistic(np.array([r.e for r in seen]), np.array([r.toxic for r in seen], dtype=float))
        return scorer
    finally:
        sample.unpersist()


def _evidence(sample: DataFrame, scorer: Scorer) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = [scorer.evidence(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(e, pa.float64())], ["toxic", "e"])
    return sample.mapInArrow(run, "toxic int, e double")


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> tuple[float, float]:
    """Slope and intercept by damped Newton steps; evidence counts up to 6, so that one hit suffices."""
    x = np.minimum(x, 6.0)
    w = np.zeros(2)
    data = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(data @ w, -40, 40)))
        grad = data.T @ (p - y) + ridge * np.array([w[0], 0.0])
        hess = (data * (p * (1 - p) + 1e-9)[:, None]).T @ data + np.diag([ridge, 1e-6])
        w -= np.clip(np.linalg.solve(hess, grad), -1, 1)
    return float(max(w[0], 0.0)), float(w[1])


def score(docs: DataFrame, scorer: Scorer | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [scorer.score(t) if scorer else 0.0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])
    return documents(docs).mapInArrow(run, "doc_id long, score double").select(
        "doc_id", (crc_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, scorer: Scorer | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below the threshold, with all their columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(k).to_pylist()
            yield b.filter(pa.array([scorer is None or scorer.score(t or "") < threshold for t in texts], pa.bool_()))
    k = docs.columns.index("text")
    return in_places(docs, lambda df: df.mapInArrow(run, df.schema))
