"""Secret scans: fixed patterns, and a character convolutional network over every other candidate.

The base patterns name their spans outright and always stay.  Candidates are runs of 12 or more
key-like characters with a digit, or of 20 or more letters that mix cases inside.  Each is read
whole with its surroundings, in overlapping windows, by a small network in numpy (character
embedding, one convolution, maximum and mean over places, logistic output); its score is that of its
most suspicious window.

Labels.  In every whole text the values of base findings are positive.
The patterns' own marks must not decide, or the network would learn the patterns again: values of
both labels are moved to random places of their text, and most positive ones are spelt again at
random in other alphabets, lengths and with other prefixes.  Negative are all other runs of the
texts that are not of letters alone (numbers, addresses, hosts) or that the scan would ask about, and
identifiers, paths, dates, version names and UUIDs put together from each text's words.  Copies of a
finding fall on one side of the split into training and held-back findings.  These calibrate the
output (Platt scaling) and set the threshold: the quantile of all held-back positives that keeps
``RECALL`` of them, whatever it is.  Candidates at or above it that touch no base span become spans
of kind ``model``.

Training.  All distinct windows are dealt by their hash into blocks of about ``BLOCK``.  In a round each of
its blocks takes Adam's steps from the shared weights, and the blocks' weights and moments are averaged
in whole numbers, so that neither layout nor order of the rows matters.  Rounds take the blocks in
turn; each is read ``ROUNDS / TURNS`` times or more.  Newton's sums and the quantile's counts come from jobs
over all held-back windows; only sums of a fixed number reach the driver.

Every whole text is scanned in the scan's own tasks, with no shuffle; the network is some thirty
kilobytes.  Without enough positives nothing is trained and only base spans are found.

Defined results: a null text counts as empty and has no spans; the hash of no spans is that of the
empty string; rows that repeat an id, and rows without one, are scanned each for itself (the latter
teach nothing); other columns never reach a task of ``scan``; ``redact`` keeps every row and column.
Patterns and network take linear time in very long texts.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import documents, in_places, saved
from tidemark.scratch import discard

RECALL = 0.99
BLOCK, BATCH = 8192, 64  # windows
ROUNDS, TURNS = 8, 4
RATE = 0.01
UNIT = 2.0 ** 26  # of the whole numbers in which weights are averaged
BEFORE, INSIDE, AFTER = 16, 40, 8
STRIDE = 28  # between the windows of a candidate longer than INSIDE
WIDTH = BEFORE + INSIDE + AFTER
SPELLINGS = 12  # of a finding, besides its own
LOOK_ALIKES = 4  # put together for each text
KINDS = ("assign", "access", "hex", "model")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_~-]{12,}={0,2}")
MIXED = re.compile(r"[A-Za-z][^A-Za-z]*[0-9]|[0-9][^0-9]*[A-Za-z]")
CASES = re.compile(r"[a-z][A-Z]+[a-z]+[A-Z]")
WORD = re.compile(r"(?<![A-Za-z])[A-Za-z]{3,10}")
RUN = re.compile(r"[A-Za-z0-9+/_.@~:-]{10,}")
WORDS_OF_ASSIGN = ("password", "passwd", "secret", "token", "api_key", "apikey")

Span = tuple[int, int, int]  # start, end, kind


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start and then kind.

    Runs of one class are maximal, so a length within the pattern finds what filtering would;
    only ``assign`` may consume a word that a shorter value holds, and is filtered afterwards.
    """
    spans: list[Span] = []
    low = text.lower()
    if any(w in low for w in WORDS_OF_ASSIGN):
        spans += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    spans.sort(key=lambda s: (s[0], s[2]))
    return spans


def candidates(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Key-like runs that touch no span of ``taken`` (ascending)."""
    out, k = [], 0
    for m in CANDIDATE.finditer(text):
        run = m.group()
        if not any(map(str.isdigit, run)) and not (len(run) >= 20 and CASES.search(run)):
            continue
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if not any(a < m.end() and m.start() < b for a, b, _ in taken[k:k + 3]):
            out.append(m.span())
    return out


def _classes() -> np.ndarray:
    """A class for each ASCII character; 0 pads, 1 is any other character."""
    table = np.ones(128, dtype=np.int64)
    for k, c in enumerate("abcdefghijklmnopqrstuvwxyz"):
        table[ord(c)], table[ord(c.upper())] = 2 + k, 28 + k
    for c in "0123456789":
        table[ord(c)] = 54
    for k, c in enumerate(" \n\"'=:-_/.+"):
        table[ord(c)] = 55 + k
    return table


CLASSES = _classes()
N_CLASSES = 66


def windows(text: str, start: int, end: int) -> list[str]:
    """What surrounds a candidate with each stretch of it; each part padded to its width."""
    before, after = text[max(0, start - BEFORE):start].rjust(BEFORE, "\0"), text[end:end + AFTER].ljust(AFTER, "\0")
    places = [*range(start, max(start + 1, end - INSIDE), STRIDE)]
    if end - places[-1] > INSIDE:
        places.append(end - INSIDE)
    return [before + text[p:min(p + INSIDE, end)].ljust(INSIDE, "\0") + after for p in places]


def _encode(windows: list[str]) -> np.ndarray:
    codes = np.frombuffer("".join(windows).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(-1, WIDTH)
    return np.where(codes == 0, 0, np.where(codes < 128, CLASSES[np.minimum(codes, 127)], 1)).astype(np.uint8)


class CharCNN:
    """Embedding, convolution of ``taps`` characters, ReLU, maximum and mean over places, logistic output."""

    def __init__(self, seed: int = 7, dim: int = 8, filters: int = 24, taps: int = 5):
        r = np.random.default_rng(seed)
        self.taps, self.dim = taps, dim
        self.w = {"e": r.normal(0, 0.3, (N_CLASSES, dim)), "k": r.normal(0, 0.2, (taps * dim, filters)),
                  "b": np.zeros(filters), "o": r.normal(0, 0.2, filters), "a": r.normal(0, 0.2, filters), "c": np.zeros(1)}
        self.w = {name: v.astype(np.float32) for name, v in self.w.items()}
        self.m, self.s = ({name: np.zeros(v.shape) for name, v in self.w.items()} for _ in range(2))
        self.step = 0
        self.scale, self.shift, self.threshold = 1.0, 0.0, 1.1

    def _forward(self, x: np.ndarray):
        emb = np.ascontiguousarray(self.w["e"][x]).reshape(len(x), -1)
        cols = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(emb, self.taps * self.dim, axis=1)[:, ::self.dim])
        conv = cols.reshape(-1, cols.shape[2]) @ self.w["k"]
        conv += self.w["b"]
        conv = np.maximum(conv, 0, out=conv).reshape(len(x), cols.shape[1], -1)
        best = conv.argmax(axis=1)
        top = np.take_along_axis(conv, best[:, None], axis=1)[:, 0]
        mean = (np.full((1, conv.shape[1]), 1 / conv.shape[1], dtype=conv.dtype) @ conv)[:, 0]
        return cols, conv, best, top, mean, (top @ self.w["o"] + mean @ self.w["a"] + self.w["c"][0]).astype(float)

    def logits(self, seen: list[str] | np.ndarray) -> np.ndarray:
        x = seen if isinstance(seen, np.ndarray) else _encode(seen)
        return np.concatenate([self._forward(x[k:k + 512])[-1] for k in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def probabilities(self, seen: list[str]) -> np.ndarray:
        return _logistic(self.scale * self.logits(seen) + self.shift)

    def _gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        cols, conv, best, top, mean, z = self._forward(x)
        d = ((_logistic(z) - y) * weight / len(x)).astype(conv.dtype)
        g = {"o": top.T @ d, "a": mean.T @ d, "c": np.array([d.sum()])}
        places = conv.shape[1]
        dconv = (conv > 0) * (d[:, None] * (self.w["a"] / places))[:, None]
        rows, filters = np.indices(top.shape)
        dconv[rows, best, filters] += d[:, None] * self.w["o"] * (top > 0)
        flat = dconv.reshape(-1, dconv.shape[2])
        g["k"], g["b"] = cols.reshape(len(flat), -1).T @ flat, flat.sum(axis=0)
        dcol = (flat @ self.w["k"].T).reshape(len(x), places, -1)
        demb = np.zeros((len(x), x.shape[1], self.dim), dtype=conv.dtype)
        for t in range(self.taps):
            demb[:, t:t + places] += dcol[:, :, t * self.dim:(t + 1) * self.dim]
        at = (x.astype(np.int64)[:, :, None] * self.dim + np.arange(self.dim)).ravel()
        g["e"] = np.bincount(at, demb.ravel(), N_CLASSES * self.dim).reshape(N_CLASSES, self.dim)
        return g

    def descend(self, x: np.ndarray, y: np.ndarray, share: float, rate: float, order: np.ndarray) -> None:
        """Adam's steps over the windows ``x`` in ``order``; ``share`` of all windows are positive."""
        share = max(share, 1e-3)
        weight = np.where(y > 0, 0.5 / share, 0.5 / max(1 - share, 1e-3))
        for k in range(0, len(x), BATCH):
            i = order[k:k + BATCH]
            g = self._gradients(x[i], y[i], weight[i])
            self.step += 1
            for name, v in self.w.items():
                m, s = self.m[name], self.s[name]
                m += 0.1 * (g[name] - m)
                s += 0.001 * (g[name] ** 2 - s)
                v -= (rate * (m / (1 - 0.9 ** self.step)) / (np.sqrt(s / (1 - 0.999 ** self.step)) + 1e-8)).astype(v.dtype)

    def fit(self, seen: list[str], labels: np.ndarray, epochs: int = 10, rate: float = RATE) -> None:
        x, y, r = _encode(seen), labels.astype(float), np.random.default_rng(11)
        for _ in range(epochs):
            self.descend(x, y, y.mean(), rate, r.permutation(len(x)))

    def calibrate(self, seen: list[str], labels: np.ndarray, recall: float) -> None:
        """Platt scaling, then the highest threshold that keeps ``recall``."""
        z, y = self.logits(seen), labels.astype(float)
        high, low = _targets(int(y.sum()), len(y))

        def sums(a: float, b: float) -> tuple[float, ...]:
            p, target = _logistic(a * z + b), np.where(y > 0, high, low)
            v = p * (1 - p) + 1e-9
            return ((p - target) * z).sum(), (p - target).sum(), (v * z * z).sum(), (v * z).sum(), v.sum()

        self.scale, self.shift = _platt(sums)
        positive = np.sort(self.probabilities([w for w, x in zip(seen, y) if x > 0]))
        self.threshold = float(positive[int((1 - recall) * len(positive))])

    def state(self) -> np.ndarray:
        """Weights, first moments and roots of second moments, end to end."""
        return np.concatenate([np.asarray(f(v), dtype=float).ravel() for f, d in ((np.asarray, self.w), (np.asarray, self.m), (np.sqrt, self.s)) for v in d.values()])

    def put_state(self, state: np.ndarray) -> None:
        at = 0
        for f, d in ((np.asarray, self.w), (np.asarray, self.m), (np.square, self.s)):
            for name, v in d.items():
                d[name] = f(state[at:at + v.size]).reshape(v.shape).astype(v.dtype)
                at += v.size


def _logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _targets(positives: int, n: int) -> tuple[float, float]:
    return (positives + 1) / (positives + 2), 1 / (n - positives + 2)


def _platt(sums: Callable[[float, float], tuple[float, ...]]) -> tuple[float, float]:
    """Scale and shift by Newton steps; ``sums`` gives the sums of gradient and Hessian over all windows."""
    a, b = 1.0, 0.0
    for _ in range(30):
        ga, gb, haa, hab, hbb = sums(a, b)
        da, db = np.linalg.solve(np.array([[haa + 1e-3, hab], [hab, hbb + 1e-6]]), np.array([ga + 1e-3 * (a - 1), gb]))
        a, b = a - float(np.clip(da, -2, 2)), b - float(np.clip(db, -2, 2))
        if max(abs(da), abs(db)) < 1e-9:
            break
    return a, b


ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
             "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
             "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_")


def _spell_again(value: str, r: random.Random) -> str:
    """A random string of the same sort in another alphabet, length and with a prefix or none."""
    letters = r.choice(ALPHABETS)
    body = "".join(r.choices(letters, k=max(16, min(64, len(value) + r.randint(-24, 16)))))
    if not MIXED.search(body):
        body = body[:-2] + "a1"
    short = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 4)))
    mark = r.random()
    return (short() + r.choice("_-") if mark < 0.3 else short() + "_" + short() + "_" if mark < 0.45 else short() + "-" + str(r.randint(100, 99999999)) + "-" if mark < 0.55 else "") + body


def _look_alikes(words: list[str], r: random.Random) -> list[str]:
    """Clean runs that a key scan might take for keys, from words of the text."""
    w = lambda: r.choice(words)
    n = lambda k: str(r.randint(10 ** (k - 1), 10 ** k - 1))
    hexes = lambda k: "".join(r.choices("0123456789abcdef", k=k))
    short = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(1, 5)))
    piece = lambda: r.choice((w(), short(), short(), n(r.randint(1, 4)), short()[:2] + n(r.randint(1, 3))))
    joined = lambda: "".join(piece() + r.choice("--__./") for _ in range(r.randint(3, 5))) + r.choice((w, short))()
    return [joined(), joined(), joined(), f"{w()}_{w()}_{n(r.randint(1, 4))}", f"{w()}/{w()}/{w()}{n(2)}", f"{w().title()}{w().title()}{w().title()}{n(1)}", f"{w()}-{w()}-{w()}-{n(r.randint(1, 4))}",
            f"20{n(2)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}", f"{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}",
            f"{w()}{n(2)}/{w()}_v{n(1)}", f"{w()}{w()}{n(4)}", f"{w()}-{n(1)}-{n(2)}-{w()}", f"{w().upper()}-{n(3)}-{n(1)}-{n(2)}-{n(6)}-{n(1)}", f"{w()[:r.randint(1, 3)]}{n(2)}_{n(2)}-{w()}-{w()[:3]}-{w()[:3]}", f"{w().title()}{w().title()}{w().title()}{w().title()}"]


def _words(text: str, r: random.Random) -> list[str]:
    """Words at random places of the whole text."""
    found = (WORD.search(text, at, at + 200) for at in (r.randrange(len(text)) for _ in range(32 if text else 0)))
    return [m[0] for m in found if m]


def _placed(said: str, text: str, words: list[str], r: random.Random) -> str:
    """A window of a run at a random place of the text, with or without something that announces a value."""
    at = r.randrange(len(text) + 1)
    before, after = text[max(0, at - BEFORE):at], text[at:at + AFTER]
    word = r.choice(words)
    lead, tail = r.choice(((" ", " "), (" ", ". "), (f" {word} = ", " "), (f' {word} = "', '" '), (f" {word}: ", "\n"), (" (", ") "), (f"{word}=", "&"), ("\n", "\n"), (" '", "' ")))
    before, after = before + lead, tail + after
    return windows(before + said + after, len(before), len(before) + len(said))[0]


def _labelled(text: str) -> Iterator[tuple[str, str, int]]:
    """(value that stands for its copies, window, label) of a text's findings and of clean runs in it.

    Values of both labels come in the same surroundings, as these tell base findings at once.
    """
    r = random.Random(text[:200])
    words = _words(text, r) or ["word"]
    taken = base_spans(text)
    for s, e, kind in taken:
        if kind == 0:
            s = ASSIGN.match(text, s).start(2)
        value = text[s:e]
        if len(value) >= 12 and MIXED.search(value):
            r = random.Random(value)
            yield value, _placed(value, text, words, r), 1
            for _ in range(SPELLINGS):
                yield value, _placed(_spell_again(value, r), text, words, r), 1
    r, k = random.Random(text[:200]), 0
    for m in RUN.finditer(text):
        said = m[0]
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if any(s < m.end() and m.start() < e for s, e, _ in taken[k:k + 3]):
            continue
        if not said.isalpha() or len(said) >= 20 and CASES.search(said):
            yield said, _placed(said, text, words, r), 0
    if len(words) >= 20:
        for said in r.sample(_look_alikes(words, r), LOOK_ALIKES):
            yield said, _placed(said, text, words, r), 0


def labelled(docs: DataFrame) -> DataFrame:
    """All distinct (v, y, w): hash of the value, label, and window in classes, of every text that has an id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch() -> pa.RecordBatch:
            v, seen, y = zip(*rows)
            codes = _encode(list(seen))
            w = pa.FixedSizeBinaryArray.from_buffers(pa.binary(WIDTH), len(codes), [None, pa.py_buffer(codes.tobytes())])
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(y, pa.int32()), w.cast(pa.binary())], ["v", "y", "w"])

        rows: list[tuple[int, str, int]] = []
        for b in batches:
            for text in b.column("text"):
                for value, seen, y in _labelled(text.as_py()):
                    rows.append((xxhash.xxh64_intdigest(value.encode()) >> 1, seen, y))
                    if len(rows) == BLOCK:
                        yield batch()
                        rows.clear()
        if rows:
            yield batch()

    return documents(docs).where("doc_id is not null").select("text").mapInArrow(run, "v long, y int, w binary").distinct()


def _blocks(found: DataFrame, n: int) -> DataFrame:
    """(block, w, y): the windows dealt by hash into ``n`` rows of lists, each in the order of the hash."""
    h = F.xxhash64("w", "v", "y")
    files = min(n, max(64, n // 8))
    rows = (found.select(F.pmod(h, F.lit(n)).alias("block"), h.alias("h"), "v", "y", "w").repartition(files, "block")
            .groupBy("block").agg(F.sort_array(F.collect_list(F.struct("h", "v", "y", "w"))).alias("rows")))
    return saved(rows.select("block", F.col("rows.w").alias("w"), F.col("rows.y").alias("y")), "blocks")


def _round(net: CharCNN, blocks: DataFrame, share: float, rate: float, turn: int) -> np.ndarray:
    """The mean of the states that each block reaches from the network's, weighted by windows."""
    begin, step, size = net.state(), net.step, net.state().size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = CharCNN(), np.zeros(size + 1, dtype=np.int64)
        for b in batches:
            for block, w, y in zip(b.column("block").to_pylist(), b.column("w"), b.column("y")):
                x = np.frombuffer(b"".join(w.as_py()), dtype=np.uint8).reshape(-1, WIDTH)
                own.put_state(begin)
                own.step = step
                own.descend(x, np.array(y.as_py(), dtype=float), share, rate, np.random.default_rng([turn, block]).permutation(len(x)))
                total += np.append(np.rint(own.state() * (len(x) * UNIT)).astype(np.int64), len(x))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array(total)], ["i", "x"])

    sums = np.zeros(size + 1)
    for r in blocks.mapInArrow(run, "i long, x long").groupBy("i").agg(F.sum("x").alias("x")).collect():
        sums[r.i] = r.x
    return sums[:-1] / (UNIT * sums[-1])


def _kth(values: DataFrame, k: int) -> float:
    """The value of rank ``k``, from 0, of the column ``t``: counts in ever narrower ranges."""
    lo, hi = values.agg(F.min("t"), F.max("t")).first()
    while lo < hi:
        part = F.least(F.floor((F.col("t") - lo) / (hi - lo) * 1000), F.lit(999))
        for r in sorted(values.where(F.col("t").between(lo, hi)).groupBy(part.alias("part"))
                        .agg(F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi")).collect()):
            if k < r.n:
                break
            k -= r.n
        lo, hi = r.lo, r.hi
    return lo


def _calibrate(net: CharCNN, held: DataFrame, positives: int, n: int, recall: float) -> None:
    """As ``CharCNN.calibrate``, over the rows of ``held``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.frombuffer(b"".join(b.column("w").to_pylist()), dtype=np.uint8).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([pa.array(net.logits(x), pa.float64()), b.column("y")], ["z", "y"])

    seen = saved(held.select("w", "y").mapInArrow(run, "z double, y int"), "logits")
    high, low = _targets(positives, n)
    z = F.col("z")

    def sums(a: float, b: float) -> tuple[float, ...]:
        t = F.least(F.greatest(z * a + b, F.lit(-40.0)), F.lit(40.0))
        p = 1 / (1 + F.exp(-t))
        d, v = p - F.when(F.col("y") > 0, high).otherwise(low), p * (1 - p) + 1e-9
        return tuple(seen.agg(*(F.sum(c) for c in (d * z, d, v * z * z, v * z, v))).first())

    net.scale, net.shift = _platt(sums)
    least = _kth(seen.where("y = 1").select((z * net.scale + net.shift).alias("t")), int((1 - recall) * positives))
    net.threshold = float(_logistic(np.array([least]))[0])
    discard(seen)


def train(docs: DataFrame, recall: float = RECALL) -> CharCNN | None:
    """The network, from the findings and clean runs of all documents; None where they hold too few findings."""
    found = saved(labelled(docs), "findings")
    held = F.col("v") % 4 == 3
    many = {(r.held, r.y): r["count"] for r in found.groupBy(held.alias("held"), "y").count().collect()}
    bad, good, bad_held, good_held = (many.get(k, 0) for k in ((False, 0), (False, 1), (True, 0), (True, 1)))
    if good_held < 5 or good < 5 or bad < 5:
        return None
    n = -(-(bad + good) // BLOCK)
    blocks = _blocks(found.where(~held), n)
    net, turns = CharCNN(), min(TURNS, n)
    for k in range(ROUNDS):
        state = _round(net, blocks.where(F.col("block") % turns == k % turns), good / (bad + good), RATE * (1 - k / ROUNDS), k)
        net.put_state(state)
        net.step += -(-(bad + good) // (n * BATCH))
    discard(blocks)
    _calibrate(net, found.where(held), good_held, good_held + bad_held, recall)
    discard(found)
    return net


def spans_of(text: str, net: CharCNN | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), both by start and then kind."""
    base = base_spans(text)
    if net is None:
        return base, base
    more = candidates(text, base)
    if not more:
        return base, base
    seen = [windows(text, s, e) for s, e in more]
    p = net.probabilities([w for ws in seen for w in ws])
    at = np.cumsum([0] + [len(ws) for ws in seen[:-1]])
    added = [(s, e, 3) for (s, e), x in zip(more, np.maximum.reduceat(p, at)) if x >= net.threshold]
    return base, sorted(base + added, key=lambda s: (s[0], s[2]))


def _said(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame, net: CharCNN | None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                base, every = spans_of(text, net)
                many = [0, 0, 0]
                for s in base:
                    many[s[2]] += 1
                rows.append((*many, hashlib.sha256(_said(base).encode()).hexdigest(), _said(every)))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds))],
                                             ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])
    return documents(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_text(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for s, e, _ in spans:
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, net: CharCNN | None) -> DataFrame:
    """The same rows and columns with every span replaced; ``n_chars`` follows where it exists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t if t is None else redact_text(t, spans_of(t, net)[1]) for t in b.column(k).to_pylist()]
            columns = list(b.columns)
            columns[k] = pa.array(texts, b.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)
    k = docs.columns.index("text")
    out = in_places(docs, lambda df: df.mapInArrow(run, df.schema))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(kind))
    return out
