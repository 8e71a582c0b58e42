"""Secrets: base patterns, and a character convolutional network over every candidate with its context.

A candidate is a run of 16 or more key characters with a letter and a digit, or the value of a base span. The network reads
BODY characters of it and CONTEXT on both sides, in classes of characters: an embedding convolution of width 5, rectifier,
maximum and mean over places, logistic output. A longer candidate is read whole, in windows of BODY characters that begin
every STEP, and has the highest of their scores; so any key of up to BODY - STEP characters lies in one window. It is trained
with numpy on labelled findings: those given, at most MAX_LABELLED rows, or else a set made by a rule. On a held-out third its
outputs are calibrated (Platt scaling). The highest threshold that still finds RECALL of the secrets has the fewest harmless
findings; the one taken has no more of them, half way down to the next harmless score. All candidates get a score. Base spans stay whatever theirs is; the network adds candidates that overlap none and reach the threshold.

Nulls and edge cases: a null or empty text has no span; offsets are code points of the whole text; repeated rows are rows
of their own; a null doc_id is returned as it is; extra columns pass through `find_secrets`, which replaces a column `secrets`.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import small_batches

KINDS = ("assign", "access", "hex", "model")
MAX_LABELLED = 20_000
CONTEXT, BODY, STEP, WIDTH, FILTERS = 24, 48, 8, 5, 24
#: Windows scored at once.
WINDOWS = 512
RECALL = 0.98

_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: The cheapest test that rules a text out: nothing can be found without a digit, or one of the words with its sign.
_DIGIT = re.compile(r"[0-9]")


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the value)."""
    found = [("assign", *m.span(), m.start(1)) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span(), m.start()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span(), m.start()) for m in _HEX.finditer(text)]
    return found


def candidates(text: str, taken: list[tuple]):
    """Runs of key characters with a letter and a digit that overlap no span (kind, start, end, ...) taken."""
    taken = sorted((a, b) for _, a, b, *_ in taken)
    starts, ends = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    for m in _CANDIDATE.finditer(text) if _DIGIT.search(text) else ():
        run = m[0]
        if any(c.isdigit() for c in run) and any(c.isalpha() for c in run):
            before = bisect_left(starts, m.end())  # spans that begin before the run ends, and the furthest end of them
            if not before or ends[before - 1] <= m.start():
                yield m.span()


#: Character classes: 0 none, 1 other, 2 white space; hex letters, other letters and digits by case; signs on their own.
_SIGNS = "\"'`:=+/_.-@#<>()[]{},;&?%$!*\\|~"
_CLASS = {c: 11 + k for k, c in enumerate(_SIGNS)}
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
CLASSES = 11 + len(_SIGNS) + len(_LETTERS)


def _char_class(c: str) -> int:
    if c in _CLASS:
        return _CLASS[c]
    if c.isdigit():
        return 3
    if "a" <= c <= "z":
        return 11 + len(_SIGNS) + ord(c) - 97
    if "A" <= c <= "Z":
        return 4 if c <= "F" else 5
    return 2 if c.isspace() else 6 if c.isalpha() else 1


def window(text: str, a: int, b: int) -> np.ndarray:
    left, body, right = text[max(0, a - CONTEXT) : a], text[a : min(b, a + BODY)], text[b : b + CONTEXT]
    row = np.zeros(2 * CONTEXT + BODY, np.int64)
    for at, part in ((CONTEXT - len(left), left), (CONTEXT, body), (CONTEXT + BODY, right)):
        row[at : at + len(part)] = [_char_class(c) for c in part]
    return row


def places(a: int, b: int) -> list[tuple[int, int]]:
    """The windows of a candidate, as (start, end); the last one ends with it."""
    return [(a, b)] if b - a <= BODY else [(k, k + BODY) for k in (*range(a, b - BODY, STEP), b - BODY)]


@dataclass
class Network:
    kernel: np.ndarray  # WIDTH x CLASSES x FILTERS
    bias: np.ndarray
    out: np.ndarray  # for the maxima over the context and over the body
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5

    def _pooled(self, x: np.ndarray):
        n = x.shape[1] - WIDTH + 1
        h = sum(self.kernel[k][x[:, k : k + n]] for k in range(WIDTH)) + self.bias
        body = slice(CONTEXT, CONTEXT + BODY - WIDTH + 1)
        inside, outside = h[:, body], np.concatenate((h[:, :CONTEXT], h[:, CONTEXT + BODY - WIDTH + 1 :]), axis=1)
        return inside, outside

    def logits(self, x: np.ndarray) -> np.ndarray:
        inside, outside = self._pooled(x)
        pooled = np.concatenate((inside.max(1), outside.max(1), inside.mean(1)), axis=1)
        return np.maximum(pooled, 0) @ self.out[:-1] + self.out[-1]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * self.logits(x) + self.scale[1], -30, 30)))

    def best(self, text: str, found: list[tuple[int, int]]) -> np.ndarray:
        """The highest score over the windows of each candidate (start, end)."""
        best = np.zeros(len(found))
        each = ((k, *w) for k, (a, b) in enumerate(found) for w in places(a, b))
        while part := list(islice(each, WINDOWS)):
            np.maximum.at(best, [k for k, _, _ in part], self.scores(np.stack([window(text, a, b) for _, a, b in part])))
        return best

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 30, step: float = 0.05, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        after = np.r_[0:CONTEXT, CONTEXT + BODY - WIDTH + 1 : x.shape[1] - WIDTH + 1]
        length = BODY - WIDTH + 1
        for _ in range(rounds):
            for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
                b, t = x[rows], y[rows]
                inside, outside = self._pooled(b)
                at_in, at_out = inside.argmax(1) + CONTEXT, after[outside.argmax(1)]
                pooled = np.concatenate((inside.max(1), outside.max(1), inside.mean(1)), axis=1)
                p = 1 / (1 + np.exp(-np.clip(np.maximum(pooled, 0) @ self.out[:-1] + self.out[-1], -30, 30)))
                g = (p - t) / len(rows)
                back = np.outer(g, self.out[:-1]) * (pooled > 0)
                self.out[:-1] -= step * 10 * (np.maximum(pooled, 0).T @ g)
                self.out[-1] -= step * 10 * g.sum()
                f = np.arange(FILTERS)
                for k in range(WIDTH):
                    for at, part in ((at_in, back[:, :FILTERS]), (at_out, back[:, FILTERS : 2 * FILTERS])):
                        np.add.at(self.kernel[k], (np.take_along_axis(b, at + k, 1), f), -step * 10 * part)
                    spread = np.broadcast_to(back[:, None, 2 * FILTERS :] / length, (len(rows), length, FILTERS))
                    np.add.at(self.kernel[k], b[:, CONTEXT + k : CONTEXT + k + length], -step * 10 * spread)
                self.bias -= step * 10 * (back[:, :FILTERS] + back[:, FILTERS : 2 * FILTERS] + back[:, 2 * FILTERS :]).sum(0)

    def calibrate(self, findings: list[tuple[str, int, int, int]]) -> None:
        """On the highest output over the windows of each finding, as best() decides."""
        y = np.array([f[3] for f in findings], float)
        z = np.array([self.logits(np.stack([window(t, *w) for w in places(a, b)])).max() for t, a, b, _ in findings])
        a, b = 1.0, 0.0
        for _ in range(500):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            a -= 0.1 * float(((p - y) * z).mean())
            b -= 0.1 * float((p - y).mean())
        self.scale = (a, b)
        score = np.concatenate([self.best(t, [(a, b)]) for t, a, b, _ in findings])
        found = np.sort(score[y == 1])
        least = found[int((1 - RECALL) * len(found))] if len(found) else 1.0
        harmless = score[(y == 0) & (score < least)]
        self.threshold = float((least + harmless.max(initial=0.0)) / 2)


def made_findings(n: int = 2400, seed: int = 11) -> list[tuple[str, int, int, int]]:
    """Labelled findings by a rule: (text, start, end, label)."""
    r = random.Random(seed)
    some = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    upper, digits = _LETTERS.upper(), "0123456789"
    word = lambda: some(_LETTERS, r.randint(3, 9))
    secret = (
        lambda: some(_LETTERS + upper + digits, r.randint(20, 44)),
        lambda: some(_LETTERS + upper + digits + "+/", r.randint(24, 64)) + r.choice(("", "=", "==")),
        lambda: "ghp_" + some(_LETTERS + upper + digits, 36),
        lambda: "sk-" + some(_LETTERS + upper + digits, 40),
        lambda: some("0123456789ABCDEF", r.choice((32, 40, 64))),
        lambda: "AIza" + some(_LETTERS + upper + digits + "-_", 35),
        lambda: r.choice("-_.").join([some(_LETTERS, r.randint(2, 6)), *(some(_LETTERS + upper + digits, r.randint(10, 32)) for _ in range(r.randint(1, 2)))]),
    )
    harmless = (
        lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}-{r.randint(10, 59)}",
        lambda: "-".join(word() for _ in range(r.randint(3, 5))) + f"-{r.randint(1, 99)}",
        lambda: "/".join(word() for _ in range(r.randint(3, 5))) + f"/{r.randint(1, 999)}",
        lambda: "_".join(word() for _ in range(3)) + f"_{r.randint(1, 9)}",
        lambda: some("0123456789", r.randint(14, 19)) + r.choice(("kg", "ms", "px", "eur")),
        lambda: "-".join(some("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)),
        lambda: word() + word() + word() + str(r.randint(1, 99)),
        lambda: "=" * 20 + word() + str(r.randint(1, 9)) + "-" * 20,
    )
    rows = []
    for k in range(n):
        label = k % 2
        body = r.choice(secret if label else harmless)()
        cue = r.choice(('key: "', "credential=", "Authorization: Bearer ", "auth ", "private_key '", " ", "use ", "by ")) if label else r.choice(("see ", "id ", "file ", "/", " ", "on "))
        left, right = f"{word()} {word()} {cue}", f"{r.choice((' ', chr(34), chr(39), '.', ','))}{word()} {word()}"
        rows.append((left + body + right, len(left), len(left) + len(body), label))
    return rows


def train(findings: list[tuple[str, int, int, int]]) -> Network:
    """A calibrated network from (text, start, end, label); every third row is held out for calibration."""
    held = [f for k, f in enumerate(findings) if k % 6 >= 4]
    learned = [(*f[:1], *w, f[3]) for k, f in enumerate(findings) if k % 6 < 4 for w in places(f[1], f[2])]
    x = np.stack([window(t, a, b) for t, a, b, _ in learned])
    y = np.array([f[3] for f in learned], float)
    rng = np.random.default_rng(5)
    net = Network(rng.normal(0, 0.1, (WIDTH, CLASSES, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, 3 * FILTERS + 1))
    net.fit(x, y)
    net.calibrate(held)
    return net


def labelled_findings(rows: DataFrame) -> list[tuple[str, int, int, int]]:
    """At most MAX_LABELLED rows (text, start, end, label) to train on, chosen by a hash."""
    picked = rows.orderBy(F.xxhash64("text", "start", "end")).limit(MAX_LABELLED).select("text", "start", "end", "label")
    return [tuple(r) for r in picked.collect()]


def spans(text: str | None, net: Network) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score), by start and then in the order of KINDS."""
    text = text or ""
    base = base_spans(text)
    rest = list(candidates(text, base))
    scores = net.best(text, [(value, b) for _, _, b, value in base] + rest)
    found = [(kind, a, b, float(s)) for (kind, a, b, _), s in zip(base, scores, strict=False)]
    found += [("model", a, b, float(s)) for (a, b), s in zip(rest, scores[len(base) :], strict=True) if s >= net.threshold]
    found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return found


def _join(found) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in found)


def find_secrets(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """docs with a column `secrets`: struct of counts, digest, spans, and the network's score of each span."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long, scores string")
    def digest(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            found = spans(t, net)
            base = [s for s in found if s[0] != "model"]
            counts = [sum(s[0] == k for s in found) for k in KINDS]
            rows.append((*counts[:3], hashlib.sha256(_join(base).encode()).hexdigest(), _join(found), counts[3], ",".join(f"{s[3]:.3f}" for s in found)))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model", "scores"])

    return docs.withColumn("secrets", digest(F.col(text)))


def secret_digest(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """The contract's digest; n_model and scores follow. labelled: findings (text, start, end, label) to train on, if there are any."""
    found = labelled_findings(labelled) if labelled is not None else []
    net = train(found if {f[3] for f in found} == {0, 1} else made_findings())
    return find_secrets(docs.select("doc_id", "text"), net).select("doc_id", "secrets.*")
