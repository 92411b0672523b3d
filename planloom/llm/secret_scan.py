"""Operator 2: secrets by patterns and by a character convolution over candidates in context.

The patterns fix the base spans, which always stay. They are candidates, and so is
every other long run of key characters that holds a digit or a capital among its
letters. A candidate's characters and those around it go through a small convolutional
network, a long one in windows that overlap by half. Base spans that the network
confirms are counted; other candidates whose highest score reaches their group's
threshold are added as kind ``cnn``. The network is trained in numpy on labelled
findings from a seeded generator, whose harmless ones (long identifiers, dotted names,
digests of files) resemble secrets. A part that was not trained on calibrates the
scores, and on a third part each group's threshold is set: the highest that keeps the
asked share of its secrets.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planloom.llm.columns import table, without

KINDS = ("assign", "access", "hex", "cnn")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Candidate: 12 or more key characters with letters, and a digit or a capital after a small letter among them.
RUN = re.compile(r"(?<![A-Za-z0-9+/_=.-])(?=[A-Za-z0-9+/_=.-]{12})(?=[^A-Za-z]{0,11}[A-Za-z])(?=[A-Za-z+/_=.-]*+[0-9]|[A-Z+/_=.-]*+[a-z][a-z+/_=.-]*+[A-Z])[A-Za-z0-9+/_=.-]*[A-Za-z0-9+/_=-]")
MIXED = re.compile(r"[0-9]|[a-z][+/_=.-]*[A-Z]")
HAS_DIGIT = re.compile(r"[0-9]")

BEFORE, INSIDE, AFTER = 20, 36, 8
WIDTH = BEFORE + INSIDE + AFTER
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 .:=\"'+/_-@"
CODES = {c: i + 2 for i, c in enumerate(ALPHABET)}  # 0 pads, 1 is any other character
RECALL = 0.98  # of labelled secrets that each group's threshold keeps
FINDINGS = 6000


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = []
    if ":" in text or "=" in text:
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if HAS_DIGIT.search(text) or HEX.search(text):
        spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def value_start(text: str, kind: str, start: int) -> int:
    """Where the secret itself begins in a base span."""
    return ASSIGN.match(text, start).start(1) if kind == "assign" else start


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Runs that no base span touches."""
    if not MIXED.search(text):
        return []
    out, i = [], 0
    reach, edges = 0, sorted((s, e) for _, s, e in taken)
    for m in RUN.finditer(text):
        if m.end() - m.start() < 12:
            continue
        while i < len(edges) and edges[i][0] < m.end():
            reach = max(reach, edges[i][1])
            i += 1
        if reach <= m.start():
            out.append((m.start(), m.end()))
    return out


def starts(start: int, end: int) -> list[int]:
    """Where the windows of a candidate begin: each half a window on, the last one ends with the candidate."""
    return [*range(start, end - INSIDE, INSIDE // 2), max(start, end - INSIDE)]


def encode(text: str, start: int, end: int) -> np.ndarray:
    """A candidate's first window: up to INSIDE of its characters, those before it and those after its end."""
    return encode_window(text, start, end, start)


def encode_window(text: str, start: int, end: int, at: int) -> np.ndarray:
    """The window at ``at``, between what stands before the candidate and what stands after it."""
    parts = (text[max(0, start - BEFORE):start].rjust(BEFORE, "\0"), text[at:min(end, at + INSIDE)].ljust(INSIDE, "\0"), text[end:end + AFTER].ljust(AFTER, "\0"))
    return np.array([0 if c == "\0" else CODES.get(c, 1) for c in "".join(parts)], np.uint8)


def highest(net, found: list[tuple[str, int, int]], batch: int = 2048) -> np.ndarray:
    """Highest probability over the windows of each candidate (text, start, end); a batch of windows at a time."""
    best = np.zeros(len(found))
    owner, rows = [], []

    def flush():
        np.maximum.at(best, owner, net.probability(np.stack(rows)))
        owner.clear(), rows.clear()

    for i, (text, start, end) in enumerate(found):
        for at in starts(start, end):
            owner.append(i)
            rows.append(encode_window(text, start, end, at))
            if len(rows) == batch:
                flush()
    if rows:
        flush()
    return best


def assigned(text: str, start: int) -> int:
    """Group of a candidate: 1 if what stands right before it gives it to a name."""
    return int(bool(re.search(r"[:=][\x20\"']*$", text[max(0, start - 8):start])))


class CharNet:
    """Embedding, one convolution, max and mean pooling, one output; plain numpy."""

    def __init__(self, seed: int, dim: int = 8, taps: int = 5, filters: int = 24):
        r = np.random.default_rng(seed)
        self.taps = taps
        self.p = {
            "e": r.normal(0, 0.3, (len(ALPHABET) + 2, dim)),
            "k": r.normal(0, 1 / np.sqrt(taps * dim), (taps * dim, filters)),
            "b": np.zeros(filters),
            "o": r.normal(0, 0.2, 2 * filters),
            "c": np.zeros(1),
        }
        self.a, self.m, self.groups = 1.0, 0.0, (0.5, 0.5)

    def forward(self, x: np.ndarray):
        emb = self.p["e"][x]
        n, w, d = emb.shape
        cols = np.concatenate([emb[:, j : w - self.taps + 1 + j] for j in range(self.taps)], axis=2)
        act = np.maximum(cols @ self.p["k"] + self.p["b"], 0)
        top = act.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(act, top[:, None], 1)[:, 0], act.mean(axis=1)], axis=1)
        return pooled @ self.p["o"] + self.p["c"][0], (cols, act, top, pooled)

    def gradients(self, x, y):
        z, (cols, act, top, pooled) = self.forward(x)
        dz = (1 / (1 + np.exp(-z)) - y) / len(y)
        g = {"o": pooled.T @ dz, "c": np.array([dz.sum()])}
        f = act.shape[2]
        dp = dz[:, None] * self.p["o"][None]
        da = np.repeat(dp[:, None, f:] / act.shape[1], act.shape[1], axis=1)
        np.put_along_axis(da, top[:, None], np.take_along_axis(da, top[:, None], 1) + dp[:, None, :f], 1)
        da *= act > 0
        g["b"] = da.sum(axis=(0, 1))
        g["k"] = np.tensordot(cols, da, ([0, 1], [0, 1]))
        dcols = da @ self.p["k"].T
        g["e"] = np.zeros_like(self.p["e"])
        d = self.p["e"].shape[1]
        for j in range(self.taps):
            np.add.at(g["e"], x[:, j : j + act.shape[1]], dcols[:, :, j * d : (j + 1) * d])
        return g

    def train(self, x, y, rounds: int, rate: float, seed: int, batch: int = 64):
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(u) for k, u in self.p.items()}
        t = 0
        for _ in range(rounds):
            order = r.permutation(len(x))
            for i in range(0, len(x), batch):
                t += 1
                for k, g in self.gradients(x[order[i : i + batch]], y[order[i : i + batch]]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, x, y):
        """Platt scaling."""
        z, a, m = self.forward(x)[0], 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-(a * z + m)))
            w = p * (1 - p) + 1e-6
            h = np.array([[np.sum(w * z * z) + 1e-3, np.sum(w * z)], [np.sum(w * z), np.sum(w) + 1e-3]])
            step = np.linalg.solve(h, np.array([np.sum((p - y) * z), np.sum(p - y)]))
            a, m = a - 0.5 * step[0], m - 0.5 * step[1]
        self.a, self.m = float(a), float(m)

    def choose(self, p, y, groups, recall: float):
        """The highest threshold of each group that keeps ``recall`` of its secrets, whose probabilities are ``p``."""
        self.groups = tuple(float(np.quantile(p[(groups == g) & (y == 1)], 1 - recall, method="lower")) for g in (0, 1))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.forward(x)[0] + self.m, -50, 50)))


def labelled_findings(count: int, seed: int, long: bool = False):
    """Seeded findings with labels: (text, start, end, secret or not).

    ``long``: some are longer than a window, their secret behind a harmless head; a fifth
    item is where the secret begins.
    """
    r = random.Random(seed)
    letters, lower, upper, digits = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    vowels, cons = "aeiou", "bcdfghklmnprstvw"
    word = lambda: "".join(r.choice(cons) + r.choice(vowels) + r.choice(["", "n", "r", "s", "t"]) for _ in range(r.randint(1, 4)))
    prose = lambda: " ".join(word() for _ in range(r.randint(3, 6)))
    names = ["key", "auth", "access_key", "private_key", "client_secret", "bearer", "credential", "pwd", "signature", "session"]
    plain = ["name", "file", "id", "page", "ref", "item", "path", "version", "label", "class"]

    def secret():
        return r.choice([
            lambda: pick(letters + digits, r.randint(16, 48)),
            lambda: pick(letters + digits + "+/", r.randint(24, 64)) + r.choice(["", "=", "=="]),
            lambda: r.choice(["sk_live_", "pk_live_", "ghp_", "xoxb-", "glpat-", "rk_"]) + pick(letters + digits, r.randint(20, 36)),
            lambda: pick(upper + digits, r.randint(16, 32)),
            lambda: pick(lower + digits, r.randint(20, 40)),
            lambda: "-".join(pick(letters + digits, 8) for _ in range(r.randint(3, 5))),
            lambda: pick(letters, r.randint(20, 44)),
            lambda: pick("0123456789abcdef", r.choice([16, 20, 32, 40, 64])),
            lambda: "AKIA" + pick(upper + digits, 16),
            lambda: "eyJ" + ".".join(pick(letters + digits + "-_", r.randint(16, 40)) for _ in range(3)),
        ])()

    def harmless():
        return r.choice([
            lambda: word() + "-" + word() + "-" + pick(digits, r.randint(1, 4)),
            lambda: word() + word() + word() + pick(digits, r.randint(1, 3)),
            lambda: "_".join([word(), word(), pick(digits, r.randint(1, 2))]),
            lambda: "/".join([word(), word(), word() + pick(digits, 1)]),
            lambda: f"20{pick(digits, 2)}-{pick('01', 1)}{pick(digits[1:3], 1)}-{pick('012', 1)}{pick(digits, 1)}T{pick(digits, 2)}",
            lambda: "v" + pick(digits, 1) + "-" + word() + "-" + word() + "-build" + pick(digits, 3),
            lambda: word().capitalize() + word().capitalize() + word().capitalize() + pick(digits, 2),
            lambda: word() * r.randint(3, 5) + pick(digits, 1),
            lambda: word().upper() + "-" + pick(digits, 4) + "-" + word().upper(),
            lambda: ".".join([word(), word(), word() + pick(digits, 1)]),
            lambda: word() + "".join(word().capitalize() for _ in range(r.randint(2, 4))),
            lambda: pick("0123456789abcdef", 8) + "-" + word() + "." + r.choice(["txt", "json", "html"]),
            lambda: word() + pick(letters + digits, 4) + word() + pick(digits, 2),
        ])()

    def long_harmless():
        return r.choice(["/", "_", "-"]).join([*(word() for _ in range(r.randint(8, 30))), word() + pick(digits, r.randint(1, 3))])

    out = []
    while len(out) < count:
        good = r.random() < 0.5
        body, hidden = secret() if good else harmless(), 0
        if long and r.random() < 0.3:
            if good:  # after a head of its own, often longer than a window
                head = r.choice(["/", "_", "-"]).join(word() for _ in range(r.randint(4, 24))) + r.choice(["/", "=", "_"])
                body, hidden = head + body, len(head)
            else:
                body = long_harmless()
        lead = r.choice([prose() + " ", prose() + f" {r.choice(names if good or r.random() < 0.2 else plain)}{r.choice([' = ', ': ', '=', ' = ' + chr(34), ': ' + chr(39)])}"])
        text = lead + body + r.choice([" ", '" ', ". ", "\n", ", "]) + prose()
        if RUN.fullmatch(body):
            out.append((text, len(lead), len(lead) + len(body), int(good), len(lead) + hidden) if long else (text, len(lead), len(lead) + len(body), int(good)))
    return out


@lru_cache(maxsize=4)
def trained(findings: int = FINDINGS, recall: float = RECALL, seed: int = 7) -> CharNet:
    rows = labelled_findings(findings, seed, long=True)
    y = np.array([v for *_, v, _ in rows], np.float64)
    g = np.array([assigned(t, s) for t, s, *_ in rows])
    net, cut, last = CharNet(seed), findings * 3 // 5, findings * 4 // 5

    def windows(part):
        """Labelled windows: a secret's are those with at least 12 of its characters, or its most; fewer are left out, and none make it harmless."""
        x, label = [], []
        for t, s, e, v, body in part:
            at = starts(s, e)
            held = [min(e, a + INSIDE) - max(a, body) for a in at]
            for a, n in zip(at, held):
                if not v or n >= min(12, max(held)) or n <= 0:
                    x.append(encode_window(t, s, e, a))
                    label.append(v and n > 0)
        return np.stack(x), np.array(label, np.float64)

    net.train(*windows(rows[:cut]), rounds=6, rate=0.01, seed=seed)
    net.calibrate(*windows(rows[cut:last]))
    net.choose(highest(net, [r[:3] for r in rows[last:]]), y[last:], g[last:], recall)
    return net


def join_spans(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _scan(net: CharNet, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            bases = [base_spans(t) for t in texts]
            held = [(i, value_start(texts[i], k, s), e) for i, b in enumerate(bases) for k, s, e in b]
            free = [(i, s, e) for i, t in enumerate(texts) for s, e in candidates(t, bases[i])]
            spans, sure = [list(b) for b in bases], np.zeros(len(texts), np.int64)
            scores = highest(net, [(texts[i], s, e) for i, s, e in held + free])
            for at, ((i, s, e), q) in enumerate(zip(held + free, scores)):
                if q >= net.groups[assigned(texts[i], s)]:
                    sure[i] += 1
                    if at >= len(held):
                        spans[i].append(("cnn", s, e))
            for s in spans:
                s.sort(key=lambda x: (x[1], KINDS.index(x[0])))
            count = lambda kind: pa.array([sum(k == kind for k, *_ in b) for b in bases], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(names))] + [count("assign"), count("access"), count("hex"), pa.array([sha256(join_spans(b).encode()).hexdigest() for b in bases]), pa.array([join_spans(s) for s in spans]), pa.array(sure)],
                [*names, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_sure"])

    return run


OUT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_sure long"


def scan_secrets(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, findings: int = FINDINGS, recall: float = RECALL) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all, if none are named) with counts, digest and list of the spans found,
    and ``n_sure``, how many candidates, base spans among them, the network takes for secrets.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and kind; null
    texts are empty. The text is read whole, one row at a time; nothing is shuffled.
    Repeated rows give repeated results; input columns named like an output are
    replaced; an empty table gives an empty result.
    """
    rows = without(docs, ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_sure", "_text"])
    names = keep if keep is not None else rows.columns
    src = rows.select(*[F.col(f"`{c}`") for c in names], F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([*src.drop("_text").schema.fields, *T.StructType.fromDDL(OUT).fields])
    return src.mapInArrow(_scan(trained(findings, recall), list(names)), schema)


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
