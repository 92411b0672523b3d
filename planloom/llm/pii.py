"""Operator 6: personal data by patterns and a skip-chain conditional random field.

The patterns fix the base spans, which always stay. The field then labels mentions:
runs of digits with phone, card or address punctuation, and words with an at sign. A
mention's own shape gives its unary potential; neighbours in the text share a chain
potential, and mentions with the same digits or address, however far apart, share a
skip potential, similar ones (one domain, the same last digits) a weaker one, so that a number written out in full once lends its label to its
shorter repetitions. Marginals come from damped loopy message passing per document;
mentions sure enough of a label and touched by no base span are added under its kind.
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

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# digit runs are taken whole: a start inside one can match no better than its own start
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NON_DIGIT = re.compile(r"[^0-9]")
DIGIT = re.compile(r"[0-9]")
#: Mention: a run of digits and their punctuation, or a word around an at sign.
NUMBER = re.compile(r"[+(]{0,2}[0-9](?:[\x20().-]{0,2}[0-9]){5,}")
ADDRESS = re.compile(r"[^\s@]{1,64}(?:@|\x20?[(\[]at[)\]]\x20?)[^\s@]{1,255}")

#: An at sign, plain or written around.
AT = re.compile(r"@|\x20?[(\[]at[)\]]\x20?")

SURE = 0.9
CHAIN_REACH = 60  # characters between neighbours that still share a potential
ROUNDS = 12
DOCUMENTS = 1500  # labelled documents of the generator


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping addresses: around each at sign, the longest local part not yet used."""
    out, used, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > used and text[start - 1] in LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            used = end = m.end()
        else:
            used = at + 1
        at = text.find("@", end)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = emails(text)
    if DIGIT.search(text):
        spans += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(_octet(p) for p in m[0].split("."))]
        for m in CARD.finditer(text):
            d = NON_DIGIT.sub("", m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                spans.append(("card", m.start(), m.end()))
        if "+" in text:
            spans += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(NON_DIGIT.sub("", m[0])) <= 15]
    return spans


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def mentions(text: str) -> list[tuple[int, int]]:
    found = []
    if "@" in text or "at)" in text or "at]" in text:
        found += [(m.start(), m.end()) for m in ADDRESS.finditer(text)]
    if DIGIT.search(text):
        found += [(m.start(), m.end()) for m in NUMBER.finditer(text)]
    out: list[tuple[int, int]] = []
    for s, e in sorted(found):
        if not out or s >= out[-1][1]:
            out.append((s, e))
    return out


def shape(text: str, start: int, end: int) -> list[float]:
    m = text[start:end]
    d = NON_DIGIT.sub("", m)
    groups = re.findall(r"[0-9]+", m)
    before = text[max(0, start - 12):start].lower()
    n = len(d)
    quad = len(groups) == 4 and m.count(".") == 3
    return [
        1.0, "@" in m, "." in m.rpartition("@")[2] and "@" in m, bool(re.search(r"[(\[]at[)\]]", m)), n < 9, 9 <= n <= 11, 12 <= n <= 12, 13 <= n <= 15, n == 16, n > 16,
        13 <= n <= 19 and luhn(d), quad, quad and all(_octet(g) for g in groups), m[:1] == "+" or before[-1:] == "+", "(" in m, "-" in m, " " in m, len(groups) == 1,
        bool(groups) and max(map(len, groups)) > 6, len(groups) > 1 and all(len(g) in (3, 4) for g in groups), len(groups) == 4 and all(len(g) == 4 for g in groups),
        any(w in before for w in ("tel", "call", "phone", "mobil")), any(w in before for w in ("card", "visa", "pay")), any(w in before for w in ("order", "no.", "id", "ref", "#", "version")),
        before[-1:].isalnum() or text[end:end + 1].isalnum(),
    ]


def identity(mention: str) -> str:
    """What repeated mentions have in common: an address, however its at sign is written, or the last seven digits."""
    if found := address(mention):
        return "@".join(found)
    return NON_DIGIT.sub("", mention)[-7:]


def likeness(mention: str) -> str:
    """What similar mentions have in common: the domain of an address, or the last four digits of a number."""
    if found := address(mention):
        return found[1]
    return NON_DIGIT.sub("", mention)[-4:]


def address(mention: str) -> list[str] | None:
    """Local part and domain, lower-cased, if there is an at sign or what stands for one."""
    parts = AT.split(mention.lower().strip(".,;:!?()<>\"'"))
    return parts if len(parts) == 2 else None


def edges(text: str, nodes: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain links between near neighbours; skip links from each mention to the one before of its identity; and such
    links to the one before that is only similar."""
    chain = [(i, i + 1) for i in range(len(nodes) - 1) if nodes[i + 1][0] - nodes[i][1] <= CHAIN_REACH]
    same: dict[str, int] = {}
    like: dict[str, tuple[int, str]] = {}
    skip, similar = [], []
    for i, (s, e) in enumerate(nodes):
        k, kin = identity(text[s:e]), likeness(text[s:e])
        if k in same:
            skip.append((same[k], i))
        elif kin in like and like[kin][1] != k:
            similar.append((like[kin][0], i))
        same[k], like[kin] = i, (i, k)
    return chain, skip, similar


class SkipChain:
    """Weights of the field: unary by shape, symmetric tables for links of each kind (chain, skip, similar)."""

    def __init__(self, features: int):
        k = len(LABELS)
        self.u, self.tables = np.zeros((features, k)), [np.zeros((k, k)) for _ in range(3)]

    def train(self, docs, rounds: int = 250, rate: float = 0.5, decay: float = 1e-4):
        """Pseudo-likelihood: each mention given the labels of those it is linked to."""
        k = len(LABELS)
        x, y, met = [], [], [[] for _ in self.tables]
        for feats, labels, *kinds in docs:
            for out, links in zip(met, kinds):
                seen = np.zeros((len(labels), k))
                for i, j in links:
                    seen[i, labels[j]] += 1
                    seen[j, labels[i]] += 1
                out.append(seen)
            x.append(feats), y.append(labels)
        x, y, met = np.concatenate(x), np.concatenate(y), [np.concatenate(m) for m in met]
        hot = np.eye(k)[y]
        for _ in range(rounds):
            z = x @ self.u + sum(m @ w for m, w in zip(met, self.tables))
            p = np.exp(z - z.max(axis=1, keepdims=True))
            g = (p / p.sum(axis=1, keepdims=True) - hot) / len(y)
            self.u -= rate * (x.T @ g + decay * self.u)
            for w, f in zip(self.tables, met):
                step = f.T @ g
                w -= rate * ((step + step.T) / 2 + decay * w)

    def marginals(self, feats: np.ndarray, *kinds, rounds: int = ROUNDS, damp: float = 0.3) -> np.ndarray:
        """Loopy sum-product over all kinds of links; its work is linear in mentions and links."""
        unary = feats @ self.u
        links = [(i, j, w) for pairs, w in zip(kinds, self.tables) for i, j in pairs]
        if links:
            i, j = np.array([x[0] for x in links]), np.array([x[1] for x in links])
            w = np.stack([x[2] for x in links])
            src, dst, pot = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([w, w])
            back = np.concatenate([np.arange(len(i)) + len(i), np.arange(len(i))])
            msg = np.zeros((len(src), len(LABELS)))
            for _ in range(rounds):
                total = unary.copy()
                np.add.at(total, dst, msg)
                out = (total[src] - msg[back])[:, :, None] + pot
                top = out.max(axis=1, keepdims=True)
                new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
                new -= new.max(axis=1, keepdims=True)
                msg = damp * msg + (1 - damp) * new
            unary = unary.copy()
            np.add.at(unary, dst, msg)
        p = np.exp(unary - unary.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def labelled_documents(count: int, seed: int):
    """Seeded documents with labelled mentions; later mentions of an entity may be shortened."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("bdfghklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4)))

    domains, tails = [f"{word()}.example.{r.choice(['com', 'org', 'net'])}" for _ in range(4)], [digits(4) for _ in range(4)]

    def card():
        body = digits(15)
        body += next(c for c in "0123456789" if luhn(body + c))
        return [body, " ".join(body[i:i + 4] for i in range(0, 16, 4)), "-".join(body[i:i + 4] for i in range(0, 16, 4))]

    def phone():
        a, b, c = digits(3), digits(3), r.choice([r.choice(tails), digits(4)])
        return [f"+1 ({a}) {b}-{c}", f"+1-{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a} {b} {c}"]

    def ip():
        return [".".join(str(r.randint(0, 255)) for _ in range(4))]

    def email():
        u, d = f"{word()}.{word()}{digits(2)}", r.choice([r.choice(domains), f"{word()}.example.{r.choice(['com', 'org', 'net'])}"])
        return [f"{u}@{d}", f"{u}@{d}", f"{u} [at] {d}", f"{u} (at) {d}"]

    def other():
        return [r.choice([lambda: digits(r.choice([6, 7, 8, 10, 12, 14, 16, 18])), lambda: f"20{digits(2)}-{digits(2)}-{digits(2)}", lambda: f"{digits(2)}.{digits(2)}.{digits(4)}", lambda: f"{r.randint(256, 999)}.{digits(3)}.{digits(3)}.{digits(3)}", lambda: f"{digits(3)}.{digits(3)}.{digits(3)}", lambda: f"@{word()}"])()]

    makers = {"email": email, "ip": ip, "card": card, "phone": phone, "none": other}
    for _ in range(count):
        parts, gold, at = [], [], 0
        entities = []
        for _ in range(r.randint(1, 4)):
            kind = r.choice(list(makers))
            forms = makers[kind]()
            entities += [(kind, forms[0] if kind == "phone" else r.choice(forms))] + [(kind, r.choice(forms)) for _ in range(r.choice([0, 1, 2]))]
        if r.random() < 0.5:
            r.shuffle(entities)
        for kind, form in entities:
            lead = " ".join(word() for _ in range(r.randint(2, 9))) + r.choice([" ", ". ", "\n", " tel ", " card "] if kind in ("phone", "card") else [" ", ". ", "\n", " order ", " id "])
            parts += [lead, form, r.choice([" ", ". ", ", "])]
            gold.append((at + len(lead), at + len(lead) + len(form), kind))
            at += len(lead) + len(form) + len(parts[-1])
        text = "".join(parts)
        nodes = mentions(text)
        labels = [next((LABELS.index(k) for s, e, k in gold if s < b and a < e), 0) for a, b in nodes]
        if nodes:
            yield text, nodes, np.array(labels)


@lru_cache(maxsize=4)
def trained(documents: int = DOCUMENTS, seed: int = 11) -> SkipChain:
    docs = [(np.array([shape(t, s, e) for s, e in nodes], float), labels, *edges(t, nodes)) for t, nodes, labels in labelled_documents(documents, seed)]
    model = SkipChain(docs[0][0].shape[1])
    model.train(docs)
    return model


def all_spans(text: str, model: SkipChain, sure: float = SURE):
    """Base spans, and base with added spans, both by kind and start."""
    base = sorted(base_spans(text), key=lambda x: (KINDS.index(x[0]), x[1]))
    nodes = mentions(text)
    if not nodes:
        return base, base
    taken = sorted((s, e) for _, s, e in base)
    starts, ends = np.array([s for s, _ in taken]), np.maximum.accumulate(np.array([e for _, e in taken])) if taken else None
    free = []
    for s, e in nodes:
        i = int(np.searchsorted(starts, e)) if taken else 0
        free.append(i == 0 or ends[i - 1] <= s)
    if not any(free):
        return base, base
    p = model.marginals(np.array([shape(text, s, e) for s, e in nodes], float), *edges(text, nodes))
    extra = [(LABELS[int(q.argmax())], s, e) for (s, e), ok, q in zip(nodes, free, p) if ok and q.argmax() and q.max() >= sure]
    return base, sorted(base + extra, key=lambda x: (KINDS.index(x[0]), x[1]))


def join_spans(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


OUT = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _scan(model: SkipChain, names: list[str], sure: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [all_spans(t or "", model, sure) for t in batch.column("_text").to_pylist()]
            counts = [pa.array([sum(k == kind for k, *_ in b) for b, _ in found], pa.int64()) for kind in KINDS]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(names))] + counts + [pa.array([sha256(join_spans(b).encode()).hexdigest() for b, _ in found], pa.string()), pa.array([join_spans(a) for _, a in found], pa.string())],
                [*names, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return run


def scan_pii(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, sure: float = SURE, documents: int = DOCUMENTS) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all, if none are named) with counts and digest of the base spans, and all spans.

    Spans are ``kind:start:end`` in code points, end exclusive, by kind and start; null
    texts are empty. Texts are read whole, one row at a time; nothing is shuffled, and
    the work per text grows with its length. Repeated rows give repeated results; input
    columns named like an output are replaced; an empty table gives an empty result.
    """
    rows = without(docs, ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "_text"])
    names = keep if keep is not None else rows.columns
    src = rows.select(*[F.col(f"`{c}`") for c in names], F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([*src.drop("_text").schema.fields, *T.StructType.fromDDL(OUT).fields])
    return src.mapInArrow(_scan(trained(documents), list(names), sure), schema)


def op6_pii(spark, sf_dir: str) -> DataFrame:
    return scan_pii(table(spark, sf_dir, "documents"), keep=["doc_id"])
