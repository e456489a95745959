"""Personal data: base patterns, and a skip-chain conditional random field over what may be an entity."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: A whole token with a digit or an @; tokens without are passed over once.
_TOKEN = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
_RUN = re.compile(r"\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,14}(?![0-9])")


def digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def luhn(number: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(number)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            end = match.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def base_spans(text: str) -> dict[str, list[Span]]:
    """Spans of each kind by the base patterns; every scan is linear in the text."""
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = _emails(text)
    if _DIGIT.search(text):
        found["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := digits(m[0])) <= 19 and luhn(d):
                found["card"].append(m.span())
        if "+" in text:
            found["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return found


@dataclass
class Unit:
    """A place that may be an entity. ``label`` is the base kind's number, or None; ``key`` is what repeats of the entity share, and ``stem`` what similar ones do."""

    start: int
    end: int
    key: str
    shape: str
    label: int | None = None

    @property
    def stem(self) -> str:
        """The last seven digits, a local part without dots and tag, or an address's first three parts."""
        if self.key[0] == "@":
            return "@" + self.key[1:].partition("+")[0].replace(".", "")
        return self.key.rpartition(".")[0] if self.key[0] == "i" else self.key[0] + self.key[1:][-7:]


def _describe(text: str) -> tuple[str, str]:
    """(key, shape): the digits but for a country code, or an address's local part; and a class of form."""
    if "@" in text:
        return "@" + text.partition("@")[0].lower(), f"@{'.' in text.partition('@')[2]:d}"
    d = digits(text)
    dots = text.count(".")
    if dots == 3 and len(d) <= 12:
        return "i" + text, "ip"
    key = d if len(d) > 12 else d[-10:]
    return "n" + key, f"n{min(len(d), 20)}{'+' if text[0] == '+' else ''}{'L' if 13 <= len(d) <= 19 and luhn(d) else ''}"


def units_of(text: str, base: dict[str, list[Span]]) -> list[Unit]:
    """Base spans, then tokens with ``@`` or at least seven digits and runs of digit groups that no base span touches."""
    found = [Unit(a, b, *_describe(text[a:b]), k) for k, kind in enumerate(KINDS) for a, b in base[kind]]
    taken = sorted((u.start, u.end) for u in found)
    starts = [a for a, _ in taken]
    reach = np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []

    def free(a: int, b: int) -> bool:
        k = int(np.searchsorted(starts, b)) if starts else 0
        return k == 0 or reach[k - 1] <= a

    extra: list[Unit] = []
    for m in _TOKEN.finditer(text):
        token = m[0]
        if "@" not in token and len(digits(token)) < 7:
            continue
        body = token.strip(".,;:!?()[]{}<>\"'*#$%&|")
        a = m.start() + token.find(body)
        wanted = ("@" in body[1:-1]) if "@" in body else re.fullmatch(r"\+?[0-9().-]*", body) and 7 <= len(digits(body)) <= 19
        if body and wanted and free(a, a + len(body)):
            extra.append(Unit(a, a + len(body), *_describe(body)))
    covered = {(u.start, u.end) for u in extra}
    edges = sorted(covered)
    heads = [a for a, _ in edges]
    for m in _RUN.finditer(text):
        a, b = m.span()
        k = int(np.searchsorted(heads, b)) if heads else 0
        if free(a, b) and (k == 0 or edges[k - 1][1] <= a):
            extra.append(Unit(a, b, *_describe(m[0])))
    return sorted(found + extra, key=lambda u: (u.start, u.end))


EDGES = ("skip", "similar", "chain")


def edges_of(units: list[Unit]) -> list[tuple[int, int, int]]:
    """(unit, later or base unit, number in ``EDGES``) of a document's graph.

    Skip edges join each occurrence of a key to the next one, near or far, and every unlabelled one to its
    key's first base span of each kind. Similar edges join each occurrence of a stem to the next one
    of another key. Chain edges join neighbours at most 40 characters apart, whatever else joins them.
    """
    edges, last, alike = [], {}, {}
    seen: dict[str, dict[int, int]] = {}
    for i, u in enumerate(units):
        if u.label is not None:
            seen.setdefault(u.key, {}).setdefault(u.label, i)
    for i, u in enumerate(units):
        if u.label is None:
            edges += [(k, i, 0) for k in seen.get(u.key, {}).values() if k != last.get(u.key) and k < i]
            edges += [(i, k, 0) for k in seen.get(u.key, {}).values() if k > i]
        if u.key in last and not (last[u.key], i, 0) in edges[-len(KINDS) :]:
            edges.append((last[u.key], i, 0))
        stem = u.stem
        if stem in alike and units[alike[stem]].key != u.key:
            edges.append((alike[stem], i, 1))
        if i and u.start - units[i - 1].end <= 40:
            edges.append((i - 1, i, 2))
        last[u.key] = alike[stem] = i
    return list(dict.fromkeys(edges))


@dataclass
class Field:
    """Potentials: ``node[shape]`` are log-potentials of no entity and of each kind; ``skip``, ``similar`` and ``chain`` what equal labels at the two ends of an edge add."""

    node: dict[str, list[float]] = field(default_factory=dict)
    skip: float = 9.0
    similar: float = 4.0
    chain: float = 0.0

    def labels(self, units: list[Unit]) -> np.ndarray:
        """The likeliest label of each unit (0: none), by loopy sum-product message passing over ``edges_of``.

        Base spans are observed. Edges between the same two units add up. Messages pass, half
        damped, until they settle: they cross an edge a round, so the bound of four
        rounds an edge only ends what would swing for ever. An edge moves a label's odds by no more than its weight,
        so where no unlabelled unit's edges outweigh its node there are no rounds.
        """
        n, m = len(units), len(KINDS) + 1
        node = np.array([self.node.get(u.shape, [0.0] + [-3.0] * len(KINDS)) for u in units])
        open_ = np.array([u.label is None for u in units])
        for i, u in enumerate(units):
            if u.label is not None:
                node[i] = -np.inf
                node[i, u.label + 1] = 0.0
        weight = (self.skip, self.similar, self.chain)
        joined: dict[tuple[int, int], float] = {}
        for i, k, kind in edges_of(units):
            pair = (min(i, k), max(i, k))
            joined[pair] = joined.get(pair, 0.0) + weight[kind]
        joined = {p: w for p, w in joined.items() if w and (open_[p[0]] or open_[p[1]])}
        if not joined:
            return node.argmax(1)
        a, b = np.array(list(joined)).T
        bonus = np.array(list(joined.values()))
        reach = np.bincount(a, abs(bonus), n) + np.bincount(b, abs(bonus), n)
        if (node[open_, 0] - node[open_, 1:].max(1) > reach[open_]).all():
            return node.argmax(1)
        source, target = np.concatenate((a, b)), np.concatenate((b, a))
        back = np.concatenate((np.arange(len(a)) + len(a), np.arange(len(a))))
        gain = np.exp(np.concatenate((bonus, bonus)))[:, None] - 1
        messages = np.zeros((len(source), m))
        for _ in range(max(200, 4 * len(a))):
            belief = node.copy()
            np.add.at(belief, target, messages)
            out = belief[source] - messages[back]
            out = np.exp(out - out.max(1, keepdims=True))
            new = np.log(out.sum(1, keepdims=True) + gain * out)  # equal labels count exp(bonus) times
            new -= new.max(1, keepdims=True)
            change = abs(new - messages).max()
            messages = 0.5 * messages + 0.5 * new
            if change < 1e-6:
                break
        belief = node.copy()
        np.add.at(belief, target, messages)
        return belief.argmax(1)

    def spans(self, text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
        """Base spans, and all spans, of a text."""
        base = base_spans(text)
        units = units_of(text, base)
        every = {k: list(v) for k, v in base.items()}
        if any(u.label is None for u in units):
            for u, label in zip(units, self.labels(units), strict=True):
                if u.label is None and label:
                    every[KINDS[label - 1]].append((u.start, u.end))
        return base, {k: sorted(v) for k, v in every.items()}


def evidence(units: list[Unit]) -> Iterator[tuple[str, int, str]]:
    """(shape, label, what its edges lead to) of each unit whose label is sure: a base span's, or none where no base span of the document has the unit's key or stem.

    What edges lead to is the numbers of sure neighbours by edge and label, as ``edge.label`` marks.
    """
    named = {u.key for u in units if u.label is not None} | {u.stem for u in units if u.label is not None}
    label = [u.label + 1 if u.label is not None else None if u.key in named or u.stem in named else 0 for u in units]
    around: list[list[str]] = [[] for _ in units]
    for i, k, kind in edges_of(units):
        # Places that overlap are one entity read twice, and say nothing of two.
        if label[i] is not None and label[k] is not None and max(units[i].start, units[k].start) >= min(units[i].end, units[k].end):
            around[i].append(f"{kind}.{label[k]}")
            around[k].append(f"{kind}.{label[i]}")
    for u, y, marks in zip(units, label, around, strict=True):
        if y is not None:
            yield u.shape, y, " ".join(sorted(marks))


def weights_of(rows: list[tuple[list[float], int, str, float]], prior: tuple[float, ...], spread: float = 1.0) -> np.ndarray:
    """Edge weights of largest pseudo-likelihood under a normal prior, by Newton steps.

    Rows are (log-potentials of the unit's shape, label, marks of ``evidence``, how often). A unit's label
    is given its neighbours': its odds are those of its node plus, for every edge, the edge's weight at the neighbour's label.
    """
    m = len(KINDS) + 1
    node = np.array([r[0] for r in rows]).reshape(-1, m)
    y, n = np.array([r[1] for r in rows], int), np.array([r[3] for r in rows], float)
    around = np.zeros((len(rows), m, len(EDGES)))
    for k, r in enumerate(rows):
        for mark in r[2].split():
            around[k, int(mark[2:]), int(mark[0])] += 1
    mean, w = np.array(prior), np.array(prior)

    def value(w):
        score = node + around @ w
        top = score.max(1, keepdims=True)
        return float((n * (score[np.arange(len(y)), y] - top[:, 0] - np.log(np.exp(score - top).sum(1)))).sum() - ((w - mean) ** 2).sum() / (2 * spread))

    for _ in range(100):
        score = node + around @ w
        p = np.exp(score - score.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        expected = np.einsum("rl,rlk->rk", p, around)
        slope = (n[:, None] * (around[np.arange(len(y)), y] - expected)).sum(0) - (w - mean) / spread
        second = np.einsum("r,rl,rlj,rlk->jk", n, p, around, around) - np.einsum("r,rj,rk->jk", n, expected, expected)
        step = np.linalg.solve(second + np.eye(len(w)) / spread, slope)
        now = value(w)
        while value(w + step) < now and abs(step).max() > 1e-9:
            step = step / 2
        w = w + step
        if abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, unlabelled: float = 0.5, share: float = 0.001, prior: tuple[float, float, float] = (9.0, 4.0, 0.0)) -> Field:
    """Learn the potentials from all documents, with base spans as labels.

    Tasks count units by shape, label and what their edges lead to (``evidence``); Spark adds the
    counts up, some thousands of rows at most whatever the input, since an edge leads to one of few labels and
    a sure unit has few edges. A unit without a base label counts as none with weight ``unlabelled``, since it
    may be an entity that the patterns miss. Node potentials are logs of each label's share of its shape
    plus ``share``, so they are the same for a table and for many copies of it, and a shape that never has a
    label stays within log(1 / ``share``) of one. Edge weights are trained from the same counts by
    pseudo-likelihood; ``prior`` is where skip, similar and chain weights start from, with the strength of about one
    document. Null texts have no units; rows that repeat count as often.
    """
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for frame in frames:
            for t in frame["text"]:
                if "@" in t or _DIGIT.search(t):
                    total.update(evidence(units_of(t, base_spans(t))))
        yield pd.DataFrame([(*k, n) for k, n in total.items()], columns=["shape", "label", "marks", "n"])

    got = docs.where("text is not null").select("text").mapInPandas(count, "shape string, label int, marks string, n long").groupBy("shape", "label", "marks").agg(F.sum("n").alias("n")).orderBy("shape", "label", "marks").collect()
    counts: dict[str, list[float]] = {}
    for r in got:
        counts.setdefault(r["shape"], [0.0] * (len(KINDS) + 1))[r["label"]] += r["n"] * (1.0 if r["label"] else unlabelled)
    node = {s: [math.log(c / sum(row) + share) for c in row] for s, row in counts.items()}
    rows = [(node[r["shape"]], r["label"], r["marks"], r["n"] * (1.0 if r["label"] else unlabelled)) for r in got if r["marks"]]
    skip, similar, chain = (float(min(12.0, max(-12.0, x))) for x in (weights_of(rows, prior) if rows else prior))
    return Field(node, skip, similar, chain)


def shown(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def find(docs: DataFrame, model: Field) -> DataFrame:
    """doc_id, counts of base spans, ``base_sha256``, ``spans`` (all) and ``n_added`` of every document.

    A null or empty text has no spans; a null doc_id stays null; rows that repeat give repeated results. Texts of any
    length are read whole, in time that grows with them. An empty table gives no rows; other columns are not read.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for t in frame["text"]:
                base, every = model.spans(t)
                out.append((*(len(base[k]) for k in KINDS), hashlib.sha256(shown(base).encode()).hexdigest(), shown(every), sum(map(len, every.values())) - sum(map(len, base.values()))))
            yield pd.DataFrame(out, columns=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]).assign(doc_id=frame["doc_id"].astype("Int64").to_numpy(dtype=object))

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return slim.mapInPandas(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame, model: Field) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; overlapping spans become one. Null texts stay null, and all other columns as they are."""
    def clean(text: str | None) -> str | None:
        if not text:
            return text
        spans = sorted((a, -b, k) for k, v in model.spans(text)[1].items() for a, b in v)
        out, at = [], 0
        for a, b, k in spans:
            if a >= at:
                out += [text[at:a], f"<{k.upper()}>"]
            at = max(at, -b)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("text")
            yield batch.set_column(k, batch.schema.field(k), pa.array([clean(t) for t in batch.column(k).to_pylist()], batch.schema.field(k).type))

    return docs.mapInArrow(run, docs.schema)
