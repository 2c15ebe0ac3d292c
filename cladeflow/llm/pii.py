"""Personal data: fixed patterns, and weak supervision for what they leave open.

Spans of the fixed patterns always stand.  Beside them, loose patterns propose candidates, and four labelers vote on
each: the strict pattern, a gazetteer of endings and prefixes, the words around, and the grouping of its signs.  The
votes of all documents are counted by kind and pattern; expectation-maximisation estimates from these counts how often
each labeler says what about true and false candidates, and a logistic span classifier is trained on the estimated
truth.  Candidates it is sure of, and that touch no fixed span, are added.

Defined cases: null and empty texts hold nothing.  Positions count code points, ends are exclusive.  Repeated rows are
searched row by row.  Without candidates nothing is added.  Very long runs of one kind of sign take linear time.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, texts

KINDS = ("email", "ip", "card", "phone")
SURE = 0.95
SPAN = "array<struct<kind:string,start:int,end:int>>"

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
FIXED = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": re.compile(r"[0-9](?:[ -]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][ ().0-9-]+[0-9]"),
}
LOOSE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\((?:at|At|AT)\)|\[(?:at|At|AT)\]|\{(?:at|At|AT)\}| (?:at|At|AT) ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\((?:dot|Dot|DOT)\)|\[(?:dot|Dot|DOT)\]|\{(?:dot|Dot|DOT)\}| (?:dot|Dot|DOT) ) ?[A-Za-z0-9-]{2,63}){1,4}"),
    "ip": re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9])(?:[0-9]{16,19}|[0-9]{4}([ ./_-])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])(?:\+[0-9]{1,3} ?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"),
}
# What a text must hold for a loose pattern to match anywhere: a substring test spares most texts the search.
NEEDED = {"email": ("dot", "Dot", "DOT"), "ip": (":",), "card": tuple("0123456789"), "phone": tuple("0123456789")}

# The gazetteers and cue words.
ENDINGS = {"com", "net", "org", "edu", "gov", "info", "io", "de", "fr", "es", "it", "uk", "nl", "eu", "ch", "at", "us", "ca", "au", "jp", "cn", "br", "in"}
CUES = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|address|courriel|correo)\b", re.I),
    "ip": re.compile(r"\b(?:ip|server|host|address|from|via|adresse)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|credit|payment|karte|carte|tarjeta)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|call|fax|mobile|fon|telefon|portable|llame)\b", re.I),
}
AGAINST = re.compile(r"\b(?:version|release|order|invoice|isbn|page|pages|section|build|serial|article|hash|sha|id)\b", re.I)


def luhn(digits: str) -> bool:
    """Whether the check digit holds."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def holds(kind: str, text: str) -> bool:
    """Whether a match of a fixed pattern passes its check."""
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 8 <= len(digits) <= 15


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of an address: a run of signs before an @, and a name with a dot behind it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            out.append((start, done))
        at = text.find("@", max(done, at + 1))
    return out


def matches(text: str) -> list[tuple[str, int, int, bool]]:
    """All matches of the fixed patterns with the outcome of their check, by kind and then by place."""
    out = [("email", a, b, True) for a, b in emails(text)]
    if not any(d in text for d in "0123456789"):
        return out
    for kind, pattern in FIXED.items():
        if kind == "phone" and "+" not in text:
            continue
        out += [(kind, m.start(), m.end(), holds(kind, m[0])) for m in pattern.finditer(text)]
    return out


@dataclass(frozen=True)
class Candidate:
    """A possible span: the votes of the labelers (1 yes, 0 no, 2 none) and what the classifier sees of it.

    ``fixed`` is 1 for a match of a fixed pattern, 0 for one that failed its check, 2 for a loose one.
    """

    kind: str
    start: int
    end: int
    votes: tuple[int, ...]
    seen: tuple[int, ...]
    fixed: int


def candidates(text: str) -> list[Candidate]:
    """Matches of the fixed patterns, and those of the loose ones that touch no fixed span."""
    found = [(k, a, b, int(ok)) for k, a, b, ok in matches(text) if ok or b - a >= 7]
    taken = [(a, b) for _, a, b, ok in found if ok]
    known = {x[:3] for x in found}
    for kind, pattern in LOOSE.items():
        if not any(x in text for x in NEEDED[kind]) or kind == "ip" and text.count(":") < 7:
            continue
        for m in pattern.finditer(text):
            a, b = m.span()
            if (kind, a, b) not in known and all(b <= c or d <= a for c, d in taken):
                found.append((kind, a, b, 2))
    return [_judged(text, *x) for x in found]


def _judged(text: str, kind: str, start: int, end: int, fixed: int) -> Candidate:
    span, before = text[start:end], text[max(0, start - 40):start]
    digits = re.sub("[^0-9]", "", span)
    whole = fixed < 2 or (kind == "email" and "@" in span) or (kind in FIXED and FIXED[kind].fullmatch(span))
    strict = int(holds(kind, span)) if whole else 2
    if kind == "email":
        listed = int(re.split(r"[^A-Za-z0-9]+", span.rstrip(".)]}"))[-1].lower() in ENDINGS)
        grouped = int(2 <= len(span.split("@")[-1].split(".")) <= 4) if "@" in span else int(" at " not in span.lower())
    elif kind == "ip":
        parts = span.split(".") if "." in span else span.split(":")
        listed = int(parts[0] not in ("0", "00", "255")) if "." in span else 2
        grouped = int(all(p == "0" or not p.startswith("0") for p in parts)) if "." in span else int(len({len(p) for p in parts}) <= 2)
    elif kind == "card":
        listed = int(digits[0] in "3456") if 16 <= len(digits) <= 19 else 0
        grouped = int(luhn(digits) and len(digits) <= 19)
    else:
        listed = int(digits[0] != "0") if span[0] == "+" else 2
        grouped = int(bool(re.fullmatch(r"\+?[0-9]{0,3} ?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}", span)) and len(set(digits)) > 2)
    cue, against = bool(CUES[kind].search(before)), bool(AGAINST.search(before))
    around = 1 if cue and not against else 0 if against and not cue else 2
    marks = len(set(re.sub("[0-9A-Za-z]", "", span)))
    alone = (start == 0 or not text[start - 1].isalnum()) and (end == len(text) or not text[end].isalnum())
    seen = (KINDS.index(kind), min(len(span) // 4, 7), min(marks, 3), int(alone), int(cue), int(against), listed, grouped, strict)
    return Candidate(kind, start, end, (strict, listed, around, grouped), seen, fixed)


SIZES = (4, 8, 4, 2, 2, 2, 3, 3, 3)      # values of each thing the classifier sees


def one_hot(seen: np.ndarray) -> np.ndarray:
    """Indicator of every value, alone and for each kind, and a constant."""
    parts = [np.ones((len(seen), 1))]
    for i, size in enumerate(SIZES):
        own = np.eye(size)[seen[:, i]]
        parts.append(own)
        if i:
            parts.append((np.eye(4)[seen[:, 0]][:, :, None] * own[:, None, :]).reshape(len(seen), -1))
    return np.concatenate(parts, 1)


def reliabilities(kinds: np.ndarray, votes: np.ndarray, counts: np.ndarray, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over counted vote patterns.

    Returns the probability that each pattern is true, and for each kind, labeler and truth how often it votes what.
    """
    yes, no = (votes == 1).sum(1), (votes == 0).sum(1)
    truth = np.clip((yes + 1) / (yes + no + 2), 0.05, 0.95)
    tables = np.zeros((len(KINDS), votes.shape[1], 2, 3))
    for _ in range(steps):
        for kind in range(len(KINDS)):
            mine = kinds == kind
            if not mine.any():
                continue
            weight = np.stack([(1 - truth[mine]) * counts[mine], truth[mine] * counts[mine]])
            share = (weight.sum(1) + 1) / (weight.sum() + 2)
            log = np.log(share)[:, None].repeat(mine.sum(), 1)
            for labeler in range(votes.shape[1]):
                prior = (99.0 if labeler == 0 else 1.0) * np.array([[2.0, 0.02, 1.0], [0.02, 2.0, 1.0]])      # the strict pattern is trusted from the start
                table = np.stack([weight[:, votes[mine, labeler] == v].sum(1) for v in range(3)], 1) + prior
                tables[kind, labeler] = table / table.sum(1, keepdims=True)
                log += np.log(tables[kind, labeler][:, votes[mine, labeler]])
            truth[mine] = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return truth, tables


def span_classifier(seen: np.ndarray, truth: np.ndarray, counts: np.ndarray, steps: int = 300) -> np.ndarray:
    """Weights of a logistic model of the estimated truth, by gradient steps over counted patterns."""
    x, weight = one_hot(seen), np.log1p(counts)
    weight = weight / weight.sum()
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 2.0 * (x.T @ (weight * (p - truth)) + 1e-4 * w)
    return w


def fit(docs: DataFrame) -> np.ndarray:
    """Weights of the span classifier, from the votes on the candidates of all documents.

    Tasks count patterns of votes and of what is seen; their number is bounded by the values these take, so
    only a bounded table of counts reaches the driver, whatever the number of documents.
    """
    def step(batch: pa.RecordBatch) -> dict:
        counted = Counter(c.votes + c.seen for text in texts(batch) for c in candidates(text))
        return {"pattern": [list(p) for p in counted], "many": list(counted.values())}

    rows = mapped(docs.select("text"), step, "pattern array<int>, many long").groupBy("pattern").agg(F.sum("many").alias("many")).collect()
    if not rows:
        return np.zeros(one_hot(np.zeros((1, len(SIZES)), int)).shape[1])
    rows = sorted((tuple(r["pattern"]), r["many"]) for r in rows)
    patterns, counts = np.array([p for p, _ in rows]), np.array([n for _, n in rows], float)
    truth, _ = reliabilities(patterns[:, 4], patterns[:, :4], counts)
    return span_classifier(patterns[:, 4:], truth, counts)


def find(docs: DataFrame, weights: np.ndarray, sure: float = SURE) -> DataFrame:
    """doc_id, fixed spans and added spans of every row."""
    limit = float(np.log(sure / (1 - sure)))

    def added(own: list[Candidate]) -> list[Candidate]:
        open_ones = [c for c in own if c.fixed == 2]
        if not open_ones:
            return []
        scores = one_hot(np.array([c.seen for c in open_ones])) @ weights
        taken = [(c.start, c.end) for c in own if c.fixed == 1]
        out = []
        for _, c in sorted(((-s, c) for s, c in zip(scores, open_ones, strict=True) if s >= limit), key=lambda x: (x[0], x[1].start, x[1].kind)):
            if all(c.end <= a or b <= c.start for a, b in taken):
                taken.append((c.start, c.end))
                out.append(c)
        return sorted(out, key=lambda c: (KINDS.index(c.kind), c.start))

    def step(batch: pa.RecordBatch) -> dict:
        base, more = [], []
        for text in texts(batch):
            own = candidates(text)
            span = lambda c: {"kind": c.kind, "start": c.start, "end": c.end}
            base.append([span(c) for c in own if c.fixed == 1])
            more.append([span(c) for c in added(own)])
        return {"doc_id": batch.column("doc_id"), "base": base, "added": more}

    return mapped(docs.select("doc_id", "text"), step, f"doc_id long, base {SPAN}, added {SPAN}")
