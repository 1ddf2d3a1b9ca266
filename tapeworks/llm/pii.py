"""Personal data: fixed patterns, then a skip-chain conditional random field per document.

The patterns find the base spans, which always stay. The field labels the words that hold a digit or an ``@`` (no
other word can be part of one) as email, ip, card, phone or none. Its potentials are

* features of the word's shape,
* a chain potential between neighbouring words, and
* a skip potential between repeated or similar words anywhere in the document: the same word whatever its case, or
  the same digits however they are grouped. A number may run over several words, so up to ``RUN`` neighbouring number
  words are read as one and compared by their last ten digits (a country code may be missing). A number that a pattern
  found is joined to every other writing of it, before or after; other words are joined to the occurrence before
  them, so a word that comes a thousand times adds a thousand edges, not a million.

Weights are learned by pseudo-likelihood on a bounded sample of documents, labelled by the patterns. The patterns
alone would teach the field nothing but themselves, so each sampled document is seen a second time with some of its
numbers written again in a form that no pattern knows (``rewritten``, labelled as the number it repeats) next to other
digits in the same form (labelled none): only the skip potential tells these apart. Inference is loopy belief
propagation with a fixed number of rounds over documents of about ``SLICE`` characters together; words inside base
spans are held to their label. Words that no pattern matched, that the field is sure of and that a skip edge ties to a
number of that label become further spans: a phone
number repeated without its plus sign, a card whose digits are grouped by dots.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.shared import hashed_share, with_package

# Fixed values of the contract: kinds in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

WORD = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*")
HINT = re.compile(r"[0-9@]")
NOT_DIGIT = re.compile(r"[^0-9]+")
EDGE = re.compile(r"^[^0-9A-Za-z+(]*|[^0-9A-Za-z)]*$")

SAMPLE_DOCS = 2_000  # documents that the field is trained on, at most
SURE = 0.9  # probability from which a word becomes a span
ROUNDS = 8  # of message passing
DAMPING = 0.3
STEPS = 400  # of training
RATE = 1.0
LINKED = 20.0  # weight in training of a word that a skip edge joins to a number, next to 1 for others
LABELS = 1 + len(KINDS)
SIMILAR_DIGITS = 7  # numbers with as many digits are similar when the last ten agree
RUN = 5  # words that one number may run over
NUMBER = re.compile(r"[0-9()+./_,;:!?-]+")  # a word that is part of a number and nothing else
SLICE = 200_000  # characters of the documents that are inferred together
SAMPLE_CHARS = 4_000_000  # of the sampled documents together
EDGES = 100_000  # messages that are computed together


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _byte_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; linear in the text."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = last + len(text[last:at].rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((0, start, found.end()))
            at, last = text.find("@", found.end()), found.end()
        else:
            at, last = text.find("@", at + 1), at + 1
    for m in IP.finditer(text):
        if all(map(_byte_part, m.groups())):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m.group())
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((3, m.start(), m.end()))
    return out


_FEATURES = ("any", "at", "at_dot", "quad", "quad_ok", "luhn", "plus", "paren", "letters", "dashed", "d1_3", "d4_6", "d7_9",
             "d10_15", "d16_19", "d20", "only_digits")


def _shape(word: str) -> list[int]:
    digits = NOT_DIGIT.sub("", word)
    n, quad = len(digits), IP.search(word)
    has = (True, "@" in word, "@" in word and "." in word.partition("@")[2], bool(quad),
           bool(quad) and all(map(_byte_part, quad.groups())), 16 <= n <= 19 and _luhn(digits), "+" in word, "(" in word,
           any(c.isalpha() for c in word), "-" in word, 0 < n < 4, 4 <= n < 7, 7 <= n < 10, 10 <= n < 16, 16 <= n < 20,
           n >= 20, n == len(word))
    return [i for i, x in enumerate(has) if x]


class Graph:
    """The words of several documents with their features, edges and, inside base spans, labels."""

    def __init__(self, texts: list[str | None], told: list[list[tuple[int, int, int]]] | None = None):
        """``told``: labelled spans of each text besides the base ones, for training."""
        self.base: list[list[tuple[int, int, int]]] = []
        self.doc, self.start, self.end, self.label = [], [], [], []
        self.rows, self.columns, self.chain, self.skip = [], [], [], []
        for d, text in enumerate(texts):
            spans = base_spans(text) if text and HINT.search(text) else []
            self.base.append(spans)
            if text and HINT.search(text):
                self._add(d, text, spans, told[d] if told else [])
        self.label = np.array(self.label, np.int64)
        self.rows, self.columns = np.array(self.rows, np.int64), np.array(self.columns, np.int64)
        self.chain = np.array(self.chain, np.int64).reshape(-1, 2)
        self.skip = np.array(self.skip, np.int64).reshape(-1, 2)

    def _add(self, d: int, text: str, spans: list[tuple[int, int, int]], told: list[tuple[int, int, int]]) -> None:
        by_start, k, open_, seen, before = sorted((s, e, kind) for kind, s, e in spans + told), 0, [], {}, None
        first = len(self.doc)
        numbers: list[str | None] = []  # digits of the words that are nothing but a number
        adjacent, closed = [], []  # to the word before; by a mark that ends a number
        for m in WORD.finditer(text):
            node, (s, e) = len(self.doc), m.span()
            while k < len(by_start) and by_start[k][0] < e:
                open_.append(by_start[k])
                k += 1
            open_ = [x for x in open_ if x[1] > s]
            word = m.group()
            marks = _shape(word)
            self.rows += [node] * len(marks)
            self.columns += marks
            self.doc.append(d)
            self.start.append(s)
            self.end.append(e)
            self.label.append(1 + min((x[2] for x in open_), default=-1))
            near = before is not None and not text[before:s].strip("\x20\t\n\x0b\x0c\r")
            adjacent.append(near)
            closed.append(word[-1] in ",;:!?")
            if near:
                self.chain.append((node - 1, node))
            before = e
            numbers.append(NOT_DIGIT.sub("", word) if NUMBER.fullmatch(word) else None)
            key = word.lower().strip(".,;:!?\"'()[]<>")
            if key in seen:
                self.skip.append((seen[key], node))
            seen[key] = node
        self._join_numbers(first, numbers, adjacent, closed, [(s, e) for kind, s, e in spans if kind != 0])

    def _join_numbers(self, first: int, numbers: list, adjacent: list[bool], closed: list[bool], spans: list[tuple[int, int]]) -> None:
        """Skip edges from the words of a number to the number of a base span with the same last ten digits, and
        else to the word before that has them."""
        of_span: dict[str, int] = {}
        inside = [-1] * len(numbers)  # the first word of the base span that a word is in
        starts = np.array(self.start[first:], np.int64)
        ends = np.array(self.end[first:], np.int64)
        for s, e in spans:
            lo, hi = int(np.searchsorted(ends, s, side="right")), int(np.searchsorted(starts, e, side="left"))
            digits = "".join(n or "" for n in numbers[lo:hi])
            for i in range(lo, hi):
                inside[i] = lo
            if len(digits) >= SIMILAR_DIGITS:
                of_span.setdefault(digits[-10:], lo)
        last: dict[str, int] = {}
        for i in range(len(numbers)):
            digits = ""
            for j in range(i, min(i + RUN, len(numbers))):
                if numbers[j] is None or (j > i and (not adjacent[j] or closed[j - 1])):
                    break
                digits += numbers[j]
                if len(digits) > 19:
                    break
                if len(digits) < SIMILAR_DIGITS:
                    continue
                key = digits[-10:]
                other = of_span.get(key)
                if other is None:
                    if j == i:
                        if key in last:
                            self.skip.append((first + last[key], first + i))
                        last[key] = i
                elif other not in inside[i:j + 1] and len(digits) - len(numbers[i]) < 10:  # the first word belongs to it
                    self.skip += [(first + other, first + x) for x in range(i, j + 1)]

    def unary(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.doc), LABELS))
        np.add.at(out, self.rows, weights[self.columns])
        return out


class Field:
    """Weights: feature x label, chain label x label, and what agreement over a skip edge is worth."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: float):
        self.unary, self.chain, self.skip = unary, chain, skip

    @classmethod
    def blank(cls) -> Field:
        return cls(np.zeros((len(_FEATURES), LABELS)), np.zeros((LABELS, LABELS)), 0.0)

    @classmethod
    def trained(cls, texts: list[str | None]) -> Field:
        """Maximise the pseudo-likelihood of the labels that the patterns and ``rewritten`` give, by AdaGrad on full batches."""
        again = [rewritten(t) for t in texts if t and base_spans(t)]
        g = Graph([*texts, *(t for t, _ in again)], [[] for _ in texts] + [told for _, told in again])
        f = cls.blank()
        n = len(g.doc)
        if not n:
            return f
        want = np.eye(LABELS)[g.label]
        a, b = g.chain.T
        near = np.zeros((n, LABELS))  # labels at the other ends of skip edges
        for x, y in (g.skip.T, g.skip.T[::-1]):
            np.add.at(near, x, want[y])
        share = np.where(near[:, 1:].any(axis=1), LINKED, 1.0)[:, None] / n
        sums = [np.full(f.unary.shape, 1e-6), np.full(f.chain.shape, 1e-6), 1e-6]
        for _ in range(STEPS):
            score = g.unary(f.unary) + f.skip * near
            np.add.at(score, a, f.chain[:, g.label[b]].T)
            np.add.at(score, b, f.chain[g.label[a]])
            p = np.exp(score - score.max(axis=1, keepdims=True))
            miss = (want - p / p.sum(axis=1, keepdims=True)) * share
            up = np.zeros_like(f.unary)
            np.add.at(up, g.columns, miss[g.rows])
            link = np.zeros_like(f.chain)
            np.add.at(link.T, g.label[b], miss[a])
            np.add.at(link, g.label[a], miss[b])
            steps = [up - 1e-5 * f.unary, link - 1e-5 * f.chain, float((miss * near).sum()) - 1e-5 * f.skip]
            for s, step in enumerate(steps):
                sums[s] = sums[s] + step * step
            f.unary = f.unary + RATE * steps[0] / np.sqrt(sums[0])
            f.chain = f.chain + RATE * steps[1] / np.sqrt(sums[1])
            f.skip += RATE * steps[2] / sums[2] ** 0.5
        return f

    def marginals(self, g: Graph) -> np.ndarray:
        """Probabilities of the labels of every word, by loopy message passing."""
        own = g.unary(self.unary)
        held = g.label > 0
        own[held] = -50.0
        own[held, g.label[held]] = 50.0
        agree = np.eye(LABELS) * self.skip
        pairs = np.concatenate([g.chain, g.skip])
        if len(pairs):
            kind = np.concatenate([np.zeros(len(g.chain), np.int64), np.ones(len(g.skip), np.int64)])
            tables = np.stack([self.chain, agree, self.chain.T, agree])
            source, target = np.concatenate([pairs, pairs[:, ::-1]]).T
            which = np.concatenate([kind, kind + 2])
            other = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
            message = np.zeros((len(source), LABELS))
            for _ in range(ROUNDS):
                belief = own.copy()
                np.add.at(belief, target, message)
                new = np.empty_like(message)
                for at in range(0, len(source), EDGES):
                    part = slice(at, at + EDGES)
                    given = belief[source[part]] - message[other[part]]
                    new[part] = _logsum(given[:, :, None] + tables[which[part]])
                message = DAMPING * message + (1 - DAMPING) * (new - new.max(axis=1, keepdims=True))
            own = own.copy()
            np.add.at(own, target, message)
        p = np.exp(own - own.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def _logsum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=1)) + top[:, 0]


def rewritten(text: str) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with its phone and card numbers written again as no pattern finds them, each followed by other digits
    in that form and by short numbers, and the spans of the repeats. The digits decide the form, so the same text gives the same."""
    parts, told, at = [text], [], len(text)
    for kind, s, e in base_spans(text):
        digits = NOT_DIGIT.sub("", text[s:e])
        if kind < 2 or len(digits) < SIMILAR_DIGITS:
            continue
        form = int(digits[-2:]) % 5
        other = "".join(str((int(c) * 7 + i * 3 + 1) % 10) for i, c in enumerate(digits))
        if kind == 2:  # as valid a card number
            other = next(o for o in (other[:-1] + str(c) for c in range(10)) if _luhn(o))
        for own, repeats in ((digits, True), (other, False)):
            if kind == 3 and form % 2 and len(own) >= 10:
                own = own[-10:]  # without the country code
            if kind == 2:
                shown = "./._."[form].join(own[i:i + 4] for i in range(0, len(own), 4))
            else:
                shown = (own, f"{own[:-7]}-{own[-7:-4]}-{own[-4:]}", f"({own[:-7]}) {own[-7:-4]}-{own[-4:]}",
                         f"{own[:-7]} {own[-7:-4]} {own[-4:]}", f"{own[:-7]} {own[-7:-4]}{own[-4:]}")[form].lstrip("- ").replace("() ", "")
            lead = " on " if repeats else " of "
            if repeats:
                told.append((kind, at + len(lead), at + len(lead) + len(shown)))
            parts.append(lead + shown)
            at += len(lead) + len(shown)
        plain = f" in {other[:4]} , {digits[-4:]} and {other[-5:]} pages"  # short numbers are no part of anything
        if kind == 2:  # nor is a number that only stands next to a card
            plain += f" .\n{digits}\n{other[:-1]}{(int(other[-1]) + 1) % 10} ."
        parts.append(plain)
        at += len(plain)
    new = "".join(parts)
    return new, [t for t in told if not any(a < t[2] and t[1] < b for _, a, b in base_spans(new))]


def find(texts: list[str | None], field: Field) -> tuple[list[list[tuple[int, int, int]]], list[list[tuple[int, int, int]]]]:
    """Base spans, and the spans that the field adds, of each text; about ``SLICE`` characters are inferred together."""
    base, added, part, size = [], [], [], 0
    for text in [*texts, None]:
        if part and (text is None and len(base) + len(part) == len(texts) or size + len(text or "") > SLICE):
            some, more = _find(part, field)
            base += some
            added += more
            part, size = [], 0
        if len(base) + len(part) < len(texts):
            part.append(text)
            size += len(text or "")
    return base, added


def _find(texts: list[str | None], field: Field) -> tuple[list[list[tuple[int, int, int]]], list[list[tuple[int, int, int]]]]:
    g = Graph(texts)
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if len(g.doc):
        p = field.marginals(g)
        best = p.argmax(axis=1)
        tied = np.zeros(len(g.doc), bool)  # to a base span of that label
        for x, y in (g.skip.T, g.skip.T[::-1]):
            tied[x[(g.label[y] > 0) & (g.label[y] == best[x])]] = True
        for node in np.flatnonzero(tied & (best > 0) & (p.max(axis=1) >= SURE) & (g.label == 0)).tolist():
            d, kind = g.doc[node], int(best[node]) - 1
            core = EDGE.sub("", texts[d][g.start[node]:g.end[node]])
            start = texts[d].index(core, g.start[node]) if core else g.end[node]
            if not core or any(s < start + len(core) and start < e for _, s, e in g.base[d]):
                continue
            last = added[d][-1] if added[d] else None
            if last and last[0] == kind and not texts[d][last[2]:start].strip("\x20\t\n\x0b\x0c\r"):
                added[d][-1] = (kind, last[1], start + len(core))
            else:
                added[d].append((kind, start, start + len(core)))
    return g.base, added


def train(docs: DataFrame, most: int = SAMPLE_DOCS) -> Field:
    """Fit on at most ``most`` documents holding a digit or an ``@``, chosen by hash, of ``SAMPLE_CHARS`` characters
    together at most; one task fits."""
    share = hashed_share(F.col("doc_id"), 13, 20.0 * most / max(1, docs.count()))
    texts = (with_package(docs).where(share).where(F.col("text").rlike("[0-9@]")).select("text")
             .orderBy(F.xxhash64("text", F.lit(11)), F.length("text")).limit(most).withColumn("all", F.lit(True)))

    def task(group: pa.Table) -> pa.Table:
        some, size = [], 0
        for text in sorted(group["text"].to_pylist(), key=lambda t: (len(t), t)):  # whole texts, short ones first
            size += len(text)
            if size > SAMPLE_CHARS and some:
                break
            some.append(text)
        f = Field.trained(some)
        return pa.table({"weights": pa.array([[*f.unary.ravel(), *f.chain.ravel(), f.skip]])})

    got = texts.groupBy("all").applyInArrow(task, "weights array<double>").collect()
    if not got:
        return Field.blank()
    w = np.array(got[0]["weights"])
    cut = len(_FEATURES) * LABELS
    return Field(w[:cut].reshape(-1, LABELS), w[cut:-1].reshape(LABELS, LABELS), float(w[-1]))


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


_COUNTS = tuple(f"n_{k}" for k in KINDS)


def detect(docs: DataFrame, field: Field) -> DataFrame:
    """``doc_id``, a count of base spans per kind, ``base_sha256`` and ``spans``, one row per row of ``docs``.

    Offsets are code points of the whole text, ends exclusive. Null and empty texts have no spans (the digest is that
    of the empty text); repeated rows are judged alike and each by itself; null ids are carried; other columns are
    ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, added = find(batch.column(1).to_pylist(), field)
            columns = {"doc_id": batch.column(0)}
            for k, name in enumerate(_COUNTS):
                columns[name] = pa.array([sum(x[0] == k for x in spans) for spans in base], pa.int64())
            columns["base_sha256"] = pa.array([hashlib.sha256(told(x).encode()).hexdigest() for x in base], pa.string())
            columns["spans"] = pa.array([told(x + y) for x, y in zip(base, added, strict=True)], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    counts = ", ".join(f"{n} long" for n in _COUNTS)
    return with_package(docs).select("doc_id", "text").mapInArrow(run, f"doc_id long, {counts}, base_sha256 string, spans string")
