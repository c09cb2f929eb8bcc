"""Secret scans: fixed rules first, then probabilistic automata inferred from what the rules label.

The rules' matches are labelled credentials. For each kind of value a prefix tree is built over symbols learnt from the values
(classes of characters, and the characters of a fixed head), and its statistically compatible states are merged (ALERGIA: Carrasco
and Oncina, 1994), which gives a deterministic probabilistic automaton of the format; the same is done for ordinary long tokens. Every
token outside the rules' spans, of the labelled values' alphabet and least length, is scored: its shape must be as likely under a format as
the format's own values are, and beyond a threshold of the log-likelihood ratio against ordinary tokens it is a span of kind "format",
so that a credential without its keyword is found. The rules' spans always stay.

Learning is bounded: by TRAIN_DOCS, TRAIN_VALUES and VALUE_CHARS, and prefix trees by Automaton.DEPTH. Scoring is not: it
sees whole texts and whole tokens.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

# The kinds in their order, their patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # [0-9a-f]+ of 32 or more: a run's only match starts at its first character
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
KINDS = ("assign", "access", "hex", "format")

#: A candidate: what the rules leave of a run of credential characters, this long.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")

#: Documents the automata learn from, at most about this many, and values of each kind kept of them, at most.
TRAIN_DOCS = 20_000
TRAIN_VALUES = 2_000
#: Characters of a value that are learnt from, at most.
VALUE_CHARS = 256
#: ALERGIA's confidence, and the log-likelihood ratio beyond which a candidate is reported.
ALPHA = 0.05
THRESHOLD = 12.0

Span = tuple[int, int, int]


def rule_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value) of the rules' matches, by start and then kind."""
    spans = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    spans += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(spans)


def candidates(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    """Candidate tokens outside the taken spans, which come by their starts."""
    k, n = 0, len(taken)
    for m in CANDIDATE.finditer(text):
        at, end = m.span()
        while k < n and taken[k][1] <= at:
            k += 1
        i = k
        while i < n and taken[i][0] < end:
            a, b = taken[i]
            if a - at >= LEAST_ASSIGN:
                yield at, a, text[at:a]
            at = max(at, b)
            i += 1
        if end - at >= LEAST_ASSIGN:
            yield at, end, text[at:end]


# ------------------------------------------------------------------------------------------------------- automata
_CHARS = ["0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+/", "_-", "=."]
_FINE = {c: i for i, cs in enumerate(_CHARS) for c in cs}


class Alphabet:
    """The symbols that values of one kind are read as, learnt from them.

    Characters that the values use about equally often are one class, so that hexadecimal digits, say, are one symbol and
    values of one format share their paths through the prefix tree. Characters at the start that many values agree on, far
    more than their class would, are symbols of their own: the format's fixed head.
    """

    #: A character of the head: this share of the values that agree so far, this many of them, this many times chance.
    SHARE, LEAST, TIMES, HEAD = 0.1, 5, 3.0, 16
    #: Character groups whose rates are within this factor are one class.
    FACTOR = 2.0

    def __init__(self, values: list[str]) -> None:
        chance = self.TIMES / max(1, len({c for v in values for c in v}))
        self.heads: dict[str, int] = {}
        level = {"": values}
        for k in range(self.HEAD):
            held: dict[str, list[str]] = {}
            for head, own in level.items():
                by: dict[str, list[str]] = {}
                for v in own:
                    if len(v) > k:
                        by.setdefault(head + v[k], []).append(v)
                held |= {h: vs for h, vs in by.items() if len(vs) >= max(self.LEAST, self.SHARE * len(own), chance * len(own))}
            self.heads |= {h: len(_CHARS) + 1 + len(self.heads) + i for i, h in enumerate(sorted(held))}
            level = held
        seen: list[dict[str, int]] = [{} for _ in _CHARS]
        for v in values:
            for c in v[self.head(v) :]:
                if c in _FINE:
                    seen[_FINE[c]][c] = seen[_FINE[c]].get(c, 0) + 1
        counts = [sum(x.values()) for x in seen]
        rates = sorted((counts[i] / len(x), i) for i, x in enumerate(seen) if x)
        self.of, self.widths, low = [len(_CHARS)] * len(_CHARS), {len(_CHARS): 100.0 + sum(len(_CHARS[i]) for i, n in enumerate(counts) if not n)}, 0.0
        for rate, i in rates:
            if not low or rate > self.FACTOR * low:
                name, low = i, rate
            self.of[i] = name
            self.widths[name] = self.widths.get(name, 0.0) + len(_CHARS[i])
        self.logs = {k: math.log(w) for k, w in self.widths.items()} | dict.fromkeys(self.heads.values(), 0.0)
        self.size = len(self.logs)

    def head(self, value: str) -> int:
        k = 0
        while value[: k + 1] in self.heads and k < len(value):
            k += 1
        return k

    def symbols(self, value: str) -> Iterator[int]:
        k = self.head(value)
        yield from (self.heads[value[: i + 1]] for i in range(k))
        other = len(_CHARS)
        yield from (self.of[_FINE[c]] if c in _FINE else other for c in value[k:])


@dataclass
class Node:
    total: int = 0
    ends: int = 0
    next: dict[int, int] = field(default_factory=dict)
    count: dict[int, int] = field(default_factory=dict)


class Automaton:
    """A deterministic probabilistic automaton over an alphabet of its own, by merging states of a prefix tree."""

    #: A prefix longer than this shares the states of this depth, which bounds the tree.
    DEPTH = 64
    #: Added to every count, so that no value is impossible.
    SMOOTH = 0.05

    def __init__(self, values: list[str], alpha: float = ALPHA) -> None:
        self.alphabet, self.nodes, self._bound = Alphabet(values), [Node()], math.sqrt(0.5 * math.log(2 / alpha))
        for value in values:
            at = 0
            for k, c in enumerate(self.alphabet.symbols(value)):
                if k == self.DEPTH:
                    break
                node = self.nodes[at]
                node.total += 1
                node.count[c] = node.count.get(c, 0) + 1
                if c not in node.next:
                    node.next[c] = len(self.nodes)
                    self.nodes.append(Node())
                at = node.next[c]
            self.nodes[at].total += 1
            self.nodes[at].ends += 1
        self._merge()
        own = sorted(self.surprise(v) for v in values)
        #: What the format's own values do not exceed, but for one in a hundred.
        self.usual = own[int(0.99 * (len(own) - 1))] if own else 0.0

    def _compatible(self, a: int, b: int) -> bool:
        """Whether no state reached from b by any string differs from the one reached from a: in ends or in any symbol."""
        todo, seen = [(a, b)], {(a, b)}
        while todo:
            x, y = (self.nodes[i] for i in todo.pop())
            if not x.total or not y.total:
                continue
            bound = self._bound * (1 / math.sqrt(x.total) + 1 / math.sqrt(y.total))
            if bound >= 1:  # too few to differ, and so is all below
                continue
            if abs(x.ends / x.total - y.ends / y.total) > bound:
                return False
            for c in {*x.count, *y.count}:
                if abs(x.count.get(c, 0) / x.total - y.count.get(c, 0) / y.total) > bound:
                    return False
                if c in x.next and c in y.next and (pair := (x.next[c], y.next[c])) not in seen and pair[0] != pair[1]:
                    seen.add(pair)
                    todo.append(pair)
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the subtree b to state a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            x, y = self.nodes[a], self.nodes[b]
            x.total += y.total
            x.ends += y.ends
            for c, n in y.count.items():
                x.count[c] = x.count.get(c, 0) + n
                if c not in x.next:
                    x.next[c] = y.next[c]
                elif x.next[c] != y.next[c]:
                    todo.append((x.next[c], y.next[c]))

    def _merge(self) -> None:
        red, seen = [0], {0}
        while True:
            fringe = sorted({(-self.nodes[t].total, t, r, c) for r in red for c, t in self.nodes[r].next.items() if t not in seen})
            if not fringe:
                break
            _, blue, parent, symbol = fringe[0]
            for r in red:
                if self._compatible(r, blue):
                    self.nodes[parent].next[symbol] = r
                    self._fold(r, blue)
                    break
            else:
                red.append(blue)
                seen.add(blue)
        place = {r: i for i, r in enumerate(red)}
        self.size = len(red)
        # (state, symbol) -> (state, surprise); symbols never seen in a state stay in it
        self.step, self.end = [], []
        for r in red:
            node = self.nodes[r]
            whole = node.total + self.SMOOTH * (self.alphabet.size + 1)
            self.end.append(-math.log((node.ends + self.SMOOTH) / whole))
            rare = (place[r], -math.log(self.SMOOTH / whole))
            self.step.append(({c: (place[node.next[c]], -math.log((n + self.SMOOTH) / whole)) for c, n in node.count.items()}, rare))
        del self.nodes

    def surprise(self, value: str, limit: float = math.inf) -> float:
        """-log of the probability of the value's shape, its path and end; any number over limit once that is exceeded."""
        at, total = 0, 0.0
        for c in self.alphabet.symbols(value):
            known, rare = self.step[at]
            at, p = known.get(c, rare)
            total += p
            if total > limit:
                return total
        return total + self.end[at]

    def log_likelihood(self, value: str) -> float:
        """Of the value itself: of its shape, and of its characters, all of a class being equally likely."""
        return -self.surprise(value) - sum(map(self.alphabet.logs.__getitem__, self.alphabet.symbols(value)))


#: From narrow to broad: values of a kind that use only these characters after their head are read as one format.
_FAMILIES = [set("".join(_CHARS[i] for i in own)) for own in ((0,), (0, 1), (0, 3), (0, 1, 2), (0, 3, 4), (0, 1, 2, 3, 4))]


def formats(values: list[str], least: int) -> list[list[str]]:
    """The values of one kind by format: by their fixed head, and by the narrowest family of characters after it. Fewer than least values
    of a head count as without one, fewer of a family go to the next broader one."""
    alphabet = Alphabet(values)
    by_head: dict[str, list[str]] = {}
    for v in values:
        by_head.setdefault(v[: alphabet.head(v)], []).append(v)
    for head in [h for h, own in by_head.items() if h and len(own) < least]:
        by_head.setdefault("", []).extend(by_head.pop(head))
    out = []
    for head, own in sorted(by_head.items()):
        rest = own
        for family in [*_FAMILIES, None]:
            fits = rest if family is None else [v for v in rest if family.issuperset(v[len(head) :])]
            if len(fits) >= least:
                out.append(fits)
                gone = set(fits)
                rest = [v for v in rest if v not in gone]
    return out


class Scorer:
    """Formats against ordinary tokens. A format needs LEAST_VALUES labelled credentials.

    A token scores if its shape is as likely under a format as the format's own values are, within MARGIN nats; its score is then the
    log-likelihood ratio of that format against ordinary tokens.
    """

    LEAST_VALUES, MARGIN = 10, 2.0

    def __init__(self, labelled: dict[int, list[str]], ordinary: list[str]) -> None:
        self.formats = [Automaton(own) for _, values in sorted(labelled.items()) for own in formats(values, self.LEAST_VALUES)]
        self.ordinary = Automaton(ordinary)
        self._seen: dict[str, float] = {}

    def score(self, value: str) -> float:
        found = self._seen.get(value)
        if found is None:
            own = [f for f in self.formats if f.surprise(value, f.usual + self.MARGIN) <= f.usual + self.MARGIN]
            found = max(f.log_likelihood(value) for f in own) - self.ordinary.log_likelihood(value) if own else -math.inf
            if len(value) <= 32:
                if len(self._seen) > 100_000:
                    self._seen.clear()
                self._seen[value] = found
        return found

    def best(self, value: str, threshold: float) -> tuple[int, int] | None:
        """The part of a token that scores highest beyond the threshold: the whole, without marks at its ends, or a side of a '='."""
        top, found = threshold, None
        for a, b in parts(value):
            if (x := self.score(value[a:b])) > top:
                top, found = x, (a, b)
        return found


_MARKS = "+/_.=-"


def parts(value: str) -> list[tuple[int, int]]:
    """A token's readings as (start, end), each of LEAST_ASSIGN characters or more."""
    out = [(0, len(value))]
    if value[0] in _MARKS or value[-1] in _MARKS or "=" in value:
        at = 0
        sides = [(0, value)]
        if "=" in value:
            for side in value.split("="):
                sides.append((at, side))
                at += len(side) + 1
        for at, side in sides:
            own = side.strip(_MARKS)
            a = at + len(side) - len(side.lstrip(_MARKS))
            out.append((a, a + len(own)))
    return list(dict.fromkeys((a, b) for a, b in out if b - a >= LEAST_ASSIGN))


def spans_of(text: str, scorer: Scorer, threshold: float = THRESHOLD) -> tuple[list[Span], list[Span]]:
    """(rules' spans, all spans), each (start, kind number, end) in order."""
    base = [s[:3] for s in rule_spans(text)]
    more = []
    if scorer.formats:
        for at, _, value in candidates(text, [(s[0], s[2]) for s in base]):
            if own := scorer.best(value, threshold):
                more.append((at + own[0], 3, at + own[1]))
    return base, sorted(base + more)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", train_docs: int = TRAIN_DOCS, train_values: int = TRAIN_VALUES) -> Scorer:
    """Fits the automata on a bounded sample: about train_docs documents by a hash of their id, train_values values a kind."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    n = rows.count()
    if n > train_docs:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 20)) < int((1 << 20) * train_docs / n))

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for x in batch.column(0):
                if x := x.as_py():
                    own = rule_spans(x)
                    found |= {(kind, value[:VALUE_CHARS]) for _, kind, _, value in own}
                    found |= {(3, v[:VALUE_CHARS]) for _, _, v in candidates(x, [(s[0], s[2]) for s in own])}
            kinds, strings = zip(*sorted(found), strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(strings, pa.string())], names=["kind", "value"])

    distinct = rows.select("text").mapInArrow(values, "kind int, value string").distinct()
    # each task keeps its own train_values a kind before they meet
    by = Window.partitionBy("kind").orderBy(F.xxhash64("value"), "value")
    kept: dict[int, list[str]] = {k: [] for k in range(4)}
    for r in distinct.withColumn("n", F.row_number().over(by)).where(F.col("n") <= train_values).collect():
        kept[r.kind].append(r.value)
    return Scorer({k: kept[k] for k in range(3)}, kept[3])


def _named(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


RESULT = "n_assign long, n_access long, n_hex long, n_format long, base_sha256 string, spans string"


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scorer: Scorer | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id with the number of spans of each kind, the digest of the rules' spans, and all spans.

    Offsets count code points, ends are exclusive. Null and empty texts have no spans: zeros, the digest of nothing and an
    empty string. Each row is scanned by itself, so repeated rows and null ids stay; an empty table gives an empty result; other columns,
    whatever their names, are not looked at.
    """
    scorer = scorer or train(docs, doc_id, text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1):
                base, every = spans_of(x.as_py() or "", scorer, threshold)
                n = [sum(s[1] == k for s in every) for k in range(4)]
                out.append((*n, hashlib.sha256(_named(base).encode()).hexdigest(), _named(every)))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 6, [pa.int64()] * 4 + [pa.string()] * 2, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_assign", "n_access", "n_hex", "n_format", "base_sha256", "spans"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {RESULT}")


MASK = "[secret]"


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scorer: Scorer | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with every run of overlapping spans in text replaced by MASK; all other columns, whatever their names, and all rows stay. Null and empty
    texts stay as they are; repeated rows are masked each for itself; an empty table stays empty."""
    scorer = scorer or train(docs, doc_id, text)

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: _masked(x, scorer, threshold), na_action="ignore")

    return docs.withColumn(text, masked(F.col(text)))


def _masked(text: str, scorer: Scorer, threshold: float) -> str:
    out, at, open_to = [], 0, -1
    for a, _, b in spans_of(text, scorer, threshold)[1]:
        if a >= open_to:
            out += [text[at:a], MASK]
        open_to = at = max(open_to, b)
    return "".join([*out, text[at:]]) if out else text
