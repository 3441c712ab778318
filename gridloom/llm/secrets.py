"""Secret scanning with one combined deterministic automaton.

The rules are parsed to syntax trees, joined under a leading "any bytes", made deterministic by
subset construction and minimised. A text's bytes pass once through the transition array; each
accepting state tells which rules have a match ending there. Runs of accepting positions give the
matches' ends, the reversed rules' automata their leftmost starts, and an exact check of the span
decides (lengths of captured parts). A private key's span goes on over the lines behind its header.

Null and empty texts have no spans. Rows with equal or null ids each give a row. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import code_points, string_chunks


@dataclass(frozen=True)
class Rule:
    """``pattern``: what the automaton runs; ``exact``: full check of a span, whose group 1 has ``least`` characters at least; ``follow``: what belongs to a span behind it."""

    kind: str
    pattern: str
    exact: str
    least: int = 0
    follow: bytes = b""


# Line ends may be escaped, as in JSON. Up to an END line all base64 belongs to the key; without one, lines of 32 characters or more and a shorter last one.
_EOL = rb"[ \t]*+(?:\r?\n|(?:\\r)?\\n)"
_ATTRIBUTES = rb"(?:" + _EOL + rb"[ \t]*+[A-Za-z0-9]++-[A-Za-z0-9-]++: [^\r\n\\]*+)*+"
_PEM_ENDED = rb"(?:[A-Za-z0-9+/=\s]|\\[nr])*+-----END [A-Z ]*PRIVATE KEY-----"
_PEM_OPEN = rb"(?:(?:" + _EOL + rb")++[ \t]*+[A-Za-z0-9+/]{32,}+=*+)++(?:" + _EOL + rb"[ \t]*+[A-Za-z0-9+/]++=*+)?+"
_PEM_BODY = _ATTRIBUTES + rb"(?:" + _PEM_ENDED + rb"|" + _PEM_OPEN + rb")"

#: Base rules first, in the order of the report; the others are the scanner's own additions.
RULES = (
    Rule(
        "assign",
        r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']? *[:=] *[\"']?[A-Za-z0-9+/_.=\-]+",
        r"(?:(?i:password|passwd|secret|token|api_?key))[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)",
        12,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", r"(AKIA[A-Z0-9]+)", 18),
    Rule("hex", r"[0-9a-f]{16}[0-9a-f]*", r"([0-9a-f]+)", 16),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", r"(gh[pousr]_[A-Za-z0-9]+)", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9\-]+", r"(xox[abprs]-[A-Za-z0-9-]+)", 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", r"(eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)", 30),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 0, _PEM_BODY),
)
BASE = ("assign", "access", "hex")


# --- regular expressions to automata -----------------------------------------------------------


class _Parser:
    """Literals, classes, groups, alternation and the repeats ? * + {n} over ASCII bytes."""

    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0

    def parse(self):
        tree = self.either()
        if self.i != len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} at {self.i}")
        return tree

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def either(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("or", options)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeat())
        return ("cat", parts)

    def repeat(self):
        node = self.atom()
        while (c := self.peek()) and c in "?*+{":
            self.i += 1
            if c == "{":
                close = self.p.index("}", self.i)
                node = ("cat", [node] * int(self.p[self.i : close]))
                self.i = close + 1
            else:
                node = {"?": ("or", [node, ("cat", [])]), "*": ("star", node), "+": ("cat", [node, ("star", node)])}[c]
        return node

    def atom(self):
        c = self.peek()
        self.i += 1
        if c == "(":
            node = self.either()
            if self.peek() != ")":
                raise ValueError("missing )")
            self.i += 1
            return node
        if c == "[":
            chars: set[int] = set()
            while self.peek() != "]":
                low = self.char()
                if self.peek() == "-" and self.p[self.i + 1] != "]":
                    self.i += 1
                    chars.update(range(low, self.char() + 1))
                else:
                    chars.add(low)
            self.i += 1
            return ("set", frozenset(chars))
        if c == ".":
            return ("set", frozenset(range(256)))
        self.i -= 1
        return ("set", frozenset([self.char()]))

    def char(self) -> int:
        if self.p[self.i] == "\\":
            self.i += 1
        self.i += 1
        return ord(self.p[self.i - 1])


def _reverse(tree):
    kind, arg = tree
    if kind == "set":
        return tree
    if kind == "star":
        return (kind, _reverse(arg))
    return (kind, [_reverse(x) for x in (reversed(arg) if kind == "cat" else arg)])


class _Nfa:
    def __init__(self):
        self.free: list[list[int]] = []
        self.by_byte: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.by_byte.append([])
        return len(self.free) - 1

    def add(self, tree, start: int) -> int:
        """The state behind ``tree`` begun at ``start``."""
        kind, arg = tree
        if kind == "set":
            end = self.state()
            self.by_byte[start].append((arg, end))
            return end
        if kind == "cat":
            for x in arg:
                start = self.add(x, start)
            return start
        end = self.state()
        if kind == "or":
            for x in arg:
                self.free[self.add(x, start)].append(end)
            return end
        loop = self.state()
        self.free[start].append(loop)
        self.free[self.add(arg, loop)].append(loop)
        self.free[loop].append(end)
        return end

    def closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


class Automaton:
    """``table[state + kinds[byte]]`` is the next state; states count in steps of ``width``, those from ``accepting`` on accept the rules in ``masks``."""

    def __init__(self, step: np.ndarray, kinds: np.ndarray, start: int, masks: list[int]):
        self.parts = (step.astype(np.int32), kinds, start, masks)
        self.width = step.shape[1]
        self.kinds = bytes(kinds.astype(np.uint8).tolist())
        shared = [i * self.width for i in range(len(step))]  # one int object a state keeps the array in cache
        self.table = [shared[i] for i in step.reshape(-1).tolist()]
        self.start, self.masks = shared[start], masks
        self.accepting = next((i for i, m in enumerate(masks) if m), len(masks)) * self.width
        loops = (step == np.arange(len(step))[:, None]).all(axis=1)
        self.dead = {i * self.width for i in np.flatnonzero(loops).tolist() if not masks[i]}

    def __reduce__(self):
        return Automaton, self.parts


def compile_rules(trees: list, searching: bool) -> Automaton:
    """Subset construction over the joined trees, then minimisation; accepting states come last."""
    nfa = _Nfa()
    root = nfa.state()
    if searching:
        nfa.by_byte[root].append((frozenset(range(256)), root))
    finals = {nfa.add(t, root): i for i, t in enumerate(trees)}
    # bytes that no set tells apart share a column
    kinds = np.zeros(256, np.int64)
    for edges in nfa.by_byte:
        for chars, _ in edges:
            member = np.isin(np.arange(256), list(chars)).astype(np.int64)
            kinds = np.unique(kinds * 2 + member, return_inverse=True)[1]
    n_kinds = int(kinds.max()) + 1
    sample = [int(np.flatnonzero(kinds == k)[0]) for k in range(n_kinds)]
    closed: dict[frozenset[int], frozenset[int]] = {}
    first = nfa.closure({root})
    number, order, rows = {first: 0}, [first], []
    for now in order:
        row = []
        for byte in sample:
            ends = frozenset(end for s in now for chars, end in nfa.by_byte[s] if byte in chars)
            then = closed.get(ends) or closed.setdefault(ends, nfa.closure(set(ends)))
            if then not in number:
                number[then] = len(order)
                order.append(then)
            row.append(number[then])
        rows.append(row)
    step = np.array(rows)
    mask = np.array([sum(1 << i for s, i in finals.items() if s in states) for states in order])
    # Moore's refinement: states stay together while their masks and successors' classes agree
    group = np.unique(mask, return_inverse=True)[1]
    while True:
        keys = np.column_stack([group, group[step]])
        finer = np.unique(keys, axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == group.max():
            break
        group = finer
    n = int(group.max()) + 1
    chosen = np.zeros(n, np.int64)
    chosen[group] = np.arange(len(group))
    ranked = np.argsort(mask[chosen] > 0, kind="stable")
    place = np.empty(n, np.int64)
    place[ranked] = np.arange(n)
    small = place[group[step[chosen[ranked]]]]
    return Automaton(small, kinds, int(place[group[0]]), mask[chosen[ranked]].tolist())


@dataclass(frozen=True)
class Scanner:
    rules: tuple[Rule, ...]
    forward: Automaton
    backward: tuple[Automaton, ...]
    exact: tuple[re.Pattern[str], ...]
    follow: tuple[re.Pattern[bytes] | None, ...]

    def find(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) byte spans: per rule leftmost, longest, not overlapping; failing ones dropped."""
        table, lo, state = self.forward.table, self.forward.accepting, self.forward.start
        hits: list[tuple[int, int]] = []
        for i, kind in enumerate(data.translate(self.forward.kinds)):
            state = table[state + kind]
            if state >= lo:
                hits.append((i, state))
        if not hits:
            return []
        masks, spans = self.forward.masks, []
        ends: list[list[int]] = [[] for _ in self.rules]
        for i, s in hits:
            m = masks[s // self.forward.width]
            for r in range(len(self.rules)):
                if m >> r & 1:
                    if ends[r] and ends[r][-1] == i - 1:
                        ends[r][-1] = i
                    else:
                        ends[r].append(i)
        for r, last in enumerate(ends):
            floor = 0
            for e in last:
                start = self._start(self.backward[r], data, e, floor)
                if start is None:
                    continue
                floor = e + 1
                m = self.exact[r].fullmatch(data[start : e + 1].decode("ascii"))
                if m and len(m[1]) >= self.rules[r].least:
                    if self.follow[r] and (body := self.follow[r].match(data, floor)):
                        floor = body.end()
                    spans.append((start, floor, r))
        return sorted(spans, key=lambda x: (x[0], x[2]))

    @staticmethod
    def _start(back: Automaton, data: bytes, last: int, floor: int) -> int | None:
        state, found = back.start, None
        for i in range(last, floor - 1, -1):
            state = back.table[state + back.kinds[data[i]]]
            if state >= back.accepting:
                found = i
            elif state in back.dead:
                break
        return found


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    trees = [_Parser(r.pattern).parse() for r in rules]
    return Scanner(rules, compile_rules(trees, True), tuple(compile_rules([_reverse(t)], False) for t in trees), tuple(re.compile(r.exact) for r in rules), tuple(re.compile(r.follow) if r.follow else None for r in rules))


# --- operators -----------------------------------------------------------------------------------


def _texts(column: pa.Array) -> Iterator[bytes]:
    for a, b, buf, offsets in string_chunks(column):
        raw, at = buf.tobytes(), offsets.tolist()
        for i in range(b - a):
            yield raw[at[i] : at[i + 1]]


def find_secrets(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and ``found``: array of (kind, start, end) in code points, by start and then rule order."""

    scan = scanner(rules)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            found = []
            for data in _texts(batch.column(1)):
                spans = scan.find(data)
                ends = np.array([span[:2] for span in spans], np.int64).reshape(-1, 2)
                points = ends if not spans or data.isascii() else code_points(np.frombuffer(data, np.uint8), ends)
                found.append([{"kind": rules[r].kind, "start": s, "end": e} for (s, e), (_, _, r) in zip(points.tolist(), spans, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(kind))], ["doc_id", "found"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, found array<struct<kind:string,start:long,end:long>>")


def redact_secrets(df: DataFrame, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``df`` with every secret's span replaced; overlapping spans become one mark. Null texts stay null."""
    where, scan = df.columns.index("text"), scanner(rules)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str | None] = []
            column = batch.column(where)
            for row, data in enumerate(_texts(column)):
                parts, done, known = [], 0, column[row].is_valid
                for s, e, _ in scan.find(data):
                    if s >= done:
                        parts += [data[done:s], mark.encode()]
                    done = max(done, e)
                texts.append(b"".join([*parts, data[done:]]).decode("utf-8") if known else None)
            yield batch.set_column(where, batch.schema.field(where), pa.array(texts, batch.schema.field(where).type))

    return df.mapInArrow(work, df.schema)


def secrets_report(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The digest columns: counts and sha256 of the base kinds' spans, and all spans as text."""
    line = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    join = lambda a: F.array_join(F.transform(a, line), ",")
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return find_secrets(df, rules).select("doc_id", *map(count, BASE), F.sha2(join(base), 256).alias("base_sha256"), join(F.col("found")).alias("spans"))


def digest(spans: list[tuple[str, int, int]]) -> str:
    """base_sha256 of spans that are in order already."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
