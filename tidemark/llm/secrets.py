"""Secret scan over a trigram inverted index.

Every rule has a regex and, derived from that regex's syntax, a Boolean query over trigrams: AND of what a concatenation needs, OR
over alternatives. Documents are indexed in segments of bounded bytes: a segment has the postings (rows) of every trigram of its
texts, lower-cased, made in one pass over the texts and without regard to rules. A rule's query intersects and unites
postings; only rows that remain are matched against the regex itself. A rule without mandatory trigrams scans every row of the
segment. An index can also be kept as a table (build_index) and asked by any set of rules later (candidates).

Defined results: null text counts as empty and has no spans; repeated rows give repeated results; extra columns are
not read, so their names cannot clash; an empty table gives an empty result; spans that begin at one place stand in the order of the rules. Offsets are
code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import weighted_blocks


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: The least length of the whole match, or of `group` if that is given; shorter matches are found and then dropped.
    least: int = 0
    group: int = 0


#: Kinds of the contract, in its order.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # maximal runs of 24 or more: what [0-9a-f]+ leaves once shorter runs are dropped
)
#: Public formats of credentials besides.
MORE = (
    # with its body and end line, where they follow before any other dashed line
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:(?:[^-]++|-(?!----))*+-----END (?:[A-Z]+ )*PRIVATE KEY-----)?"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("bearer", r"(?i:authorization: *bearer) +[A-Za-z0-9._~+/-]{16,}"),
    Rule("url", r"[a-z][a-z0-9+.-]{1,12}://[^\s/:@]++:[^\s/:@]{3,}+@[A-Za-z0-9.-]+"),
)

# --- Boolean trigram queries -------------------------------------------------------------------------------------

#: A query is True (no condition), a trigram, or ("and" | "or", frozenset of queries).
Query = bool | str | tuple
#: Exact sets of strings beyond this many are given up for what is known to be mandatory.
MOST_STRINGS = 64


def _both(kind: str, parts: list[Query]) -> Query:
    if kind == "and":
        parts = [p for p in parts if p is not True]
    elif any(p is True for p in parts):
        return True
    flat: set = set()
    for p in parts:
        flat |= set(p[1]) if isinstance(p, tuple) and p[0] == kind else {p}
    return True if not flat else next(iter(flat)) if len(flat) == 1 else (kind, frozenset(flat))


def _of_strings(strings: set[str]) -> Query:
    return _both("or", [_both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


@dataclass
class _Info:
    """exact: every string that the part matches, lower-cased, or None; query: what any match needs."""

    exact: set[str] | None
    query: Query = True

    @property
    def needs(self) -> Query:
        return self.query if self.exact is None else _of_strings(self.exact)


ANYTHING = _Info(None)


def _concat(items: list[_Info]) -> _Info:
    """Neighbouring exact parts are joined, so that trigrams across their borders count."""
    need, run, whole = [], {""}, True
    for x in items:
        if x.exact is not None and len(run) * len(x.exact) <= MOST_STRINGS:
            run = {a + b for a in run for b in x.exact}
            continue
        whole = False
        need += [_of_strings(run), x.needs]
        run = {""} if x.exact is None else set(x.exact)
    return _Info(run) if whole else _Info(None, _both("and", [*need, _of_strings(run)]))


def _either(items: list[_Info]) -> _Info:
    if all(x.exact is not None for x in items) and sum(len(x.exact) for x in items) <= MOST_STRINGS:
        return _Info(set().union(*(x.exact for x in items)))
    return _Info(None, _both("or", [x.needs for x in items]))


def _repeated(one: _Info, least: int, most: int | None) -> _Info:
    if one.exact is not None and most is not None and sum(len(one.exact) ** k for k in range(least, most + 1)) <= MOST_STRINGS:
        made, exact = {""}, set()
        for k in range(most + 1):
            exact |= made if k >= least else set()
            made = {a + b for a in made for b in one.exact}
        return _Info(exact)
    return _Info(None, one.needs) if least else ANYTHING


class _Reader:
    """Reads a regex from left to right for what its matches must contain. What it does not know stands for anything, so that a query may ask too little but never too much."""

    COUNT = re.compile(r"\{(\d*)(?:(,)(\d*))?\}")
    CLASS = re.compile(r"\[\^?\]?(?:[^\]\\]|\\.)*\]", re.DOTALL)

    def __init__(self, pattern: str):
        self.pattern, self.at, self.verbose = pattern, 0, False

    def peek(self, text: str) -> bool:
        return self.pattern.startswith(text, self.at)

    def take(self, text: str) -> bool:
        found = self.peek(text)
        self.at += len(text) * found
        return found

    def alternatives(self) -> _Info:
        items = [self.sequence()]
        while self.take("|"):
            items.append(self.sequence())
        return _either(items)

    def sequence(self) -> _Info:
        items = []
        while self.at < len(self.pattern) and not self.peek("|") and not self.peek(")"):
            items.append(self.repetition(self.atom()))
        return _concat(items)

    def repetition(self, one: _Info) -> _Info:
        count = self.COUNT.match(self.pattern, self.at)
        if self.peek("*") or self.peek("+") or self.peek("?"):
            least, most = {"*": (0, None), "+": (1, None), "?": (0, 1)}[self.pattern[self.at]]
            self.at += 1
        elif count and (count[1] or count[3]):
            self.at = count.end()
            least, most = int(count[1] or 0), int(count[3]) if count[3] else None if count[2] else int(count[1])
        else:
            return one
        self.take("+") or self.take("?")  # possessive or lazy: the strings are the same
        return self.repetition(_repeated(one, least, most))

    def atom(self) -> _Info:
        if self.take("("):
            return self.group()
        if self.peek("["):
            return self.char_class()
        c = self.pattern[self.at]
        self.at += 1
        if c == "\\":
            return self.escape()
        return _Info({""}) if c in "^$" else ANYTHING if c == "." else _Info({c.lower()})

    def group(self) -> _Info:
        around = any(map(self.take, ("?=", "?!", "?<=", "?<!", "?#")))
        flags = re.compile(r"\?(?:P<\w+>|:|>|[aiLmsux]*(?:-[imsx]+)?[:)])").match(self.pattern, self.at)
        if flags:
            self.at = flags.end()
            self.verbose |= "x" in flags[0].partition("-")[0] and "<" not in flags[0]
            if flags[0].endswith(")"):
                return _Info({""})
        elif not around and self.take("?"):  # a condition or a named reference
            around = True
        inner = self.alternatives()
        self.take(")")
        # what looks around takes no text, and no text joins across it for certain
        return ANYTHING if around else inner

    def char_class(self) -> _Info:
        found = self.CLASS.match(self.pattern, self.at)
        self.at = found.end()
        inside = found[0][1:-1]
        plain = inside and inside[0] != "^" and "\\" not in inside and "-" not in inside[1:-1] and len(inside) <= 8
        return _Info({c.lower() for c in inside}) if plain else ANYTHING

    def escape(self) -> _Info:
        c = self.pattern[self.at]
        self.at += 1
        if c in "xuU":
            size = {"x": 2, "u": 4, "U": 8}[c]
            digits, self.at = self.pattern[self.at : self.at + size], self.at + size
            return _Info({chr(int(digits, 16)).lower()})
        if c in "bBAZ":
            return _Info({""})
        return ANYTHING if c.isalnum() else _Info({c})


def trigram_query(pattern: str) -> Query:
    """What the lower-cased text must contain for the pattern to match; True if nothing is mandatory."""
    re.compile(pattern)
    reader = _Reader(pattern)
    found = reader.alternatives().needs
    return True if reader.verbose else found  # blanks and comments of verbose patterns are not told apart


def trigrams(query: Query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def code(trigram: str) -> int:
    """A trigram of ASCII characters as a number; -1 for any other, which no index knows."""
    return int.from_bytes(trigram.encode(), "big") if trigram.isascii() else -1


class Segment:
    """Postings of every trigram of bytes of a block of texts (A-Z as a-z): sorted codes, and the rows of each."""

    def __init__(self, codes: np.ndarray, ends: np.ndarray, rows: np.ndarray, size: int):
        self.codes, self.ends, self.postings, self.all = codes, ends, rows, np.arange(size, dtype=np.int32)

    @staticmethod
    def of(texts: list[bytes]) -> Segment:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
        flat = np.frombuffer(b"".join(t.lower() + b"\0\0" for t in texts), np.uint8).astype(np.uint64)
        n = max(0, len(flat) - 2)
        row = np.repeat(np.arange(len(texts), dtype=np.uint64), sizes)[:n]
        pairs = np.sort((flat[:n] << np.uint64(48)) | (flat[1 : n + 1] << np.uint64(40)) | (flat[2 : n + 2] << np.uint64(32)) | row)
        pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if n else pairs
        codes = (pairs >> np.uint64(32)).astype(np.int64)
        last = np.flatnonzero(np.concatenate([codes[1:] != codes[:-1], [True]])) if len(codes) else np.zeros(0, np.int64)
        return Segment(codes[last].astype(np.int32), last + 1, (pairs & np.uint64(0xFFFFFFFF)).astype(np.int32), len(texts))

    def rows(self, query: Query) -> np.ndarray:
        """Sorted rows that a query leaves."""
        if query is True:
            return self.all
        if isinstance(query, str):
            k = int(np.searchsorted(self.codes, code(query)))
            if not query.isascii():
                return self.all
            if k == len(self.codes) or self.codes[k] != code(query):
                return self.all[:0]
            return self.postings[(self.ends[k - 1] if k else 0) : self.ends[k]]
        found = sorted(map(self.rows, query[1]), key=len)
        if query[0] == "or":
            return np.unique(np.concatenate(found))
        left = found[0]
        for other in found[1:]:
            if not len(left):
                break
            left = left[np.isin(left, other, assume_unique=True)]
        return left


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(k, r, re.compile(r.pattern, re.ASCII), trigram_query(r.pattern)) for k, r in enumerate(rules)]

    def block(self, texts: list[str], segment: Segment | None = None) -> list[list[tuple[int, int, int]]]:
        """(start, rule's number, end) of each text, sorted."""
        segment, found = segment or Segment.of([t.encode() for t in texts]), [[] for _ in texts]
        for k, rule, regex, query in self.rules:
            for i in segment.rows(query).tolist():
                for m in regex.finditer(texts[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[i].append((m.start(), k, m.end()))
        return [sorted(x) for x in found]


INDEX = "size int, codes binary, ends binary, postings binary"


def build_index(docs: DataFrame, text: str = "text", key: str = "doc_id", block_bytes: int = 4_000_000) -> DataFrame:
    """A row a segment: `keys` (its rows' keys) and its postings; write it as a table, and ask it by candidates()."""
    kind = docs.schema[key].dataType.simpleString()
    picked = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in weighted_blocks(batches, "t", block_bytes):
            s = Segment.of([t.encode() for t in batch.column("t").to_pylist()])
            keys = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("k"))
            yield pa.RecordBatch.from_arrays([keys, pa.array([len(s.all)], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (s.codes, s.ends, s.postings))], names=["keys", *(x.split()[0] for x in INDEX.split(", "))])

    return picked.mapInArrow(run, f"keys array<{kind}>, {INDEX}")


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """key, kind: the documents of an index that a rule's query leaves; all that the rule can match are among them."""
    kind = index.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [(r.kind, trigram_query(r.pattern)) for r in rules]
        for batch in batches:
            for n in range(batch.num_rows):
                keys = batch.column("keys")[n].values
                of = lambda c, t: np.frombuffer(batch.column(c)[n].as_py(), t)  # noqa: E731, B023
                s = Segment(of("codes", np.int32), of("ends", np.int64), of("postings", np.int32), batch.column("size")[n].as_py())
                for name, query in queries:
                    rows = s.rows(query)
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows, pa.int32())), pa.array([name] * len(rows), pa.string())], names=["key", "kind"])

    return index.mapInArrow(run, f"key {kind}, kind string")


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def scan(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = BASE + MORE, block_bytes: int = 2_000_000) -> DataFrame:
    """keys and `spans` (array of kind, start, end by start and then the rules' order) for every row of docs."""
    picked = docs.select(*[F.col(k) for k in keys], F.coalesce(F.col(text), F.lit("")).alias("__text"))
    kinds = [r.kind for r in rules]
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in weighted_blocks(batches, "__text", block_bytes):
            found = scanner.block(batch.column(len(keys)).to_pylist())
            spans = pa.array([[{"kind": kinds[k], "start": s, "end": e} for s, k, e in x] for x in found], struct)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), spans], names=[*keys, "spans"])

    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return picked.mapInArrow(run, f"{schema}, spans {SPANS}")


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def redacted(docs: DataFrame, text: str = "text", mask: str = "[secret]", rules: tuple[Rule, ...] = BASE + MORE, block_bytes: int = 2_000_000) -> DataFrame:
    """docs with every found span of `text` replaced by mask (overlapping spans as one); null texts stay null, all rows and columns stay."""
    names, place = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in weighted_blocks(batches, text, block_bytes):
            texts = batch.column(place).to_pylist()
            out = []
            for t, found in zip(texts, scanner.block([t or "" for t in texts]), strict=True):
                if not found:
                    out.append(t)
                    continue
                parts, done = [], 0
                for s, _, e in found:
                    if s >= done:
                        parts += [t[done:s], mask]
                    done = max(done, e)
                out.append("".join(parts) + t[done:])
            columns = [pa.array(out, batch.schema.field(k).type) if k == place else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def op8(docs: DataFrame) -> DataFrame:
    """The contract's digest columns, from scan()."""
    base = [r.kind for r in BASE]
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of_base = F.filter("spans", lambda x: x["kind"].isin(base))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint")
    return scan(docs).select("doc_id", *[count(k).alias(f"n_{k}") for k in base], F.sha2(joined(of_base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
