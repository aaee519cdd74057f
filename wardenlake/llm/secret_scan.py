"""Secret scans over a trigram inverted index.

Each rule's regular expression is turned into a Boolean query of the trigrams that any match must hold (AND over the parts that
must follow each other, OR over alternatives). Texts come in blocks; a block's index has a posting list, here a bitset over its
texts, for every trigram that some rule asks for. A rule's postings are intersected and united as its query says, and only the
texts left are searched with the expression itself. A rule without mandatory trigrams (a bare character class) scans every text.
The index is of whole texts, in lower case, so it also serves rules that take letters in either case; it can only let too many through.

A rule's spans are leftmost and non-overlapping; matches that fail its length test are dropped after that. Spans of different
rules may overlap. Redaction replaces the union of all spans.

Nulls and edges: a null or empty text has no spans; a text of any length is searched whole; repeated rows each get their row; a
null doc_id stays null; further columns may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, flat, slices, text_bytes


@dataclass(frozen=True)
class Rule:
    """group: whose length must reach least, span: what is the secret (0: the whole match). base: part of the fixed contract, first in order."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    either_case: bool = False
    base: bool = False
    span: int = 0

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.either_case else 0))


# A key is its header and all up to its END line, with no other BEGIN or END line in between. Where that is missing it is the fields and the lines of
# base64 that follow (16 characters at least; a shorter one as the last, and a checksum). Line breaks may be written as escapes, quoted, indented or lost.
_KEY = r"(?:[A-Z]+ )*PRIVATE KEY(?: BLOCK)?-----"
_GAP = r"""(?:\\[nrt]|[\s>"'#*,|])"""
_NEXT = r"""(?:[\x20\t"',]*+(?:\r?\n|\r|(?:\\r)?\\n)[\x20\t>"'#*,|]*+){1,2}"""
_FIELD = rf"{_GAP}*+(?:Proc-Type|DEK-Info|Content-Domain|Version|Comment|MessageID|Hash|Charset|X-[A-Za-z-]+):[^\r\n\\]*+"
_LAST = rf"""{_GAP}++[A-Za-z0-9+/]+={{1,2}}(?![A-Za-z0-9+/=])|{_NEXT}[A-Za-z0-9+/]+(?=[\x20\t"',]*+(?:[\r\n]|\\[nr]|\Z))"""
_LINES = rf"(?:{_FIELD})*+(?:{_GAP}++[A-Za-z0-9+/]{{16,}}={{0,2}})*+(?:{_LAST})?+(?:{_NEXT}=[A-Za-z0-9+/]{{4}})?+"
_PRIVATE_KEY = rf"-----BEGIN {_KEY}(?:(?:[^-]+|-(?!----(?:BEGIN|END) ))*+-----END {_KEY}|{_LINES})"

RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, False, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, False, True),
    Rule("private_key", _PRIVATE_KEY),
    Rule("repo_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    # a search starts only where a run of the token's characters does and takes the run once, so that its cost is linear
    Rule("web_token", r"(?<![A-Za-z0-9_-])(?:(?!eyJ)[A-Za-z0-9_-])*+(eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)", span=1),
    Rule("url_password", r"(?<![a-z0-9+.-])[0-9+.-]*+([a-z][a-z0-9+.-]*+://[^\s:/@]++:[^\s:/@]{3,}+@)", span=1),
)

# --- trigram queries: True (anything), or ("and"|"or", frozenset of trigrams and queries) -------------------------------

MANY = 64


def _join(op: str, parts: list) -> object:
    if op == "or" and any(p is True for p in parts):
        return True
    flat_parts = set()
    for p in parts:
        if isinstance(p, tuple) and p[0] == op:
            flat_parts |= p[1]
        elif p is not True:
            flat_parts.add(p)
    return True if not flat_parts else next(iter(flat_parts)) if len(flat_parts) == 1 else (op, frozenset(flat_parts))


def _of_strings(strings: set[str]) -> object:
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


def _class(items: list) -> set[str] | None:
    """The characters of a small positive class."""
    out: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            out.add(chr(arg))
        elif op is C.RANGE and arg[1] - arg[0] < 16:
            out |= {chr(x) for x in range(arg[0], arg[1] + 1)}
        else:
            return None
    return {x.lower() for x in out}


def _walk(tree: Sequence) -> tuple[set[str] | None, object]:
    """(all strings it can match, lower case, if they are few; what any match must hold besides)."""
    done: list[object] = []
    run: set[str] = {""}

    def flush() -> None:
        nonlocal run
        done.append(_of_strings(run))
        run = {""}

    exact = True
    for op, arg in tree:
        strings: set[str] | None = None
        query: object = True
        if op is C.LITERAL:
            strings = {chr(arg).lower()}
        elif op is C.IN:
            strings = _class(arg)
        elif op is C.SUBPATTERN:
            strings, query = _walk(arg[3])
        elif op is C.BRANCH:
            branches = [_walk(x) for x in arg[1]]
            if all(s is not None for s, _ in branches):
                strings = set().union(*(s for s, _ in branches))
            query = _join("or", [_of_strings(s) if s is not None else q for s, q in branches])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, inner = arg
            s, q = _walk(inner)
            if s is not None and high == 1:
                strings = s | {""} if low == 0 else s
            elif s is not None and low == high and low <= 4 and len(s) ** low <= MANY:
                strings = {""}
                for _ in range(low):
                    strings = {x + y for x in strings for y in s}
            elif low:
                query = _of_strings(s) if s is not None else q
        elif op is C.AT:
            continue
        if strings is not None and len(run) * len(strings) <= MANY:
            run = {x + y for x in run for y in strings}
            continue
        exact = False
        flush()
        if strings is not None and len(strings) <= MANY:
            run = strings
        else:
            done.append(query if strings is None else _of_strings(strings))
    if exact:
        return run, _of_strings(run)
    flush()
    return None, _join("and", done)


def trigram_query(pattern: str) -> object:
    """The Boolean query of a regular expression; True if no trigram is mandatory."""
    return _walk(_parser.parse(pattern))[1]


def trigrams_of(query: object) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


def _code(t: str) -> list[int]:
    """The three-byte windows of a trigram; more than one if it isn't ASCII."""
    b = t.encode("utf-8")
    return [b[i] << 16 | b[i + 1] << 8 | b[i + 2] for i in range(len(b) - 2)]


_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


class TrigramIndex:
    """Postings of a block of texts, for the trigrams that are asked for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray, codes: np.ndarray):
        self.n = len(offsets) - 1
        self.rows = np.zeros((len(codes), self.n), bool)
        self.at = {int(c): i for i, c in enumerate(codes)}
        if len(data) >= 3:
            low = _LOWER[data]
            grams = low[:-2] << np.uint32(16) | low[1:-1] << np.uint32(8) | low[2:]
            hits = np.flatnonzero(wanted[grams])
            doc = np.searchsorted(offsets, hits, "right") - 1
            inside = hits + 3 <= offsets[doc + 1]
            self.rows[np.searchsorted(codes, grams[hits[inside]]), doc[inside]] = True

    def find(self, query: object) -> np.ndarray:
        if query is True:
            return np.ones(self.n, bool)
        if isinstance(query, str):
            return np.logical_and.reduce([self.rows[self.at[c]] for c in _code(query)])
        return (np.logical_and if query[0] == "and" else np.logical_or).reduce([self.find(q) for q in query[1]])


class Scanner:
    def __init__(self, rules: Sequence[Rule] = RULES):
        self.rules, self.kinds = rules, {r.kind: i for i, r in enumerate(rules)}
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.codes = np.array(sorted({c for q in self.queries for t in trigrams_of(q) for c in _code(t)}), np.uint32)
        self.wanted = np.zeros(1 << 24, bool)
        self.wanted[self.codes] = True
        # [..]+ with a least length finds the same maximal runs as {least,} does, which gives up sooner on short ones
        self.searches = [re.compile(p.removesuffix("+") + f"{{{r.least},}}") if (p := r.pattern) and re.fullmatch(r"\[[^\]\\^]+\]\+", p) and not r.either_case else r.compiled() for r in rules]

    def spans(self, rule: int, text: str) -> Iterator[tuple[int, int]]:
        r = self.rules[rule]
        for m in self.searches[rule].finditer(text):
            if m.end(r.group) - m.start(r.group) >= r.least:
                yield m.span(r.span)

    def scan(self, values: pa.Array) -> list[list[tuple[str, int, int]]]:
        """The spans (kind, start, end) of each text, by start, then kind as listed."""
        data, offsets = flat(values)
        index = TrigramIndex(data, offsets, self.wanted, self.codes)
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(values))]
        texts: dict[int, str] = {}
        for k, query in enumerate(self.queries):
            for i in np.flatnonzero(index.find(query)).tolist():
                if i not in texts:
                    texts[i] = values[i].as_py().decode("utf-8", "replace")
                found[i] += [(start, k, end) for start, end in self.spans(k, texts[i])]
        return [[(self.rules[k].kind, start, end) for start, k, end in sorted(x)] for x in found]


def redact(text: str, spans: Sequence[tuple[str, int, int]]) -> str:
    """The text with the union of its spans replaced; runs of spans that overlap or touch get the first one's kind."""
    out, at, mark = [], 0, ""
    for kind, start, end in spans:
        if start > at or not mark:
            out += [mark, text[at:start]] if start >= at else []
            mark, at = f"[{kind.upper()}]", max(at, end)
        else:
            at = max(at, end)
    return "".join([*out, mark, text[at:]])


def scan_documents(docs: DataFrame, rules: Sequence[Rule] = RULES, with_text: bool = False) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id and spans, an array of (kind, start, end) in code points; with_text adds the
    redacted text."""
    bound_batches(docs.sparkSession)
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for part in slices(batches, "b", 1 << 20):
            spans = scanner.scan(part.column(1))
            columns = [part.column(0), pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for x in spans], pa.list_(kind))]
            if with_text:
                columns.append(pa.array([redact(t.as_py().decode("utf-8", "replace"), s) if s else None for t, s in zip(part.column(1), spans, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "spans", "redacted"][: len(columns)])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, spans array<struct<kind string, start long, end long>>" + ", redacted string" * with_text
    return docs.select("doc_id", text_bytes().alias("b")).mapInArrow(run, schema)


def secret_digests(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, a count for each base kind, base_sha256 over the base spans and all spans as text."""
    base = [r.kind for r in rules if r.base]
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    own = F.filter("spans", lambda s: s["kind"].isin(base))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [of(k) for k in base]
    return scan_documents(docs, rules).select("doc_id", *counts, F.sha2(joined(own), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redacted_rows(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """docs with every secret replaced by its kind in text, and n_chars set anew where that is a column. All rows and columns stay."""
    bound_batches(docs.sparkSession)
    at, schema, names = docs.columns.index("text"), docs.schema, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            text = batch.column(at)
            raw = text.cast(pa.binary()).fill_null(b"")
            one = pa.RecordBatch.from_arrays([pa.array(range(len(raw)), pa.int32()), raw], ["i", "b"])
            new: list = []
            for part in slices(iter([one]), "b", 1 << 20):
                new += [redact(t.as_py().decode("utf-8", "replace"), s) if s else None for t, s in zip(part.column(1), scanner.scan(part.column(1)), strict=True)]
            changed = [i for i, x in enumerate(new) if x is not None]
            columns = list(batch.columns)
            if changed:
                values, mask = pa.array(new, text.type), pa.array([x is not None for x in new])
                columns[at] = pa.compute.if_else(mask, values, text)
                if "n_chars" in names:
                    n = columns[names.index("n_chars")]
                    columns[names.index("n_chars")] = pa.compute.if_else(mask, pa.array([len(x) if x is not None else None for x in new]).cast(n.type), n)
            yield pa.RecordBatch.from_arrays(columns, names)

    import pyarrow.compute  # noqa: F401  pa.compute

    return docs.mapInArrow(run, schema)
