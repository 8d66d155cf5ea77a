"""Secret scans with a trigram index.

Each rule's regular expression is parsed, and from its tree comes a Boolean query of
trigrams that every match must contain. Every block of texts is indexed by trigram
(postings of text numbers), the query is evaluated by intersecting and uniting postings,
and only the texts that remain are searched with the expression itself. A rule from which
no trigram can be derived searches all texts. Index and texts are in the same task, so
nothing is shuffled, and a lost task is simply run again.

Definitions. A null or empty text has no span. Spans count code points, the end is
exclusive. Within a kind matches are leftmost and do not overlap, and matches shorter than
the rule's minimum are dropped after matching. Repeated rows are reported each. Extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import by_value, slices


@dataclass(frozen=True)
class Rule:
    """``pattern`` with the least length of the given group; shorter matches are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The rules of the contract, in its order.
RULES = (
    Rule(
        "assign",
        r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", least=24),
)

# A query is True (says nothing), a trigram, or ("and" | "or", queries).
Query = object
LIMIT = 64


def _both(kind: str, parts: list) -> Query:
    if kind == "and":
        parts = [p for p in parts if p is not True]
        if not parts:
            return True
    elif any(p is True for p in parts):
        return True
    unique = list(dict.fromkeys(parts))
    return unique[0] if len(unique) == 1 else (kind, tuple(unique))


def _of_strings(strings: list[str]) -> Query:
    """Trigrams of one of the given strings."""
    return _both("or", [_both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


class _Trigrams:
    """Walks a parsed expression; ``near`` holds the strings that what was read last may have been."""

    def sequence(self, items) -> tuple[list[str] | None, Query]:
        """(all strings that the items can match, or None if not few; query)."""
        known, near, queries = True, [""], []
        for op, value in items:
            exact, query = self.item(op, value)
            queries.append(query)
            if exact is not None and len(near) * len(exact) <= LIMIT:
                near = [a + b for a in near for b in exact]
            else:
                queries.append(_of_strings(near))
                near, known = exact if exact is not None else [""], False
        queries.append(_of_strings(near))
        return (near if known else None), _both("and", queries)

    def item(self, op, value) -> tuple[list[str] | None, Query]:
        if op is sre.LITERAL:
            return [chr(value).lower()], True
        if op is sre.SUBPATTERN:
            return self.sequence(value[-1])
        if op is sre.BRANCH:
            found = [self.sequence(x) for x in value[1]]
            exact = None if any(e is None for e, _ in found) else [s for e, _ in found for s in e]
            return (exact if exact and len(exact) <= LIMIT else None), _both("or", [q for _, q in found])
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, inner = value
            exact, query = self.sequence(inner)
            if least == 0:
                return ([*exact, ""] if most == 1 and exact is not None else None), True
            return (exact if most == 1 else None), query
        if op is sre.AT:
            return [""], True
        return None, True


def trigram_query(pattern: str) -> Query:
    """The trigrams, in lower case, that every match of ``pattern`` contains; True if there are none."""
    return _Trigrams().sequence(sre_parser.parse(pattern))[1]


def trigrams_in(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else {t for q in query[1] for t in trigrams_in(q)}


def _folded(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def build_index(texts: pa.Array, wanted: set[str]) -> dict[str, np.ndarray]:
    """Postings of the wanted ASCII trigrams: the sorted numbers of the texts that contain them."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    codes = {int.from_bytes(t.encode(), "big"): t for t in wanted}
    if len(raw) < 3 or not codes:
        return {t: np.zeros(0, np.int64) for t in wanted}
    low = _folded(raw).astype(np.uint32)
    code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
    asked = np.zeros(1 << 24, bool)
    asked[list(codes)] = True
    at = np.flatnonzero(asked[code])
    text = np.searchsorted(offsets, at, side="right") - 1
    inside = at + 2 < offsets[text + 1]
    at, text = at[inside], text[inside]
    code = code[at]
    return {t: np.unique(text[code == c]) for c, t in codes.items()}


def candidates(query: Query, index: dict[str, np.ndarray], n: int) -> np.ndarray:
    """Numbers of the texts that satisfy the query."""
    if query is True:
        return np.arange(n)
    if isinstance(query, str):
        return index[query]
    found = [candidates(q, index, n) for q in query[1]]
    out = found[0]
    for x in found[1:]:
        out = np.intersect1d(out, x, assume_unique=True) if query[0] == "and" else np.union1d(out, x)
    return out


def spans_of(rule: Rule, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _searched(rule: Rule) -> re.Pattern:
    """A repeated class that must be of some length need not be matched where it is shorter."""
    whole = re.fullmatch(r"(\[[^\]\\]+\])\+", rule.pattern)
    return re.compile(f"{whole[1]}{{{rule.least},}}" if whole and rule.group == 0 else rule.pattern)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id and its ``spans``: array of (kind, start, end), by start and then by rule."""
    queries = [trigram_query(r.pattern) for r in rules]
    # Only ASCII trigrams are indexed: outside of them, case folding is not one to one.
    queries = [q if all(t.isascii() for t in trigrams_in(q)) else True for q in queries]
    wanted = {t for q in queries for t in trigrams_in(q)}
    compiled = [_searched(r) for r in rules]
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for big in batches:
            for batch in slices(big, 1, 4_000_000):
                texts = batch.column(1).cast(pa.string())
                index = build_index(texts, wanted)
                found: dict[int, list] = {}
                for order, (rule, query) in enumerate(zip(rules, queries)):
                    for i in candidates(query, index, len(texts)):
                        text = texts[int(i)].as_py()
                        for a, b in spans_of(rule, compiled[order], text) if text else ():
                            found.setdefault(int(i), []).append((a, order, b))
                rows = [
                    [{"kind": rules[o].kind, "start": a, "end": b} for a, o, b in sorted(found.get(i, ()))]
                    for i in range(len(texts))
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(rows, pa.list_(span))], names=["id", "spans"]
                )

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(
        run, f"id {id_type}, spans array<struct<kind:string,start:long,end:long>>"
    )


def digest(spans: DataFrame) -> DataFrame:
    """Counts per kind, the spans as text, and its SHA-256."""
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return spans.select(
        F.col("id").alias("doc_id"),
        *[count(r.kind) for r in RULES],
        F.sha2(listed, 256).alias("base_sha256"),
        listed.alias("spans"),
    )


by_value(__name__)
