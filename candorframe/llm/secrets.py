"""Secret scans over a trigram index.

Every rule is a regular expression. From its parse tree comes a Boolean query over trigrams that each matching text must hold: literals in a row
give an AND of their trigrams, alternatives an OR, anything else nothing. Documents are indexed segment by segment (a slice of an Arrow batch): one pass
over the bytes finds the trigrams that some rule asks for and lists the documents of each. A rule's postings are united and intersected by its
query, and only the documents that remain are searched with the expression. A rule without a mandatory trigram searches every document.

A segment's index lives as long as its batch, so nothing is shuffled or stored and the memory is bounded by the batch.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as op
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candorframe.llm.common import wide_rows

SECRETS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


@dataclass(frozen=True)
class Rule:
    """``keep`` is the least length of ``group``; a shorter match is dropped, yet what it covers is not searched again."""

    kind: str
    pattern: str
    group: int = 0
    keep: int = 1


# The base rules.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
# Published forms of well-known credentials.
MORE = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----"),
    Rule("forge_token", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE
SEGMENT_ROWS = 500


# A trigram query is None (every text may match), ("gram", bytes), ("and", queries) or ("or", queries).
def _all(parts: list) -> tuple | None:
    parts = [p for p in dict.fromkeys(parts) if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts: list) -> tuple | None:
    if any(p is None for p in parts):
        return None
    sets = {p: _wanted(p) for p in parts}
    # What asks for more than another plain alternative adds nothing.
    plain = [p for p in sets if p[0] == "gram" or p[0] == "and" and all(q[0] == "gram" for q in p[1])]
    parts = [p for p in sets if not any(q != p and sets[q] <= sets[p] for q in plain)]
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _grams(text: str) -> tuple | None:
    raw = text.encode().lower()
    return _all([("gram", raw[i : i + 3]) for i in range(len(raw) - 2)])


def _variants(nodes, most: int = 64) -> list[str] | None:
    """All texts that ``nodes`` can match, if they are few; a letter stands for both cases."""
    out = [""]
    for kind, arg in nodes:
        if kind is op.LITERAL:
            more = [chr(arg)]
        elif kind is op.SUBPATTERN:
            more = _variants(arg[3], most)
        elif kind is op.BRANCH:
            each = [_variants(b, most) for b in arg[1]]
            more = None if any(e is None for e in each) else [t for e in each for t in e]
        elif kind is op.IN and all(k is op.LITERAL for k, _ in arg):
            more = [chr(c) for _, c in arg]
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[1] <= 2 and (inner := _variants(arg[2], most)) is not None:
            more = [t for n in range(arg[0], int(arg[1]) + 1) for t in ([""] if n == 0 else inner if n == 1 else [a + b for a in inner for b in inner])]
        else:
            return None
        if more is None or len(out) * len(more) > most:
            return None
        out = [a + b for a in out for b in more]
    return out


def trigram_query(pattern: str) -> tuple | None:
    """The Boolean trigram query that every text matching ``pattern`` fulfils, over texts with A-Z lower-cased."""

    def walk(nodes) -> tuple | None:
        parts, run = [], []
        for node in nodes:
            # The longest runs of nodes with few possible texts give trigrams across node borders.
            if _variants([*run, node]) is not None:
                run.append(node)
                continue
            parts += close(run)
            run = [node] if _variants([node]) is not None else []
            kind, arg = node
            if run:
                continue
            if kind is op.SUBPATTERN:
                parts.append(walk(arg[3]))
            elif kind is op.BRANCH:
                parts.append(_any([walk(b) for b in arg[1]]))
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[0] >= 1:
                parts.append(walk(arg[2]))
        return _all(parts + close(run))

    def close(run: list) -> list:
        return [_any([_grams(t) for t in _variants(run)])] if run else []

    return walk(_parser.parse(pattern))


def _wanted(query: tuple | None) -> set[bytes]:
    if query is None:
        return set()
    return {query[1]} if query[0] == "gram" else set().union(*map(_wanted, query[1]))


class Segment:
    """Postings of the wanted trigrams over one batch of texts: sorted document numbers by trigram."""

    def __init__(self, texts: list[bytes], number: np.ndarray, count: int):
        self.size = len(texts)
        # One byte that no trigram holds parts the texts, so no trigram crosses a border.
        joined = np.frombuffer(b"\n".join(texts).lower() + b"\n\n\n", np.uint8)
        code = joined[:-2].astype(np.uint32) << 16
        code |= joined[1:-1].astype(np.uint32) << 8
        code |= joined[2:]
        gram = number[code]
        at = np.flatnonzero(gram)
        ends = np.cumsum([len(t) + 1 for t in texts])
        pairs = np.unique(gram[at].astype(np.int64) * self.size + np.searchsorted(ends, at, side="right"))
        self.postings = np.split(pairs % self.size, np.searchsorted(pairs // self.size, np.arange(1, count + 2)))[1:]

    def find(self, query: tuple | None, index: dict[bytes, int]) -> np.ndarray:
        if query is None:
            return np.arange(self.size)
        if query[0] == "gram":
            return self.postings[index[query[1]]]
        found = sorted((self.find(q, index) for q in query[1]), key=len)
        out = found[0]
        for f in found[1:]:
            out = np.intersect1d(out, f, assume_unique=True) if query[0] == "and" else np.union1d(out, f)
        return out


def spans(rule: Rule, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.keep]


def _run_pattern(rule: Rule) -> str:
    """A repeated class matches its whole run, so a short run can be left out while searching instead of afterwards: same spans, fewer matches."""
    parsed = list(_parser.parse(rule.pattern))
    if rule.group == 0 and len(parsed) == 1 and parsed[0][0] is op.MAX_REPEAT and parsed[0][1][:2] == (1, op.MAXREPEAT):
        return f"{rule.pattern[:-1]}{{{rule.keep},}}"
    return rule.pattern


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``secrets``: an array of (kind, start, end) per row, by start and then the order of ``rules``; code points, end exclusive.

    Input: text and any other columns, which stay. A null or empty text has no secrets. Nothing depends on ids, so repeated rows, ties and null
    ids do not matter. Whole texts are searched. A column named ``secrets`` is replaced.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    index = {g: i for i, g in enumerate(sorted(set().union(*map(_wanted, queries))))}
    if any(b"\n" in g for g in index):
        raise ValueError("a mandatory trigram holds a line end, which parts the texts of a segment")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(column: pa.Array) -> pa.Array:
        number = np.zeros(1 << 24, np.uint8 if len(index) < 255 else np.uint16)
        for g, i in index.items():
            number[int.from_bytes(g, "big")] = i + 1
        compiled = [re.compile(_run_pattern(r), re.ASCII) for r in rules]
        found: list[list] = [[] for _ in range(len(column))]
        for at in range(0, len(column), SEGMENT_ROWS):
            texts = [t or "" for t in column.slice(at, SEGMENT_ROWS).to_pylist()]
            segment = Segment([t.encode() for t in texts], number, len(index))
            for order, (rule, query) in enumerate(zip(rules, queries)):
                for d in segment.find(query, index):
                    found[at + d] += [(s, order, e) for s, e in spans(rule, compiled[order], texts[d])]
        return pa.array([[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in sorted(f)] for f in found], kind)

    wide_rows(docs.sparkSession)
    return docs.withColumn("secrets", F.arrow_udf(run, SECRETS)(F.col("text").cast("string")))


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_<base kind>..., base_sha256, spans): counts and digest of the base spans, and all spans as ``kind:start:end`` joined by commas."""
    found = scan(docs.select("doc_id", "text"), rules).drop("text")
    base = [r.kind for r in BASE]
    said = "array_join(transform({0}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    of_base = f"filter(secrets, s -> s.kind IN ({', '.join(map(repr, base))}))"
    return found.select(
        "doc_id",
        *[F.expr(f"CAST(size(filter(secrets, s -> s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in base],
        F.sha2(F.expr(said.format(of_base)), 256).alias("base_sha256"),
        F.expr(said.format("secrets")).alias("spans"),
    )


def mask(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``[kind]``; overlapping spans are merged and take the first one's kind."""
    merged = """aggregate(secrets, array(named_struct('kind', '', 'start', 0L, 'end', 0L)),
        (a, s) -> IF(s.start < element_at(a, -1).end,
            concat(slice(a, 1, size(a) - 1), array(named_struct('kind', element_at(a, -1).kind, 'start', element_at(a, -1).start,
                   'end', greatest(element_at(a, -1).end, s.end)))),
            concat(a, array(s))))"""
    masked = """CASE WHEN size(secrets) = 0 THEN text ELSE concat(
        array_join(transform(sequence(2, size(m)), i -> concat(substring(text, CAST(m[i - 2].end + 1 AS INT), CAST(m[i - 1].start - m[i - 2].end AS INT)),
                   '[', m[i - 1].kind, ']')), ''),
        substring(text, CAST(element_at(m, -1).end + 1 AS INT))) END"""
    # Rows travel whole in a struct, so no name of theirs can clash.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"))
    out = scan(rows, rules).withColumn("m", F.expr(merged)).select(F.col("row").withField("text", F.expr(masked)).alias("row"))
    return out.select("row.*")
