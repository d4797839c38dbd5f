"""Operator 9: secret scans through a trigram inverted index.

For each rule a Boolean query over trigrams is derived from its regex: literals become strings, alternations become OR,
sequences become AND, and what can stand for nothing asks for nothing. A rule whose query is empty (hex runs) scans all
texts. The index is cut by documents into segments, as search engines do: each slice of rows gets its own posting
lists, holding only the trigrams that some rule asks for. Postings are intersected within the segment and the regex
verifies the candidates there. Nothing is shuffled, memory is bounded by a slice (4 MB of text or one longer text), and a
lost executor repeats a slice.

The base rules follow their contract: matches are leftmost and do not overlap within a kind, spans are code points of
the whole match with exclusive ends, and matches below a rule's length are dropped. Null text counts as empty.
"""

from __future__ import annotations

import functools
import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import given_back, map_batches, raw_texts, slices

try:
    from re import _constants as C
    from re import _parser as P
except ImportError:  # Python before 3.11
    import sre_constants as C
    import sre_parse as P


@dataclass(frozen=True)
class Rule:
    """``least`` characters are asked of ``group``; matches with less are dropped."""

    kind: str
    pattern: str
    flags: int = 0
    group: int = 0
    least: int = 0


# A private key in PEM: from the header through the next END line of a private key with no other BEGIN between them. Where
# there is none, what follows the header in its line and the lines of base64 after it, in source code and quotes too.
_TO_END = r"[^-]*(?:-(?!----(?:BEGIN |END [A-Z ]{0,30}PRIVATE KEY-----))[^-]*)*-----END [A-Z ]{0,30}PRIVATE KEY-----"
_EOL = r"""(?:\\[rn]|["',+;\\ \t\r])*(?:\n|\\n)"""
_BLANK = r"(?:[ \t\r>]*(?:\n|\\n))"
_START = r"""[ \t>|#*"']*"""
_ROW = r"""(?:[A-Za-z0-9+/]{32,}={0,2}|[A-Za-z0-9+/]+={0,2}(?=["',+;\\ \t\r]*(?:\n|\\[rn]|\Z)))"""
_FIELD = r"[A-Za-z]+(?:-[A-Za-z]+)*:[^\n\\]*"
_LINES = (
    r"(?:[ \t]*(?:[A-Za-z0-9+/]{16,}={0,2}|[A-Za-z0-9+/]+={1,2}))*"
    rf"(?:(?:{_EOL}{_START}{_FIELD})*{_EOL}{_BLANK}{{0,2}}{_START}{_ROW}(?:{_EOL}{_START}{_ROW}|{_EOL}{_BLANK}{_START}[A-Za-z0-9+/]{{32,}}={{0,2}})*)?"
)

#: Kinds in the order in which spans with one start are listed. The first three are the contract's.
#: `[0-9a-f]{32,}` finds the same spans as `[0-9a-f]+` with the short ones dropped: both take whole runs.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 0, 32),
    Rule("private_key", rf"-----BEGIN [A-Z ]{{0,30}}PRIVATE KEY-----(?:{_TO_END}|{_LINES})"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^/\s:@]{1,64}:[^/\s:@]{1,64}@", re.A),
)

#: Bytes whose trigrams are looked up at a time.
PART = 1 << 20

ANY = ("any",)
MOST_STRINGS = 64


def _all(parts):
    parts = [p for p in parts if p != ANY]
    return ANY if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _one(parts):
    return ANY if any(p == ANY for p in parts) else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[bytes]):
    """What a text holds that has one of the strings."""
    if any(len(s) < 3 for s in strings):
        return ANY
    return _one([_all([("tri", s[i : i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)])


def _fold(code: int) -> bytes:
    return chr(code).encode(errors="surrogatepass").lower()


def _sequence(nodes):
    """The strings that the nodes match, if these are few, and the query that any match fulfils."""
    asked, strings, whole = [], {b""}, True
    for node in nodes:
        own, query = _node(node)
        if own is not None and len(own) * len(strings) <= MOST_STRINGS:
            strings = {a + b for a in strings for b in own}
        else:
            whole = False
            asked += [_of_strings(strings), query]
            strings = {b""} if own is None else own
    return (strings if whole else None), _all([*asked, _of_strings(strings)])


def _node(node):
    op, arg = node
    if op is C.LITERAL:
        return {_fold(arg)}, ANY
    if op is C.IN:
        chars: set[bytes] = set()
        for kind, x in arg:
            if kind is C.LITERAL:
                chars.add(_fold(x))
            elif kind is C.RANGE and x[1] - x[0] < MOST_STRINGS:
                chars |= {_fold(c) for c in range(x[0], x[1] + 1)}
            else:
                return None, ANY
        return (chars, ANY) if len(chars) <= 8 else (None, ANY)
    if op is C.SUBPATTERN:
        return _sequence(arg[-1])
    if op is C.BRANCH:
        got = [_sequence(x) for x in arg[1]]
        if all(s is not None for s, _ in got) and sum(len(s) for s, _ in got) <= MOST_STRINGS:
            strings = set().union(*(s for s, _ in got))
            return strings, _of_strings(strings)
        return None, _one([q for _, q in got])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        least, most, body = arg
        own, query = _sequence(body)
        if least == most == 1:
            return own, query
        if (least, most) == (0, 1) and own is not None:
            return own | {b""}, ANY
        return None, query if least else ANY
    if op is C.AT:
        return {b""}, ANY
    return None, ANY


def trigram_query(pattern: str, flags: int = 0):
    """A nested query of ("and" | "or", parts), ("tri", three bytes in lower case) and ANY, true of any text that matches."""
    return _sequence(P.parse(pattern, flags))[1]


def _trigrams(query) -> set[bytes]:
    if query == ANY:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*map(_trigrams, query[1]))


def _posted(query, postings: dict[bytes, set[int]], rows: set[int]) -> set[int]:
    if query == ANY:
        return rows
    if query[0] == "tri":
        return postings.get(query[1], set())
    parts = [_posted(q, postings, rows) for q in query[1]]
    return set.intersection(*parts) if query[0] == "and" else set.union(*parts)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.queries = [trigram_query(r.pattern, r.flags) for r in rules]
        self.regexes = [re.compile(r.pattern, r.flags) for r in rules]
        self.trigrams = sorted(set().union(*map(_trigrams, self.queries)))
        self.number = np.zeros(1 << 24, np.uint16)
        for i, t in enumerate(self.trigrams):
            self.number[int.from_bytes(t, "big")] = i + 1

    def postings(self, texts: list[bytes]) -> dict[bytes, set[int]]:
        """The segment's index: the rows that hold each trigram."""
        # two line ends between rows: no rule asks for a trigram with one
        joined = b"\n\n".join(texts).lower() + b"\n\n"
        starts = np.cumsum([0] + [len(t) + 2 for t in texts])[:-1]
        out: dict[bytes, set[int]] = {}
        # in parts that overlap by two bytes: the numbers take several times the bytes' place
        for a in range(0, len(joined) - 2, PART):
            data = np.frombuffer(joined, np.uint8, min(PART + 2, len(joined) - a), a).astype(np.uint32)
            found = self.number[(data[:-2] << 16) | (data[1:-1] << 8) | data[2:]]
            at = np.flatnonzero(found)
            pairs = np.unique(found[at].astype(np.int64) << 32 | (np.searchsorted(starts, at + a, "right") - 1))
            for p in pairs.tolist():
                out.setdefault(self.trigrams[(p >> 32) - 1], set()).add(p & 0xFFFFFFFF)
        return out

    def scan(self, texts: list[bytes]) -> dict[int, list[tuple[int, int, int]]]:
        """For each row with matches: (start, number of the rule, end), sorted."""
        index, every, strings = self.postings(texts), set(range(len(texts))), {}
        out: dict[int, list[tuple[int, int, int]]] = {}
        for k, (rule, query, regex) in enumerate(zip(self.rules, self.queries, self.regexes)):
            for i in sorted(_posted(query, index, every)):
                text = strings.get(i)
                if text is None:
                    text = strings[i] = texts[i].decode()
                for m in regex.finditer(text):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out.setdefault(i, []).append((m.start(), k, m.end()))
        return {i: sorted(x) for i, x in out.items()}


@functools.lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])
BASE = 3


def secret_digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document with counts of the base kinds, a digest of their spans, and all spans as text."""

    def digest(batch: pa.RecordBatch) -> dict:
        texts = raw_texts(batch.column("text"))
        found = scanner(rules).scan(texts)
        spans = [found.get(i, []) for i in range(len(texts))]
        said = lambda x: ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in x)
        counts = [[sum(k == n for _, k, _ in x) for x in spans] for n in range(BASE)]
        base = [hashlib.sha256(said([y for y in x if y[1] < BASE]).encode()).hexdigest() for x in spans]
        return {"doc_id": batch.column("doc_id"), "n_assign": counts[0], "n_access": counts[1], "n_hex": counts[2], "base_sha256": base, "spans": [said(x) for x in spans]}

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), digest, SCHEMA, ARROW)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every secret replaced by ``[kind]``; overlapping spans become one, named by the first.

    All columns stay, n_chars (if there) follows the text, and rows without secrets, null texts too, stay as they are.
    """
    names = docs.columns
    at = names.index("text")
    chars = names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        with given_back():
            for batch in batches:
                for part in slices(batch, names[at]):
                    found = scanner(rules).scan(raw_texts(part.column(at)))
                    if found:
                        texts = part.column(at).to_pylist()
                        for i, spans in found.items():
                            texts[i] = _cut(texts[i], spans, rules)
                        columns = list(part.columns)
                        columns[at] = pa.array(texts, part.schema.field(at).type)
                        if chars is not None:
                            counts = columns[chars].to_pylist()
                            for i in found:
                                counts[i] = len(texts[i])
                            columns[chars] = pa.array(counts, part.schema.field(chars).type)
                        part = pa.RecordBatch.from_arrays(columns, schema=part.schema)
                    yield part

    return docs.mapInArrow(run, docs.schema)


def _cut(text: str, spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    out, end = [], 0
    for start, k, stop in spans:
        if start >= end:
            out += [text[end:start], f"[{rules[k].kind}]"]
        end = max(end, stop)
    return "".join([*out, text[end:]])
