"""Secret scan with linking of credentials that come in several parts.

Base kinds are reported by their pattern alone.  Three weak kinds (an
identifier, a bare secret, an endpoint) are too common to report by
themselves: a weak candidate is reported only if a complementary part stands
within ``REACH`` characters of it in the same scope, from the end of the one to
the start of the other.  A scope is a block of
lines without an empty line.  An identifier needs a secret, a secret needs an
identifier or an endpoint, and an endpoint needs a secret; base matches count
as parts (access as identifier; assign and hex as secrets).  Parts that overlap
are not complements, so that one token never plays both: a bare secret that is
an identifier's value, or a piece of an endpoint.  Only an endpoint with a
secret as a named value (``?sig=...``) ends before it, and is then one of two.

The join is by interval: parts are sorted by start and by end, and each
candidate looks up the last complementary part that ends before it and the
first that starts behind it, so that no pairs are listed.  All work is within
one text, so rows stay where they are.

Defined cases: a null text is an empty text; offsets count code points, end
exclusive; spans of the same start are ordered by kind; repeated rows are
scanned one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from strataq.llm._text import slices, texts

# The kinds in their order, their patterns and least lengths.
KINDS = ("assign", "access", "hex", "ident", "bare", "endpoint")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
IDENT = re.compile(r"""(?ai:client_?id|user_?name|user|login|account|(?<!secret)(?<!secret[_-])access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,}|(?<![A-Z0-9])A[A-Z]IA[A-Z0-9]{12,}""")
BARE = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/=_-])")
ENDPOINT = re.compile(r"(?ai:https?|jdbc:[a-z]+|postgres|postgresql|mysql|mongodb|redis|amqp|s3)://[^\s\"'<>]+")
BREAK = re.compile(r"\n[\x20\x09-\x0D]*\n")
REACH = 256
#: For whole columns at once: texts without a match have no such span.
FIRST = {
    "assign": r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]",
    "access": r"AKIA[A-Z0-9]{12}",
    "hex": r"[0-9a-f]{32}",
    "bare": r"[A-Za-z0-9+/_-]{24}",
    "ident": r"(?i)(id|name|user|login|account|key)[\"']? *[:=]|A[A-Z]IA[A-Z0-9]{12}",
    "endpoint": r"://",
}
NEEDS = {"ident": ("secret",), "bare": ("ident", "endpoint"), "endpoint": ("secret",)}
ROLE = {"assign": "secret", "hex": "secret", "bare": "secret", "access": "ident", "ident": "ident", "endpoint": "endpoint"}
Span = tuple[int, int, int]  # start, place of the kind, end


def base_spans(text: str, likely=lambda kind: True) -> list[Span]:
    """The base kinds' spans in order. Matches are leftmost and do not overlap within a kind; those too short are dropped."""
    out: list[Span] = []
    if likely("assign"):
        out += ((m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST["assign"])
    if likely("access"):
        out += ((m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"])
    if likely("hex"):
        out += ((m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"])
    return sorted(out)


def linked_spans(text: str, base: list[Span], likely=lambda kind: True) -> list[Span]:
    """The weak candidates that have a complementary part within reach in their scope."""
    weak = [(m.start(), KINDS.index(k), m.end()) for k, pattern in (("ident", IDENT), ("bare", BARE), ("endpoint", ENDPOINT)) if likely(k) for m in pattern.finditer(text)]
    if not weak:
        return []
    covered = sorted((s, e) for s, _, e in base)
    starts = [s for s, _ in covered]
    furthest, most = [], -1
    for _, e in covered:
        most = max(most, e)
        furthest.append(most)

    def inside(s: int, e: int) -> bool:
        """Whether a base span overlaps."""
        k = bisect_left(starts, e)
        return k > 0 and furthest[k - 1] > s

    weak = _cut([x for x in weak if not inside(x[0], x[2])], text)
    breaks = [m.start() for m in BREAK.finditer(text)]
    starts_of: dict[str, list[int]] = {"secret": [], "ident": [], "endpoint": []}
    ends_of: dict[str, list[int]] = {"secret": [], "ident": [], "endpoint": []}
    for s, k, e in [*base, *weak]:
        starts_of[ROLE[KINDS[k]]].append(s)
        ends_of[ROLE[KINDS[k]]].append(e)
    for at in (*starts_of.values(), *ends_of.values()):
        at.sort()

    def has(role: str, s: int, e: int) -> bool:
        """Whether a part of the role is near in scope. No part holds a break, so the nearest on either side decide."""
        scope = bisect_left(breaks, s)
        before, after = bisect_right(ends_of[role], s), bisect_left(starts_of[role], e)
        if before and s - (end := ends_of[role][before - 1]) <= REACH and bisect_left(breaks, end) == scope:
            return True
        return after < len(starts_of[role]) and (start := starts_of[role][after]) - e <= REACH and bisect_left(breaks, start) == scope

    return [x for x in sorted(weak) if any(has(role, x[0], x[2]) for role in NEEDS[KINDS[x[1]]])]


def _cut(weak: list[Span], text: str) -> list[Span]:
    """The candidates, endpoints ending before the first bare secret that is a named value in them."""
    named = sorted(s for s, k, _ in weak if KINDS[k] == "bare" and s and text[s - 1] == "=")
    out = []
    for s, k, e in weak:
        at = bisect_left(named, s)
        out.append((s, k, named[at]) if KINDS[k] == "endpoint" and at < len(named) and named[at] < e else (s, k, e))
    return out


def joined(spans: list[Span]) -> str:
    """kind:start:end of each, comma-joined."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


FIELDS = (("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()))
_NONE = (0, 0, 0, hashlib.sha256(b"").hexdigest(), "")


def scan(text: str, likely=lambda kind: True) -> tuple:
    """Counts of the base kinds, the digest of their spans, and all spans."""
    base = base_spans(text, likely)
    every = sorted([*base, *linked_spans(text, base, likely)])
    counts = [sum(k == n for _, k, _ in base) for n in range(3)]
    return (*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every))


def _scanning(key: str, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                column_texts = texts(part.column(column))
                likely = {k: pc.match_substring_regex(column_texts, p).to_numpy(zero_copy_only=False) for k, p in FIRST.items()}
                base = likely["assign"] | likely["access"] | likely["hex"]
                secret, ident = likely["assign"] | likely["hex"] | likely["bare"], likely["access"] | likely["ident"]
                worth = base | secret & (ident | likely["endpoint"])
                rows = [_NONE] * part.num_rows
                for i in worth.nonzero()[0]:
                    rows[i] = scan(column_texts[int(i)].as_py(), lambda k, i=i: likely[k][i])
                arrays = [pa.array([r[n] for r in rows], kind) for n, (_, kind) in enumerate(FIELDS)]
                yield pa.RecordBatch.from_arrays([part.column(key), *arrays], [key, *(f for f, _ in FIELDS)])

    return run


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, counts, digest and spans of every row."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(_scanning(key, text), f"`{key}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_secret_scan": op6_secret_scan}
ORACLE_SQL: dict[str, str] = {}
