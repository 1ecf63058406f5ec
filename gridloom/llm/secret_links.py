r"""Secret scans with multipart credential linking.

Base spans, found anywhere in the whole text and always reported: assign (a keyword, = or :, and a
value of 6 or more characters), access (AKIA and 16 or more capitals or digits) and hex (24 or more
of 0-9a-f). The method adds weak candidates: `ident` (user or client identifiers), `endpoint` (URLs,
hosts with ports, IPv4 addresses) and `blob` (32 or more base64 characters of mixed classes, or the
value of a key too short for assign). A weak candidate is reported only where complementary parts
co-occur: within `reach` code points of it, inside one scope, there are parts of two other roles of
identifier, secret and endpoint, weak or not, or, for a blob, one identifier that isn't itself weak.

Scopes are paragraphs (stretches without an empty line). The interval join goes by sorted starts and the
furthest end so far of each role, so the work grows with the parts, not with their pairs or lengths.

Defined cases: a null text is empty; empty texts have no spans; repeated rows are scanned each;
other columns are ignored; an empty table gives an empty result. A text has no length limit.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

ASSIGN = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
IDENT = re.compile(r"\b(?i:user(?:name)?|login|client_?id|account(?:_?id)?|access_?key(?:_?id)?)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@-]{3,})", re.ASCII)
#: The parts of an endpoint, told in this order at one place: a URL; a host and port (a run of host characters
#: that ends in a name and before a port); an IPv4 address with or without one.
URL_OR_IP = re.compile(r"\b(?:([a-z][a-z0-9+]{1,15}://[A-Za-z0-9_.@:/?&=%~+-]+)|(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{2,5})?)", re.ASCII)
HOST_END = re.compile(r"(?<=[A-Za-z0-9-])(\.)[a-z]{2,10}:[0-9]{2,5}")
HOST_START = re.compile(r"\b(?=[A-Za-z0-9-])", re.ASCII)
_LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
BLOB = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,}={0,2}", re.ASCII)
SCOPE = re.compile(r"\n[ \t]*\n")
#: Roles that complement each other; the order of kinds with equal starts.
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "ident": "identifier", "endpoint": "endpoint", "blob": "secret"}
ORDER = {k: i for i, k in enumerate(ROLE)}
#: Code points between parts that belong together.
REACH = 200

Span = tuple[int, int, str]


def _keyed(text: str) -> bool:
    """Whether the text has a keyword of ASSIGN at all; cheaper than the pattern."""
    low = text.lower()
    return any(k in low for k in ("password", "passwd", "secret", "token", "apikey", "api_key"))


def base_spans(text: str) -> list[Span]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 6] if _keyed(text) else []
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], ORDER[s[2]]))


def endpoints(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping endpoints in one pass: hosts are found from their ports, and looked for
    backwards only to where the last host ended."""
    hosts = HOST_END.finditer(text) if ":" in text else iter(())
    others = URL_OR_IP.finditer(text)
    host, other, at, out = next(hosts, None), next(others, None), 0, []
    low = None  # where the labels before host's last dot begin
    while host or other:
        start = None
        if host:
            if low is None:
                dot = low = host.start(1)
                while low > at and (text[low - 1] in _LABEL or text[low - 1] == "." and text[low] != "."):
                    low -= 1
            first = HOST_START.search(text, max(low, at), dot)
            if first is None:
                host, low = next(hosts, None), None
                continue
            start = first.start()
        if other and (start is None or other.start() < start or other.start() == start and other[1]):
            found, at = (other.start(), other.end()), other.end()
        else:
            found, at = (start, host.end()), host.end()
        out.append(found)
        if other and other.start() < at:
            others = URL_OR_IP.finditer(text, at)
            other = next(others, None)
        while host and (host.start(1) <= at or host.end() <= at):
            host, low = next(hosts, None), None
    return out


def _weak(text: str, base: list[Span]) -> list[Span]:
    out = []
    if ":" in text or "=" in text or "." in text:
        out += [(m.start(), m.end(), "ident") for m in IDENT.finditer(text)]
        out += [(s, e, "endpoint") for s, e in endpoints(text)]
    for m in BLOB.finditer(text):
        v = m[0]
        if any(c.isdigit() for c in v) and any(c.islower() for c in v) and any(c.isupper() for c in v):
            out.append((m.start(), m.end(), "blob"))
    # short values are reported with an identifier near only
    if any(k == "ident" for _, _, k in out) or any(k == "access" for _, _, k in base):
        out += [(m.start(1), m.end(1), "blob") for m in ASSIGN.finditer(text) if len(m[1]) < 6]
    if not out:
        return out
    starts = [s[0] for s in base]
    ends = list(accumulate((e for _, e, _ in base), max))

    def free(s: Span) -> bool:
        i = bisect_left(starts, s[1])  # base spans that begin before its end
        return not i or ends[i - 1] <= s[0]

    return [s for s in out if free(s)]


def linked(text: str, base: list[Span], reach: int = REACH) -> list[Span]:
    """Weak candidates whose complementary parts co-occur."""
    weak = _weak(text, base)
    if not weak:
        return []
    cuts = [m.start() for m in SCOPE.finditer(text)]
    # of a role's parts, by start: the furthest end up to each, so that one look tells of any overlap
    begins, furthest = {}, {}
    for r in ("identifier", "secret", "endpoint", "access"):
        own = sorted((s, e) for s, e, k in base + weak if r in (k, ROLE[k]))
        begins[r] = [s for s, _ in own]
        furthest[r] = list(accumulate((e for _, e in own), max))
    kept = []
    for s, e, k in weak:
        i = bisect_right(cuts, s)
        low = max(cuts[i - 1] if i else 0, s - reach)
        high = min(cuts[i] if i < len(cuts) else len(text), e + reach)

        def meets(r: str) -> bool:
            j = bisect_left(begins[r], high)  # parts that begin before the window ends
            return j > 0 and furthest[r][j - 1] > low

        if all(meets(r) for r in ("identifier", "secret", "endpoint") if r != ROLE[k]) or k == "blob" and meets("access"):
            kept.append((s, e, k))
    return kept


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def spans(text: str | None, reach: int = REACH) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a text."""
    text = text or ""
    base = base_spans(text)
    more = linked(text, base, reach)
    return base, sorted(base + more, key=lambda s: (s[0], ORDER[s[2]])) if more else base


def _scan(reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, every = spans(text.as_py(), reach)
                kinds = [k for _, _, k in base]
                rows.append((*(kinds.count(k) for k in ("assign", "access", "hex")), hashlib.sha256(written(base).encode()).hexdigest(), written(every)))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans; a row for each row."""
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return d.mapInArrow(_scan(reach), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def _redact(reach: int, mark: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for c in tv.chunks(batch.column(at)):
                some, out = batch.slice(c.lo, c.n), []
                for x in some.column(at):
                    text = x.as_py()
                    if text:
                        parts, last = [], 0
                        for s, e, _ in spans(text, reach)[1]:
                            if e > last:
                                parts += [text[last : max(s, last)], mark if s >= last else ""]
                                last = e
                        text = "".join(parts) + text[last:] if parts else text
                    out.append(text)
                yield some.set_column(at, "text", pa.array(out, pa.string()))

    return run


def redact(docs: DataFrame, reach: int = REACH, mark: str = "[SECRET]") -> DataFrame:
    """docs with every reported span of text replaced by mark. All other columns stay."""
    return docs.mapInArrow(tv.tidy(_redact(reach, mark)), docs.schema)
