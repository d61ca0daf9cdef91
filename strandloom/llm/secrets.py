"""Operator 9, secret scans: pattern kinds plus multipart credentials linked inside scopes."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "endpoint", "weak_secret", "weak_id")

_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
# Parts that mean nothing alone: an endpoint, a bare key body, an account identifier.
_URL = re.compile(r"""(?:https?|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\s"'<>]+""", re.A)
_DOTTED = re.compile(r"(?<![A-Za-z0-9_.@-])(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?![A-Za-z0-9_-])", re.A)
_PORT = re.compile(r":[0-9]{1,5}(?![0-9A-Za-z_])")
_ADDRESS = re.compile(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}")
#: A name before what it names a host: then labels without a port are one too.
_NAMED = re.compile(r"(?<![A-Za-z])(?:host(?:name)?|server|endpoint|url|address|addr|domain|broker|proxy|database|db|at|on|via)[\"']?\x20*[:=]?\x20*[\"']?$", re.A | re.I)
_BODY = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
_ACCOUNT = re.compile(r"(?<![0-9A-Za-z])(?:\d{12}(?![0-9A-Za-z])|(?:user(?:name)?|login|client_?id|account)\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{3,})", re.A | re.I)


def endpoint_spans(text: str) -> list[tuple[int, int]]:
    """URLs, IPv4 addresses, and host names, with a port behind them.

    A host name has two labels or more between dots, of which the last begins with a letter. It
    counts if it begins with ``www.``, a port follows, or a word before it says that it is a host;
    other dotted words are versions, files or prose. No list of domains decides.
    """
    urls = [m.span() for m in _URL.finditer(text)]
    starts, out = [s for s, _ in urls], list(urls)
    for m in _DOTTED.finditer(text):
        s, e = m.span()
        if (i := bisect_left(starts, e)) and urls[i - 1][1] > s:
            continue  # inside a URL
        port = _PORT.match(text, e)
        if _ADDRESS.fullmatch(text, s, e):
            if any(int(x) > 255 for x in m.group().split(".")):
                continue
        else:
            top = m.group().rsplit(".", 1)[1]
            named = len(top) > 1 and (text.startswith("www.", s) or _NAMED.search(text, max(0, s - 24), s))
            if not top[0].isalpha() or not (port or named):
                continue
        out.append((s, port.end() if port else e))
    return sorted(out)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the three self-evident kinds, leftmost and non-overlapping within a kind."""
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [("hex", *m.span()) for m in _HEX.finditer(text)]


def _mixed(body: str) -> bool:
    """Random-looking key material has digits and both letter cases."""
    return any(c.isdigit() for c in body) and any(c.islower() for c in body) and any(c.isupper() for c in body)


def linked_spans(text: str, base: list[tuple[str, int, int]], reach: int) -> list[tuple[str, int, int]]:
    """Weak parts that co-occur with complementary parts.

    Three sorted lists of parts (identifiers, secrets, endpoints) are interval-joined: parts
    link if they lie in one paragraph (no blank line between) and at most ``reach`` code points
    apart. A bare key body is reported next to an identifier or endpoint, an account next to a
    secret, an endpoint only where an identifier and a secret are both in reach.
    """
    covered = merge_spans(base)
    starts = [s for s, _ in covered]

    def free(s: int, e: int) -> bool:
        """Not inside or across what a base kind has: merged spans, so the last that starts before e tells."""
        i = bisect_left(starts, e)
        return not i or covered[i - 1][1] <= s

    bodies = [m.span() for m in _BODY.finditer(text) if _mixed(m.group()) and free(*m.span())]
    if not bodies and not base:
        return []
    ids = [(s, e) for k, s, e in base if k == "access"]
    secrets = [(s, e) for k, s, e in base if k != "access"]
    points = [x for x in endpoint_spans(text) if free(*x)]
    accounts = [m.span() for m in _ACCOUNT.finditer(text) if free(*m.span())]
    if not (bodies or points or accounts):
        return []
    breaks = [m.start() for m in re.finditer(r"\n[^\S\n]*\n", text)]
    scope = lambda at: bisect_right(breaks, at)

    def near(span: tuple[int, int], others: list[tuple[int, int]], begins: list[int], scopes: list[int], tops: list[int]) -> bool:
        """others are sorted; ``tops``, the furthest end so far in the paragraph, tells the first that can be in reach."""
        own = scope(span[0])
        lo = bisect_left(tops, span[0] - reach, bisect_left(scopes, own), bisect_right(scopes, own))
        for s, e in others[lo : bisect_right(begins, span[1] + reach)]:
            if (s, e) != span and s - span[1] <= reach and span[0] - e <= reach and scope(s) == own:
                return True
        return False

    def listed(parts: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[int], list[int], list[int]]:
        begins, tops = [s for s, _ in parts], [e for _, e in parts]
        scopes = [scope(s) for s in begins]
        for i in range(1, len(parts)):
            if scopes[i] == scopes[i - 1]:
                tops[i] = max(tops[i], tops[i - 1])
        return parts, begins, scopes, tops

    groups = {"id": listed(sorted(ids + accounts)), "secret": listed(sorted(secrets + bodies)), "point": listed(sorted(points))}
    close = lambda span, kind: near(span, *groups[kind])
    out = [("weak_secret", *x) for x in bodies if close(x, "id") or close(x, "point")]
    out += [("weak_id", *x) for x in accounts if close(x, "secret")]
    return out + [("endpoint", *x) for x in points if close(x, "id") and close(x, "secret")]


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("spans", T.ArrayType(_SPAN))])
_WITH_TEXT = T.StructType([*_SCHEMA.fields, T.StructField("text", T.StringType())])


def _arrow_spans(rows: list[list[tuple[str, int, int]]]) -> pa.Array:
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    return pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in rows], pa.list_(kind))


def scan_text(text: str, reach: int = 400) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end; code points, end exclusive) of one text, in order."""
    base = base_spans(text)
    return ordered(base + linked_spans(text, base, reach))


def find_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id", reach: int = 400) -> DataFrame:
    """One row per document: doc_id, spans (array of kind, start, end) over its whole text.

    Narrow: no shuffle, one pass, memory of one Arrow batch. A null text has no spans, repeated
    rows each give a row, other columns are ignored, an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [scan_text(t.as_py() or "", reach) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), _arrow_spans(spans)], ["doc_id", "spans"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, _SCHEMA)


def merge_spans(spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((s, e) for _, s, e in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def redact_text(text: str, reach: int = 400, mark: str = "<SECRET>") -> str:
    """The text with every span replaced by ``mark``; overlapping spans by one."""
    out, at = [], 0
    for s, e in merge_spans(scan_text(text, reach)):
        out += [text[at:s], mark]
        at = e
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, reach: int = 400, mark: str = "<SECRET>") -> DataFrame:
    """All documents with secrets replaced by ``mark``; n_chars follows. Null texts stay null.

    Repeated rows are rows of their own; other columns are kept; an empty table gives none. ``text`` is a string.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index("text")
            texts = [None if t is None else redact_text(t, reach, mark) for t in (x.as_py() for x in b.column(i))]
            yield b.set_column(i, "text", pa.array(texts, b.schema.field(i).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def span_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (text) from find_secrets' rows."""
    of = lambda *kinds: F.filter("spans", lambda x: x.kind.isin(*kinds))
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    n = lambda kind: F.size(of(kind)).cast("long").alias(f"n_{kind}")
    base = F.sha2(F.encode(text(of("assign", "access", "hex")), "UTF-8"), 256)
    return found.select("doc_id", n("assign"), n("access"), n("hex"), base.alias("base_sha256"), text(F.col("spans")).alias("spans"))
