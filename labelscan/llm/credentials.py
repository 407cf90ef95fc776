"""Secrets: fixed patterns, and weak candidates that an interval join links to the other parts of a credential.

The patterns find the base spans, in time proportional to the text: they are tried only where one of their fixed words,
or a long enough run of their bytes, stands.

A credential has parts: an identifier, a secret, and perhaps an endpoint. Weak candidates are what looks like a part but
is too common to be reported by itself:

* token (a secret): a run of TOKEN bytes, 16 to 128 long, with digits, capitals and small letters and an entropy of at
  least 3.5 bits a byte; or the password of an address such as scheme://user:password@host;
* user (an identifier): the value assigned to a name such as user, login, client_id or key_id, the user of such an
  address, or a temporary access key;
* endpoint: an address with a scheme, or the value assigned to a name such as host, server or endpoint.

The scope of a part is its paragraph (a stretch without an empty line) as far as REACH characters from the part. Scopes
are joined by bins of their document: a token is reported if an identifier is in its scope, a user if a secret is, and an
endpoint if both are; base spans are parts too (access an identifier, assign and hex secrets). A bin holds no more parts
than its characters have room for, so that a document of any number of parts makes pairs in proportion to its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscan.llm.shared import pieces, stored

BASE, WEAK = ("assign", "access", "hex"), ("token", "user", "endpoint")
KINDS = (*BASE, *WEAK)
#: Which part of a credential each kind is.
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "token": "secret", "user": "identifier", "endpoint": "endpoint"}
#: What must stand in the scope of a weak candidate of each kind.
NEEDS = {"token": ("identifier",), "user": ("secret",), "endpoint": ("identifier", "secret")}
REACH = 200
SPAN = "array<struct<kind:string,start:long,end:long>>"

#: Words and patterns of the base kinds (fixed values).
WORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")

#: Names and forms of the weak kinds.
USER_NAME = re.compile(rb"""(?:user|user_?name|user_?id|login|account|client_?id|(?:access_?)?key_?id)["']?\x20*$""", re.I)
HOST_NAME = re.compile(rb"""(?:host|host_?name|server|endpoint|base_?url|database)["']?\x20*$""", re.I)
VALUE = re.compile(rb"""[:=]\x20*["']?([A-Za-z0-9+/_.=@:-]{3,128})""")
TEMPORARY = re.compile(rb"A(?:SI|RO|ID|GP)A[A-Z0-9]{16,}")
SCHEME = re.compile(rb"[A-Za-z][A-Za-z0-9+.-]{1,15}$")
ADDRESS = re.compile(rb"""://(?:([^\s:/@"'<>]{1,128}):([^\s:/@"'<>]{1,128})@)?([^\s/"'<>]+)""")
NAME_BYTES = 32  # of a name before its sign at most

_HEX, _TOKEN, _DIGIT, _UPPER, _LOWER = (np.zeros(256, bool) for _ in range(5))
_DIGIT[48:58] = _UPPER[65:91] = _LOWER[97:123] = True
_HEX[[*range(48, 58), *range(97, 103)]] = True
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_="]] = True


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return edges[::2], edges[1::2]


def _places(raw: bytes, word: bytes) -> Iterator[int]:
    at = raw.find(word)
    while at >= 0:
        yield at
        at = raw.find(word, at + 1)


def base_spans(raw: bytes, data: np.ndarray) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns' matches that are long enough, leftmost and without overlaps within a kind."""
    found, lower, done = [], raw.lower(), 0
    for at in sorted(p for w in WORDS for p in _places(lower, w)):
        if at >= done and (m := ASSIGN.match(raw, at)):
            done = m.end()
            if len(m[1]) >= 6:
                found.append(("assign", at, done))
    done = 0
    for at in _places(raw, b"AKIA"):
        if at >= done and (m := ACCESS.match(raw, at)):
            done = m.end()
            if done - at >= 20:
                found.append(("access", at, done))
    starts, ends = _runs(_HEX[data])
    return found + [("hex", a, b) for a, b in zip(starts.tolist(), ends.tolist(), strict=True) if b - a >= 24]


def _entropy(token: bytes) -> float:
    p = np.unique(np.frombuffer(token, np.uint8), return_counts=True)[1] / len(token)
    return float(-(p * np.log2(p)).sum())


def weak_spans(raw: bytes, data: np.ndarray) -> list[tuple[str, int, int]]:
    """(kind, start, end) of what could be part of a credential."""
    found = []
    starts, ends = _runs(_TOKEN[data])
    sums = [np.concatenate(([0], np.cumsum(c[data]))) for c in (_DIGIT, _UPPER, _LOWER)]
    fit = (ends - starts >= 16) & (ends - starts <= 128)
    for s in sums:
        fit &= s[ends] > s[starts]
    found += [("token", a, b) for a, b in zip(starts[fit].tolist(), ends[fit].tolist(), strict=True) if _entropy(raw[a:b]) >= 3.5]
    for at in np.flatnonzero((data == 58) | (data == 61)).tolist():
        name = raw[max(0, at - NAME_BYTES) : at]
        if raw.startswith(b"://", at):
            if (scheme := SCHEME.search(name)) and (m := ADDRESS.match(raw, at)):
                found += [(k, *m.span(g)) for k, g in (("user", 1), ("token", 2)) if m[g]]
                found.append(("endpoint", *m.span(3)) if m[1] else ("endpoint", at - len(scheme[0]), m.end()))
            continue
        kind = "user" if USER_NAME.search(name) else "endpoint" if HOST_NAME.search(name) else None
        if kind and (m := VALUE.match(raw, at)):
            found.append((kind, *m.span(1)))
    found += [("user", *m.span()) for word in (b"ASIA", b"AROA", b"AIDA", b"AGPA") for at in _places(raw, word) if (m := TEMPORARY.match(raw, at))]
    return found


def _apart(spans: list[tuple[str, int, int]], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The spans that touch no base span and none before them in their order: by start, longest first."""
    out, blocked = [], sorted((a, b) for _, a, b in base)
    ends = np.maximum.accumulate(np.array([b for _, b in blocked], np.int64)) if blocked else np.empty(0, np.int64)
    starts, done = np.array([a for a, _ in blocked], np.int64), 0
    for kind, a, b in sorted(set(spans), key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        i = int(np.searchsorted(starts, b))  # base spans that begin before this one's end
        if a >= done and not (i and ends[i - 1] > a):
            out.append((kind, a, b))
            done = b
    return out


def parts(docs: DataFrame) -> DataFrame:
    """(row, doc_id, base, weak, paragraphs): spans of each text in code points, and the paragraphs (start, end) of texts with weak ones."""

    def spans(found: list[list[tuple[str, int, int]]]) -> pa.Array:
        flat = [s for x in found for s in x]
        columns = list(zip(*flat, strict=True)) if flat else [[], [], []]
        values = pa.StructArray.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["kind", "start", "end"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
                raw = b"\n".join(texts)  # no pattern takes a line feed
                data = np.frombuffer(raw, np.uint8)
                points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
                base, weak = base_spans(raw, data), weak_spans(raw, data)
                weak = _apart(weak, base)
                lists = []
                for found, order in ((base, lambda s: (s[1], KINDS.index(s[0]))), (weak, lambda s: s[1])):
                    rows: list[list[tuple[str, int, int]]] = [[] for _ in texts]
                    for kind, a, b in sorted(found, key=order):
                        d = int(np.searchsorted(first, a, "right")) - 1
                        rows[d].append((kind, int(points[a] - points[first[d]]), int(points[b] - points[first[d]])))
                    lists.append(rows)
                breaks = [[int(points[first[d] + m.end()] - points[first[d]]) for m in re.finditer(rb"\n[ \t\r]*\n", t)] if lists[1][d] else [] for d, t in enumerate(texts)]
                offsets = pa.array(np.cumsum([0, *map(len, breaks)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), *map(spans, lists), pa.ListArray.from_arrays(offsets, pa.array([x for b in breaks for x in b], pa.int64()))], ["row", "doc_id", "base", "weak", "breaks"]
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows.mapInArrow(run, f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, base {SPAN}, weak {SPAN}, breaks array<long>")


def linked(found: DataFrame) -> DataFrame:
    """(row, kind, start, end, partners): weak candidates of parts() with what they need in their scope.

    partners are the nearest part of each role that is needed: (role, kind, start, end).
    """
    spans = found.where("size(weak) > 0").select("row", "breaks", F.explode(F.concat("base", "weak")).alias("s")).select("row", "breaks", "s.*")
    role = F.element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), F.col("kind"))
    before = F.coalesce(F.array_max(F.filter("breaks", lambda x: x <= F.col("start"))), F.lit(0))
    after = F.coalesce(F.array_min(F.filter("breaks", lambda x: x > F.col("start"))), F.lit(1 << 62))
    spans = spans.select("row", "kind", "start", "end", role.alias("role"), F.greatest(before, F.col("start") - REACH).alias("low"), F.least(after, F.col("end") + REACH).alias("high"))
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / REACH), F.floor(b / REACH)))
    weak = spans.where(F.col("kind").isin(*WEAK)).withColumn("bin", bins(F.col("low"), F.col("high")))
    other = spans.select("row", *[F.col(c).alias(f"o_{c}") for c in ("kind", "start", "end", "role")], F.floor(F.col("start") / REACH).alias("bin"))
    needs = F.element_at(F.create_map(*[x for k, v in NEEDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.col("kind"))
    pairs = weak.join(other, ["row", "bin"]).where((F.col("o_start") >= F.col("low")) & (F.col("o_end") <= F.col("high")) & F.array_contains(needs, F.col("o_role")))
    far = F.greatest(F.col("o_start") - F.col("end"), F.col("start") - F.col("o_end"))
    one = F.min(F.struct(far.alias("far"), F.col("o_role").alias("role"), F.col("o_kind").alias("kind"), F.col("o_start").alias("start"), F.col("o_end").alias("end"))).alias("one")
    nearest = pairs.groupBy("row", "kind", "start", "end", "o_role").agg(one)
    whole = nearest.groupBy("row", "kind", "start", "end").agg(F.array_sort(F.collect_list(F.struct("one.role", "one.kind", "one.start", "one.end"))).alias("partners"))
    return whole.where(F.size("partners") == F.size(needs))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans, links): base spans by start and then kind, all spans likewise, and the linked candidates with their partners.

    docs is (doc_id, text); every row is a document, repeated ids too. Null and empty texts have no spans, further
    columns are ignored, an empty table gives no rows.
    """
    found = stored(parts(docs), "parts")
    links = linked(found).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind", "partners"))).alias("links"))  # those of a text
    empty = F.array().cast("array<struct<start:long,end:long,kind:string,partners:array<struct<role:string,kind:string,start:long,end:long>>>>")
    out = found.join(links, "row", "left").withColumn("links", F.coalesce("links", empty))
    place = F.array(*map(F.lit, KINDS))
    keyed = F.transform(F.concat("base", F.transform("links", lambda x: F.struct(x["kind"], x["start"], x["end"]))), lambda s: F.struct(s["start"].alias("start"), F.array_position(place, s["kind"]).alias("place"), s["kind"].alias("kind"), s["end"].alias("end")))
    spans = F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return out.select("doc_id", "base", spans.alias("spans"), "links")
