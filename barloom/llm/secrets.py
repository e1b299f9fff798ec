"""Secrets in texts, and credentials whose parts are found apart.

Certain ("base") spans are found alone: assignments of a secret, access identifiers, long hex strings.  Weak
candidates (an account name, a bare random-looking string, an address) are common in clean text, so they are
reported only where the parts that complete a credential stand near: each part is an interval of ``reach``
characters around it within its scope (a paragraph), and intervals of one scope are joined by a sweep in order
of position: the end of the last part of a role before, the start of the next one behind.  That reads each
part once, also in a text full of them.

* identifier (weak): a secret, weak or certain, within reach
* candidate (weak secret): an identifier or an endpoint within reach
* endpoint: both an identifier and a secret within reach

Weak spans that touch a certain one, or an earlier kind of weak ones, are dropped.  Places are code points,
ends exclusive.  Nulls: a null text is empty; doc_id may be null.  Equal rows each get a row with the same
result; rows that share only doc_id are told apart by a hash of their texts.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

KINDS = ("assign", "access", "hex", "identifier", "candidate", "endpoint")
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "identifier": "identifier", "candidate": "secret", "endpoint": "endpoint"}
#: Fixed patterns of the certain kinds; matches with a shorter value, or shorter ones, are dropped.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")              # a run of these characters is one match, so its length can be asked at once
ASSIGN_VALUE, ACCESS_LENGTH = 6, 20
#: Weak kinds.
IDENTIFIER = re.compile(r"""(?:access_?key(?:_?id)?|client_?id|user(?:_?name)?|login|account(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.=-]{3,})""", re.I | re.A)
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])", re.A)
ENDPOINT = re.compile(r"""[a-z][a-z0-9+.-]{1,20}://[^\s"'<>]{3,}|(?:endpoint|host(?:_?name)?|server)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.:/-]{4,})""", re.I | re.A)
SCOPE = re.compile(r"\n[ \t]*\n")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Certain spans by start, then kind."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _random_looking(word: str) -> bool:
    return any(c.isdigit() for c in word) and any(c.islower() for c in word) and any(c.isupper() for c in word)


def weak_spans(text: str, taken: list[Span]) -> list[Span]:
    """Weak candidates that touch no taken span and no earlier kind."""
    found: list[Span] = []
    if ":" in text or "=" in text:
        found += [("identifier", m.start(), m.end()) for m in IDENTIFIER.finditer(text)]
        found += [("endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    found += [("candidate", m.start(), m.end()) for m in CANDIDATE.finditer(text) if _random_looking(m[0])]
    kept: list[Span] = []
    for rank in (("identifier",), ("endpoint",), ("candidate",)):
        held = sorted((s[1], s[2]) for s in taken + kept)
        i = 0
        for s in (s for s in found if s[0] in rank):
            while i < len(held) and held[i][1] <= s[1]:
                i += 1
            if i == len(held) or held[i][0] >= s[2]:
                kept.append(s)
    return sorted(kept, key=lambda s: s[1])


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


PART = "array<struct<start:int,end:int,kind:string,scope:int,weak:boolean>>"


def parts(docs: DataFrame) -> DataFrame:
    """A row a document: doc_id, key, n_assign, n_access, n_hex, base_sha256, parts (certain and weak, with scopes)."""
    def find(batches):
        for batch in batches:
            for at in range(0, len(batch), 256):
                rows = []
                for doc_id, key, text in zip(*(batch.column(i).slice(at, 256).to_pylist() for i in range(3))):
                    text = text or ""
                    base = base_spans(text)
                    weak = weak_spans(text, base)
                    scopes = [m.start() for m in SCOPE.finditer(text)] if weak else []
                    found, scope = [], 0
                    for s in sorted(base + weak, key=lambda s: (s[1], KINDS.index(s[0]))):
                        while scope < len(scopes) and scopes[scope] < s[1]:
                            scope += 1
                        found.append({"start": s[1], "end": s[2], "kind": s[0], "scope": scope, "weak": KINDS.index(s[0]) > 2})
                    count = [sum(s[0] == k for s in base) for k in KINDS[:3]]
                    rows.append((doc_id, key, *count, hashlib.sha256(written(base).encode()).hexdigest(), found))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    part = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("scope", pa.int32()), ("weak", pa.bool_())]))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), part]
    names = ["doc_id", "key", "n_assign", "n_access", "n_hex", "base_sha256", "parts"]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text") \
        .mapInArrow(find, f"doc_id long, key long, n_assign long, n_access long, n_hex long, base_sha256 string, parts {PART}")


def linked(found: DataFrame, reach: int = 300) -> DataFrame:
    """Weak parts that others complete: doc_id, key, links (array of start, end, kind)."""
    rows = found.where(F.exists("parts", lambda p: p["weak"])).select("doc_id", "key", "parts").dropDuplicates(["doc_id", "key"]) \
        .select("doc_id", "key", F.inline("parts"))
    role = F.element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), F.col("kind"))
    rows = rows.withColumn("role", role)
    scope = Window.partitionBy("doc_id", "key", "scope")
    before = scope.orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    behind = scope.orderBy(F.col("start").desc(), F.col("end").desc(), F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, -1)
    near = {r: (F.coalesce(F.col("start") - F.max(F.when(F.col("role") == r, F.col("end"))).over(before) <= reach, F.lit(False))
                | F.coalesce(F.min(F.when(F.col("role") == r, F.col("start"))).over(behind) - F.col("end") <= reach, F.lit(False)))
            for r in ("identifier", "secret", "endpoint")}
    rows = rows.withColumns({f"near_{r}": c for r, c in near.items()})
    complete = (F.when(F.col("kind") == "identifier", F.col("near_secret"))
                .when(F.col("kind") == "candidate", F.col("near_identifier") | F.col("near_endpoint"))
                .otherwise(F.col("near_identifier") & F.col("near_secret")))
    return rows.where(F.col("weak") & complete).groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "end", "kind")).alias("links"))


def secrets(docs: DataFrame, reach: int = 300) -> DataFrame:
    """``docs`` (doc_id, text) with n_assign, n_access, n_hex, base_sha256, found (array of start, end, kind) and key."""
    found = cut(parts(docs))
    more = linked(found, reach)
    a, b = found.alias("a"), more.alias("b")
    rank = F.create_map(*[F.lit(x) for kv in zip(KINDS, range(len(KINDS))) for x in kv])
    certain = F.transform(F.filter("a.parts", lambda p: ~p["weak"]), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["kind"].alias("kind")))
    every = F.concat(certain, F.coalesce("b.links", F.array().cast("array<struct<start:int,end:int,kind:string>>")))
    order = F.array_sort(F.transform(every, lambda s: F.struct(s["start"].alias("start"), F.element_at(rank, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.key") == F.col("b.key")), "left") \
        .select("a.doc_id", "a.key", "n_assign", "n_access", "n_hex", "base_sha256", order.alias("found"))


def spans_text(found) -> object:
    """The spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(docs: DataFrame, reach: int = 300, mark: str = "<secret>") -> DataFrame:
    """All columns of ``docs``, every span found replaced by ``mark``; n_chars follows, where there is such a column."""
    spans = secrets(docs, reach).where(F.size("found") > 0).dropDuplicates(["doc_id", "key"]).select(
        F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("_found"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("doc_id").cast("long").alias("_id0"), F.xxhash64("text").alias("_key0"))
    rows = rows.join(spans, F.col("_id0").eqNullSafe(F.col("_id")) & (F.col("_key0") == F.col("_key")), "left")

    @F.pandas_udf("string")
    def masked(text, found):
        def one(t, spans):
            if t is None or spans is None or not len(spans):
                return t
            out, at = [], 0
            for s in spans:
                if s["start"] >= at:
                    out += [t[at:s["start"]], mark]
                at = max(at, s["end"])
            return "".join(out) + t[at:]
        return pd.Series([one(t, f) for t, f in zip(text, found)], dtype=object)

    rows = rows.withColumn("_text", F.when(F.col("_found").isNull(), F.col("_doc.text")).otherwise(
        masked(F.when(F.col("_found").isNotNull(), F.col("_doc.text")), "_found")))    # other texts stay out of Python
    new = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])
