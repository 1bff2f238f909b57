"""Secret scans: Aho-Corasick prefilter, anchored expressions near its hits, embedded checksums."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

# The kinds in the order of their listing, and their formats.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "github", "npm")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
}
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CHECKED = {"github": re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})"),
           "npm": re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})")}
LEAST = {"assign": 8, "access": 16, "hex": 32}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

SPAN = StructType([
    StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()),
])


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, names in KEYWORDS.items():
        for name in names:
            out.add_word(name, (kind, len(name)))
    out.make_automaton()
    return out


def lowered(text: str) -> str:
    """Lower case with the positions kept."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(x := c.lower()) != 1 else x for c in text)


def checksum(payload: str) -> str:
    """Six base-62 digits of the CRC-32, as token issuers append it."""
    n, out = zlib.crc32(payload.encode()), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = BASE62[digit] + out
    return out


def hex_runs(text: str) -> Iterator[tuple[int, int]]:
    """Longest runs of hex digits of the least length: such a run covers every 32nd place somewhere, so only these are probed."""
    step, done = LEAST["hex"], 0
    for probe in HEX.finditer(text[step - 1 :: step]):
        for k in range(probe.start(), probe.end()):
            at = step - 1 + step * k
            if at < done:
                continue
            start = at
            while start > done and text[start - 1] in "0123456789abcdef":
                start -= 1
            done = HEX.match(text, at).end()
            if done - start >= step:
                yield start, done


def find(text: str, words: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then kind.

    Per kind the matches are leftmost and do not overlap: an expression is tried only where
    a keyword begins and the kind's last match has ended, then the length decides.
    """
    found, ends = [], dict.fromkeys(KINDS, 0)
    hits = sorted((last - n + 1, kind) for last, (kind, n) in words.iter(lowered(text)))
    for start, kind in hits:
        if start < ends[kind]:
            continue
        pattern = ASSIGN if kind == "assign" else ACCESS if kind == "access" else CHECKED[kind]
        m = pattern.match(text, start)
        if not m:
            continue
        if kind in CHECKED:
            if checksum(m[1]) != m[2]:
                continue
        elif len(m[2] if kind == "assign" else m[0]) < LEAST[kind]:
            ends[kind] = m.end()
            continue
        ends[kind] = m.end()
        found.append((kind, start, m.end()))
    found += [("hex", a, b) for a, b in hex_runs(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``secrets``: kind, start and end (code points, exclusive) of each span.

    Null and empty texts have no spans; long texts are read whole; repeated rows each get
    their spans; an empty table gives no rows; a column named ``secrets`` is replaced.
    """
    keep = tuple(c for c in keep if c != "secrets")
    schema = StructType([*[docs.schema[c] for c in keep], StructField("secrets", ArrayType(SPAN))])
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        for batch in batches:
            at = batch.schema.get_field_index("__text")
            spans = [
                [{"kind": k, "start": a, "end": b} for k, a, b in find(t.as_py() or "", words)] for t in batch.column(at)
            ]
            columns = [batch.column(batch.schema.get_field_index(f"__{i}")) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, span)], names=[*keep, "secrets"])

    given = docs.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(keep)], F.col(text).alias("__text"))
    return given.mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, the digest of the base spans and all spans as text."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind))

    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *[count(kind).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"),
    )
