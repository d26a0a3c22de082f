"""Secret scans: fixed patterns, and strings that zstandard can't explain from their surroundings.

The base patterns (assignments, access keys, hexadecimal runs) are always reported. Beside them a candidate is a run of
16 or more key characters that holds a digit and a letter and stands after a sensitive word. Its novelty is the number
of bytes that it adds to the compressed size of its surroundings without other copies of it, under a dictionary of common
identifiers (a fixed list, IDENTIFIERS); a candidate that adds at least ``NOVELTY`` bytes a character can't be pieced together from code and identifiers and is reported as
``novel``. All of it is local to a document: no shuffle, and a lost task is simply run again.

Positions are code points of the whole text; an assignment's span is the whole match.

Edge cases: null and empty texts have no spans; a null key stays null; repeated rows are scanned alike; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

# Kinds in the order in which equal starts are listed, their patterns and least lengths.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_CHARS = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
MIXED = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])", re.DOTALL)
#: Words that make the text after them sensitive, and how many characters after them.
SENSITIVE = re.compile(r"pass|pwd|secret|token|key|credential|auth|bearer|private|signature|session|cookie", re.IGNORECASE | re.ASCII)
REACH = 48
#: Characters on each side that a candidate is compressed with.
AROUND = 400
#: Compressed bytes that each character must add.
NOVELTY = 0.6

IDENTIFIERS = """
abstract access account address admin allow api application args array async auth authorization await base64 bearer
begin boolean bucket build bytes cache callback catch certificate char class client cluster column commit config
connection const content context cookie count create credential data database date debug decode default define delete
describe digest directory double else encode encoding encrypt endpoint env environment error event except expires export
extends false field file filter float format from function getattr global group handler hash header host http https id
identifier if import include index input instance integer interface is_valid iterator json key lambda latest length
library license list localhost login logger main map master message metadata method mode model module name namespace
null number object offset option order output package page param parameters parse password path pattern payload port
prefix private production profile property protected protocol public python query read record refresh region release
request require resource response result return role root schema secret select self server service session setting
sha256 signature source src start static status storage stream string struct system table target template test text
throw timeout timestamp token trace transaction true type undefined unsigned update upload uri url user username uuid
value var vector version void warning while window worker write xml yaml
0123456789abcdef ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz
def __init__(self, *args, **kwargs): return None; public static void main(String[] args) { System.out.println(); }
const client = new Client({ host: "localhost", port: 8080 }); import os; os.environ["API_KEY"]; export PATH=/usr/local/bin
"""


@lru_cache(1)
def compressor() -> zstandard.ZstdCompressor:
    words = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(level=6)
    return zstandard.ZstdCompressor(dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False)


def novelty(before: str, candidate: str, after: str) -> float:
    """Bytes that each character of the candidate adds to the compressed surroundings."""
    pack = compressor().compress
    around = (before + "\n" + after).encode()
    return (len(pack(around + b"\n" + candidate.encode())) - len(pack(around + b"\n"))) / len(candidate)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), in the order in which they are listed."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def novel_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates that no base span touches and that nothing around them explains."""
    spans, b, reach, quiet = [], 0, 0, sorted((s, e) for s, _, e in base)
    for s, e in quiet:  # spans may overlap: keep the furthest end so far
        reach = max(reach, e)
        spans.append((s, reach))
    quiet, spans = spans, []
    for m in CANDIDATE.finditer(text):
        while b < len(quiet) and quiet[b][1] <= m.start():
            b += 1
        if b < len(quiet) and quiet[b][0] < m.end() or not MIXED.match(m[0]):
            continue
        if SENSITIVE.search(text, max(0, m.start() - REACH), m.start()):
            # Other copies of the candidate don't explain it.
            before, after = (part.replace(m[0], " ") for part in (text[max(0, m.start() - AROUND) : m.start()], text[m.end() : m.end() + AROUND]))
            if novelty(before, m[0], after) >= NOVELTY:
                spans.append((m.start(), 3, m.end()))
    return spans


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of a text."""
    base = base_spans(text) if text else []
    return base, sorted(base + novel_spans(text, base)) if text else []


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])
SPAN_DDL = "array<struct<kind:string,start:long,stop:long>>"


def find_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, base and spans: arrays of (kind, start, stop), base without what the novelty adds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = lambda spans: [{"kind": KINDS[k], "start": s, "stop": e} for s, k, e in spans]
        for batch in batches:
            found = [scan(t) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([told(b) for b, _ in found], pa.list_(SPAN)), pa.array([told(a) for _, a in found], pa.list_(SPAN))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "base", "spans"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, base {SPAN_DDL}, spans {SPAN_DDL}")


def redact(text: str, spans: list) -> str:
    """The text with each span (of any overlap) replaced by its kind."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["stop"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"<{s['kind']}>"]
        at = max(at, s["stop"])
    return "".join(out) + text[at:]
