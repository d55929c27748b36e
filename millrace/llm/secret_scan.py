"""Secrets in whole texts: fixed patterns, and novelty by compression.

A candidate is a long run of key characters, close after a sensitive word. Each is measured: its
novelty is the number of bytes that zstandard needs more for the surrounding text with the
candidate than without, when primed with a dictionary of identifiers and of the document's own
identifiers, whole and split at changes of case. A random key can't be
compressed; a name, a path or a placeholder can, because its parts are in the dictionary or
near by. Other places of the same candidate are taken out of the surrounding text, so that a
key is as new where it is repeated. Candidates that stay as long as they were are reported as well.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from millrace.llm.common import text_of

# Kinds in the order of a report, the patterns of the first three and their least lengths.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run is taken whole, as [0-9a-f]+ would
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

SENSITIVE = ("password", "passwd", "secret", "token", "apikey", "api_key", "api key", "credential", "private key", "auth", "bearer")
SENSITIVE_WORD = re.compile("|".join(map(re.escape, SENSITIVE)), re.IGNORECASE | re.ASCII)
LEAST_CANDIDATE = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_CANDIDATE)
RUN = re.compile("[A-Za-z0-9+/_=-]+")
WORD = re.compile("[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
IDENTIFIER = re.compile("[A-Za-z][0-9_/]|[0-9_/][A-Za-z]|[a-z][A-Z]")
LEAST_WORD = 4
REACH = 48  # code points between a sensitive word's end and a candidate's start
AROUND = 256  # code points of text on each side that a candidate is measured against
NOVEL_SHARE = 0.8  # of the candidate's length, in marginal bytes
ONE_CASE = 0.75  # letters of one case only carry less (log2 26 of log2 62 bits), so so much less is asked of them

IDENTIFIERS = """access account address admin algorithm allow_origin api_key application argument array async auth_token
authorization await base64 bearer boolean bucket buffer callback certificate changeme class client_id client_secret config
connection const container content_type context controller cookie credential database decode default delete description digest
directory document domain download element encode endpoint environment example export expires_in extends false filename final
function handler hashlib header hostname http https import include index input insert instance integer interface json key_id
language length license local localhost login module namespace null number object option output package parameter password
permission placeholder platform prefix private_key process production property protected provider public query random redirect
refresh_token region register release request require resource response result return role schema scope secret_key select self
server service session_id signature software static status storage string struct subscription suffix super system table
template test_key throw timeout timestamp token true type undefined update upload url user_agent username utf-8 uuid value
variable version void webhook website whitelist xxxxxxxxxxxxxxxx your_api_key_here 0123456789abcdef 1234567890"""

SCHEMA = (
    "doc_id BIGINT, n_assign BIGINT, n_access BIGINT, n_hex BIGINT, base_sha256 STRING, spans STRING, n_novel BIGINT, marginal_bytes STRING"
)


def _same(span: str) -> set[str]:
    """What counts as another place of a span: itself, and its long parts, as it may stand after other names or signs."""
    parts = (span.strip("+/_=-"), *span.split("="), *re.split("[+/=]", span))
    return {span, *(part for part in parts if len(part) >= LEAST_CANDIDATE)}


def _without(text: str, lo: int, hi: int, low: int, high: int, parts: Iterable[str]) -> str:
    """text[lo:hi] without the places of the parts within text[low:high], also those that lo or hi cuts."""
    places = []
    for part in parts:
        at = text.find(part, max(low, lo - len(part) + 1), min(high, hi + len(part) - 1))
        while at >= 0:
            places.append((at, at + len(part)))
            at = text.find(part, at + len(part), min(high, hi + len(part) - 1))
    kept = []
    for start, end in sorted(places):
        kept.append(text[lo : min(start, hi)])
        lo = max(lo, end)
    return "".join(kept) + text[lo:hi]


def names_and_parts(runs: Iterable[str]) -> list[str]:
    """The runs that are short enough to be no candidate, and the words that names are made of, in both cases, each once."""
    out = {}
    for run in runs:
        if len(run) < LEAST_CANDIDATE:
            out[run] = None
        for word in WORD.findall(run):
            if LEAST_WORD <= len(word) < LEAST_CANDIDATE:
                out |= dict.fromkeys((word, word.lower(), word.capitalize()))
    return list(out)


def own_names(text: str, spans: Iterable[tuple[int, int]]) -> list[str]:
    """Identifiers of a text (not its plain words) without what the spans hold, at any of their places."""
    spans = sorted(spans)
    held, k, runs = set().union(*(_same(text[start:end]) for start, end in spans)), 0, {}
    for m in RUN.finditer(text):
        while k < len(spans) and spans[k][1] <= m.start():
            k += 1
        touched = k < len(spans) and spans[k][0] < m.end()
        if touched or (m.end() - m.start() >= LEAST_CANDIDATE and not held.isdisjoint((*_same(m[0]), *re.split("[+/=_-]", m[0])))):
            continue
        if IDENTIFIER.search(m[0]):
            runs[m[0]] = None
    return names_and_parts(runs)


class Novelty:
    """Marginal compressed bytes of a string within its text, primed with a dictionary."""

    def __init__(self, identifiers: str = IDENTIFIERS, level: int = 3):
        self.identifiers, self.level = identifiers, level
        primed = "\n".join((*names_and_parts(identifiers.split()), identifiers))
        primed = zstandard.ZstdCompressionDict(primed.encode("utf-8", "replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level)
        self.compressor = zstandard.ZstdCompressor(dict_data=primed, level=level, write_content_size=False, write_checksum=False)

    def within(self, text: str, spans: Iterable[tuple[int, int]]) -> Novelty:
        """The same with the text's own names in the dictionary, for measuring the spans."""
        own = own_names(text, spans)
        return Novelty("\n".join((self.identifiers, *own)), self.level) if own else self

    def __call__(self, text: str, start: int, end: int) -> int:
        same = _same(text[start:end])
        before = _without(text, max(0, start - AROUND), start, 0, start, same)
        after = _without(text, end, min(len(text), end + AROUND), end, len(text), same)
        size = lambda x: len(self.compressor.compress(x.encode("utf-8", "replace")))
        return size(before + after + text[start:end]) - size(before + after)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of the fixed patterns' matches, in code points, sorted."""
    spans = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    lowered = text.lower()
    if any(word in lowered for word in ASSIGN_WORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    return sorted(spans)


def candidates(text: str, known: list[tuple[int, int, int]], reach: int = REACH) -> list[tuple[int, int]]:
    """(start, end) of the long runs in sensitive context that touch none of the known spans (sorted by start).

    A run counts if a sensitive word ends within ``reach`` code points before it, or in it: then what
    follows the first such word is the candidate. Words and runs are found once each and walked together.
    """
    runs = [m.span() for m in CANDIDATE.finditer(text)]
    if not runs:
        return []
    lowered = text.lower()
    if not any(word in lowered for word in SENSITIVE):
        return []
    ends = [m.end() for m in SENSITIVE_WORD.finditer(text)]
    furthest = list(itertools.accumulate((end for _, _, end in known), max))
    starts = [start for start, _, _ in known]
    found, k = [], 0
    for start, end in runs:
        while k < len(ends) and ends[k] < start - reach:
            k += 1
        if k == len(ends):
            break
        first = max(start, ends[k])
        if end - first < LEAST_CANDIDATE:
            continue
        before = bisect.bisect_left(starts, end)  # known spans that begin before its end
        if not before or furthest[before - 1] <= first:
            found.append((first, end))
    return found


def least_bytes(candidate: str, share: float = NOVEL_SHARE) -> float:
    """Marginal bytes from which a candidate is reported."""
    one_case = candidate.isalpha() and (candidate.islower() or candidate.isupper())
    return share * len(candidate) * (ONE_CASE if one_case else 1)


def measured_spans(text: str, novelty: Novelty, reach: int = REACH, share: float = NOVEL_SHARE) -> list[tuple[int, int, int, int]]:
    """(start, index of the kind, end, marginal bytes) of the fixed patterns' matches and the incompressible candidates, sorted."""
    base = base_spans(text)
    found = candidates(text, base, reach)
    if not (base or found):
        return []
    within = novelty.within(text, [*((start, end) for start, _, end in base), *found])
    spans = [(start, kind, end, within(text, start, end)) for start, kind, end in base]
    novel = ((start, 3, end, within(text, start, end)) for start, end in found)
    return sorted([*spans, *(x for x in novel if x[3] >= least_bytes(text[x[0] : x[2]], share))])


def _joined(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _scan(identifiers: str, reach: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(identifiers)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                found = measured_spans(text.as_py(), novelty, reach, share)
                spans = [x[:3] for x in found]
                counts = [sum(kind == k for _, kind, _ in spans) for k in range(4)]
                digest = hashlib.sha256(_joined(x for x in spans if x[1] < 3).encode()).hexdigest()
                marginal = ",".join(str(x[3]) for x in found)
                rows.append((*counts[:3], digest, _joined(spans), counts[3], marginal))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.string()]
            arrays = [pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)]
            names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel", "marginal_bytes"]
            yield pa.record_batch([batch.column("doc_id"), *arrays], names=["doc_id", *names])

    return run


def scan_secrets(docs: DataFrame, identifiers: str = IDENTIFIERS, reach: int = REACH, share: float = NOVEL_SHARE) -> DataFrame:
    """One row per document: counts and spans of secrets, and each span's marginal bytes.

    ``spans`` lists kind:start:end by start and then kind, comma-joined, in code points with
    an exclusive end; ``base_sha256`` is the digest of the list without the kind "novel". A
    candidate starts at most ``reach`` code points after a sensitive word, and is reported if its
    marginal bytes are at least ``share`` of its length (less for letters of one case, ``least_bytes``). A
    null or empty text has no spans. Rows are independent of each other: a null or repeated
    doc_id is returned as it is.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return rows.mapInArrow(_scan(identifiers, reach, share), SCHEMA)
