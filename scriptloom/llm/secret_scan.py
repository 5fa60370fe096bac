"""Secret scan: Aho-Corasick keyword prefilter, anchored patterns near hits, embedded checksums.

One pass over the ASCII-folded text finds every keyword at once. A pattern of a kind is then
matched only at the place where one of its keywords stands, so text without keywords costs
nothing beyond the automaton. Kinds that carry a checksum or a decodable header are reported
only if that validates. Runs of hex digits have no keyword; they are found as runs.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_text, map_arrow, non_empty

#: In the order in which spans that start together are listed.
BASE_KINDS = ("assign", "access", "hex")
EXTRA_KINDS = ("github", "npm", "jwt", "pem")
ORDER = {kind: i for i, kind in enumerate(BASE_KINDS + EXTRA_KINDS)}

#: Folded keyword -> kind.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm",
    "eyj": "jwt",
    "-----begin ": "pem",
}
HEX_RUN = re.compile(r"[0-9a-f]{24,}")
ANCHORED = {
    "assign": re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "github": re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "jwt": re.compile(r"(eyJ[A-Za-z0-9_-]++)\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++"),
    "pem": re.compile(r"-----BEGIN ((?:[A-Z]+ )?PRIVATE KEY)-----([A-Za-z0-9+/=\s]++)-----END \1-----"),
}
JWT_RUN = re.compile(r"[A-Za-z0-9_-]++")
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62(value: int, width: int = 6) -> str:
    out = ""
    while value:
        value, digit = divmod(value, 62)
        out = DIGITS[digit] + out
    return out.rjust(width, "0")


def with_checksum(body: str) -> str:
    """A token body followed by its checksum: base-62 CRC-32 in six digits."""
    return body + base62(zlib.crc32(body.encode()))


def _validates(kind: str, match: re.Match) -> bool:
    if kind == "assign":
        return len(match[1]) >= 6
    if kind == "access":
        return len(match[0]) >= 20
    if kind in ("github", "npm"):
        body = match[0][4:]
        return with_checksum(body[:30]) == body
    if kind == "jwt":
        try:
            head = json.loads(base64.urlsafe_b64decode(match[1] + "=" * (-len(match[1]) % 4)))
        except (ValueError, binascii.Error, RecursionError):
            return False
        return isinstance(head, dict) and "alg" in head
    if kind == "pem":
        try:
            return len(base64.b64decode("".join(match[2].split()), validate=True)) >= 16
        except (ValueError, binascii.Error):
            return False
    return True


@lru_cache(1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def scan_text(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind; code points, end exclusive.

    Per kind the spans are those of a leftmost, non-overlapping search with failing matches
    dropped: a match that does not validate still moves the search to its end. No part of the
    text is scanned by more than a fixed number of hits, so the time is linear.
    """
    spans = [("hex", *m.span()) for m in HEX_RUN.finditer(text)]
    folded = text.lower() if text.isascii() else text.encode().lower().decode()
    hits: dict[str, list[int]] = {}
    for last, (kind, width) in _automaton().iter(folded):
        hits.setdefault(kind, []).append(last + 1 - width)
    for kind, starts in hits.items():
        done, pattern = 0, ANCHORED[kind]
        for start in sorted(starts):
            if start < done:
                continue
            if match := pattern.match(text, start):
                done = match.end()
                if _validates(kind, match):
                    spans.append((kind, start, done))
            elif kind == "jwt":  # a hit further on in the same run of letters would fail alike
                done = JWT_RUN.match(text, start).end()
    return sorted(spans, key=lambda s: (s[1], ORDER[s[0]]))


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every text: id, count and digest of the base spans, all spans.

    Returns (id_col, n_assign, n_access, n_hex, base_sha256, spans), one row per input row, in
    one pass without a shuffle. Null and empty texts have no spans (counts 0, digest of the
    empty string, spans ''). A null id stays null; repeated rows give repeated rows; an empty
    table gives none. Other columns are ignored, whatever their names. Texts are scanned
    whole; bytes that are not UTF-8 count as one U+FFFD each.
    """
    kind = df.schema[id_col].dataType

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in non_empty(batches):
            found = [scan_text(t) for t in as_text(batch.column(1))]
            base = [[s for s in spans if s[0] in BASE_KINDS] for spans in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array([sum(s[0] == k for s in spans) for spans in base], pa.int64()) for k in BASE_KINDS),
                    pa.array([hashlib.sha256(listed(spans).encode()).hexdigest() for spans in base]),
                    pa.array([listed(spans) for spans in found], pa.string()),
                ],
                names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return map_arrow(df.select(id_col, text_col), scan, f"`{id_col}` {kind.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
