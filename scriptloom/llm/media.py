"""Media columns: HTML to interleaved text and media references, payloads resolved by digest.

``interleave`` parses HTML into one ordered sequence of structs per document: runs of text and
references to media, each with its position and the caption that belongs to it. ``store_media``
writes payloads, as 8-bit PCM samples in a WAV container, to files in a shared folder. They
stay where they were written: ``index_media`` reads the stored bytes back and says of each
digest what is stored under it and in which row of which file. ``resolve`` joins the references
of the sequences to that index, by digest, and leaves positions and captions as they were;
``fetch`` brings the stored bytes themselves to those references that are to be read.

So shuffled are digests, positions and descriptions, never pages or payloads, unless payloads
are fetched. A digest to which a third of all documents refer is one row of the index, and the
many rows on the other side of a sort-merge join can be split by adaptive execution.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .common import as_bytes, as_text, map_arrow, non_empty

BLOCK = 64
RATE = 8000
MEDIA_TAGS = ("img", "audio", "video", "source", "embed")
SKIPPED = ("script", "style", "template", "noscript")
INLINE = ("a", "b", "i", "em", "strong", "span", "code", "sub", "sup", "small", "u")
#: Elements whose end closes what is still open in them.
ENCLOSING = ("article", "section", "main", "body", "html")
ITEM = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())])
ITEM_SQL = "struct<position:int,kind:string,text:string,ref:string,caption:string>"


class _Sequence(HTMLParser):
    """Text runs and media references in the order in which a page shows them.

    Figures nest. A caption belongs to all media of its figure, before and after it, and is
    closed by the end of the figure, of the page or of any tag that holds the figure. A tag of
    SKIPPED ends with the element around it at the latest; a template or noscript for which
    the page has no end tag left is not skipped at all.
    """

    def __init__(self, ends: dict[str, int]):
        super().__init__(convert_charrefs=True)
        #: End tags of SKIPPED that the page still has for start tags to come.
        self.ends = ends
        self.items: list[list] = []
        self.text: list[str] = []
        #: Of each open figure: places of its media, pieces of its caption (None before one), and whether that is open.
        self.figures: list[list] = []
        self.skipped: str | None = None

    def flush(self):
        if said := " ".join("".join(self.text).split()):
            self.items.append(["text", said, None, None])
        self.text = []

    def close_figure(self):
        self.flush()
        media, caption, _ = self.figures.pop()
        if said := " ".join("".join(caption or ()).split()):
            for at in media:
                self.items[at][3] = said

    def handle_starttag(self, tag, attrs):
        if self.skipped and tag not in SKIPPED:
            return
        named = dict(attrs)
        if tag in SKIPPED:
            self.ends[tag] -= 1
            if self.ends[tag] >= 0 or tag in ("script", "style"):
                self.skipped = tag
        elif tag == "figure":
            self.flush()
            self.figures.append([[], None, False])
        elif tag == "figcaption" and self.figures:
            self.flush()
            self.figures[-1][1] = [*(self.figures[-1][1] or []), " "]
            self.figures[-1][2] = True
        elif tag in MEDIA_TAGS and (ref := named.get("src")):
            self.flush()
            if self.figures:
                self.figures[-1][0].append(len(self.items))
            self.items.append(["media", None, ref, named.get("alt") or None])
        elif tag not in INLINE:
            self.flush()

    def handle_endtag(self, tag):
        if self.skipped:
            if tag == self.skipped or tag in ENCLOSING:
                self.skipped = None
            if tag in SKIPPED:
                return
        if tag == "figcaption" and self.figures:
            self.figures[-1][2] = False
        elif tag == "figure" and self.figures:
            self.close_figure()
        elif tag in ENCLOSING:
            while self.figures:
                self.close_figure()
            self.flush()
        elif tag not in INLINE:
            self.flush()

    def handle_data(self, data):
        if not self.skipped:
            (self.figures[-1][1] if self.figures and self.figures[-1][2] else self.text).append(data)

    def finish(self):
        while self.figures:
            self.close_figure()
        self.flush()


def parse_page(html: str) -> list[tuple[int, str, str | None, str | None, str | None]]:
    """(position, kind, text, ref, caption) of one page, positions from 0 without gaps."""
    folded = html.lower()
    page = _Sequence({tag: folded.count(f"</{tag}") for tag in SKIPPED})
    page.feed(html)
    page.close()
    page.finish()
    return [(i, *item) for i, item in enumerate(page.items)]


def interleave(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id_col, items array of (position, kind, text, ref, caption)), one row per input row.

    Null and empty pages give empty arrays; malformed HTML gives what the parser can read.
    Null ids stay null, repeated rows are repeated, other columns are ignored.
    """
    names = [f.name for f in ITEM]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in non_empty(batches):
            items = [[dict(zip(names, x)) for x in parse_page(t)] for t in as_text(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, pa.list_(ITEM))], names=[id_col, "items"])

    return map_arrow(df.select(id_col, html_col), run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, items array<{ITEM_SQL}>")


def payload_of(raw: bytes) -> bytes:
    """The bytes with 0 appended up to a positive multiple of 64."""
    return raw + bytes(-len(raw) % BLOCK or (BLOCK if not raw else 0))


def to_wav(payload: bytes) -> bytes:
    """One channel of 8-bit samples."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def from_wav(media: bytes) -> bytes:
    """The samples of a stored WAV, read by the chunks of the container."""
    stream = io.BytesIO(media)
    if stream.read(4) != b"RIFF" or stream.seek(8) != 8 or stream.read(4) != b"WAVE":
        raise ValueError("not a WAV container")
    while len(head := stream.read(8)) == 8:
        name, size = struct.unpack("<4sI", head)
        if name == b"data":
            return stream.read(size)
        stream.seek(size + size % 2, io.SEEK_CUR)
    raise ValueError("no samples")


def features(samples: bytes) -> str:
    """Level, crossings of the mean line, and entropy of the sample histogram."""
    values = np.frombuffer(samples, np.uint8)
    counts = np.bincount(values, minlength=256)
    centred = np.arange(256) - 128
    rms = float(np.sqrt(counts @ (centred**2) / len(values)))
    crossings = int(np.count_nonzero((values[1:] >= 128) != (values[:-1] >= 128)))
    shares = counts[counts > 0] / len(values)
    return f"rms={rms:.4f};crossings={crossings};entropy={abs(float(-(shares * np.log2(shares)).sum())):.4f};peak={int(values.max())}"


STORED = "digest binary, n_bytes long, media binary"
DESCRIBED = "digest binary, n_bytes long, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature string"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def media_of(df: DataFrame, text_col: str) -> DataFrame:
    """(digest, n_bytes, media) of each text: SHA-256 of its bytes, their number, the WAV.

    One row per input row. Null and empty texts are 64 zero bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in non_empty(batches):
            raw = as_bytes(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(x).digest() for x in raw], pa.binary()), pa.array(map(len, raw), pa.int64()), pa.array([to_wav(payload_of(x)) for x in raw], pa.binary())], names=_names(STORED))

    return map_arrow(df.select(text_col), run, STORED)


def store_media(df: DataFrame, text_col: str, folder: str) -> DataFrame:
    """Write the media of all texts to a folder that executors share, and read them back.

    Returns (digest, n_bytes, media, file, row) from the files. A task writes what it has made,
    so nothing is shuffled; a repeated text is stored by each row that holds it, and the index
    chooses one. An empty table gives an empty store.
    """
    media_of(df, text_col).write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(STORED).parquet(folder).select(*_names(STORED), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))


def index_media(store: DataFrame) -> DataFrame:
    """(DESCRIBED, file, row): one row for each digest, computed from the stored bytes.

    Equal payloads have equal descriptions; of their places the first by file and row is
    given. A stored form that is no WAV is an error.
    """
    names = [*_names(DESCRIBED), "file", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in non_empty(batches):
            rows = []
            for media in batch.column(2).to_pylist():
                back = from_wav(media)
                rows.append((len(back), hashlib.sha256(back).digest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).digest(), features(back)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c) for c in zip(*rows)), batch.column(3), batch.column(4)], names=names)

    described = map_arrow(store.select("digest", "n_bytes", "media", "file", "row"), run, f"{DESCRIBED}, file string, row long")
    value = [c for c in names if c not in ("digest", "file", "row")]
    at = F.min(F.struct("file", "row")).alias("at")
    return described.groupBy("digest").agg(*(F.first(c).alias(c) for c in value), at).select("digest", *value, "at.file", "at.row")


def references(sequences: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, digest, positions, captions): a row for each page and payload that it refers to.

    References are ``sha256:`` and the digest in hex; others are left out, and so are pages
    without any. positions and captions, of equal length, are in the order of the page.
    """
    named = F.filter("items", lambda x: (x["kind"] == "media") & x["ref"].rlike("^sha256:[0-9a-fA-F]{64}$"))
    refs = F.transform(named, lambda x: F.struct(F.unhex(F.substring(x["ref"], 8, 64)).alias("digest"), x["position"].alias("position"), x["caption"].alias("caption")))
    each = sequences.select(*keep, refs.alias("_refs")).select(*keep, "_refs", F.explode(F.array_distinct(F.col("_refs.digest"))).alias("digest"))
    mine = F.filter("_refs", lambda x: x["digest"] == F.col("digest"))
    return each.select(*keep, "digest", F.transform(mine, lambda x: x["position"]).alias("positions"), F.transform(mine, lambda x: x["caption"]).alias("captions"))


def resolve(refs: DataFrame, index: DataFrame) -> DataFrame:
    """Each reference with the columns of its digest in the index; null ones where it lacks that.

    The index holds a digest once. It is read from a written table, so both sides of the join
    are plain exchanges, which adaptive execution can split.
    """
    return refs.join(durable(index), "digest", "left")


def fetch(resolved: DataFrame, store: DataFrame) -> DataFrame:
    """The resolved references with ``media``, the stored bytes of their row; null where unresolved.

    Payloads are shuffled by file and row; take only the references whose bytes are wanted.
    """
    return resolved.join(store.select("file", "row", "media"), ["file", "row"], "left")


def page_html(digest: str, text: str) -> str:
    """A page of the whole text around two references to its medium.

    The first line that is not blank is a paragraph, then comes the medium with the second as
    its caption, then the others, and at the end the medium again.
    """
    lead, caption, *rest = [*(line for line in text.splitlines() if line.strip()), "", ""]
    said = "".join(f"<p>{escape(line)}</p>" for line in rest)
    return f'<article><p>{escape(lead)}</p><figure><audio src="sha256:{digest}"></audio><figcaption>{escape(caption)}</figcaption></figure>{said}<audio src="sha256:{digest}" alt="again"></audio></article>'


def pages_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, html): the page of each text; null and empty texts are a page of their medium alone."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in non_empty(batches):
            pages = [page_html(hashlib.sha256(x).hexdigest(), x.decode("utf-8", "replace")) for x in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pages, pa.string())], names=[id_col, "html"])

    return map_arrow(df.select(id_col, text_col), build, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, html string")
