"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Patterns propose spans. Labelers of four sorts (checksum, pattern form, gazetteer, context) each vote
for, against or abstain on every span. The votes of all spans of the corpus, counted by
pattern, go through expectation-maximisation, which estimates how often each labeler is right
without any labels. Its posteriors are the targets of a logistic span classifier over votes,
kind, length and neighbouring characters. Spans of the base kinds always stay; spans of the
extra kinds stay if the classifier accepts them. Of both the classifier's probability is told.

The base patterns take the longest run and drop it whole if it fails, so a card or phone
number with other digits beside it is lost to them. The extra kinds card_part and phone_part
are what lies within such runs; the others are numbers and names in forms that the base
patterns do not know.

Both passes read each text once and neither shuffles text. What reaches the driver is one
count for each combination of kind, votes and span features, of which ``CODES`` can exist.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, map_arrow, non_empty

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("card_part", "phone_part", "phone_local", "email_spelled", "iban", "ssn", "name")
KINDS = BASE_KINDS + EXTRA_KINDS
LABELERS = ("checksum", "form", "gazetteer", "context_for", "context_against")
#: Kinds x votes x length classes x left classes x right classes: the bound of the counts.
SHAPE = (len(KINDS), *[3] * len(LABELERS), 4, 4, 4)
CODES = int(np.prod(SHAPE))

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
#: A match can only begin where a run of digits does, so the look-behind keeps the scan linear.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
#: What a failed run of digits may hold: a whole run, or groups of four.
CARD_PART = re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])")
PHONE_PART = re.compile(r"\+(?:1[\x20.-]?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}|[2-9][0-9]{1,2}[\x20.-]?[0-9]{2,4}[\x20.-]?[0-9]{5,8})(?![0-9])")
PHONE_LOCAL = re.compile(r"(?<![0-9+()])(?<![+0-9][\x20.-])(?:\([0-9]{3}\)[\x20-]?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])")
SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:(?:\x20?[\[(]dot[\])]\x20?|\.)[A-Za-z0-9-]{1,63}){1,4}")
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora")
NAME = re.compile(rf"(?<!\w)(?:{'|'.join(sorted(TITLES, key=len, reverse=True))})\.?\x20[^\W\d_a-z][^\W\d_]+(?:\x20[^\W\d_a-z][^\W\d_]+)?")
IBAN_COUNTRIES = frozenset("AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR".split())
#: Common given names in the languages of the titles: a list that does not propose names, so it can speak against one.
GIVEN = frozenset(
    "Adam Alice Alain Ana Andrea Anna Anne Antonio Barbara Bernd Carlos Carmen Catherine Charles Claire Claudia Daniel David Elena Elizabeth Emma Eva Francisco Frank George Hans Helen Ines Isabel Jack James Jan "
    "Jane Javier Jean John Jose José Juan Julia Karl Klaus Laura Louis Luis Luise Manuel Marc María Maria Marie Mario Mark Martin Mary Max Michael Michel Miguel Nicolas Olivia Pablo Paul Pedro Peter Philippe "
    "Pierre Rafael Richard Robert Rosa Sabine Sarah Sofia Sophie Stefan Susan Thomas Uwe Walter William Wolfgang".split()
)
#: First digits of card numbers that issuers use: (lowest, highest) of as many digits.
ISSUERS = ((4, 4), (51, 55), (2221, 2720), (34, 34), (37, 37), (6011, 6011), (644, 659), (3528, 3589))
TOP_DOMAINS = frozenset("com org net edu gov io de fr es uk info biz eu ch at it nl co".split())
CONTEXT_FOR = {
    "email": ("mail", "contact", "write", "schreib", "contacter", "correo"), "ip": ("ip", "host", "address", "server", "login", "adresse"), "card": ("card", "visa", "mastercard", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "fax", "mobile", "telefon", "móvil"), "phone_part": ("phone", "call", "tel", "fax", "mobile", "telefon", "móvil"), "phone_local": ("phone", "call", "tel", "fax", "mobile", "telefon", "móvil"),
    "card_part": ("card", "visa", "mastercard", "karte", "carte", "tarjeta"), "email_spelled": ("mail", "contact", "write", "schreib", "contacter", "correo"), "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"), "ssn": ("ssn", "social", "security"), "name": ("name", "dear", "signed", "regards", "liebe", "cher", "querido"),
}
CONTEXT_AGAINST = ("version", "figure", "isbn", "chapter", "price", "serial", "build", "release", "part no", "§")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ outwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done:  # the local part, in growing steps to its left
            step = text[max(done, start - 256) : start]
            kept = len(step.rstrip(LOCAL))
            start -= len(step) - kept
            if kept:
                break
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            done = match.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _base_and_failed(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int]], list[tuple[int, int]]]:
    """Base spans, then the runs of digits and the phone numbers that failed but may hold one."""
    spans = [("email", a, b) for a, b in _emails(text)]
    spans += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split("."))]
    runs, phones = [], []
    for match in CARD.finditer(text):
        if match.end() - match.start() >= 13:
            if 16 <= len(d := _digits(match[0])) <= 19 and luhn(d):
                spans.append(("card", *match.span()))
            else:
                runs.append(match.span())
    if "+" in text:
        for match in PHONE.finditer(text):
            if 8 <= (n := len(_digits(match[0]))) <= 15:
                spans.append(("phone", *match.span()))
            elif n > 15:
                phones.append(match.span())
    return spans, runs, phones


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, by kind and start; failing matches are dropped, not retried."""
    return _base_and_failed(text)[0]


def _iban(text: str) -> bool:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def proposed_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and those of the extra kinds on which the classifier decides, each by kind and start."""
    base, runs, phones = _base_and_failed(text)
    spans = [("card_part", *m.span()) for a, b in runs for m in CARD_PART.finditer(text, a, b)]
    spans += [("phone_part", *m.span()) for a, b in phones for m in PHONE_PART.finditer(text, a, b)]
    if any(mark in text for mark in (")", "-", ".")):
        spans += [("phone_local", *m.span()) for m in PHONE_LOCAL.finditer(text)]
    if "at]" in text or "at)" in text:
        spans += [("email_spelled", *m.span()) for m in SPELLED.finditer(text)]
    spans += [("iban", *m.span()) for m in IBAN.finditer(text)]
    if "-" in text:
        spans += [("ssn", *m.span()) for m in SSN.finditer(text)]
    if any(t in text for t in TITLES):
        spans += [("name", *m.span()) for m in NAME.finditer(text)]
    if base and spans:
        taken = sorted((a, b) for _, a, b in base)
        spans = [s for s in spans if not _overlaps(taken, s[1], s[2])]
    return base, spans


def _overlaps(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether [start, end) meets one of the sorted spans; base spans of different kinds may overlap each other."""
    at = bisect_left(taken, (end,))
    return any(b > start for _, b in taken[max(0, at - len(BASE_KINDS)) : at])


def extra_spans(text: str) -> list[tuple[str, int, int]]:
    """Proposed spans of the extra kinds."""
    return proposed_spans(text)[1]


def _checksum(kind: str, s: str) -> int:
    if kind in ("card", "card_part"):
        return 1 if luhn(_digits(s)) else -1
    if kind == "iban":
        return 1 if _iban(s) else -1
    return 0


def _form(kind: str, s: str) -> int:
    if kind == "email":
        return 1 if not s.startswith((".", "-", "%", "+")) and ".." not in s else -1
    if kind == "ip":
        return -1 if any(len(p) > 1 and p[0] == "0" for p in s.split(".")) else 1
    if kind in ("card", "card_part"):
        return 1 if len(_digits(s)) == 16 else 0
    if kind in ("phone", "phone_part", "phone_local"):
        return 1 if len(_digits(s)) >= 10 and s.count("(") == s.count(")") else -1
    if kind == "email_spelled":
        return 1 if re.search(r"[\[(]dot[\])]", s) else 0
    if kind == "name":
        return 1 if len(s.split()) == 3 else 0
    if kind == "ssn":
        return -1 if s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" or s.endswith("0000") else 1
    return 0


def _gazetteer(kind: str, s: str) -> int:
    if kind == "email":
        return 1 if s.rpartition(".")[2].lower() in TOP_DOMAINS else -1
    if kind == "ip":
        return -1 if s.startswith(("0.", "127.", "255.")) else 1
    if kind in ("card", "card_part"):
        d = _digits(s)
        return 1 if any(low <= int(d[: len(str(low))]) <= high for low, high in ISSUERS) else -1
    if kind in ("phone", "phone_part"):
        return -1 if s[1] == "0" else 1
    if kind == "phone_local":
        return -1 if _digits(s)[0] in "01" else 1
    if kind == "email_spelled":
        return 1 if re.split(r"[^A-Za-z0-9]+", s.rstrip("])"))[-1].lower() in TOP_DOMAINS else -1
    if kind == "iban":
        return 1 if s[:2] in IBAN_COUNTRIES else -1
    if kind == "name":
        return 1 if s.split()[1] in GIVEN else 0
    return 0


def _side(char: str) -> int:
    return 0 if not char else 1 if char.isspace() else 2 if char.isalnum() else 3


def code_of(text: str, kind: str, start: int, end: int) -> int:
    """Kind, votes and features of a span as one number below ``CODES``."""
    s, around = text[start:end], text[max(0, start - 48) : start].lower()
    checksum, form, gazetteer = _checksum(kind, s), _form(kind, s), _gazetteer(kind, s)
    for_it = 1 if any(w in around for w in CONTEXT_FOR[kind]) else 0
    left, right = _side(text[start - 1 : start]), _side(text[end : end + 1])
    against = -1 if any(w in around for w in CONTEXT_AGAINST) or (kind not in ("email", "name") and 2 in (left, right)) else 0
    length = min(3, (end - start) // 10)
    return int(np.ravel_multi_index((KINDS.index(kind), checksum + 1, form + 1, gazetteer + 1, for_it + 1, against + 1, length, left, right), SHAPE))


@dataclass(frozen=True)
class SpanModel:
    """probability[c]: that a span of code c is personal data; reliability: P(vote | class) by class, kind and labeler."""

    probability: np.ndarray
    reliability: np.ndarray

    def accepts(self, code: int) -> bool:
        return self.probability[code] >= 0.5


#: Votes that the labelers' reliabilities over all kinds weigh in those for one kind.
POOLED_VOTES = 8.0


def expectation_maximisation(votes: np.ndarray, kinds: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of each row, P(vote | class) by class, kind, labeler and vote).

    votes: rows x labelers in 0..2 (against, abstain, for). A labeler is as reliable for a kind
    as its votes there show, drawn towards what it is over all kinds, so rare kinds borrow from
    common ones. The start takes labelers to be right more often than not, which fixes which
    class is which.
    """
    columns = np.arange(votes.shape[1])
    start = np.array([[0.25, 0.5, 0.25]] * len(columns))
    lean = np.stack([start * [1.5, 1, 0.5], start * [0.5, 1, 1.5]])
    given = np.repeat(lean[:, None], len(KINDS), axis=1)
    prior = np.full(len(KINDS), 0.5)
    posterior = np.full(len(counts), 0.5)
    place = kinds * 3
    for _ in range(rounds):
        logs = np.log(given[:, kinds[:, None], columns, votes]).sum(axis=2)
        gap = logs[0] + np.log(1 - prior[kinds]) - logs[1] - np.log(prior[kinds])
        posterior = 1 / (1 + np.exp(np.clip(gap, -50, 50)))
        for c, weight in enumerate((counts * (1 - posterior), counts * posterior)):
            for j in columns:
                got = np.bincount(place + votes[:, j], weight, 3 * len(KINDS)).reshape(-1, 3)
                over_all = got.sum(axis=0) + 4 * lean[c, j]
                got += POOLED_VOTES * over_all / over_all.sum() + lean[c, j]
                given[c, :, j] = got / got.sum(axis=1, keepdims=True)
        for k in range(len(KINDS)):
            mine = kinds == k
            prior[k] = (counts[mine] @ posterior[mine] + 1) / (counts[mine].sum() + 2)
    return posterior, given


def _one_hot(codes: np.ndarray) -> np.ndarray:
    parts = np.stack(np.unravel_index(codes, SHAPE), axis=1)
    return np.concatenate([np.ones((len(codes), 1)), *(np.eye(n)[parts[:, i]] for i, n in enumerate(SHAPE))], axis=1)


def fit_spans(code_counts: dict[int, int], rounds: int = 300) -> SpanModel:
    """EM over the counted votes, then logistic regression on its posteriors; no spans: accept none."""
    if not code_counts:
        return SpanModel(np.zeros(CODES), np.zeros((2, len(KINDS), len(LABELERS), 3)))
    codes = np.array(sorted(code_counts))
    counts = np.array([code_counts[c] for c in codes], float)
    parts = np.stack(np.unravel_index(codes, SHAPE), axis=1)
    posterior, given = expectation_maximisation(parts[:, 1 : 1 + len(LABELERS)], parts[:, 0], counts)
    x, share = _one_hot(codes), np.sqrt(counts) / np.sqrt(counts).sum()
    weights = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ weights))
        weights -= 4 * (x.T @ (share * (p - posterior)) + 1e-4 * weights)
    return SpanModel(1 / (1 + np.exp(-_one_hot(np.arange(CODES)) @ weights)), given)


def count_votes(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(code, n): how many spans of the corpus have each combination of votes and features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in non_empty(batches):
            for text in as_text(batch.column(0)):
                for spans in proposed_spans(text):
                    seen.update(code_of(text, *s) for s in spans)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["code", "n"])

    return map_arrow(df.select(text_col), run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def train(df: DataFrame, text_col: str = "text") -> SpanModel:
    """The span classifier of a corpus; collects at most ``CODES`` counts."""
    return fit_spans({r["code"]: r["n"] for r in count_votes(df, text_col).collect()})


def find_spans(text: str, model: SpanModel) -> list[tuple[str, int, int]]:
    """Base spans, and the extra ones that the model accepts, by kind and start."""
    base, extra = proposed_spans(text)
    return base + [s for s in extra if model.accepts(code_of(text, *s))]


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: SpanModel | None = None) -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, probabilities), one row per input row.

    probabilities has the classifier's hundredths for each of the spans, in their order.

    Trains on the votes of ``df`` unless a model is given. Null and empty texts have no spans.
    Null ids stay null, repeated rows are repeated and an empty table gives no rows. Other
    columns are ignored. Spans count code points, end exclusive, and are listed by kind.
    """
    model = model or train(df, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in non_empty(batches):
            texts = as_text(batch.column(1))
            found = [find_spans(t, model) for t in texts]
            base = [[s for s in spans if s[0] in BASE_KINDS] for spans in found]
            chance = [",".join(str(round(100 * model.probability[code_of(t, *s)])) for s in spans) for t, spans in zip(texts, found)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array([sum(s[0] == k for s in spans) for spans in base], pa.int64()) for k in BASE_KINDS),
                    pa.array([hashlib.sha256(listed(s).encode()).hexdigest() for s in base], pa.string()),
                    pa.array([listed(s) for s in found], pa.string()),
                    pa.array(chance, pa.string()),
                ],
                names=[id_col, *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "probabilities"],
            )

    counts = ", ".join(f"n_{k} long" for k in BASE_KINDS)
    return map_arrow(df.select(id_col, text_col), run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, {counts}, base_sha256 string, spans string, probabilities string")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, overlapping ones joined, replaced by its kind in angle brackets.

    What a kind is a part or form of names it: card_part is <CARD>.
    """
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"<{kind.partition('_')[0].upper()}>"]
        done = max(done, end)
    return "".join(out) + text[done:]


def redact(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", model: SpanModel | None = None) -> DataFrame:
    """All columns of ``df`` with personal data in ``text_col`` masked and ``length_col`` updated.

    Null texts stay null; every row stays. Columns keep their names, types and order.
    """
    model = model or train(df, text_col)
    names = df.columns
    at = names.index(text_col)
    length_at = names.index(length_col) if length_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in non_empty(batches):
            old, valid = as_text(batch.column(at)), batch.column(at).is_valid().to_pylist()
            new = [masked(t, s) if (s := find_spans(t, model)) else t for t in old]
            columns = batch.columns
            columns[at] = pa.array([t if v else None for t, v in zip(new, valid)], batch.schema.field(at).type)
            if length_at is not None:
                lengths = batch.column(length_at).to_pylist()
                columns[length_at] = pa.array([len(t) if v and t != o else n for t, v, o, n in zip(new, valid, old, lengths)], batch.schema.field(length_at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return map_arrow(df, run, df.schema)
