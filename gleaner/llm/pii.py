"""Personal data by a semi-Markov conditional random field, beside the base patterns.

Base spans come from fixed patterns and always stay. Around every digit group or ``@`` of a text lie
candidate segments: runs of neighbouring groups. A semi-Markov CRF scores whole segments (their
shape, group lengths, check digit, separators, the word before), and dynamic programming over the
pieces of a region chooses boundaries and types together; an entity has ``MAX_PIECES`` pieces at
most, everything else is one-piece background. Regions without a candidate are background by
definition, so that the recursion only runs where something may be found.

The model is trained on a bounded sample of documents: their base spans are the labels, and copies
of them in other writings (phones without the country's plus, cards in groups) teach the forms
that the patterns do not know. Segments it finds beside base spans are added.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = ("email", "ip", "card", "phone")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CHUNK = re.compile(r"[^\x20\x09-\x0D]+")
#: Documents of the training sample at most, passes over it, and pieces of one entity at most.
SAMPLE_DOCS = 2000
PASSES = 8
MAX_PIECES = 7
#: Candidates need as many digits (or an @), and stand in a region cut at other words.
LEAST_DIGITS = 7
_REGION = re.compile(r"[+(]?[0-9][0-9().,:+/-]*(?:\x20[+(]?[0-9][0-9().,:+/-]*)*")
_CUES = {"phone": "phone", "tel": "phone", "call": "phone", "mobile": "phone", "fax": "phone", "card": "card", "visa": "card",
         "mail": "email", "email": "email", "ip": "ip", "host": "ip", "server": "ip"}


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    """The check digit of card numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def chunks_with_at(text: str) -> Iterator[tuple[int, str]]:
    """Words with an @ and their places: no part of an address crosses white space."""
    done, at = 0, text.find("@")
    while at >= 0:
        lo = max(done, max(text.rfind(c, done, at) for c in " \t\n\x0b\x0c\r") + 1)
        chunk = _CHUNK.match(text, lo)
        yield lo, chunk.group()
        done = chunk.end()
        at = text.find("@", done)


def emails(chunk: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses that do not overlap, each from its @ to both sides, so that long words cost their length."""
    done, at = 0, chunk.find("@")
    while at >= 0:
        size = _LOCAL.match(chunk[done:at][::-1]).end()
        domain = _DOMAIN.match(chunk, at + 1) if size else None
        if domain:
            yield at - size, domain.end()
        done = domain.end() if domain else at + 1
        at = chunk.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, rank, end, kind) of the base patterns, sorted; matches that fail are dropped, not retried."""
    found = []
    for lo, chunk in chunks_with_at(text):
        found += [(lo + a, 0, lo + b) for a, b in emails(chunk)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return [(s, r, e, KINDS[r]) for s, r, e in sorted(found)]


@dataclass(frozen=True)
class Region:
    """A stretch of text with candidates: its place and the limits of its pieces."""

    start: int
    text: str
    pieces: tuple[tuple[int, int], ...]
    before: str


def regions(text: str) -> list[Region]:
    """Stretches of digit groups with enough digits, and words with an @; trailing punctuation cut.

    Digits inside a longer word are no candidates.
    """
    found = [(lo, chunk) for lo, chunk in chunks_with_at(text)]
    for m in _REGION.finditer(text):
        s, a, b = m.group(), m.start(), m.end()
        inside = a and text[a - 1].isalnum() or b < len(text) and text[b].isalnum()
        if len(s) >= LEAST_DIGITS and not inside and len(digits_of(s)) >= LEAST_DIGITS:
            found.append((a, s))
    out = []
    for start, s in sorted(found):
        pieces = []
        for p in _CHUNK.finditer(s):
            stop = p.start() + len(p.group().rstrip(".,:;/-(+!?"))
            if stop > p.start():
                pieces.append((p.start(), stop))
        if pieces:
            words = re.findall(r"[A-Za-z]+", text[max(0, start - 40): start])
            out.append(Region(start, s, tuple(pieces), words[-1].lower() if words else ""))
    return out


def features(region: Region, i: int, j: int) -> list[str]:
    """Whole-span features of the pieces i to j - 1."""
    span = region.text[region.pieces[i][0]: region.pieces[j - 1][1]]
    digits = digits_of(span)
    groups = re.findall("[0-9]+", span)
    names = [
        f"digits={min(len(digits), 20)}", f"pieces={j - i}", "groups=" + "-".join(str(min(len(g), 9)) for g in groups[:7]),
        "marks=" + "".join(sorted(set(re.sub("[0-9A-Za-z]", "", span)))), f"plus={span[0] == '+'}",
        f"shape={re.sub('[a-z]+', 'a', re.sub('[A-Z]+', 'A', re.sub('[0-9]+', '9', span)))[:16]}",
        f"card={12 <= len(digits) <= 19 and luhn(digits)},{len(digits) >= 12}",
        f"octets={len(groups) == 4 and span.count('.') == 3 and all(int(g[:9]) < 256 for g in groups)}",
        f"mail={bool(_EMAIL.fullmatch(span))}",
    ]
    cue = _CUES.get(region.before)
    if cue and i == 0:
        names.append(f"cue={cue}")
    return names


Model = dict[str, np.ndarray]


def segment_scores(region: Region, model: Model, known: dict | None = None) -> dict[tuple[int, int], np.ndarray]:
    """Score of each kind for each candidate segment, by its limits in pieces."""
    scores = {}
    for i in range(len(region.pieces)):
        for j in range(i + 1, min(i + MAX_PIECES, len(region.pieces)) + 1):
            names = features(region, i, j) if known is None else known[i, j]
            scores[i, j] = sum((model[n] for n in names if n in model), np.zeros(len(KINDS)))
    return scores


def decode(region: Region, model: Model) -> list[tuple[int, int, int]]:
    """The best segmentation: (first piece, last piece + 1, kind) of its entities."""
    scores, n = segment_scores(region, model), len(region.pieces)
    best, back = [0.0] * (n + 1), [(0, -1)] * (n + 1)
    for j in range(1, n + 1):
        best[j], back[j] = best[j - 1], (j - 1, -1)
        for i in range(max(0, j - MAX_PIECES), j):
            kind = int(scores[i, j].argmax())
            if best[i] + scores[i, j][kind] > best[j]:
                best[j], back[j] = best[i] + scores[i, j][kind], (i, kind)
    found, j = [], n
    while j:
        i, kind = back[j]
        if kind >= 0:
            found.append((i, j, kind))
        j = i
    return found[::-1]


def gradient(region: Region, gold: set[tuple[int, int, int]], model: Model, known: dict) -> dict[str, np.ndarray]:
    """Of the log likelihood of the gold segmentation: gold less expected counts of every feature."""
    scores, n = segment_scores(region, model, known), len(region.pieces)
    ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    ahead[0] = behind[n] = 0.0
    for j in range(1, n + 1):
        ways = [ahead[j - 1]] + [ahead[i] + np.logaddexp.reduce(scores[i, j]) for i in range(max(0, j - MAX_PIECES), j)]
        ahead[j] = np.logaddexp.reduce(ways)
    for i in range(n - 1, -1, -1):
        ways = [behind[i + 1]] + [behind[j] + np.logaddexp.reduce(scores[i, j]) for j in range(i + 1, min(i + MAX_PIECES, n) + 1)]
        behind[i] = np.logaddexp.reduce(ways)
    out: dict[str, np.ndarray] = {}
    for (i, j), score in scores.items():
        change = -np.exp(ahead[i] + score + behind[j] - ahead[n])
        for a, b, kind in gold:
            if (a, b) == (i, j):
                change[kind] += 1
        for name in known[i, j]:
            out[name] = out[name] + change if name in out else change.copy()
    return out


def labelled(text: str) -> list[tuple[Region, set[tuple[int, int, int]]]]:
    """Regions of a text with their base spans as segments; spans that do not end with pieces are left out."""
    spans, out = base_spans(text), []
    for region in regions(text):
        starts = {region.start + a: k for k, (a, _) in enumerate(region.pieces)}
        ends = {region.start + b: k + 1 for k, (_, b) in enumerate(region.pieces)}
        gold, last = set(), 0
        for s, rank, e, _ in spans:
            if s in starts and e in ends and starts[s] >= last:
                gold.add((starts[s], ends[e], rank))
                last = ends[e]
        out.append((region, gold))
    return out


def grouped_cards(text: str) -> list[str]:
    """The cards of a text in groups of four digits."""
    found = [digits_of(text[s:e]) for s, rank, e, _ in base_spans(text) if rank == 2]
    return [" ".join(d[i: i + 4] for i in range(0, 16, 4)) for d in found if len(d) == 16]


def national(text: str) -> list[tuple[Region, set[tuple[int, int, int]]]]:
    """Phones of a text written without plus and country code: ``(ddd) ddd-dddd`` and ``ddd-ddd-dddd``."""
    out = []
    for s, rank, e, _ in base_spans(text):
        digits = digits_of(text[s:e])[-10:]
        if rank == 3 and len(digits) == 10:
            for form in (f"({digits[:3]}) {digits[3:6]}-{digits[6:]}", f"{digits[:3]}-{digits[3:6]}-{digits[6:]}"):
                for region in regions(form):
                    out.append((region, {(0, len(region.pieces), 3)}))
    return out


def train(texts: list[str], passes: int = PASSES) -> Model:
    """Weights by stochastic gradient steps in a fixed order; no data gives an empty model, which finds nothing."""
    held = [x for t in texts for x in [*labelled(t), *national(t), *[y for c in grouped_cards(t) for y in labelled(c)]]]
    known = [{(i, j): features(r, i, j) for i in range(len(r.pieces)) for j in range(i + 1, min(i + MAX_PIECES, len(r.pieces)) + 1)} for r, _ in held]
    model: Model = {}
    squares: Model = {}
    for _ in range(passes):
        for (region, gold), names in zip(held, known):
            for name, change in gradient(region, gold, model, names).items():
                if name not in model:
                    model[name], squares[name] = np.zeros(len(KINDS)), np.full(len(KINDS), 1e-3)
                change = change - 1e-4 * model[name]
                squares[name] += change**2
                model[name] += 0.3 * change / np.sqrt(squares[name])
    return model


def all_spans(text: str, model: Model) -> tuple[list, list]:
    """(base spans, all spans) of a text: segments of the model that touch no base span are added."""
    base = base_spans(text)
    added, open_spans, seen = [], [], 0
    for region in regions(text) if model else []:
        start, end = region.start, region.start + len(region.text)
        while seen < len(base) and base[seen][0] < end:
            open_spans.append(base[seen])
            seen += 1
        open_spans = [x for x in open_spans if x[2] > start]  # regions come by their starts
        near = [(s, e) for s, _, e, _ in open_spans if s < end]
        if len(near) == 1 and near[0][0] <= start + region.pieces[0][0] and near[0][1] >= start + region.pieces[-1][1]:
            continue  # one base span covers the region
        for i, j, kind in decode(region, model):
            a, b = start + region.pieces[i][0], start + region.pieces[j - 1][1]
            if all(e <= a or s >= b for s, e in near):
                added.append((a, kind, b, KINDS[kind]))
    return base, sorted([*base, *added])


def listing(spans: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Train on the documents with an @ or digits whose ids have the least hashes, ``sample_docs`` at most."""
    ids = [r.doc_id for r in docs.where(F.col("text").rlike("@|[0-9]{3}")).select("doc_id").orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(sample_docs).collect()]
    held = docs.where(F.col("doc_id").isin(ids)).select("doc_id", "text").limit(2 * sample_docs).collect()
    return train([r.text for r in sorted(held) if r.text])


def find(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row.

    A null text counts as empty: no spans, the hash of the empty listing. Rows are read one by one, so
    repeated rows repeat. An empty table gives an empty table. Offsets are code points.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, hashes, lists = [[] for _ in KINDS], [], []
            for text in batch.column(1).to_pylist():
                base, every = all_spans(text or "", model)
                for rank, column in enumerate(counts):
                    column.append(sum(s[1] == rank for s in base))
                hashes.append(hashlib.sha256(listing(base).encode()).hexdigest())
                lists.append(listing(every))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(hashes, pa.string()), pa.array(lists, pa.string())],
                ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def op9_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in all documents, the model trained on a bounded sample of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find(docs, fit(docs))
