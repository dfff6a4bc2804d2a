"""Personal data in texts: base patterns, and spans that a character BiLSTM with a CRF adds.

Every whole text is scanned where it is read. The base patterns are exact. The
tagger reads windows of `WINDOW` that overlap by `OVERLAP`; left out are those
in which, and in whose neighbours, no value could pass the test below: they hold
no digit, and not both an at and a dot. Windows of a batch run through the network together. Its spans are put into the
coordinates of the document; of overlapping ones the span that no window edge
cuts wins, then the longer, then the earlier. Spans are trimmed to what a value
can begin and end with, and dropped if they fail what makes a value of the kind
(a name and a host with an at between; four numbers up to 255; check digit and
number of digits) or touch a base span; how they are spelled is the tagger's own.

Defined cases: null text is empty; repeated rows are scanned each; other columns
pass through in `row`; positions are code points, ends exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.tagger import KINDS, Tagger, codes, luhn, trained

WINDOW, OVERLAP = 256, 48
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
NOT_DIGITS = re.compile(r"[^0-9]+")
AT = re.compile(r"@|(?<![a-z])at(?![a-z])", re.I)
DOT = re.compile(r"(?<=\S)\.(?=\S)|\s\.\s|(?<![a-z])dot(?![a-z])", re.I)
LETTERS = re.compile(r"[^\W\d_]")
#: What every e-mail that passes holds, wherever it is cut out.
SOME_AT = re.compile("@|at", re.I)
SOME_DOT = re.compile(r"\S\.\S|\s\.\s|dot", re.I)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, by start, then kind."""
    out = []
    if "@" in text:
        last, at = 0, text.find("@")
        while at >= 0:
            start = at
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            m = HOST.match(text, at + 1) if start < at else None
            if m:
                out.append((start, 0, m.end()))
                last = m.end()
            at = text.find("@", max(at + 1, last))
    if DIGITS.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if 12 <= m.end() - m.start() <= 37 and 12 <= len(d := NOT_DIGITS.sub("", m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGITS.sub("", m[0])) <= 15]
    return sorted(out)


def windows(text: str) -> list[tuple[int, int]]:
    """Start and end of the windows over a whole text; none over an empty one."""
    return [(at, min(at + WINDOW, len(text))) for at in range(0, max(len(text) - OVERLAP, min(len(text), 1)), WINDOW - OVERLAP)]


def may_hold(text: str) -> bool:
    """False only where no part of the text is a value that passes: one needs a digit, or (an e-mail) an at and a dot."""
    return bool(DIGITS.search(text) or (SOME_AT.search(text) and SOME_DOT.search(text)))


def windows_to_read(text: str) -> list[tuple[int, int]]:
    """The windows that may hold a value, and their neighbours, whose spans compete with theirs; what the network finds in the others would be dropped."""
    if not may_hold(text):
        return []
    every = windows(text)
    live = [False, *(may_hold(text[a:b]) for a, b in every), False]
    return [w for k, w in enumerate(every) if live[k] or live[k + 1] or live[k + 2]]


def tagged(texts: list[str], model: Tagger, batch: int = 512) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of what the tagger finds in each text, reconciled over its windows."""
    coded = [codes(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)) for text in texts]
    plan = sorted(((i, *w) for i, text in enumerate(texts) for w in windows_to_read(text)), key=lambda w: w[2] - w[1])  # of like lengths together
    found: list[list[tuple]] = [[] for _ in texts]
    for at in range(0, len(plan), batch):
        part = plan[at : at + batch]
        size = np.array([b - a for _, a, b in part])
        x = np.zeros((len(part), int(size.max())), np.int64)
        for k, (i, a, b) in enumerate(part):
            x[k, : b - a] = coded[i][a:b]
        tags = model.decode(x, size)
        kind = np.pad((tags + 1) // 2, ((0, 0), (1, 1)))  # 0: none
        goes_on = np.pad((tags > 0) & (tags % 2 == 0), ((0, 0), (1, 1)))
        new = (kind[:, 1:] > 0) & ~(goes_on[:, 1:] & (kind[:, 1:] == kind[:, :-1]))
        over = (kind[:, :-1] > 0) & ~(goes_on[:, 1:] & (kind[:, 1:] == kind[:, :-1]))
        (rows, starts), ends = np.nonzero(new), np.nonzero(over)[1]
        for k, s, e, what in zip(rows.tolist(), starts.tolist(), ends.tolist(), kind[rows, starts + 1].tolist()):
            i, a, b = part[k]
            cut = (s == 0 and a > 0) or (e == b - a and b < len(texts[i]))
            found[i].append((cut, s - e, a + s, what - 1, a + e))
    out = []
    for spans in found:
        taken: list[tuple[int, int, int]] = []  # by start, disjoint: the neighbours tell whether there is room
        for _, _, s, kind, e in sorted(spans):
            at = bisect_left(taken, (s,))
            if (at == 0 or taken[at - 1][2] <= s) and (at == len(taken) or e <= taken[at][0]):
                taken.insert(at, (s, kind, e))
        out.append(taken)
    return out


def apart(spans: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans that touch none of `base`, which is sorted by start."""
    starts = [s for s, _, _ in base]
    reach = [0, *accumulate((e for _, _, e in base), max)]  # the furthest end of the first so many
    return [x for x in spans if reach[bisect_left(starts, x[2])] <= x[0]]


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """Without signs at the ends that no value begins or ends with, and without a first bracket that nothing closes."""
    while start < end and not (text[start].isalnum() or text[start] in "+(" and end - start > 1):
        start += 1
    while start < end and not text[end - 1].isalnum():
        end -= 1
    value = text[start:end]
    if value.startswith("(") and value.count("(") > value.count(")"):
        return trimmed(text, start + 1, end)
    return start, end


def passes(kind: str, value: str) -> bool:
    """Whether the value is one of its kind, however it is spelled."""
    if kind == "email":
        sides = AT.split(value, maxsplit=1)
        return len(sides) == 2 and all(re.search("[A-Za-z0-9]{2}", x) for x in sides) and bool(DOT.search(sides[1]))
    numbers = re.findall("[0-9]+", value)
    digits = "".join(numbers)
    if kind == "ip":
        return len(numbers) == 4 and all(int(p) <= 255 for p in numbers)
    if LETTERS.search(value):
        return False
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def all_spans(texts: list[str], model: Tagger) -> list[tuple[list, list]]:
    """Base spans and added spans of each text."""
    out = []
    for text, more in zip(texts, tagged(texts, model)):
        base = base_spans(text)
        spans = [(s, k, e) for (s, e), k in ((trimmed(text, s, e), k) for s, k, e in more) if s < e]
        out.append((base, [(s, k, e) for s, k, e in apart(spans, base) if passes(KINDS[k], text[s:e])]))
    return out


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])


def find_pii(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """`row` (the input row, or its columns in `carry`) and `spans` (kind, start, end, base), by start, then kind."""
    model = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                texts = [x.as_py() or "" for x in part.column("text")]
                spans = [[{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, k, e, b in sorted([(*x, True) for x in base] + [(*x, False) for x in more])] for base, more in all_spans(texts, model.value)]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(spans, pa.list_(SPAN))], names=["row", "spans"])

    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("row"), F.col(text_col).alias("text"))
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())])
    return source.mapInArrow(run, T.StructType([source.schema["row"], T.StructField("spans", T.ArrayType(span))]))


def digest(docs: DataFrame) -> DataFrame:
    found = find_pii(docs, carry=["doc_id"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(F.col("row.doc_id").alias("doc_id"), *map(count, KINDS), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
