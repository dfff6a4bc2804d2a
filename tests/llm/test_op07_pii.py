"""Base patterns against plain regexes; the tagger on held-out windows; the query's digest against brute force."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

from tickloom.llm import op07_pii as P
from tickloom.llm import tagger

from . import spellings

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute(text):
    out = []
    for k, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if [True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(d) <= 19 and tagger.luhn(d or "1"), 9 <= len(d) <= 15][k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_patterns():
    r = random.Random(3)
    for _ in range(5000):
        text = "".join(r.choice("a1.@ -+(0)%5é") for _ in range(r.randrange(40)))
        assert P.base_spans(text) == brute(text), text
    for text in ("4111 1111 1111 1111", "x@y.z@w.v", "999.1.1.1.1", "+49 (30) 1234567 x", "1" * 5000, "a" * 5000 + "@", "0000000255.1.1.1"):
        assert P.base_spans(text) == brute(text), text[:50]


def test_windows_cover_whole_texts():
    for n in (0, 1, 47, 48, 49, 255, 256, 257, 464, 465, 5000):
        found = P.windows("x" * n)
        assert not n and not found or found[0][0] == 0 and found[-1][1] == n
        assert all(0 < b - a <= P.WINDOW for a, b in found) and all(c <= b - P.OVERLAP for (_, b), (c, _) in zip(found, found[1:]))


def best_tags(m, codes):
    """Plain Viterbi over one window, in 64 bits."""
    e = m.emissions(codes[None])[0].astype(float)
    allowed = lambda a, b: b == 0 or b % 2 or a in (b - 1, b)
    score, back = e[0] + m.p["first"], []
    for step in e[1:]:
        options = np.array([[score[a] + m.p["trans"][a, b] if allowed(a, b) else -1e9 for a in range(tagger.TAGS)] for b in range(tagger.TAGS)])
        back.append(options.argmax(1))
        score = options.max(1) + step
    tags = [int(score.argmax())]
    for b in reversed(back):
        tags.append(int(b[tags[-1]]))
    return tags[::-1]


def test_decoding_of_many_windows_equals_plain_viterbi():
    m = tagger.trained()
    x, _ = tagger.labelled(40, 321)
    size = np.array([tagger.LENGTH - 7 * (k % 5) for k in range(40)])
    found, same = m.decode(x, size), 0
    for k in range(40):
        assert not found[k, size[k] :].any()
        same += found[k, : size[k]].tolist() == best_tags(m, x[k, : size[k]])
    assert same >= 39  # 32 bits may turn a tie


def test_gradients_and_held_out_windows():
    m = tagger.Tagger()
    x, y = tagger.labelled(2, 5)
    _, g = m.gradients(x, y)
    for k in ("embed", "xf", "hb", "out", "trans", "first"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        m.p[k][at] += 1e-5
        up = m.gradients(x, y)[0]
        m.p[k][at] -= 2e-5
        down = m.gradients(x, y)[0]
        m.p[k][at] += 1e-5
        assert g[k][at] == pytest.approx((up - down) / 2e-5, rel=1e-3)
    x, y = tagger.labelled(300, 99)
    found = tagger.trained().decode(x)
    assert (found == y)[y > 0].mean() > 0.9 and (found > 0)[y == 0].mean() < 0.02


def test_digest(spark):
    rows = [(1, "mail jo@x.org now"), (2, None), (3, ""), (4, "call +1 (017) 555-7713, host 10.0.0.1, card 4111 1111 1111 1111."), (4, "call +1 (017) 555-7713"), (None, "é 1.2.3.4"), (5, "nothing here at version 2.0"), (6, "word " * 40000 + "a@b.cd")]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, spans string, row int")
    got = P.digest(df).collect()
    want = sorted((i is None, i or 0, [(s, k, e) for s, k, e in brute(t or "")]) for i, t in rows)
    have = []
    for r in got:
        spans = [(int(x.split(":")[1]), tagger.KINDS.index(x.split(":")[0]), int(x.split(":")[2])) for x in r.spans.split(",") if x]
        text_rows = [t for i, t in rows if i == r.doc_id]
        base = next(b for b in (brute(t or "") for t in text_rows) if hashlib.sha256(",".join(f"{tagger.KINDS[k]}:{s}:{e}" for s, k, e in b).encode()).hexdigest() == r.base_sha256)
        assert set(base) <= set(spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in base) for j in range(4)]
        have.append((r.doc_id is None, r.doc_id or 0, base))
    assert sorted(have) == want
    assert P.digest(df.where("false")).count() == 0


def test_the_tagger_adds_what_the_patterns_miss():
    model = tagger.trained()
    found = {t: P.all_spans([t], model)[0][1] for t in ("please call (017) 555-7713 soon", "write to jo.b [at] example [dot] org today", "version 2.0 of the year 2024 at 12:30")}
    a, b, c = found.values()
    assert a and b and not c


def test_recall_and_precision_of_what_is_added():
    r, right, given, there = random.Random(78), 0, 0, 0
    for _ in range(150):
        text, spans = "", []
        for _ in range(40):
            u = r.random()
            kind = r.randrange(4) if u < 0.05 else -1
            piece = tagger._entity(r, tagger.KINDS[kind]) if kind >= 0 else tagger._decoy(r) if u < 0.1 else tagger._word(r)
            if kind >= 0:
                spans.append((len(text), kind, len(text) + len(piece)))
            text += piece + " "
        base, more = P.all_spans([text], tagger.trained())[0]
        missed = {x for x in spans if all(x[2] <= a or x[0] >= b for a, _, b in base)}
        right, given, there = right + len(missed & set(more)), given + len(more), there + len(missed)
    assert right >= 0.85 * there and right >= 0.9 * given


def test_nothing_is_added_to_clean_prose(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = P.find_pii(docs, carry=["doc_id"])
    assert found.selectExpr("inline(spans)").where("not base").count() <= 1


def test_a_value_across_windows_is_found_once():
    text = "word " * 48 + "(017) 555-7713 " + "word " * 100
    spans = [s for at in range(30) for s in [P.all_spans(["x" * at + " " + text], tagger.trained())[0][1]]]
    assert all(len(s) == 1 for s in spans)


def test_a_text_of_very_many_values_is_read_in_linear_time():
    found = [(k * 20, k % 4, k * 20 + 12) for k in range(300_000)]
    began = time.perf_counter()
    assert P.apart([(s + 5, k, e + 2) for s, k, e in found], found) == [] and P.apart([(s + 13, k, e + 4) for s, k, e in found], found) == [(s + 13, k, e + 4) for s, k, e in found]
    assert time.perf_counter() - began < 5
    names, hosts = ("anna", "max", "k.lee", "noor.a"), ("mail", "example", "north")
    text = "".join(f"{names[k % 4]} (at) {hosts[k % 3]} (dot) org, a{k}@b.cd and " for k in range(20_000))
    began = time.perf_counter()
    base, more = P.all_spans([text], tagger.trained())[0]
    assert len(base) == 20_000 and len(more) > 15_000 and time.perf_counter() - began < 60
    spans = sorted(base + more)
    assert all(a[2] <= b[0] for a, b in zip(spans, spans[1:]))


def test_apart_against_all_pairs():
    r = random.Random(6)
    for _ in range(200):
        base = sorted((s, 0, s + r.randrange(1, 9)) for s in r.sample(range(60), 8))
        spans = [(s, 1, s + r.randrange(1, 6)) for s in r.sample(range(60), 12)]
        assert P.apart(spans, base) == [(s, k, e) for s, k, e in spans if all(e <= x or s >= z for x, _, z in base)]


def test_spellings_written_by_hand(spark):
    """Figures of the README: exact values, and how many texts without any get one."""
    right = touched = 0
    for number, (kind, value) in enumerate(spellings.VALUES):
        sentence = spellings.SENTENCES[number % len(spellings.SENTENCES)]
        at = sentence.index("{}")
        base, more = P.all_spans([sentence.replace("{}", value)], tagger.trained())[0]
        right += (at, tagger.KINDS.index(kind), at + len(value)) in base + more
        touched += any(tagger.KINDS[k] == kind and s < at + len(value) and e > at for s, k, e in base + more)
    assert len(spellings.VALUES) >= 100 and right >= 0.55 * len(spellings.VALUES) and touched >= 0.6 * len(spellings.VALUES)
    assert sum(any(x) for x in P.all_spans(spellings.OTHERS, tagger.trained())) <= 3


def test_windows_without_a_possible_value_are_left_out(monkeypatch):
    from tickloom.llm import op07_pii as P

    model, prose = P.trained(), "Das ist ein langer Satz, that says nothing at all. " * 60
    texts = [prose, prose[:1500] + " write to jo.doe at mail dot example dot org soon " + prose[1500:], prose[:700] + "call +49 (30) 1234,5678 or 10 . 0 . 0 . 7 now" + prose[700:], "", "a", "at . ", prose + "4111-1111-1111-1111"]
    read, plain = [], model.decode
    monkeypatch.setattr(model, "decode", lambda x, size: read.append(len(x)) or plain(x, size))
    got = P.all_spans(texts, model)
    few = sum(read)
    monkeypatch.setattr(P, "windows_to_read", P.windows)
    assert P.all_spans(texts, model) == got and any(more for _, more in got)
    assert few < 20 < sum(read) - few
    for value in ("ab@cd.ef", "ab at cd dot ef", "AB AT cd . ef", "1.2.3.4"):
        assert P.may_hold(value)
