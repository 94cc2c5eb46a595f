"""Disguised personal data and fill-in-middle cuts against plain Python."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociforge.llm import fim, pii

# The base patterns as the contract words them.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d // 10 + d % 10
    return total % 10 == 0


def plain_spans(text):
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


@pytest.mark.parametrize("letters", ["a@.-1 é", "01.+ ()-", "4+1 -", "@a.%_٣", "259.. @"])
def test_detector_equals_plain_patterns(letters):
    rng = random.Random(letters)
    for _ in range(4000):
        text = "".join(rng.choices(letters, k=rng.randrange(40)))
        assert pii.detect(text) == plain_spans(text), text
        assert [s[:3] for s in pii.spans(text) if s[3]] == plain_spans(text), text


DISGUISED = [
    ("email", "mail jоhn@example.com now", "jоhn@example.com"),
    ("email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    ("email", "j\u200bohn@exa\u00admple.com", "j\u200bohn@exa\u00admple.com"),
    ("email", "write john dot smith (at) example [dot] co dot uk please", "john dot smith (at) example [dot] co dot uk"),
    ("email", "Write John AT example DOT org", "John AT example DOT org"),
    ("email", "john @ example.com", "john @ example.com"),
    ("email", "ana arroba correo punto es", "ana arroba correo punto es"),
    ("phone", "call plus one five five five double one two three four five six.", "plus one five five five double one two three four five six"),
    ("phone", "tel +49 drei null fünf sechs 12 34 567.", "+49 drei null fünf sechs 12 34 567"),
    ("phone", "＋١٢٣ 456 7890", "＋١٢٣ 456 7890"),
    ("ip", "192 dot 168 dot 1 dot 254", "192 dot 168 dot 1 dot 254"),
    ("ip", "server 10[.]0[.]0[.]1 ok", "10[.]0[.]0[.]1"),
    ("ip", "one nine two dot one six eight dot zero dot one", "one nine two dot one six eight dot zero dot one"),
    ("card", "card four five three nine 1488 0343 6467", "four five three nine 1488 0343 6467"),
    ("card", "4O12 8888 8888 1881", "4O12 8888 8888 1881"),
]


@pytest.mark.parametrize("kind,text,wanted", DISGUISED)
def test_disguises_map_back_to_the_source(kind, text, wanted):
    for before in ("", "\u00e9 \u2013 six, xx \u200b ", "x" * 5000 + " "):
        whole = before + text
        added = [(pii.KINDS[k], whole[a:b]) for k, a, b, base in pii.spans(whole) if not base]
        assert added == [(kind, wanted)]


@pytest.mark.parametrize("text", ["he looked at example.com and left", "meet at noon. One, two, three dots", "the dot at the end (a) of it", "le plus grand. Un point de vue", "1. one\n2. two", "le 6. Un an après", "v1.2.3 (a.b) at 5"])
def test_clean_texts_stay_clean(text):
    assert pii.spans(text) == []


def test_a_word_after_an_identifier_is_a_word():
    text = "tel +1 (848) 555-1373 Un an. To a point john@b.cd came"
    assert [s[3] for s in pii.spans(text)] == [True, True]
    text = "jоhn@b.cd"
    assert [(text[a:b], base) for _, a, b, base in pii.spans(text)] == [("jоhn@b.cd", False), ("hn@b.cd", True)]


def test_edits_map_back():
    text = "abc--def==g"
    step = pii.Rewritten(text, [(3, 5, "+"), (8, 10, "")])
    assert step.text == "abc+defg"
    for i, c in enumerate(step.text):
        a, b = step.source(i, i + 1)
        assert text[a:b] == (c if c != "+" else "--")
    assert step.source(2, 8) == (2, 11) and step.source(6, 8) == (7, 11)


def test_find(spark):
    rows = [(1, "a@b.c and a (at) b.cd", "x"), (1, "a@b.c and a (at) b.cd", "x"), (2, None, "x"), (3, "", None), (None, "+1 234 567 890", "x"), (4, "1.2." * 200_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = pii.find(docs, mask=True).collect()
    assert len(got) == len(rows)
    by = {r["id"]: r for r in got}
    assert [tuple(s) for s in by[1]["spans"]] == [("email", 0, 5, True), ("email", 10, 21, False)] and by[1]["masked"] == "[EMAIL] and [EMAIL]"
    assert sum(r["id"] == 1 for r in got) == 2
    assert by[2]["spans"] == by[3]["spans"] == [] and by[2]["masked"] == ""
    assert by[None]["masked"] == "[PHONE]" and len(by[4]["spans"]) == 100_000
    empty = pii.find(docs.where("false"))
    assert empty.columns == ["id", "spans"] and empty.count() == 0


# ---- fill-in-middle ------------------------------------------------------------------------------------------------------------

UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+", "char": r"(?s)."}


def plain_fim(key, text, unit):
    text = text or ""
    units = re.findall(UNITS[unit], text)
    assert "".join(units) == text
    h = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return key, n, "plain", None, None, text
    if h[3] % 100 < 50:
        return key, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return key, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", sorted(UNITS))
def test_transform(spark, unit):
    rng = random.Random(unit)
    texts = [None, "", "\n", "\n\n\n", "a", "a\n", "<", "<<S", "a<P>b\nc\n", ">\n<P\nM>", "é\n\nß\n" * 3000, "x" * 300_000, "a b\n" * 100_000]
    texts += ["".join(rng.choices("ab \n\n\té日𝄞\r", k=rng.randrange(30))) for _ in range(400)]
    rows = [(i if i != 5 else None, t, "clash") for i, t in enumerate(texts)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string")
    out = fim.transform(docs, unit).withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    want = sorted((plain_fim(k, t, unit) for k, t, _ in rows), key=str)
    got = sorted(((r["id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out), key=str)
    assert got == want
    source = {k: t or "" for k, t, _ in rows}
    assert all(r["back"] == source[r["id"]] for r in out)


def test_transform_rates_and_empty(spark):
    docs = spark.range(500).selectExpr("id as doc_id", "concat('a\nb\nc ', id) as text")
    forms = {r["form"]: r["count"] for r in fim.transform(docs, rate=40, suffix_first=0).groupBy("form").count().collect()}
    assert set(forms) == {"plain", "psm"} and 150 < forms["psm"] < 250
    assert fim.transform(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        fim.Runs(np.zeros(0, "uint8"), np.zeros(1, "int64"), "page")
