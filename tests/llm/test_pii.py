"""Base spans against the contract's patterns as they stand; the field's further spans; whole queries."""

import hashlib
import random
import re

from tapeworks.llm import pii


def luhn(d):
    t = 0
    for i, c in enumerate(d[::-1]):
        x = int(c)
        if i % 2:
            x = x * 2 - 9 if x > 4 else x * 2
        t += x
    return t % 10 == 0


def plain(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15:
            out.append((3, *m.span()))
    return out


PIECES = ["a@b.c", "x.y+z@m-1.example.com", "@", "@@", "a@b", "_", ".", "..", "1.2.3.4", "256.1.1.1", "001.02.3.4", "1.2.3", ".5",
          "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "0", "12", "+1 (900) 555-2077", "+49 30 1234567", "+1",
          "++1234567890", "é", "日本", " ", "\n", "-", "(", ")", "+", "word", "½", "٣", "6011000990139424", "\x00", "99999"]


def test_base_spans():
    rng = random.Random(0)
    for _ in range(4000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12)))
        assert pii.base_spans(text) == plain(text), text
    for hard in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "a." * 100_000 + "@", "@" * 200_000, "+1" * 100_000, "1 " * 100_000):
        pii.base_spans(hard)
        pii.find([hard], pii.Field.blank())


def trained():
    rng = random.Random(2)
    texts = []
    for _ in range(150):
        phone = f"+1 ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
        texts.append(f"call {phone} or mail me{rng.randint(0, 99)}@host{rng.randint(0, 9)}.example.com from "
                     f"{rng.randint(1, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.1 in {rng.randint(1000, 9999)} , version 2.0")
        texts.append(f"call {phone} now\nand again {phone} on page {rng.randint(1, 400)}")
        card = "".join(rng.choices("0123456789", k=15))
        card = next(card + str(c) for c in range(10) if luhn(card + str(c)))
        texts.append(f"paid by {rng.choice([' ', '-', '']).join(card[j:j + 4] for j in range(0, 16, 4))} on day {rng.randint(1, 31)}")
    return pii.Field.trained(texts)


def test_repeats_share_their_label():
    field = trained()
    text = "Reach me at +1 (415) 555-0134 today. " + "word " * 300 + "Later use 415-555-0134 instead, in 1999."
    (base,), (added,) = pii.find([text], field)
    assert pii.told(base) == pii.told(plain(text))
    assert [(k, text[s:e]) for k, s, e in added] == [(3, "415-555-0134")]
    clean = "In 1999 there were 42 pages, version 2.0, and 12345 lines; see chapter 7."
    assert pii.find([clean, None, ""], field) == ([[], [], []], [[], [], []])
    assert pii.find([text, clean], field)[1][0] == added  # a text is judged by itself


def planted(seed, n=60):
    """Texts with a phone or card that is written again further on as no pattern finds it, and the repeats."""
    rng, texts, spans = random.Random(seed), [], []
    for i in range(n):
        if i % 2:
            d = "".join(rng.choices("0123456789", k=15))
            d = next(d + str(c) for c in range(10) if luhn(d + str(c)))
            first, again, kind = " ".join(d[j:j + 4] for j in range(0, 16, 4)), rng.choice([".", "_", "/"]).join(d[j:j + 4] for j in range(0, 16, 4)), 2
        else:
            d = f"{rng.randint(200, 999)}{rng.randint(200, 999)}{rng.randint(1000, 9999)}"
            first, kind = f"+1 ({d[:3]}) {d[3:6]}-{d[6:]}", 3
            again = rng.choice([f"{d[:3]}-{d[3:6]}-{d[6:]}", "1" + d, d])
        middle = "".join(f"word {rng.randint(1, 5000)} more " for _ in range(20))
        text = f"Use {first} now. {middle} or {again} later, not {rng.randint(10**9, 10**10 - 1)} in 1999."
        texts.append(text)
        spans.append((kind, text.rindex(again), text.rindex(again) + len(again)))
    return texts, spans


def test_skip_potentials_find_the_repeats():
    field = trained()
    texts, spans = planted(1)
    _, added = pii.find(texts, field)
    caught = sum(s in a for s, a in zip(spans, added))
    assert caught >= 0.9 * len(texts) and sum(map(len, added)) == caught       # and nothing else
    _, without = pii.find(texts, pii.Field(field.unary, field.chain, 0.0))
    assert sum(s in a for s, a in zip(spans, without)) < 0.2 * len(texts)
    for text, kind, again in (("A 4111 1111 1111 1111 then 4111.1111.1111.1111 .", 2, "4111.1111.1111.1111"),
                              ("Before 49301234567 comes +49 30 1234567 here", 3, "49301234567")):
        (base,), (more,) = pii.find([text], field)
        assert len(base) == 1 and [(k, text[s:e]) for k, s, e in more] == [(kind, again)]


def test_slices_and_dense_documents(monkeypatch):
    field = trained()
    texts = [*planted(3)[0], None, "", "no digits", *planted(4)[0]]
    whole = pii.find(texts, field)
    monkeypatch.setattr(pii, "SLICE", 900)
    monkeypatch.setattr(pii, "EDGES", 7)
    assert pii.find(texts, field) == whole and len(whole[1]) == len(texts)
    assert pii.find([], field) == ([], [])
    dense = " ".join(str(10**6 + 7919 * i) for i in range(20_000))
    assert pii.find([dense], field) == ([[]], [[]])


def test_detect(spark):
    rows = [(1, "a@b.c 1.2.3.4"), (2, None), (3, ""), (None, "+49 30 1234567"), (1, "a@b.c 1.2.3.4"), (4, "no data " * 20_000),
            (5, "é" * 50_000 + " a@b.c")]
    docs = spark.createDataFrame([(i, t, "x", 9) for i, t in rows], "doc_id long, text string, spans string, all int")
    out = pii.detect(docs, pii.train(docs)).collect()
    got = sorted(((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in out), key=str)
    want = []
    for i, t in rows:
        spans = plain(t or "")
        told = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))
        want.append((i, *(sum(x[0] == k for x in spans) for k in range(4)), hashlib.sha256(told.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    for r in out:
        t = dict(rows)[r["doc_id"]] or ""
        assert set(pii.told(plain(t)).split(",")) <= set(r["spans"].split(","))
    empty = docs.limit(0)
    assert pii.detect(empty, pii.train(empty)).count() == 0
