import hashlib
import random
import re

from broadsheet.llm import pii, secrets


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_pii(t):
    digits = lambda m: re.sub(r"[^0-9]", "", m[0])
    found = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(*m.span(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]
    return sorted(found, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def plain_secrets(t):
    found = [(*m.span(), "assign") for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A) if len(m[2]) >= 6]
    found += [(*m.span(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(*m.span(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[0], secrets.KINDS.index(s[2])))


PIECES = ["password", "=", "AKIA", "token", ": ", "'", '"', "ſecret", "@", "a.b", "12", "4111 1111 1111 1111", "+1", "(2)", "-", "255.1.2", "256", ".", "0" * 30, " ", "é", "abcdef0123456789abcdef012345", "passwd", "api_key", "APIKEY", "\n", "İ", "x@y.z"]


def test_spans_equal_plain_scans():
    draw, keywords = random.Random(5), secrets.automaton()
    for _ in range(8000):
        text = "".join(draw.choice(PIECES) for _ in range(draw.randint(1, 14)))
        assert pii.base_spans(text) == plain_pii(text)
        assert secrets.find_secrets(text, keywords) == plain_secrets(text)


def test_checked_tokens():
    body = "A" * 20 + "b" * 10
    good, bad = f"ghp_{body}{secrets.checksum(body)}", f"ghp_{body}000000"
    assert secrets.find_secrets(f"x {good} {bad}", secrets.automaton()) == [(2, 42, "github")]


def test_contexts_discover(spark):
    rows = [(i, f"call my phone number 415 555 {1000 + i} today", 1) for i in range(5)]
    rows += [(10 + i, f"my phone number +1 415 555 {2000 + i} ok", 1) for i in range(8)]
    rows += [(50, "the order number 415 555 1000 today", 1), (99, None, 1), (None, "", 1)]
    found = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string, row int")).collect()}
    assert all(found[i].spans == "phone:21:33" and found[i].n_phone == 0 for i in range(5))
    assert all(found[i].spans == "phone:16:31" and found[i].n_phone == 1 for i in range(10, 18))
    assert found[50].spans == "" and found[99].spans == "" and found[None].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_personal_data(none).count() == 0 and secrets.scan_secrets(none).count() == 0


def test_repeats_and_long_texts(spark):
    text = "x " * 200_000 + "password=abcdef1234 " + "9" * 50_000 + " a@b.co"
    docs = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    at = text.index("password")
    assert [r.spans for r in secrets.scan_secrets(docs).collect()] == [f"assign:{at}:{at + 19},hex:{at + 20}:{at + 50020}"] * 2
    assert [r.n_email for r in pii.find_personal_data(docs).collect()] == [1, 1]


def test_discovery_goes_on_from_what_was_discovered(spark):
    """Seeds raise one pattern; what it finds raises another, which no seed stands at."""
    rows = [(i, f"my phone number +1 415 555 {2000 + i} ok") for i in range(8)]
    rows += [(10 + i, f"my phone number 415 555 {1000 + i}.") for i in range(4)]
    rows += [(20 + i, f"415 555 {1000 + i} reach Ann\n") for i in range(4)]
    rows += [(30, "415 555 3000 reach Ann"), (31, "Tel: 415 555 3000"), (40, "order 415 555 9999 came late"), (41, "order 415 555 1000 came late")]
    found = {r.doc_id: r.spans for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[10 + i] == "phone:16:28" and found[20 + i] == "phone:0:12" for i in range(4))
    assert found[30] == "phone:0:12" and found[31] == found[40] == found[41] == ""


def test_contexts_on_both_sides():
    assert pii.contexts("a b 1 c d", 4, 5) == ["a b _", "_ c d"]
    assert pii.contexts("x\nTel: 1\ny", 7, 8) == ["^ tel _"]
    assert pii.contexts("1 is.\nnext", 0, 1) == []
    assert pii.contexts("1", 0, 1) == []
