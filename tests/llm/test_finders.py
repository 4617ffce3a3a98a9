"""Personal data, secrets and quality rules against plain statements of the contracts."""

import hashlib
import re

import pytest

from tidemark.llm import pii, quality, secrets

DOCS = "doc_id long, text string, lang string, spans string, n_email long"


def table(spark, texts):
    rows = [(i, t, None, "clash", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def sha(spans):
    return hashlib.sha256(",".join(spans).encode()).hexdigest()


def luhn(number):
    digits = [int(c) for c in number][::-1]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def plain_pii(text):
    """The base rules with nothing but re.finditer."""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, f"email:{m.start()}:{m.end()}"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, f"ip:{m.start()}:{m.end()}"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, f"card:{m.start()}:{m.end()}"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, f"phone:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(found)]


PII = [
    None, "", "no data here", "a@b.c", "x..@y.com and é.z@mail.example.com, a@b@c.de.", "@@a@b.cc@d.ee", "a@b", "a@-.-",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 01.02.003.255 9.9.9", "12345678901.2.3.4",
    "4111 1111 1111 1111 and 4111-1111-1111-1112", "4111  1111", "0" * 19, "0" * 20, "00000000000 0",
    "call +1 (743) 555-3824 now +12 +123456789 +1234567890123456 +1------2", "+1 (.....", "+49 30 1234567 +4930123456",
    "1" * 5000, "a." * 3000 + "@", "\U0001f600 a@b.cd \U0001f600 1.1.1.1",
]


def test_pii_base(spark):
    got = {r["doc_id"]: r for r in pii.find(table(spark, PII)).collect()}
    assert len(got) == len(PII)
    for i, text in enumerate(PII):
        want = plain_pii(text or "")
        assert got[i]["base_sha256"] == sha(want), text
        assert set(want) <= set(filter(None, got[i]["spans"].split(",")))
        counts = [sum(s.startswith(k + ":") for s in want) for k in ("email", "ip", "card", "phone")]
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == counts


def test_pii_added():
    assert [s[0] for s in pii.added_spans("IBAN DE89 3704 0044 0532 0130 00 please")] == ["iban"]
    assert pii.added_spans("DE88 3704 0044 0532 0130 00") == []
    assert [s[0] for s in pii.added_spans("my social security number 123-45-6789")] == ["national"]
    assert pii.added_spans("build 123-45-6789") == []


def plain_secrets(text):
    found = []
    rule = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(rule, text, re.I | re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            found.append((m.start(), 1, f"access:{m.start()}:{m.end()}"))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 24:
            found.append((m.start(), 2, f"hex:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(found)]


KEY = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
SECRETS = [
    None, "", "plain words only", f'token = "{KEY}"', "PassWord:abcdef", "password: abc", "api_key='Zz9+/_.=-'", "apikey  =  x" + "1" * 9,
    "AKIA" + "A1" * 8, "AKIA" + "A" * 15, "xAKIAAKIA" + "Z9" * 9, "f" * 23, "f" * 24, "fg" * 30, "token=token=abcdefg", "ſecret=abcdef",
    "secret" + " " * 500 + "=" + "q" * 6, f"é {KEY} é",
]


def test_secrets_base(spark):
    got = {r["doc_id"]: r for r in secrets.find(table(spark, SECRETS)).collect()}
    for i, text in enumerate(SECRETS):
        want = plain_secrets(text or "")
        assert got[i]["base_sha256"] == sha(want), text
        assert set(want) <= set(filter(None, got[i]["spans"].split(",")))


def test_automaton_merges_and_scores():
    keys = [hashlib.md5(str(i).encode()).hexdigest() for i in range(300)]
    models = secrets.fit(keys, ["ordinarylongwordsinarow", "anotherverylongwordhere"] * 20)
    assert len(models[0].states()) < 100
    assert secrets.format_score(models, hashlib.md5(b"other").hexdigest()) > secrets.MARGIN
    assert secrets.format_score(models, "justsomeverylongword") < secrets.MARGIN
    assert secrets.fit([], ["a"]) is None


def test_empty_tables(spark):
    none = table(spark, [])
    for find in (pii.find, secrets.find, quality.digest):
        assert find(none).collect() == []


QUALITY = [
    (None, (0, 0, 0, 0, 0), True), ("", (0, 0, 0, 0, 0), True), ("one two", (2, 6, 0, 0, 0), True),
    ("a b c d e a b c d e", (10, 10, 0, 0, 10), True),
    ("a b c d e f g h i j k.", (11, 12, 0, 0, 0), False),
    ("#a *b\n#a *b\n \n x", (5, 9, 4, 1, 0), True),
    (" ".join(f"w{i}" for i in range(4)) + ".\n" + " ".join(f"v{i}" for i in range(9)) + ".", (13, 28, 0, 0, 0), False),
]


def test_quality_counts(spark):
    got = {r["doc_id"]: r for r in quality.digest(table(spark, [q[0] for q in QUALITY])).collect()}
    for i, (_, want, failed) in enumerate(QUALITY):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == failed
        assert not (failed and r["kept"])


@pytest.mark.parametrize("line,bad", [
    ("Home", True), ("Home | About | Contact", True), ("BUY THIS NOW TODAY", True), ("We use a cookie on this site.", True),
    ("This is a whole sentence of its own.", False), ("Four words without end", False), ("##### $$$$$ %%%%% x", True),
])
def test_lines(spark, line, bad):
    keep = "A sentence that stays here because it is fine, with more words than ten."
    r = quality.quality(spark.createDataFrame([(1, f"{keep}\n{line}")], "doc_id long, text string")).first()
    assert (r["n_bad_lines"] == 1) == bad
    assert r["clean_text"] == (keep if bad else f"{keep}\n{line}")
