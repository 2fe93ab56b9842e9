import random

import regex

from leafledger.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def sound(kind, value):
    digits = regex.sub("[^0-9]", "", value)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in value.split(".")),
            "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def brute(text):
    return [(k, m.start(), m.end()) for k, kind in enumerate(pii.KINDS) for m in regex.finditer(PATTERNS[kind], text or "") if sound(kind, m[0])]


def spans(column):
    return [tuple(s) for s in column]


def test_base_spans_against_the_patterns(make):
    rng = random.Random(6)
    pieces = ["a.b", "@", "x-y.com", ".", "..", " ", "é", "🎉", "+1", "+49 ", "(030)", "-", "12", "4929348385146306", "4929-3483 8514-6306",
              "192.168.0.1", "300.1.1.1", "0010.0.0.255", "1.2.3.4.5.6.7.8", "%", "_", "word", "555-7713", "\n", "@d.e", "a@b.c_x@d.e"]
    rows = [(i, "".join(rng.choices(pieces, k=rng.randrange(1, 25)))) for i in range(300)]
    got = {r.doc_id: spans(r.base) for r in pii.find_pii(make(rows)).collect()}
    assert got == {i: brute(t) for i, t in rows}


def test_labelers_add_what_the_base_patterns_miss(make):
    rows = [(i, f"write to name{i}@mail.example.com or call +1 (555) 010-{1000 + i} now, host 10.20.30.{i % 200}") for i in range(40)]
    rows += [(100, "pay by card 4929348385146306 4556737586899855 please"), (101, "nothing to see 12 34 here")]
    got = {r.doc_id: r for r in pii.find_pii(make(rows)).collect()}
    assert spans(got[100].base) == [] and [s[0] for s in spans(got[100].added)] == [2, 2]
    assert [rows[40][1][s:e] for _, s, e in spans(got[100].added)] == ["4929348385146306", "4556737586899855"]
    assert not got[101].added and all(len(got[i].base) == 3 for i in range(40))


def test_reliable_labelers_count_more():
    patterns = [(0, (1, 1, 0, 1, 1), 500.0), (0, (-1, -1, 0, -1, -1), 400.0), (0, (1, -1, 0, 1, 1), 20.0), (0, (-1, 1, 0, -1, -1), 30.0)]
    right = pii.reliabilities(patterns)
    assert right[0, (1, 1, 0, 1, 1)] > 0.99 and right[0, (-1, -1, 0, -1, -1)] < 0.01
    assert right[0, (1, -1, 0, 1, 1)] > 0.5 > right[0, (-1, 1, 0, -1, -1)]
    assert pii.reliabilities([]) == {}


def test_odd_rows(odd, make):
    got = pii.find_pii(odd)
    assert got.count() == odd.count() and got.where("size(base) + size(added) > 0").count() == 0
    assert pii.find_pii(odd.where("doc_id = -1")).count() == 0
    long = [(1, "a" * 200_000 + "@"), (2, "1." * 100_000), (3, "1 " * 100_000), (4, "+1" + "." * 100_000), (5, "a@b" + ".c" * 50_000), (6, "9" * 100_000)]
    assert {r.doc_id: spans(r.base) for r in pii.find_pii(make(long)).collect()} == {i: brute(t) for i, t in long}


def test_redaction_and_listing(make):
    docs = make([(1, "é mail a@b.co and 1.2.3.4!")])
    found = docs.join(pii.find_pii(docs), "doc_id")
    row = found.select(pii.redacted(found.text, found.base).alias("t"), pii.listed(found.base).alias("s")).first()
    assert (row.t, row.s) == ("é mail [email] and [ip]!", "email:7:13,ip:18:25")


def test_no_python_on_the_main_path(make):
    plan = pii.find_pii(make([(1, "a@b.co")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_keys_and_passwords_are_counted(make):
    value = "0123456789abcdef0123"
    texts = [
        f'a token = "{value}" b', f"API_KEY:{value} and secret= {value}", f"password '{value}'", "token = short", f"tokens are {value}", None, "",
        f"mytoken={value}", f"Passwd: \"{value}/+=\"",
    ]
    got = {r.doc_id: r.n_secret for r in pii.find_pii(make(list(enumerate(texts)))).collect()}
    assert got == {0: 1, 1: 2, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0, 8: 1}
