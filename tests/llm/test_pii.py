import random
import re

from sparkcast.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    tests = (("email", EMAIL, lambda m: True), ("ip", IP, lambda m: all(int(p) <= 255 for p in m.group().split("."))),
             ("card", CARD, lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", PHONE, lambda m: 8 <= len(digits(m)) <= 15))
    return [(k, m.start(), m.end()) for k, p, ok in tests for m in p.finditer(text or "") if ok(m)]


def texts():
    rng = random.Random(8)
    parts = ["a@b.co", "x.y%z@mail-1.example.org", "a@b", "@", "a@b.c@d.e", "10.0.0.1", "1.2.3.4.5.6.7.8", "256.1.1.1", "007.01.2.3", "4111 1111 1111 1111",
             "4111-1111-1111-1112", "4111111111111111", "+49 (30) 123-4567", "+1 2", "+1234567890123456", "é🙂", "word", "+1 555.123.4567@x.yz",
             "1 2 3 4 5 6 7 8", "00", "-", ".", "..", "4539578763621486", "6011000990139424 0"]
    out = [None, "", " ", "+", "1" * 400 + "." + "2" * 300, "a" * 5000 + "@", "1 " * 30000, "x@y" + ".z" * 4000]
    for _ in range(300):
        out.append("".join(rng.choice(parts) + rng.choice(["", " ", "\n", ", ", "_", "-"]) for _ in range(rng.randrange(1, 25))))
    return out


def test_base_spans(spark):
    rows = [(i, t, 1) for i, t in enumerate(texts())] + [(None, "mail a@b.co", 2), (3, "+", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int").repartition(4)
    got = pii.sanitise(docs).collect()
    by = {r.doc_id: r for r in got if r.doc_id != 3}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        if i == 3:
            continue
        r = by[i]
        assert [(s.kind, s.start, s.stop) for s in r.base] == plain(t), (t or "")[:100]
        assert all((t or "")[s.start:s.stop] == s.value for s in r.spans)
        assert [s for s in r.spans if s.kind != "term"] == r.base
        if not r.spans:
            assert r.sanitised == (t or "")
    assert by[None].sanitised == "mail [EMAIL]"


def test_disclosing_terms(spark):
    rows = [(i, f"the clerk Zanthor signs as z@corp.example here {i}\nsome other line {i}") for i in range(6)]
    rows += [(10 + i, f"the clerk and word{i} here\nnothing of note\nthe end of it {i}") for i in range(40)]
    rows += [(90, "Zanthor alone"), (91, "the clerk Zanthor, ZANTHOR! and Zanthors z@corp.example")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by = {r.doc_id: r for r in pii.sanitise(docs, rule=pii.Disclosure(support=3)).collect()}
    terms = lambda i: {s.value for s in by[i].spans if s.kind == "term"}
    assert "Zanthor" in terms(0) and "the" not in terms(0) and "clerk" not in terms(0)
    assert {"Zanthor", "ZANTHOR"} <= terms(91) and "Zanthors" not in terms(91)
    assert terms(90) == set() and by[90].sanitised == "Zanthor alone"
    assert "z@corp" not in by[0].sanitised and "Zanthor" not in by[0].sanitised and "[EMAIL]" in by[0].sanitised
    assert all(not by[i].spans for i in range(10, 50))


def test_empty_and_native(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.sanitise(docs).collect() == []
    plan = pii.sanitise(spark.createDataFrame([(1, "a@b.co")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
