import re

from treeloom.llm import pii

CASES = [
    None,
    "",
    "a.b+c@mail.example.com, x@y, @z.org a@b.c@d.e me@-.-",
    "1.2.3.4.5 300.1.1.1 001.02.3.255 1.2.3 " + "9" * 5000 + ".1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112; 4390698575873170 5 5",
    "+1 (743) 555-3824 +12 +1 ( +49 30 123456 7 +1234567890123456789",
    "ü@é.com my card ünïcode 4111111111111111 IP 10.0.0.1",
    "a" * 20000 + " " + "1" * 20000 + "@" * 3000,
]


def brute(text):
    """The base spans by the plain patterns."""
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text) if len(text) < 9000 else []:
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if len(text) < 9000 else []:
        if all(len(p) < 9 and int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"\D", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def base(text):
    return [(s["kind"], s["start"], s["end"]) for s in pii.spans(text) if s["kind"] in pii.BASE_KINDS]


def test_base_spans_are_those_of_the_patterns():
    for text in CASES:
        assert base(text) == brute(text), text and text[:60]


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 200_000, "@" * 200_000, "a@" * 100_000, "+1 " * 100_000, "1 " * 200_000):
        pii.spans(text)


def test_validators_and_context():
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765431")
    assert [s["kind"] for s in pii.spans("IBAN GB82 WEST 1234 5698 7654 32 AND MORE")] == ["iban"]
    assert not pii.spans("number 123-45-6789 here")
    assert [s["kind"] for s in pii.spans("social security 123-45-6789 here")] == ["id_number"]
    plain, near = pii.spans("see 10.0.0.1"), pii.spans("server 10.0.0.1")
    assert near[0]["score"] > plain[0]["score"]


def test_operator_on_rows(spark):
    rows = [(i, t, "x", "clash") for i, t in enumerate(CASES)] + [(1, CASES[2], None, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, pii string")
    out = pii.find_pii(df).collect()
    assert len(out) == len(rows) and set(out[0].asDict()) == {"doc_id", "text", "source", "pii"}
    for r in out:
        assert [(s["kind"], s["start"], s["end"]) for s in r["pii"] if s["kind"] in pii.BASE_KINDS] == brute(r["text"])
    assert pii.find_pii(df.limit(0)).count() == 0
