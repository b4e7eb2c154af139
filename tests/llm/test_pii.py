import hashlib
import random
import re

from prefscale.llm import pii

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def ok(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn(d)
    return kind != "phone" or 9 <= len(d) <= 15


def brute(text):
    kinds = list(BASE)
    spans = sorted((m.start(), kinds.index(k), m.end()) for k, p in BASE.items() for m in p.finditer(text or "") if ok(k, m[0]))
    joined = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)
    return (*(sum(k == i for _, k, _ in spans) for i in range(4)), hashlib.sha256(joined.encode()).hexdigest()), joined


def texts():
    r = random.Random(3)
    bits = ["a", "B.c", "_", "@", "@x.", "y-z.d", "\n", " ", "ß", "😀", "1", "25", "256", ".", "-", "+", "(", ")", "4111 1111 1111 1111", "+1 (386) 555-3733", "10.0.0.255", "DE89370400440532013000", "ssn 123-45-6789"]
    out = ["".join(r.choice(bits) for _ in range(r.randint(0, 60))) for _ in range(500)]
    return [*out, None, "", "a@b.c_d@e.f", "00000255.1.1.1", "1" * 20_000, "1 " * 20_000, "a" * 3_000 + "@", "a@b." + "c." * 9000, "x@y.zz " * 3000, "+" + "1-" * 9000]


def test_base_is_brute_force(spark):
    want = [(i, *brute(t)[0]) for i, t in enumerate(texts())]
    rows = pii.digest(spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")).collect()
    assert sorted(tuple(r)[:6] for r in rows) == want
    for r in rows:
        kept = ",".join(x for x in r.spans.split(",") if x.split(":")[0] in BASE)
        assert kept == brute(texts()[r.doc_id])[1]


def test_added_kinds(spark):
    rows = ["konto DE89 3704 0044 0532 0130 00.", "DE88370400440532013000", "xDE89370400440532013000", "SSN: 123-45-6789", "123-45-6789", "ssn 000-45-6789"]
    got = pii.digest(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert [r.spans for r in sorted(got)] == ["iban:6:33", "", "", "ssn:5:16", "", ""]


def test_redact_keeps_columns_and_the_rest_of_the_text(spark):
    rows = [(1, "ß a@b.cc, +1 (386) 555-3733!", "x"), (1, None, "y"), (2, "nothing", None), (3, "+4111111111111111 , 10.0.0.1", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, pii string")
    got = {r.pii: r for r in pii.redact(df).collect()}
    assert got["x"].text == "ß [EMAIL], [PHONE]!" and got["y"].text is None and got[None].text == "nothing"
    assert got["z"].text == "+[CARD] , [IP]" and list(got["z"].asDict()) == ["doc_id", "text", "pii"]


def test_plan_has_no_python(spark):
    plan = pii.digest(spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_empty(spark):
    assert pii.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
