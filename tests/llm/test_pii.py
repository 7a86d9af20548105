import hashlib
import random
import re

from headwise.llm import pii
from headwise.llm.queries import QUERIES

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def passes(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 10 <= len(digits) <= 15


def base_spans(text):
    found = [(m.start(), rank, f"{k}:{m.start()}:{m.end()}") for rank, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if passes(k, m.group())]
    return [s for _, _, s in sorted(found)]


def card():
    body = "".join(random.choice("0123456789") for _ in range(random.randint(13, 18)))
    return next(body + c for c in "0123456789" if luhn(body + c))


def random_text(random_):
    bits = ["a@b.c", "@", ".", "x@y", " ", "  ", "1.2.3.4", "256.1.1.1", "00012.3.4.5", "+", "+1 (988) 555-2485", "9", "-", "é😀", "ab", "_", "%", "\n", "5", "0", "(", ")", "a@b.c_d@e.f", "...", card(), card(), "+4912345678901"]
    return "".join(random_.choice(bits) for _ in range(random_.randint(0, 25)))


def test_base_spans_equal_plain_patterns(spark):
    random_ = random.Random(11)
    random.seed(4)
    texts = [random_text(random_) for _ in range(1500)] + [None, "", "a" * 3000, "1" * 3000, "a@b" + ".c" * 20_000, "+1" + "." * 20_000, ("a@b.c +1 (988) 555-2485 " * 1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find(df).collect():
        want = base_spans(r.text or "")
        assert [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind in pii.BASE] == want, r.text


def test_account_numbers_need_check_and_score(spark):
    good, bad = "DE89370400440532013000", "DE88370400440532013000"
    rows = [(1, f"iban {good}"), (2, f"iban {bad}"), (3, f"x {good} y"), (4, f"bank GB82 WEST 1234 5698 7654 32, so"), (5, f"sample bank {good}")]
    got = {r.doc_id: [s.kind for s in r.spans if s.kind == "iban"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["iban"], 2: [], 3: [], 4: ["iban"], 5: ["iban"]}


def test_account_numbers_end_where_their_country_says(spark):
    texts = {
        "bank DE89370400440532013000 Bitte": ["DE89370400440532013000"],
        "iban DE89370400440532013000 12 Euro": ["DE89370400440532013000"],
        "iban GB82 WEST 1234 5698 7654 32 Please pay": ["GB82 WEST 1234 5698 7654 32"],
        "iban DE89370400440532013000 BIC COBADEFF": ["DE89370400440532013000"],
        "bank NL91 ABNA 0417 1643 00 FR14 2004 1010 0505 0001 3M02 606 bank": ["NL91 ABNA 0417 1643 00", "FR14 2004 1010 0505 0001 3M02 606"],
        "é😀 bank AB12 CODE DE89370400440532013000\nKONTO": ["DE89370400440532013000"],
        "NO9386011117947 1 iban": ["NO9386011117947"],
        "account MT84MALT011000012345MTLCAST001S OK": ["MT84MALT011000012345MTLCAST001S"],
        "bank ZZ80539007547034 Q 1": ["ZZ80539007547034"],
        "bank DE88370400440532013000 Bitte, DE89370400440532013000X, DE89370400440532013000x, xDE89370400440532013000": [],
    }
    rows = list(enumerate(texts))
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.text: [r.text[s.start : s.end] for s in r.spans if s.kind == "iban"] for r in got.collect()} == texts
    clean = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean[0] == "bank [IBAN] Bitte" and clean[2] == "iban [IBAN] Please pay"
    many = spark.createDataFrame([(1, "AB12 " * 10_000), (2, "DE89 3704 0044 0532 0130 00 " * 2_000)], "doc_id long, text string")
    assert {r.doc_id: sum(s.kind == "iban" for s in r.spans) for r in pii.find(many, threshold=0.0).collect()} == {1: 0, 2: 2_000}


def test_confirmed_account_numbers_need_no_context(spark, tmp_path):
    good, bad = "DE89370400440532013000", "DE88370400440532013000"
    rows = [(1, f"virement {good} merci"), (2, f"{good}|{bad}"), (3, f"test {good}"), (4, f"x {bad} y"), (5, f"iban {good}, a@b.c")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.spans, r.scores) for r in QUERIES["op3_personal_data"](spark, str(tmp_path)).collect()}
    assert got == {1: ("iban:9:31", "0.60"), 2: ("iban:0:22", "0.60"), 3: ("iban:5:27", "0.40"), 4: ("", ""), 5: ("iban:5:27,email:29:34", "0.90,0.90")}
    clean = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean == {1: "virement [IBAN] merci", 2: f"[IBAN]|{bad}", 3: "test [IBAN]", 4: f"x {bad} y", 5: "iban [IBAN], [EMAIL]"}


def test_time_is_linear_in_long_runs(spark):
    df = spark.createDataFrame([(1, "a" * 2_000_000 + "@"), (2, "1" * 2_000_000 + "."), (3, "a@b" + ".c" * 500_000)], "doc_id long, text string")
    assert sorted((r.doc_id, len(r.spans)) for r in pii.find(df).collect()) == [(1, 0), (2, 0), (3, 1)]


def test_redaction_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "é a@b.c, 1.2.3.4 end", "z"), (2, None, "y"), (3, "clean", None), (3, "clean", None)], "spans long, text string, found string")
    got = {(r.spans, r.text) for r in pii.redact(df).collect()}
    assert got == {(1, "é [EMAIL], [IP] end"), (2, None), (3, "clean")}
    assert pii.redact(df).columns == df.columns and pii.redact(df).count() == 4 and pii.redact(df.limit(0)).count() == 0


def test_query(spark, small):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = QUERIES["op3_personal_data"](spark, small).collect()
    assert len(got) == len(texts)
    for r in got:
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in want) for k in pii.BASE]
        assert set(want) <= set(r.spans.split(","))  or not want
