import pytest
from brute import PATTERNS, base_spans, luhn, sha
from conftest import EDGE_ROWS, frame
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scorelens.llm import pii


def spans_of(spark, texts):
    found = pii.find(frame(spark, list(enumerate(texts))))
    given = F.filter("pii_spans", lambda s: s["given"])
    rows = found.select("doc_id", pii.listed(given).alias("base"), pii.listed(F.col("pii_spans")).alias("all")).collect()
    return [(r["base"], r["all"]) for r in sorted(rows, key=lambda r: r.doc_id)]


def test_edges(edge):
    found = pii.find(edge)
    assert found.columns == [*edge.columns, "pii_spans"]
    base = F.filter("pii_spans", lambda s: s["given"])
    got = sorted(((r[0], r[1]) for r in found.select("doc_id", F.sha2(pii.listed(base), 256)).collect()), key=repr)
    assert got == sorted(((d, sha(base_spans(t))) for d, t in EDGE_ROWS), key=repr)


@settings(max_examples=3, deadline=None)
@given(texts=st.lists(st.text("0123456789.. -+@()aZ_%é\n", max_size=60), min_size=200, max_size=200))
def test_base_spans_of_any_text(spark, texts):
    assert [b for b, _ in spans_of(spark, texts)] == [base_spans(t) for t in texts]


CASES = [
    "1.2.3.4.5.6.7.8 and 1.2.3.256 and 001.002.003.004",
    "x@y.z@a.b a.b@c.d_e@f.g @a.b a@b a@-.- é@ü.de a@b.c.",
    "4111111111111111 4111 1111 1111 1111 4111-1111-1111-1112 411111111111111 0000000000000000 ",
    "+1 (555) 010-9999, +123, ++12345678901, +1234567890123456, +12-345-678-90-",
    "é" * 10 + "10.0.0.1" + "𝒳" * 5 + "+441234567890",
    "12 34",
    "1.1.1.1 " * 400,
]


def test_cases(spark):
    assert [b for b, _ in spans_of(spark, CASES)] == [base_spans(t) for t in CASES]


def test_added_kinds(spark):
    texts = [
        "pay to DE89 3704 0044 0532 0130 00 now", "pay to DE88 3704 0044 0532 0130 00 now", "GB82WEST12345698765432",
        "my SSN is 123-45-6789", "part 123-45-6789", "ssn 000-45-6789",
    ]
    kinds = [[s.split(":")[0] for s in a.split(",") if s and s.split(":")[0] not in PATTERNS] for _, a in spans_of(spark, texts)]
    assert kinds == [["iban"], [], ["iban"], ["ssn"], [], []]


def test_context_moves_the_score(spark):
    found = pii.find(frame(spark, [(1, "call me: +1 555 010 9999"), (2, "zzzz +1 555 010 9999")])).collect()
    scores = {r.doc_id: r.pii_spans[0].score for r in found}
    assert scores[1] > scores[2]


@pytest.mark.parametrize("digits", ["4111111111111111", "4111111111111112", "79927398713", "0", "18"])
def test_luhn(spark, digits):
    assert spark.range(1).select(pii.luhn(F.lit(digits))).first()[0] == luhn(digits)


def test_redaction(spark, edge, empty):
    rows = [(1, "write a@b.cd or +1 555 010 9999."), (2, "clean"), (3, None), (4, "ip 1.2.3.4.5.6.7.8"), (5, "é 4111111111111111")]
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(frame(spark, rows)).collect()}
    assert got == {
        1: ("write <email> or <phone>.", 25), 2: ("clean", 5), 3: (None, 0), 4: ("ip <ip>.<ip>", 12), 5: ("é <card>", 8),
    }
    assert pii.redact(edge).schema.simpleString() == edge.schema.simpleString()
    assert pii.redact(edge).count() == len(EDGE_ROWS)
    assert pii.redact(empty).count() == 0 and pii.find(empty).count() == 0


def test_account_numbers_before_other_words(spark):
    texts = ["ES91 2100 0418 4502 0005 1332 BIC", "pay ES9121000418450200051332 2024", "DE89 3704 0044 0532 0130 00 AB", "ES92 2100 0418 4502 0005 1332"]
    df = spark.createDataFrame([(i, f"bank account {t}") for i, t in enumerate(texts)], "doc_id bigint, text string")
    found = {r.doc_id: [s.value for s in r.pii_spans if s.kind == "iban"] for r in pii.find(df).collect()}
    assert found == {0: ["ES91 2100 0418 4502 0005 1332"], 1: ["ES9121000418450200051332"], 2: ["DE89 3704 0044 0532 0130 00"], 3: []}
    assert all("2100" not in r.text for r in pii.redact(df).where("doc_id < 2").collect())


def test_columns_under_its_own_names_are_left_alone(spark):
    schema = "doc_id bigint, text string, pii_clean string, pii_spans int, pii_spans_email string, row int, spans string, hit int, clean int, email int"
    df = spark.createDataFrame([(1, "a b@c.de", "kept", 7, "own", 1, "s", 2, 3, 4), (2, None, None, None, None, None, None, None, None, None)], schema)
    out = pii.redact(df)
    assert out.schema == df.schema
    first = out.where("doc_id = 1").first()
    assert first.text == "a <email>" and tuple(first)[2:] == ("kept", 7, "own", 1, "s", 2, 3, 4)
    found = pii.find(df)
    assert [s.kind for s in found.where("doc_id = 1").first().pii_spans] == ["email"] and found.first().pii_spans_email == "own"
