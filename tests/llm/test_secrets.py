"""Candidates and labels of the secret scan."""

import pytest
from pyspark.sql import functions as F

from tickloom.llm import secrets
from tickloom.llm.queries import labelled_secrets

KEY = "AKIA" + "ABCDEFGH12345678"
LOGIN = "0123456789abcdef01"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (f"postgres://user:{LOGIN}@db:5432/x", LOGIN),
        (f"see {KEY}:somesecret", KEY),
        (f"token={LOGIN}:suffix", LOGIN),
        ("password = correcthorsebattery", "correcthorsebattery"),
        ("pwd: ab12!", "ab12!"),
        ("password = \"a b#c$d!1\" end", "a b#c$d!1"),
        ("secret='x#y$z!w9', next", "x#y$z!w9"),
        ("Authorization: Bearer ab#cd-efgh", "ab#cd-efgh"),
        ("/x?token=abcd!efg&key=other#1", "abcd!efg"),
        ("api_key=QUJDREVGRzEyMzQ1==", "QUJDREVGRzEyMzQ1=="),
    ],
)
def test_candidates_keep_the_value(text, want):
    raw = text.encode()
    assert want in [raw[a:b].decode() for a, b in secrets.candidates_of(raw)]


def test_long_texts_take_linear_time():
    assert secrets.candidates_of(b"key" * 100_000) == [] and len(secrets.candidates_of(b"a1=" * 100_000)) == 0


def test_labels_by_format_and_context(spark):
    cases = [
        (KEY, True), (LOGIN.upper(), True), ("sk-abcdefghij1234567890", True), ("see a://user:swordfish-77@db now", True), ("password: swordfish#77", True),
        ("x.12345@mail.example.com", False), ("4111111111111111", False), ("someidentifier-1234567", None), ("ab12abcdefgh@x", None), ("password: letters", None),
    ]
    df = spark.createDataFrame([(i, t, "src/a") for i, (t, _) in enumerate(cases)], "doc_id long, text string, source string")
    got = labelled_secrets(secrets.findings(df)).groupBy("id").agg(F.collect_set("label").alias("l"), F.count("*").alias("n")).collect()
    for r in got:
        want = cases[r.id][1]
        assert (want in r.l) if want is not None else r.l == [], (cases[r.id], r)
    assert len(got) == len(cases)
