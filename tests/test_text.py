import pytest
from pyspark.sql import functions as F

from curbline.functions import taxonomy as X, text as N
from curbline.functions.redaction import has_pii, masked, pii_census
from curbline.operators.text_vectors import hashed_vectors, pair_distances


def one(spark, expr, **values):
    row = {k: F.lit(v).cast("string").alias(k) for k, v in values.items()}
    return spark.range(1).select(*row.values()).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,gone,token",
    [
        ("Call me at 718-555-0142 about the leak", "718-555-0142", "[REDACTED_PHONE]"),
        ("Reach reporter@example.com regarding it", "reporter@example.com", "[REDACTED_EMAIL]"),
        ("Reach josé@example.com regarding it", "josé", "[REDACTED_EMAIL]"),
        ("Flooding at 123 Flatbush Avenue near the corner", "123 Flatbush", "[REDACTED_ADDRESS]"),
        ("(718) 555 0142 and +1 718.555.0143", "0143", "[REDACTED_PHONE]"),
    ],
)
def test_masks(spark, text, gone, token):
    out = one(spark, masked(F.col("t")), t=text)
    assert gone not in out and token in out
    assert one(spark, has_pii(F.col("t")), t=text) is True


@pytest.mark.parametrize("text", ["Hydrant leaking onto the street, water pooling", None, ""])
def test_masks_leave_clean_text(spark, text):
    assert one(spark, masked(F.col("t")), t=text) == text
    assert one(spark, has_pii(F.col("t")), t=text) is False


def test_census(rows):
    df = rows([("a", "x@y.org"), ("a", "plain"), ("b", "718-555-0142")], "g string, t string")
    got = {r["g"]: (r["n"], r["n_email"], r["n_phone"], r["n_pii"]) for r in pii_census(df, "t", ["g"]).collect()}
    assert got == {"a": (2, 1, 0, 1), "b": (1, 0, 1, 1)}


@pytest.mark.parametrize(
    "text,thin", [("leak", True), ("", True), (None, True), ("   \t leak \n      ", True),
                  ("Water pouring from the ceiling onto the floor", False)]
)
def test_thin(spark, text, thin):
    assert one(spark, N.is_thin(F.col("t")), t=text) is thin


@pytest.mark.parametrize(
    "text,multi",
    [
        ("Water leak from ceiling and the floor is buckling", True),
        ("Hydrant leaking water onto the street", False),
        ("Loud music and it never stops at night", True),
        ("Loud music & more", False),
        (None, False),
    ],
)
def test_multi_issue(rows, text, multi):
    out = N.text_flags(rows([(text,)], "descriptor string")).first()
    assert out["multi_issue"] is multi


def test_keywords_start_words(spark):
    assert one(spark, N.issue_categories(F.col("t")), t="street") == []
    assert one(spark, N.issue_categories(F.col("t")), t="The wall is Buckling") == ["structural"]


@pytest.mark.parametrize(
    "kind,text,agencies,multi",
    [
        ("Water System", "Water from the ceiling and the floor is buckling", ["DEP", "DOB"], True),
        ("Water System", "Hydrant leaking onto the street", ["DEP"], False),
        ("Other", "something unclassifiable", [], False),
        (None, None, [], False),
        ("HEAT/HOT WATER", None, ["DEP", "HPD"], True),
    ],
)
def test_multi_agency(rows, kind, text, agencies, multi):
    df = rows([(kind, text)], "complaint_type string, descriptor string")
    out = N.multi_agency(df).first()
    assert (out["agencies"], out["is_multi"]) == (agencies, multi)


@pytest.mark.parametrize(
    "code,clean,valid",
    [("  dep ", "DEP", True), ("", None, False), (None, None, False), ("hpd", "HPD", True), ("FBI", "FBI", False)],
)
def test_codes(spark, code, clean, valid):
    assert one(spark, X.clean_code(F.col("c")), c=code) == clean
    assert one(spark, X.is_agency(F.col("c")), c=code) is valid


def test_prior(spark):
    assert one(spark, X.usual_agency(F.col("c")), c="Damaged Tree") == "DPR"
    assert one(spark, X.usual_agency(F.col("c")), c="damaged tree") is None
    assert one(spark, X.usual_agency(F.col("c")), c=None) is None


@pytest.mark.parametrize(
    "kind,text,out", [("Sewer", "backup", "Sewer: backup"), (None, "backup ", "backup"), ("Sewer", None, "Sewer"), (None, None, "")]
)
def test_ticket_text(spark, kind, text, out):
    assert one(spark, N.ticket_text(F.col("a"), F.col("b")), a=kind, b=text) == out


def test_equal_text_equal_vector(rows):
    df = rows([(1, "No heat, no HEAT"), (2, "no heat no heat"), (3, "loud party"), (4, "")], "id bigint, t string")
    got = {r["id"]: r["vector"] for r in hashed_vectors(df, "id", "t", 16).collect()}
    assert got[1] == got[2] != got[3] and 4 not in got
    assert sum(got[1]) == 4 and len(got[1]) == 16


def test_pair_distance(rows):
    df = rows([(1, "a b", "b a"), (2, "a b", "c d"), (3, "", "a"), (4, "a a b", "a")], "id bigint, text_a string, text_b string")
    got = {r["id"]: r["distance"] for r in pair_distances(df, "id").collect()}
    assert got[1] == 0 and got[2] == 1 and got[3] == 1
    assert got[4] == pytest.approx(1 - 2 / 5**0.5, abs=1e-8)


def test_masks_and_ends_are_looked_for_only_where_they_can_be(spark):
    """The guarded forms equal the plain patterns, also with other digits, spaces and line ends."""
    from pyspark.sql import functions as F

    from curbline.functions import redaction as R, text as X

    texts = ["", " ", "a@b.co x", "\u2028a@b.co \n", ": x: \n", "x :\r\n", "\u00a0x\u00a0", ":: \u0085", "x:\u2028", "x: \x1c", "call 212-555-1234\u2029",
             "\u0662\u0661\u0662 555 \u0661\u0662\u0663\u0664", "(212)5551234", "212\u00a05551234", "12 main st\n", None]
    df, plain = spark.createDataFrame([(t,) for t in texts], "t string"), F.col("t")
    for _, pattern, token in R.MASKS:
        plain = F.regexp_replace(plain, pattern, token)
    cut = F.regexp_replace(F.concat(F.lit(": "), F.coalesce("t", F.lit(""))), "^[: ]+|[: ]+$", "")
    for got, want in ((R.masked(F.col("t")), plain), (X.strip(F.col("t")), F.regexp_replace("t", r"(?U)^\s+|\s+$", "")),
                      (X.ticket_text(F.lit(None), F.col("t")), F.regexp_replace(cut, r"(?U)^\s+|\s+$", ""))):
        assert df.filter(~got.eqNullSafe(want)).count() == 0
    kept = df.select(R.masked(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "contains" in kept.lower()
