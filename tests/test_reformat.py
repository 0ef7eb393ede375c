import pytest
from pyspark.sql import functions as F

from textshield.operators import reformat, subjects

CASES = [
    ("Hubungi 081200000123 segera.", "id", "Hubungi (+62) 812 0000 0123 segera."),
    ("Call +6281200000123", "en", "Call (+62) 812 0000 0123"),
    ("Kantor 0217698277", "id", "Kantor (021) 769 82 77"),
    ("6281365202009", "en", "(+62) 813 6520 2009"),
    ("(+62) 813 6520 2009", "en", "(+62) 813 6520 2009"),
    ("193.195.198.107 on 27-04-2025", "en", "193.195.198.107 on 27 April 2025"),
    ("May 5, 2024", "id", "05 Mei 2024"),
    ("31 February 2020", "id", "[PLEASE REVIEW] Februari 2020"),
    ("2022 January", "en", "January 2022"),
    ("15 août 2024", "fr", "15 Août 2024"),
    ("from 28 May 2015 until 27 May 2014", "en", "from 27 May 2014 until 28 May 2015"),
    ("from March 2022 to January 2020", "en", "from January 2020 to March 2022"),
    ("mr. budi dan ibu kota, ibu nina", "id", "Mr. budi dan ibu kota, Ibu nina"),
    ("", "en", ""),
    (None, "en", None),
]


def test_reformat(spark):
    df = spark.createDataFrame([(i, t, loc) for i, (t, loc, _) in enumerate(CASES)], "i int, text string, locale string")
    rows = reformat.reformat_documents(df).orderBy("i").collect()
    assert [r["final"] for r in rows] == [c[2] for c in CASES]
    assert rows[0]["changes"][0]["via"] == "regex-mobile" and rows[4]["changed_count"] == 0


@pytest.mark.parametrize(
    "text,want",
    [
        ("Ibu Nina menyatakan sesuatu. Ibu Nina menambahkan hal lain. menyampaikan kabar.", "Ibu Nina menyatakan sesuatu. Beliau menambahkan hal lain. Beliau menyampaikan kabar."),
        ("Rizal menyatakan ini. mengatakan lainnya.", "Rizal menyatakan ini. Ia mengatakan lainnya."),
        ("Ibu Nina hadir. Bapak Andi pergi.", "Ibu Nina hadir. Bapak Andi pergi."),
    ],
)
def test_subjects(spark, text, want):
    df = spark.createDataFrame([(text, "id", "reference_check"), (text, "en", "reference-check")], "text string, locale string, type_of_check string")
    got = [r["text"] for r in subjects.continue_documents(df).collect()]
    assert got == [want, text]


def test_dominant_name(spark):
    df = spark.createDataFrame([("Rizal Rizal",), ("Rizal Anna",), ("Ibu Bapak",)], "p string")
    assert [r[0] for r in df.select(subjects.dominant_name(F.col("p"))).collect()] == ["Rizal", None, None]
