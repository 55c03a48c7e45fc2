"""Fields of texts whose values stand behind, below or above their labels, or without one."""

import pytest
from __spark_entry__ import queries
from cardloom.operators import extract
from pyspark.sql import functions as F

CARDS = [
    ("""AARON, Benjamin L.
ESTATE
c/o Mrs. Helen Reaves - Mother
Owner
Ph# (404) 784-2878
5566 Marbut Road Lithonia, GA.
Relation:
Date of death
dob 6/27/1966
December 8, 2004
Date of burial
December 14, 2004
Description:
LOT# 316 Range B Grave# 2
Section 4 Block 5 Northside
Sex M
Age
38
Type of Grave
SVC Vault
Grave Fee $675.00
Undertaker Haugabrooks
""", {"deceased_name": "AARON, Benjamin L", "address": "5566 Marbut Road Lithonia, GA.", "owner": None, "relation": None, "phone": "(404) 784-2878", "date_of_death": "2004-12-08", "date_of_burial": "2004-12-14",
      "description": "LOT# 316 Range B Grave# 2 Section 4 Block 5 Northside", "sex": "M", "age": "38", "grave_type": "SVC Vault", "grave_fee": "675.00", "undertaker": "Haugabrooks", "board_of_health_no": None, "svc_no": None}),
    ("DOE, Jane 5 Elm Street\nESTATE\nDate of Death December 8, 2004\nDate of Burial December 14, 2004\ndeb 6/27/1956\n", {"date_of_death": "2004-12-08", "date_of_burial": "2004-12-14"}),
    ("AARON, B.\nESTATE\n5566 Marsh Rd.\nLitchfield, GA.\nDecember 8, 2004\nDecember 14, 2004\ndob 12/27/1966\n", {"date_of_death": "2004-12-08", "date_of_burial": "2004-12-14", "address": "5566 Marsh Rd."}),
    ("AARON, B.\nDecember 14, 2004\nDecember 14, 2004\ndob 12/27/1966\n", {"date_of_death": None, "date_of_burial": "2004-12-14"}),
    ("""ADAMS, James
Owner
Relation:
Date of death
Date of burial
3-20-41
Description: Lot #64- Range G- Grave 9- Section 2- Block 2 SS
Sex M. Age 54 Type of Grave
Undertaker
Cox
Board of Health No.
8047A
Grave Fee
125.00
SVC No.
8047
""", {"deceased_name": "ADAMS, James", "date_of_death": None, "date_of_burial": "1941-03-20", "description": "Lot #64- Range G- Grave 9- Section 2- Block 2 SS", "sex": "M", "age": "54", "grave_type": None, "undertaker": "Cox", "board_of_health_no": "8047A", "grave_fee": "125.00", "svc_no": "8047"}),
    ("AARON, B.\nType of Grave SVC Vault\nGrave Fee $75.00\n49,711\nPACKAGE\n", {"svc_no": "49,711", "grave_fee": "75.00", "grave_type": "SVC Vault"}),
    ("AARON, B.\nDate of burial: December 14, 2004\nDate of death: December 8, 2004\nDirection:\nSection 4 Block 5 Northside\nLOT #316 Range B Grave # 2\n", {"description": "Section 4 Block 5 Northside LOT #316 Range B Grave # 2", "date_of_death": "2004-12-08", "date_of_burial": "2004-12-14"}),
    ("ADAMS, James\nDate of death Date of burial 3-20-41\n", {"date_of_death": None, "date_of_burial": "1941-03-20"}),
    ("DOE, Jane\nDate of Death Date of Burial March 6, 1956\n", {"date_of_death": None, "date_of_burial": "1956-03-06"}),
    ("DOE, Jane\nDate of Death Date of Burial October 30, 2021\nOctober 16, 2021\n", {"date_of_death": "2021-10-16", "date_of_burial": "2021-10-30"}),
    ("ADAMS, James\nBoard of Health No.\nCox\nUndertaker\nGrave Fee\nSex\nM\nAge\n54\nType of Grave\nDescription: Lot #64- Range G\n", {"undertaker": "Cox", "board_of_health_no": None, "grave_fee": None, "grave_type": None, "sex": "M", "age": "54", "description": "Lot #64- Range G"}),
    ("", {"deceased_name": None, "date_of_death": None, "date_of_burial": None, "description": None}),
]


@pytest.fixture(scope="module")
def read(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CARDS)] + [(99, None)], "k int, t string")
    return {r["k"]: r["f"] for r in df.select("k", extract.all_fields(F.col("t"), 2026).alias("f")).collect()}


@pytest.mark.parametrize("k", range(len(CARDS)))
def test_fields_of_texts(read, k):
    assert {f: read[k][f] for f in CARDS[k][1]} == CARDS[k][1]


def test_no_text_has_no_fields(read):
    assert all(v is None for v in read[99].asDict().values())


def test_minimal_fields(spark):
    texts = ["A, B\nDate of Death Date of Burial October 30,2021\nOctober 16, 2021", "A, B\nDate of Death 1/2/1950 Date of Burial 1/5/1950", "A, B\nDate of Burial 1/5/1950", "A, B\nMarch 3, 1950"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r[0]["date_of_death"] for r in df.orderBy("k").select(extract.minimal_fields(F.col("t"))).collect()]
    assert got == ["2021-10-30", "1950-01-02", None, "1950-03-03"]


def test_forms_state_both_dates_where_they_coincide(spark, tmp_path):
    """Parts of the form without labels whose two days are one, as tables of more than 20,000 parts have."""
    parts = spark.createDataFrame([(k, 7) for k in (2, 20000, 50000)], "p_partkey long, p_size int")
    parts.write.parquet(f"{tmp_path}/part.parquet")
    got = {r["id"]: (r["date_of_death"], r["date_of_burial"]) for r in queries()["extract_fields"](spark, str(tmp_path)).collect()}
    assert got == {2: ("1951-01-03", "1951-01-07"), 20000: ("1951-01-01",) * 2, 50000: ("1978-05-19",) * 2}
