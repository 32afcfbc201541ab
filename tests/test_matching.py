"""Two sources level by level."""

from tidewell.operators.matching import match_sources

OFFER = "id bigint, mpn string, model_name string, brand string, gpu_model string, vram_gb int, name string, condition string"


def test_levels(spark):
    left = [
        (1, "AB-1", "M 1", "B", "C", 8, "n", None), (2, None, "m-1", "B", "C", 8, "n", None), (3, None, "other", "asus", "RTX5080", 16, "x OC", None), (4, None, None, None, None, None, " Name ", None),
        (5, None, "M1", None, None, None, None, "used"), (6, None, None, "ASUS", "rtx 5080", 16, "plain", None), (7, None, None, None, None, None, None, None), (8, "--", " ", None, None, None, "", None),
    ]
    right = [
        (11, "ab 1", None, None, None, None, None, "new"), (12, None, "M1", None, None, None, None, None), (10, None, "M.1", None, None, None, None, "NEW"),
        (13, None, None, "ASUS", "RTX 5080", 16, "y OC", None), (14, None, None, None, None, None, "NAME", None), (15, None, None, None, None, None, "NAME OC", None), (16, None, "M1", None, None, None, None, "USED"),
    ]
    got = {r.left_id: (r.right_id, r.level, r.confidence, r.review) for r in match_sources(spark.createDataFrame(left, OFFER), spark.createDataFrame(right, OFFER)).collect()}
    assert got == {1: (11, 1, 1.0, False), 2: (10, 2, 0.95, False), 3: (13, 3, 0.8, False), 4: (14, 4, 0.5, True), 5: (16, 2, 0.95, False)}


def test_keys_that_many_rows_share_make_no_pairs(spark):
    many = spark.range(2000).selectExpr("id", "'AB1' AS mpn", "NULL AS model_name", "NULL AS brand", "NULL AS gpu_model", "CAST(NULL AS INT) AS vram_gb", "NULL AS name", "NULL AS condition")
    assert {r.right_id for r in match_sources(many, many).collect()} == {0} and match_sources(many.limit(0), many).isEmpty()
