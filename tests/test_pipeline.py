from dataclasses import replace

from pyspark.sql import functions as F

from conftest import SMALL
from tenurekit import queries
from tenurekit.columns import SINCE
from tenurekit.plans import pipeline
from tenurekit.sources.tables import load_table
from tenurekit.sources.roles import ROLE_STUDY, users


def test_whole_study_from_files(spark, tmp_path):
    user_file = str(tmp_path / "user")
    key = F.col("user_id")
    users(spark, SMALL).select(
        key.cast("string").alias("user_id"), SINCE,
        *(c for c in users(spark, SMALL).columns if c.startswith("compliment")),
        F.concat_ws(", ", key + 1, key + 2).alias("friends"),
        F.when(key % 3 == 0, "2015,2016").alias("elite"),
    ).write.json(user_file)
    paths = {
        "business": queries._business_file(spark, SMALL),
        "user": user_file,
        "review": queries._review_file(spark, SMALL),
        "tip": queries._tip_file(spark, SMALL),
    }
    study = replace(ROLE_STUDY, n_folds=3, n_lambdas=6, min_tenure_years=0.5)
    reports = pipeline.run(spark, paths, str(tmp_path / "out"), study)
    assert reports["full_cv"].count() == 6
    assert reports["leakage_sensitivity"].count() == 16
    assert 0 <= reports["full_concordance"].first().c_index <= 1
    assert reports["leakage_flags"].filter("note IS NOT NULL").first().variable == "tenure_years"
    kept = load_table(spark, str(tmp_path / "out" / "engineered"))
    assert kept.count() == reports["dataset_summary"].first().n_users > 50
    assert reports["ph_test"].filter("term = 'GLOBAL'").count() == 1
