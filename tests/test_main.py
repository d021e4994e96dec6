"""The jobs by command line, on tables written from the test data."""

from __future__ import annotations

import json

import pytest

from pyspark.errors import AnalysisException

from clickweave.__main__ import BATCH_JOBS, STATISTICS, main
from clickweave.plans import shared
from clickweave.sources import testdata

PARAMS = json.dumps({"startDate": "2024-01-01", "endDate": "2024-01-30", "startAge": 20, "endAge": 50,
                     "professionals": "", "targetPageFlow": "1,2,3"})


@pytest.fixture(scope="module")
def tables(spark, small_dir, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    for name in ("user_visit_action", "user_info", "product_info", "city_area"):
        getattr(testdata, name)(spark, small_dir).write.parquet(f"{root}/{name}")
    return root


@pytest.mark.parametrize("job", BATCH_JOBS)
def test_batch_job_appends_its_report(spark, tables, tmp_path, job):
    arguments = [job, "--params", PARAMS, "--task-id", "t9", "--total", "3000", "--output", str(tmp_path / "out"),
                 "--actions", f"{tables}/user_visit_action", "--users", f"{tables}/user_info",
                 "--products", f"{tables}/product_info", "--cities", f"{tables}/city_area"]
    main(arguments, spark)
    main(arguments, spark)
    if job == "session-reports":
        for single, name in (("session-stat", "session_stat"), ("session-sample", "session_random_extract")):
            main([single, *arguments[1:-10], "--output", str(tmp_path / single), *arguments[-8:]], spark)
            shared, alone = (spark.read.parquet(str(tmp_path / p)) for p in (f"out/{name}", single))
            assert sorted(map(str, shared.distinct().collect())) == sorted(map(str, alone.collect()))
        return
    report = spark.read.parquet(str(tmp_path / "out"))
    assert report.count() and {r[0] for r in report.select("taskid").distinct().collect()} == {"t9"}
    assert report.count() == 2 * report.distinct().count() or job == "session-detail"


def test_ad_stream_job(spark, small_dir, tmp_path):
    testdata.ad_line(spark, small_dir).select("value").write.text(str(tmp_path / "in"))
    main(["ad-stream", "--files", str(tmp_path / "in"), "--checkpoint", str(tmp_path / "check"),
          "--output", str(tmp_path / "out"), "--threshold", "7", "--available-now"], spark)
    assert spark.read.parquet(str(tmp_path / "out" / "ad_user_click_count")).agg({"clickCount": "sum"}).first()[0] == 1000


@pytest.mark.parametrize("job", STATISTICS)
def test_running_statistics_jobs(spark, small_dir, tmp_path, job):
    testdata.ad_line(spark, small_dir).select("value").write.text(str(tmp_path / "in"))
    main([job, "--files", str(tmp_path / "in"), "--checkpoint", str(tmp_path / "check"),
          "--output", str(tmp_path / "out"), "--available-now"], spark)
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0


def test_shared_folder_keeps_what_others_store_there(spark, tables, tmp_path):
    foreign = str(tmp_path / "shared" / "other")
    spark.range(3).write.parquet(foreign)
    main(["session-reports", "--params", PARAMS, "--task-id", "t1", "--output", str(tmp_path / "out"), "--shared-folder",
          str(tmp_path / "shared"), "--actions", f"{tables}/user_visit_action", "--users", f"{tables}/user_info"], spark)
    assert spark.read.parquet(foreign).count() == 3
    assert [p.name for p in (tmp_path / "shared").iterdir()] == ["other"]
    shared.shared_table(spark.range(2), "mine", str(tmp_path / "shared"))
    with pytest.raises(AnalysisException):
        shared.shared_table(spark.range(2), "mine", str(tmp_path / "shared"))
