from pathlib import Path

from ledgerloom.session import durable, release


def test_durable_steps_are_released(spark):
    release(spark)
    df = durable(spark.range(10), "step")
    folder = Path(df.inputFiles()[0].removeprefix("file://")).parent
    assert df.count() == 10 and folder.exists()
    assert release(spark) == 1 and not folder.exists() and release(spark) == 0
