import pytest

from tapeworks.session import build


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    at = tmp_path_factory.mktemp("spark")
    session = build("tests", "local[4]", 4, **{
        "spark.ui.enabled": "false", "spark.driver.memory": "3g", "spark.sql.warehouse.dir": f"file://{at}/warehouse",
        "spark.checkpoint.dir": f"file://{at}/checkpoints", "spark.sql.streaming.numRecentProgressUpdates": "5", "spark.ui.showConsoleProgress": "false",
    })
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def tape(spark):
    from tapeworks.tape import generate

    return generate(spark, scale=0.25)


@pytest.fixture(scope="session")
def tape_dir(tape, tmp_path_factory):
    at = tmp_path_factory.mktemp("tape")
    tape.write(str(at))
    return str(at)


@pytest.fixture(scope="session")
def trades(spark, tape):
    rows = tape.trades.orderBy("arrival_ms", "trade_id").toPandas()
    return spark.createDataFrame(rows.reset_index(names="arrival_seq")).cache()


@pytest.fixture(scope="session")
def quotes(tape):
    return tape.quotes.cache()
