import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    root = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", f"{root}/shared").config("spark.sql.warehouse.dir", f"{root}/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def image():
    """A 64 KiB image: boot stub to $C000, which stores into itself, calls $C010 and returns."""
    mem = bytearray(0x10000)
    mem[1] = 0x37
    mem[0x0801:0x080D] = bytes([0x0B, 0x08, 0x0A, 0x00, 0x9E, 0x20]) + b"49152" + b"\0"
    mem[0xC000:0xC007] = bytes([0x8D, 0x00, 0xC0, 0x20, 0x10, 0xC0, 0x60])
    mem[0xC010:0xC014] = bytes([0xEE, 0x20, 0xC0, 0x60])
    return bytes(mem)


@pytest.fixture
def rows(spark):
    """Rows of a frame as sorted tuples."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
