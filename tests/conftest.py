import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from groundtrace.session import local_session

    session = local_session("4", 4, "4g", str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def events(spark):
    """Process events derived from the smallest tables, kept for all tests."""
    from groundtrace.catalog.binding import process_events

    return process_events(spark, SF).persist()


@pytest.fixture(scope="session")
def make_events(spark):
    """Sanitised events from dictionaries; missing fields are null."""
    from pyspark.sql import types as T

    from groundtrace import schema

    def make(rows, **extra):
        fields = T.StructType(
            [T.StructField("event_key", T.LongType())] + list(schema.sanitized_schema())
            + [T.StructField(n, T._parse_datatype_string(k)) for n, k in extra.items()])
        data = [tuple(r.get(f.name, i if f.name == "event_key" else None) for f in fields)
                for i, r in enumerate(rows)]
        return spark.createDataFrame(data, fields)

    return make
