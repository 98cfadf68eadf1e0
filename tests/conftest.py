import json
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from thingfleet.session import builder  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        builder("tests", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false"})
        .master("local[8]")
        .config("spark.driver.memory", "6g")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


V10 = "https://www.w3.org/2019/wot/td/v1"
V11 = "https://www.w3.org/2022/wot/td/v1.1"


def lamp(**more):
    td = {
        "@context": V11,
        "@type": "Thing",
        "title": "lamp",
        "security": ["nosec_sc"],
        "securityDefinitions": {"nosec_sc": {"scheme": "nosec"}},
        "properties": {
            "status": {
                "type": "string",
                "forms": [{"href": "https://x.example/status", "op": ["readProperty"]}],
            }
        },
    }
    td.update(more)
    return {k: v for k, v in td.items() if v is not ...}


def legacy():
    return {
        "@context": [V10, {"ex": "http://ex/"}],
        "id": "urn:dev:2",
        "td:title": "old",
        "hasSecurityConfiguration": "nosec_sc",
        "registration": {"id": "_:b0", "created": "2024-01-01T00:00:00Z"},
        "securityDefinitions": {
            "@none": {"scheme": "nosec", "x": 1},
            "basic_sc": {"td:scheme": "basic"},
        },
    }


def docs_df(spark, *docs):
    from pyspark.sql import functions as F

    rows = [(d.get("id"), json.dumps(d)) for d in docs]
    df = spark.createDataFrame(rows, "id string, body string")
    return df.withColumn("doc", F.parse_json("body"))
