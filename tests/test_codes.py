"""The query of error codes looks up every code that has a name, and numbers that have none."""

from meshframe.plans import catalog
from meshframe.sources import errors


def test_every_name_is_found(spark, sf):
    found = {r["name"]: r["n"] for r in catalog.QUERIES["error_code_lookup"](spark, sf).collect()}
    assert set(found) == {name for _, name in errors.codes()} | {"???"}
    assert sum(found.values()) == 2 * spark.read.parquet(f"{sf}/orders.parquet").count()
