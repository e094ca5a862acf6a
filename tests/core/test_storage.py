"""Intermediate tables: what is kept and what is deleted."""

import os

from oriel import storage


def there(df):
    return [os.path.exists(x.removeprefix("file://")) for x in df.inputFiles()]


def test_scratch_deletes_all_but_what_is_kept(spark):
    df = spark.range(10)
    with storage.scratch(spark) as keep:
        first = storage.materialise(df, "first")
        with storage.scratch(spark) as inner:
            gone = storage.materialise(first.where("id > 2"), "gone")
            second = inner(storage.materialise(gone.where("id > 3"), "second"))
        assert not any(there(gone)) and all(there(second))
        third = keep(storage.materialise(second.where("id > 4"), "third"))
    assert third.count() == 5
    assert not any(there(first) + there(second)) and all(there(third))
    storage.release(third)
    assert not any(there(third))
