"""Two tables in one save: readers see both or neither."""

import pytest

from stemforge.sources.versions import Conflict, Versions, restored_health, save_health, save_project


def frame(spark, *ids):
    return spark.createDataFrame([(i, f"v{i}") for i in ids], "id long, v string")


def ids(version, spark, name):
    return sorted(r["id"] for r in version.table(spark, name).collect())


@pytest.fixture
def store(spark, tmp_path):
    return Versions(spark, str(tmp_path / "store"))


def test_a_save_that_breaks_off_leaves_the_pair_before_it(spark, store):
    assert store.read() is None
    assert save_project(store, frame(spark, 1), frame(spark, 10, 11)).number == 1

    def breaks(name):
        if name == "records":
            raise OSError("lost")

    with pytest.raises(OSError):
        store.save({"projects": frame(spark, 1, 2), "records": frame(spark, 10, 11, 12)}, between=breaks)
    now = store.read()
    assert (now.number, ids(now, spark, "projects"), ids(now, spark, "records")) == (1, [1], [10, 11])
    save_project(store, frame(spark, 1, 2), frame(spark, 12))
    later = store.read()
    assert (later.number, ids(later, spark, "projects"), ids(later, spark, "records")) == (2, [1, 2], [12])
    # a reader that pinned the first version keeps it
    assert ids(now, spark, "records") == [10, 11] and ids(store.read(1), spark, "projects") == [1]


def test_a_save_in_the_meantime_is_a_conflict(spark, store):
    first = save_project(store, frame(spark, 1), frame(spark, 10))
    save_project(store, frame(spark, 2), frame(spark, 20), after=first.number)
    with pytest.raises(Conflict):
        save_project(store, frame(spark, 3), frame(spark, 30), after=first.number)
    taken = store.read()
    with pytest.raises(Conflict):
        store._commit(taken)  # the same number twice
    assert ids(store.read(), spark, "projects") == [2]


def test_tables_that_are_not_given_stay_and_vacuum_keeps_what_is_named(spark, store):
    save_project(store, frame(spark, 1), frame(spark, 10))
    store.save({"projects": frame(spark, 2)})
    store.save({"projects": frame(spark, 3)})
    assert ids(store.read(), spark, "records") == [10]
    removed = store.vacuum(keep=2)
    assert len(removed) == 1 and "projects" in removed[0] and store.numbers() == [2, 3]
    assert (ids(store.read(2), spark, "projects"), ids(store.read(3), spark, "projects"), ids(store.read(3), spark, "records")) == ([2], [3], [10])


def test_an_empty_table_keeps_its_schema(spark, store):
    save_project(store, frame(spark), frame(spark, 1))
    assert store.read().table(spark, "projects").dtypes == [("id", "bigint"), ("v", "string")] and ids(store.read(), spark, "projects") == []


def test_health_is_restored_for_keys_in_use(spark, store):
    rows = [("a", "cooldown", 5_000), ("b", "cooldown", 10_000_000), ("c", "healthy", 0), ("d", "authBlocked", 2**62), ("gone", "cooldown", 10_000_000)]
    assert restored_health(store, spark.createDataFrame([("a",)], "key string"), 0).count() == 0
    save_health(store, spark.createDataFrame(rows, "key string, status string, blocked_until long"))
    keys = spark.createDataFrame([(k,) for k in "abcd"], "key string")
    got = {r["key"]: (r["status"], r["blocked_until"]) for r in restored_health(store, keys, now=6_000).collect()}
    assert got == {"a": ("healthy", 0), "b": ("cooldown", 10_000_000), "c": ("healthy", 0), "d": ("authBlocked", 2**62)}
    assert set(r["key"] for r in restored_health(store, keys, now=6_000_000).collect()) == {"b", "d"}
