import pytest

from cellspark.functions import registry


def test_chains_and_keys():
    keep = {"transform_name": "KeepSelectedDataFields", "base_fields": ["x"], "preserved_fields": ["y"]}
    same = {"transform_name": "Identity"}
    assert registry.chain(keep)({"x": 1, "y": 2, "z": 3}) == {"x": 1, "y": 2}
    assert registry.chain({"liftings": {"a": same, "b": keep}})({"x": 1, "z": 3}) == {"x": 1}
    assert registry.chain(None)({"z": 3}) == {"z": 3}
    assert registry.cache_key(keep) == registry.cache_key(dict(reversed(keep.items()))) != registry.cache_key({**keep, "base_fields": []})
    with pytest.raises(ValueError, match="no such transform: Nothing"):
        registry.chain({"transform_name": "Nothing"})


def test_own_transforms():
    registry.register("Twice")(lambda relations, key: {**relations, key: 2 * relations[key]})
    assert registry.chain({"transform_name": "Twice", "key": "n"})({"n": 4}) == {"n": 8}


def test_unknown_objects_count_as_null():
    assert registry.plain({"a": (1, object()), 2: None}) == {"a": [1, None], "2": None}


def test_cached(spark, tmp_path):
    calls = []
    registry.register("Count")(lambda relations: calls.append(1) or {"n": relations["n"].where("id > 2")})
    for _ in range(2):
        got = registry.cached(spark, str(tmp_path), {"n": spark.range(5)}, {"transform_name": "Count"})
        assert sorted(r["id"] for r in got["n"].collect()) == [3, 4]
    assert calls == [1]
