"""Named transforms, chains of them, and results kept under the hash of their parameters."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import functions as F

#: A bundle of relations by name; transforms take one and give one.
Relations = dict[str, Any]
Transform = Callable[..., Relations]

TRANSFORMS: dict[str, Transform] = {}


def register(name: str) -> Callable[[Transform], Transform]:
    """Makes a transform known by name; a later one of the same name takes its place."""

    def add(f: Transform) -> Transform:
        TRANSFORMS[name] = f
        return f

    return add


@register("Identity")
def identity(relations: Relations) -> Relations:
    return relations


@register("KeepSelectedDataFields")
def keep_fields(relations: Relations, base_fields: list[str], preserved_fields: list[str]) -> Relations:
    """Only the relations named; what isn't read is never computed."""
    return {k: v for k, v in relations.items() if k in {*base_fields, *preserved_fields}}


def plain(value: Any) -> Any:
    """The value as JSON can hold it; what it can't becomes null."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value if value is None or isinstance(value, (str, int, float, bool)) else None


def steps_of(config: dict | None) -> list[tuple[str, dict]]:
    """The chain a config stands for: one transform, or several by any names, perhaps under `liftings`; in order."""
    if not config:
        return []
    if set(config) == {"liftings"}:
        config = config["liftings"]
    many = [config] if "transform_name" in config else config.values()
    return [(c["transform_name"], {k: v for k, v in c.items() if k not in ("transform_name", "transform_type")}) for c in many]


def chain(config: dict | None) -> Callable[[Relations], Relations]:
    """One transform of a config's steps; ValueError for a name that isn't registered."""
    steps = steps_of(config)
    if unknown := [name for name, _ in steps if name not in TRANSFORMS]:
        raise ValueError(f"no such transform: {', '.join(unknown)}")

    def run(relations: Relations) -> Relations:
        for name, parameters in steps:
            relations = TRANSFORMS[name](relations, **parameters)
        return relations

    return run


def make_hash(value: Any) -> int:
    """A number below 2**32 - 1 from the SHA-1 of a value's text."""
    return int(hashlib.sha1(str(value).encode()).hexdigest(), 16) % ((1 << 32) - 1)


def content_key(relations: Relations) -> str:
    """A digest of all rows of the relations, in any order: sums of two hashes, and counts, one aggregate each."""
    parts = []
    for name in sorted(relations):
        df = relations[name]
        columns = [F.to_json(F.struct(c)) for c in sorted(df.columns)]
        sums = [F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)")) for seed in (1, 2)]
        parts.append((name, sorted(df.dtypes), *map(str, df.agg(F.count(F.lit(1)), *sums).first())))
    return hashlib.sha1(json.dumps(plain(parts)).encode()).hexdigest()[:16]


def cache_key(config: dict | None, content: str = "") -> str:
    """Names of the steps and a digest of their parameters and of the data: the folder of a chain's results."""
    steps = steps_of(config)
    digest = hashlib.sha1(json.dumps([content, plain([list(s) for s in steps])], sort_keys=True).encode()).hexdigest()
    return f"{'_'.join(name for name, _ in steps) or 'raw'}/{digest[:16]}"


def cached(spark, base: str, relations: Relations, config: dict | None) -> Relations:
    """The chain's results as Parquet below base, made where they are missing: for these relations, as other rows under the
    same base give another folder. Each relation is written whole before the list of relations, which holds the
    parameters too, so a folder without the list counts as missing; one with other parameters is an error."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = f"{base.rstrip('/')}/{cache_key(config, content_key(relations))}"
    manifest = json.dumps(plain([list(s) for s in steps_of(config)]), sort_keys=True)
    files = fs_path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(fs_path(f"{root}/_relations")):
        made = chain(config)(relations)
        for name, df in made.items():
            df.write.mode("overwrite").parquet(f"{root}/{name}")
        spark.createDataFrame([(n, manifest) for n in sorted(made)], "name string, parameters string").coalesce(1).write.mode("overwrite").parquet(f"{root}/_relations")
    listed = spark.read.parquet(f"{root}/_relations").collect()
    if any(r["parameters"] != manifest for r in listed):
        raise ValueError(f"{root} holds results of other parameters")
    names = [r["name"] for r in listed]
    return {n: spark.read.parquet(f"{root}/{n}") for n in names}
