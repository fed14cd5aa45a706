"""Parser manifests: records, versions, maintainers, release notes; as columns."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Development states by rank, and the features of a parser.
STATUS_RANK = {"inactive": 0, "planning": 1, "pre-alpha": 2, "alpha": 3, "beta": 4, "stable": 5, "mature": 6}
FEATURES = ("ast", "uast", "roles")
CURRENT_MAJOR = 3
_MAINTAINER = r"^([^<(]+)\s<([^>]+)>(\s\(@([^\s]+)\))?"


def rank(status: Column) -> Column:
    """Number of a development state; unknown states are 0."""
    table = F.create_map(*(F.lit(x) for kv in STATUS_RANK.items() for x in kv))
    return F.coalesce(F.try_element_at(table, status), F.lit(0))


def supports(features: Column, feature: str) -> Column:
    return F.coalesce(F.array_contains(features, feature), F.lit(False))


def in_development(status: Column) -> Column:
    return rank(status) < STATUS_RANK["alpha"]


def major(version: Column) -> Column:
    """First number of a version; 0 for an empty one."""
    return F.when(F.coalesce(version, F.lit("")) == "", 0).otherwise(F.split_part(version, F.lit("."), F.lit(1)).cast("int"))


def for_current(version: Column, current: int = CURRENT_MAJOR) -> Column:
    return major(version) == current


def is_recommended(status: Column, version: Column, current: int = CURRENT_MAJOR) -> Column:
    return for_current(version, current) & (rank(status) >= STATUS_RANK["beta"])


def contains_topics(topics: Column, required: Iterable[str]) -> Column:
    """Whether all required tags are there."""
    need = sorted(set(required))
    return F.size(F.array_intersect(F.array(*(F.lit(t) for t in need)).cast("array<string>"), topics)) == len(need)


def order(drivers: DataFrame) -> DataFrame:
    """By state, best first; then most features; then language."""
    return drivers.orderBy(rank(F.col("status")).desc(), F.size("features").desc(), F.col("language").asc())


def maintainers(texts: DataFrame, column: str = "text") -> DataFrame:
    """One row per line of the form ``Name <mail> (@handle)``; other lines are left out."""
    lines = texts.select("*", F.explode(F.split(column, r"\r?\n")).alias("_line")).withColumn("_line", F.trim("_line")).where(F.col("_line").rlike(_MAINTAINER))
    part = lambda i: F.regexp_extract("_line", _MAINTAINER, i)
    return lines.select(*(c for c in texts.columns if c != column), part(1).alias("name"), part(2).alias("email"), part(4).alias("handle"))


def profile_url(handle: Column) -> Column:
    return F.when(F.coalesce(handle, F.lit("")) != "", F.concat(F.lit("https://github.com/"), handle)).otherwise("")


def contact_url(handle: Column, email: Column) -> Column:
    """The profile, else a mail link, else nothing."""
    mail = F.when(F.coalesce(email, F.lit("")) != "", F.concat(F.lit("mailto:"), email)).otherwise("")
    return F.when(profile_url(handle) != "", profile_url(handle)).otherwise(mail)


_VERSION = r"^v(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-([0-9A-Za-z.\-]+))?(?:\+[0-9A-Za-z.\-]+)?$"


def version_key(tag: Column) -> Column:
    """Sort key of a tag ``vX.Y.Z[-pre]``; null for other tags.  A pre-release comes before its
    release; its parts compare as numbers where both are, numbers before words."""
    part = lambda i: F.regexp_extract(tag, _VERSION, i)
    pre = F.transform(
        F.filter(F.split(part(4), r"\."), lambda p: p != ""),
        lambda p: F.struct((~p.rlike(r"^\d+$")).alias("word"), F.when(p.rlike(r"^\d+$"), p.try_cast("bigint")).otherwise(F.lit(0).cast("bigint")).alias("number"), p.alias("text")),
    )
    return F.when(tag.rlike(_VERSION), F.struct(*(part(i).try_cast("bigint").alias(f"v{i}") for i in (1, 2, 3)), (F.size(pre) == 0).alias("release"), pre.alias("pre")))


def versions(tags: DataFrame, by: list[str], tag: str = "tag") -> DataFrame:
    """(by..., versions): version tags without the v, latest first."""
    own = tags.select(*by, version_key(F.col(tag)).alias("k"), F.substring(tag, 2, 1000).alias("v")).where("k is not null")
    return own.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v")), asc=False), lambda x: x["v"]).alias("versions"))


def latest_version(tags: DataFrame, by: list[str], tag: str = "tag") -> DataFrame:
    """(by..., latest): the greatest version tag, without the v."""
    own = tags.select(*by, version_key(F.col(tag)).alias("k"), F.substring(tag, 2, 1000).alias("v")).where("k is not null")
    return own.groupBy(*by).agg(F.max_by("v", "k").alias("latest"))


def sdk_version(text: Column, module: str) -> Column:
    """The greatest version, as text, that a dependency file names for a module."""
    found = F.regexp_extract_all(text, F.lit(re.escape(module) + r"\S*\s+v?([0-9][^\s\"]*)"), 1)
    return F.array_max(found)


def image_version(image: Column) -> Column:
    """Version in an image name: after the last colon, before the last dash."""
    label = F.when(F.instr(image, ":") > 1, F.substring_index(image, ":", -1)).otherwise(image)
    return F.when(label.rlike("^.+-"), F.regexp_replace(label, r"-[^-]*$", "")).otherwise(label)


def runtime_versions(build_image: Column, gopath: Column, native_image: Column, runtime: Column) -> Column:
    """struct(native, go): the build image decides, then the runtime where the parser is part of it, then its own image."""
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    native = F.when(given(build_image), image_version(build_image)).when(given(gopath), image_version(runtime)).when(given(native_image), image_version(native_image)).otherwise("")
    return F.struct(native.alias("native"), F.when(given(runtime), image_version(runtime)).otherwise("").alias("go"))


def release_note(message: Column) -> Column:
    """Commit text as bullets, without empty and sign-off lines."""
    lines = F.filter(F.transform(F.split(message, "\n"), lambda s: F.trim(s)), lambda s: (s != "") & ~s.startswith("Signed-off-by:"))
    return F.array_join(F.transform(lines, lambda s: F.concat(F.lit("* "), s)), "\n")


def decode(text: str) -> dict[str, Any]:
    """A manifest from TOML, with lists and states filled in."""
    import tomllib

    raw = tomllib.loads(text)
    return {"name": "", "language": "", "aliases": [], "version": "", "status": "", "features": [], "documentation": {}} | raw


def encode(m: dict[str, Any]) -> str:
    """TOML of a manifest; empty optional fields are left out."""
    import json

    lines = []
    for k in ("name", "language", "aliases", "version", "build", "status", "features"):
        v = m.get(k)
        if v is None or (k in ("version", "build") and not v):
            continue
        lines.append(f"{k} = {v.isoformat() if hasattr(v, 'isoformat') else json.dumps(v, ensure_ascii=False)}")
    if doc := {k: v for k, v in (m.get("documentation") or {}).items() if v}:
        lines += ["", "[documentation]", *(f"{k} = {json.dumps(v, ensure_ascii=False)}" for k, v in doc.items())]
    return "\n".join(lines) + "\n"


def to_message(m: DataFrame) -> DataFrame:
    """Manifest rows as protocol records: states as enum names, features in upper case."""
    return m.withColumns({"status": F.upper(F.translate("status", "-", "_")), "features": F.transform("features", F.upper)})


def from_message(m: DataFrame) -> DataFrame:
    return m.withColumns({"status": F.lower(F.translate("status", "_", "-")), "features": F.transform("features", F.lower)})


_FIELDS = "name string, language string, aliases array<string>, version string, status string, features array<string>"


def to_toml(m: DataFrame) -> DataFrame:
    """Manifest rows as TOML texts: (toml)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([encode({k: v for k, v in r.items() if v is not None}) for r in b.to_pylist()], pa.string())], ["toml"])

    return m.mapInArrow(run, "toml string")


def from_toml(texts: DataFrame, column: str = "toml") -> DataFrame:
    """Manifest rows of TOML texts, with ``error`` instead where one can't be read."""
    names = [f.split()[0] for f in _FIELDS.split(", ")]
    kinds = pa.schema([(n, pa.list_(pa.string()) if n in ("aliases", "features") else pa.string()) for n in names] + [("error", pa.string())])

    def read(text: str) -> dict:
        try:
            return {k: v for k, v in decode(text).items() if k in names}
        except Exception as e:  # noqa: BLE001 - no manifest may end the job of all others
            return {"error": f"{type(e).__name__}: {e}"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pylist([read(t) for t in b.column(0).to_pylist()], kinds)

    return texts.select(column).mapInArrow(run, f"{_FIELDS}, error string")
