"""Catalog of model artifacts: versions, checksums, replicas and cache.

A catalog row is one version: model_name, version, registered_at, seq,
checksum, size_bytes, encrypted. A location row is one copy: model_name,
version, provider, pos.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.chunks import Chunks, plan_chunks, prefix
from fleetgauge.functions.common import percent, same_keys, with_total

KEYS = ["model_name", "version"]
COPY = ["model_name", "version", "provider"]


def normal_name(name: str | Column) -> Column:
    """Model name in catalog form: blanks to underscores, lower case."""
    return F.lower(F.replace(F.col(name) if isinstance(name, str) else name, F.lit(" "), F.lit("_")))


def register_versions(catalog: DataFrame | None, new: DataFrame) -> DataFrame:
    """Catalog with the new rows; the last registration (`seq`) of a version wins.

    A missing version is named after the time of registration. An `overrides`
    MAP column may replace registered_at, checksum or size_bytes.
    """
    rows = new.withColumn("model_name", normal_name("model_name")).withColumn(
        "version",
        F.coalesce(F.col("version").cast("string"), F.concat(F.lit("v_"), F.unix_timestamp(F.col("registered_at").cast("timestamp")))),
    )
    if "overrides" in new.columns:
        for c in ("registered_at", "checksum", "size_bytes"):
            given = F.col("overrides")[c].cast(new.schema[c].dataType)
            rows = rows.withColumn(c, F.coalesce(given, F.col(c)))
        rows = rows.drop("overrides")
    if catalog is not None:
        rows = catalog.unionByName(rows)
    rest = [c for c in rows.columns if c not in KEYS]
    # One aggregate per column: those that nobody asks for are pruned, and their columns with them.
    return rows.groupBy(*KEYS).agg(*[F.max_by(c, "seq").alias(c) for c in rest])


def latest_version(catalog: DataFrame) -> DataFrame:
    """Newest version per model; of equal times the one registered first."""
    first = F.struct(F.col("registered_at"), -F.col("seq"))
    return catalog.groupBy("model_name").agg(
        F.max_by("version", first).alias("version"), F.max("registered_at").alias("registered_at")
    )


def list_versions(catalog: DataFrame, locations: DataFrame) -> DataFrame:
    """Versions with size and sorted providers (a set as small as the number of providers)."""
    where = locations.groupBy(*KEYS).agg(F.array_sort(F.collect_set("provider")).alias("providers"))
    return same_keys(catalog.select(*KEYS, "registered_at", "size_bytes"), where, KEYS)


def weights_info(catalog: DataFrame) -> DataFrame:
    """Every version beside the number of versions of its model."""
    n = catalog.groupBy("model_name").agg(F.count(F.lit(1)).alias("version_count"))
    return same_keys(catalog.select(*KEYS, "size_bytes"), n, ["model_name"])


def verify_integrity(locations: DataFrame, catalog: DataFrame, actual: DataFrame) -> DataFrame:
    """Whether each registered copy has the registered checksum; a missing copy does not.

    actual: model_name, version, provider, actual_checksum.
    """
    expected = same_keys(locations.select(*COPY), catalog.select(*KEYS, "checksum"), KEYS)
    found = same_keys(expected, actual.select(*COPY, "actual_checksum"), COPY)
    ok = F.coalesce(F.col("checksum") == F.col("actual_checksum"), F.lit(False))
    return found.select(*COPY, ok.alias("verified"))


def pick_replica(locations: DataFrame, catalog: DataFrame, actual: DataFrame) -> DataFrame:
    """First location of each version, in order, whose content matches; null provider when none does."""
    checked = same_keys(locations.select(*COPY, "pos"), verify_integrity(locations, catalog, actual), COPY)
    return checked.groupBy(*KEYS).agg(
        F.min(F.when(F.col("verified"), F.struct("pos", "provider"))).alias("__best")
    ).select(*KEYS, F.col("__best.provider").alias("provider"), F.col("__best").isNull().alias("failed"))


def missing_replicas(catalog: DataFrame, locations: DataFrame, targets: list[str]) -> DataFrame:
    """Copies that the configured targets should have and do not."""
    wanted = catalog.select(*KEYS, F.explode(F.array(*[F.lit(t) for t in targets])).alias("provider"))
    return wanted.join(locations, COPY, "left_anti")


def replication_diff(locations: DataFrame, source: str, destination: str) -> DataFrame:
    """What a sync with deletion would do: copy to, or delete from, the destination."""
    side = {p: locations.where(F.col("provider") == p).select(*KEYS).distinct() for p in (source, destination)}
    copy = side[source].join(side[destination], KEYS, "left_anti").withColumn("action", F.lit("copy"))
    return copy.unionByName(side[destination].join(side[source], KEYS, "left_anti").withColumn("action", F.lit("delete")))


def delete_versions(catalog: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Catalog without the requested versions, and the requests with whether they matched.

    requests: model_name, version (null for all versions of the model).
    """
    wanted = requests.withColumn("model_name", normal_name("model_name"))
    whole = wanted.where(F.col("version").isNull()).select("model_name").distinct()
    single = wanted.where(F.col("version").isNotNull()).select(*KEYS).distinct()
    left = catalog.join(whole, "model_name", "left_anti").join(single, KEYS, "left_anti").select(*catalog.columns)
    models = catalog.select("model_name").distinct().withColumn("__model", F.lit(True))
    versions = catalog.select(*KEYS).distinct().withColumn("__version", F.lit(True))
    seen = same_keys(same_keys(wanted, models, ["model_name"]), versions, KEYS)
    found = F.when(F.col("version").isNull(), F.col("__model")).otherwise(F.col("__version"))
    return left, seen.withColumn("found", F.coalesce(found, F.lit(False))).drop("__model", "__version")


def cache_eviction(files: DataFrame, order: list[str], size: str, max_bytes: int, chunks: Chunks | None = None) -> DataFrame:
    """Files to drop, least recently used first, once the total is over the maximum, until 80 % are left."""
    chunks = chunks or plan_chunks(files, order[0])
    total = files.agg(F.sum(size).alias("__total"))
    summed = prefix(files, [], order, chunks, {"__before": ("sum", F.col(size))}, exclusive=True)
    goes = (F.col("__total") > max_bytes) & (F.col("__total") - F.col("__before") > F.lit(max_bytes * 0.8))
    return with_total(summed, total).where(goes).select(*files.columns)


def storage_status(df: DataFrame, price_per_gb: dict[str, float]) -> DataFrame:
    """Models, versions, size, cost and share per provider, with a total row."""
    price = F.lit(0.0)
    for p, amount in price_per_gb.items():
        price = F.when(F.col("provider") == p, amount).otherwise(price)
    sized = df.withColumn("__cost", F.col("size_bytes") / F.lit(1e9) * price)
    out = sized.rollup("provider").agg(
        F.grouping_id().cast("bigint").alias("level"), F.count_distinct("model_name").alias("models"),
        F.count_distinct(F.struct(*KEYS)).alias("versions"), F.sum("size_bytes").alias("size_bytes"), F.sum("__cost").alias("cost"),
    )
    return with_total(out, df.agg(F.sum("size_bytes").alias("__all"))).select(
        "provider", "level", "models", "versions", "size_bytes", "cost", percent("size_bytes", "__all").alias("share_pct")
    )


def compare_versions(listed: DataFrame, pairs: DataFrame) -> DataFrame:
    """Size difference, days apart and provider sets of two versions.

    listed: rows of `list_versions`; pairs: model_name, version_a, version_b.
    """
    a = listed.select("model_name", *[F.col(c).alias(f"{c}_a") for c in ("version", "registered_at", "size_bytes", "providers")])
    b = listed.select("model_name", *[F.col(c).alias(f"{c}_b") for c in ("version", "registered_at", "size_bytes", "providers")])
    both = pairs.join(a, ["model_name", "version_a"]).join(b, ["model_name", "version_b"])

    def text(c: Column) -> Column:
        return F.array_join(F.array_sort(c), ",")

    return both.select(
        "model_name", "version_a", "version_b", (F.col("size_bytes_b") - F.col("size_bytes_a")).alias("size_change"),
        F.abs(F.datediff("registered_at_b", "registered_at_a")).alias("days_apart"),
        text(F.array_intersect("providers_a", "providers_b")).alias("in_both"),
        text(F.array_except("providers_a", "providers_b")).alias("only_in_a"),
        text(F.array_except("providers_b", "providers_a")).alias("only_in_b"),
    )


def exists_by_prefix(prefixes: DataFrame, objects: DataFrame, prefix_col: str = "prefix", name: str = "name") -> DataFrame:
    """Whether any object name starts with each prefix.

    Names are cut to the lengths that occur among the prefixes and matched by
    equality, so no name is compared with every prefix.
    """
    lengths = prefixes.agg(F.collect_set(F.length(prefix_col)).alias("__lengths"))
    heads = with_total(objects.select(name), lengths).select(F.col(name), F.explode("__lengths").alias("__n")).where(
        F.length(name) >= F.col("__n")
    ).select(F.expr(f"substring(`{name}`, 1, __n)").alias(prefix_col))
    # The few prefixes select the heads before those are made distinct.
    marked = heads.join(prefixes.select(prefix_col).distinct(), prefix_col, "left_semi").distinct()
    marked = marked.withColumn("__hit", F.lit(True))
    return same_keys(prefixes, marked, [prefix_col]).withColumn("exists", F.coalesce("__hit", F.lit(False))).drop("__hit")
