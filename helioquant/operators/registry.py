"""Asset and channel tables: building, set-based changes, integrity."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "block"
INVERTER = "inverter"
STATION = "weather_station"

# Name forms of the asset types.
NAME_FORMATS = {BLOCK: "Block-%02d", INVERTER: "INV-%02d", STATION: "WS-%02d"}


def natural_id(*parts: Column | str) -> Column:
    """An id that the natural key determines, so that a second run writes the same ids."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.sha2(F.concat_ws("|", *[c.cast("string") for c in columns]), 256)


def device_names(
    devices: DataFrame,
    plant: str = "plant_id",
    source_key: str = "source_key",
    kind: str = "asset_type",
) -> DataFrame:
    """Number the devices of a plant and type by source key and name them.

    One row per device (repeats collapse first), so a window holds a plant's devices, never its
    readings.
    """
    order = Window.partitionBy(plant, kind).orderBy(source_key)
    numbered = devices.dropDuplicates([plant, kind, source_key]).withColumn(
        "device_index", F.row_number().over(order)
    )
    name = reduce(
        lambda acc, item: acc.when(
            F.col(kind) == item[0], F.format_string(item[1], F.col("device_index"))
        ),
        list(NAME_FORMATS.items())[1:],
        F.when(
            F.col(kind) == BLOCK, F.format_string(NAME_FORMATS[BLOCK], F.col("device_index"))
        ),
    )
    return numbered.withColumn("name", name)


def build_assets(
    devices: DataFrame, plant: str = "plant_id", attributes: Sequence[str] = ()
) -> DataFrame:
    """The tree plant -> synthetic block -> inverters and stations, as one adjacency table.

    ``devices`` has the plant, ``source_key``, ``asset_type``, ``rated_dc_kwp`` and
    ``rated_ac_kw`` (null for stations). Ratings are stored in watts as well, which is the name
    bound rules use. Ids follow from plant, type and source key, so a device that is added later
    changes no other id, though it may change names, which count devices in the order of their keys.
    """
    block_name = F.lit(NAME_FORMATS[BLOCK] % 1)
    block_id = natural_id(plant, F.lit(BLOCK), block_name)
    leaves = device_names(devices, plant).select(
        natural_id(plant, "asset_type", "source_key").alias("id"),
        F.col(plant).alias("plant_id"),
        block_id.alias("parent_id"),
        "name",
        "asset_type",
        "source_key",
        F.col("device_index").cast("int").alias("device_index"),
        (F.col("rated_dc_kwp") * F.lit(1000.0)).alias("rated_dc_w"),
        (F.col("rated_ac_kw") * F.lit(1000.0)).alias("rated_ac_w"),
        (F.col("asset_type") == STATION).alias("approx_ghi"),
        (F.col("asset_type") == STATION).alias("poa_assumed"),
        *attributes,
    )
    blocks = (
        devices.select(plant)
        .distinct()
        .select(
            block_id.alias("id"),
            F.col(plant).alias("plant_id"),
            F.lit(None).cast("string").alias("parent_id"),
            block_name.alias("name"),
            F.lit(BLOCK).alias("asset_type"),
        )
    )
    return leaves.unionByName(blocks, allowMissingColumns=True)


def build_channels(assets: DataFrame, templates: DataFrame) -> DataFrame:
    """Each asset times the channel templates of its type."""
    joined = assets.select("id", "plant_id", "source_key", "asset_type").join(
        templates, "asset_type"
    )
    return joined.select(
        natural_id("id", "signal_key").alias("id"),
        F.col("id").alias("asset_id"),
        "plant_id",
        F.col("source_key").alias("device"),
        *[c for c in templates.columns if c != "asset_type"],
    )


def map_devices(
    df: DataFrame, assets: DataFrame, device: str = "device", plant: str | None = None
) -> DataFrame:
    """Attach asset name, plant and parent to readings; unknown devices keep nulls.

    ``plant`` names the readings' plant column; without it source keys must be unique over plants.
    """
    names = assets.where(F.col("source_key").isNotNull()).select(
        F.col("source_key").alias(device),
        F.col("id").alias("asset_id"),
        F.col("name").alias("asset_name"),
        F.col("plant_id").alias("asset_plant_id"),
        F.col("parent_id").alias("asset_parent_id"),
    )
    if plant is None:
        return df.join(names, device, "left")
    own = df.join(names.withColumn(plant, F.col("asset_plant_id")), [plant, device], "left")
    return own.select(*df.columns, *[c for c in names.columns if c != device])


def map_plants(
    df: DataFrame, plant_ids: DataFrame, raw: str = "plant_id", out: str = "plant"
) -> DataFrame:
    """Attach the plant that a feed's own plant id stands for; ids that the map lacks keep null.

    ``plant_ids``: raw_plant_id, plant. Ids are compared as trimmed text, so that a feed may write
    them as numbers. Of several plants of one id the first by name counts; :func:`repeated_keys`
    reports them. A column ``out`` that is there already is replaced.
    """
    names = plant_ids.groupBy(F.trim(F.col("raw_plant_id").cast("string")).alias("_raw")).agg(
        F.min("plant").alias("_plant")
    )
    kept = df.columns if out in df.columns else [*df.columns, out]
    joined = df.withColumn("_raw", F.trim(F.col(raw).cast("string"))).join(names, "_raw", "left")
    return joined.withColumn(out, F.col("_plant")).select(*kept)


def upsert(
    target: DataFrame,
    updates: DataFrame,
    keys: Sequence[str],
    created: str | None = None,
    updated: str | None = None,
    now: Column | None = None,
    latest: str | None = None,
) -> DataFrame:
    """Target rows replaced by updates of the same key, and updates of new keys added.

    Of several updates of one key the one with the largest ``latest`` (a column of updates) counts;
    without ``latest`` keys of updates must be unique, and every one of them is written.

    With ``created``/``updated`` column names, a replaced row keeps its creation time and takes
    ``now`` as its update time.
    """
    keys = list(keys)
    now = F.current_timestamp() if now is None else now
    updates = _newest(updates, keys, latest)
    fresh = updates
    if created:
        kept = target.select(*keys, F.col(created).alias("_created"))
        fresh = fresh.join(kept, keys, "left").withColumn(created, F.coalesce("_created", now))
        fresh = fresh.drop("_created")
    if updated:
        fresh = fresh.withColumn(updated, now)
    untouched = target.join(updates.select(*keys), keys, "left_anti")
    return untouched.unionByName(fresh.select(*target.columns))


def _newest(rows: DataFrame, keys: Sequence[str], latest: str | None) -> DataFrame:
    """Of rows with one key the one with the largest ``latest``, ties by all other columns."""
    if latest is None:
        return rows
    row = F.struct(F.col(latest), *[F.col(c) for c in rows.columns if c != latest])
    return rows.groupBy(*keys).agg(F.max(row).alias("_row")).select("_row.*").select(*rows.columns)


def insert_if_absent(
    target: DataFrame, rows: DataFrame, keys: Sequence[str], latest: str | None = None
) -> DataFrame:
    """Target plus the rows whose key it lacks; rows already there are left as they are.

    Of several rows with one key the one with the largest ``latest`` is added, or the largest by
    all columns in their order.
    """
    keys = list(keys)
    fresh = _newest(rows, keys, latest or rows.columns[0]).join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def set_active(
    dictionary: DataFrame, signal_keys: Iterable[str], active: bool, key: str = "signal_key"
) -> DataFrame:
    """Switch signals on or off; other rows are unchanged."""
    listed = F.col(key).isin(*signal_keys)
    return dictionary.withColumn(
        "is_active", F.when(listed, F.lit(active)).otherwise(F.col("is_active"))
    )


def restore(
    dictionary: DataFrame, snapshot: DataFrame, signal_keys: Iterable[str], key: str = "signal_key"
) -> DataFrame:
    """Roll the listed keys back to a snapshot; keys the snapshot lacks are removed."""
    keys = list(signal_keys)
    others = dictionary.where(~F.coalesce(F.col(key).isin(*keys), F.lit(False)))
    return others.unionByName(
        snapshot.where(F.col(key).isin(*keys)).select(*dictionary.columns)
    )


def delete_cascade(
    plants: DataFrame, assets: DataFrame, channels: DataFrame, plant_ids: Iterable[str]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove plants with their assets and the channels of those assets."""
    ids = list(plant_ids)
    gone = assets.where(F.col("plant_id").isin(*ids)).select(F.col("id").alias("asset_id"))
    return (
        plants.where(~F.coalesce(F.col("id").isin(*ids), F.lit(False))),
        assets.where(~F.coalesce(F.col("plant_id").isin(*ids), F.lit(False))),
        channels.join(gone, "asset_id", "left_anti"),
    )


def registry_counts(assets: DataFrame, channels: DataFrame) -> DataFrame:
    """Assets and channels per plant."""
    n_assets = assets.groupBy("plant_id").agg(F.count(F.lit(1)).alias("total_assets"))
    n_channels = (
        channels.select("asset_id")
        .join(assets.select(F.col("id").alias("asset_id"), "plant_id"), "asset_id")
        .groupBy("plant_id")
        .agg(F.count(F.lit(1)).alias("total_channels"))
    )
    return n_assets.join(n_channels, "plant_id", "left").select(
        "plant_id",
        "total_assets",
        F.coalesce("total_channels", F.lit(0)).cast("long").alias("total_channels"),
    )


def repeated_keys(df: DataFrame, keys: Sequence[str], constraint: str) -> DataFrame:
    """Keys that occur more than once, as violation rows."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .where(F.col("n_rows") > 1)
        .select(
            F.lit(constraint).alias("constraint"),
            F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"),
            "n_rows",
        )
    )


def orphans(
    df: DataFrame, key: str, parent: DataFrame, parent_key: str, constraint: str
) -> DataFrame:
    """Keys of ``df`` that the parent table lacks, as violation rows with their row counts."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")
        .select(F.lit(constraint).alias("constraint"), F.col(key).cast("string").alias("key"), "n_rows")
    )


def check_constraints(
    plants: DataFrame, assets: DataFrame, channels: DataFrame, dictionary: DataFrame
) -> DataFrame:
    """Violations of the registry's unique keys and references; empty when it is sound."""
    parts = [
        repeated_keys(plants, ["organization_id", "name"], "plant_name_unique"),
        repeated_keys(assets, ["plant_id", "name"], "asset_name_unique"),
        repeated_keys(channels, ["asset_id", "signal_key"], "channel_signal_unique"),
        orphans(channels, "signal_key", dictionary, "signal_key", "channel_signal_exists"),
        orphans(channels, "asset_id", assets, "id", "channel_asset_exists"),
        orphans(assets, "parent_id", assets, "id", "asset_parent_exists"),
        orphans(assets, "plant_id", plants, "id", "asset_plant_exists"),
    ]
    return reduce(DataFrame.unionByName, parts)
