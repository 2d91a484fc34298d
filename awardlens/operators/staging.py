"""Staging of raw contract rows, load frames with their constraints, and the use of a merge map."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from awardlens.functions import text as fn
from awardlens.sources import files

#: Tiers of a name match: merged at once from the first similarity on, reviewed from the second.
AUTO, REVIEW = 0.92, 0.85


def staged_contracts(raw: DataFrame, source: str, license_id: str, authority: str) -> DataFrame:
    """Raw contract rows under their staged names and types; rows without an id are left out.

    The procuring entity is the authority, with the province where one is known.
    """
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    number = lambda c: F.col(c).cast("string").try_cast("double")
    day = lambda c: F.nullif(F.substring(text(c), 1, 10), F.lit("NaT"))
    flag = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    placed = files.location(raw, None)
    province = F.nullif(F.trim("office"), F.lit(""))
    out = placed.select(
        text("contractId").alias("reference_number"),
        text("description").alias("title"),
        text("category").alias("category"),
        text("componentCategories").alias("component_categories"),
        fn.status_group(F.col("status")).alias("status"),
        number("budget").alias("amount"),
        number("amountPaid").alias("amount_paid"),
        number("progress").alias("progress"),
        text("contractor").alias("contractor_name"),
        day("startDate").alias("start_date"),
        day("completionDate").alias("completion_date"),
        text("infraYear").alias("infra_year"),
        text("programName").alias("program_name"),
        text("sourceOfFunds").alias("source_of_funds"),
        province.alias("province"),
        F.nullif(F.trim("region"), F.lit("")).alias("region"),
        number("latitude").alias("latitude"),
        number("longitude").alias("longitude"),
        flag("hasSatelliteImage").alias("has_satellite_image"),
        fn.whole_number(F.col("reportCount").cast("string")).alias("report_count"),
        flag("isLive").alias("is_live"),
        F.lit(source).alias("data_source"),
        F.lit(license_id).alias("data_license"),
        F.concat_ws(" - ", F.lit(authority), province).alias("procuring_entity"),
    )
    return out.where("reference_number IS NOT NULL")


def merged_names(records: DataFrame, merge_map: DataFrame, name: str = "contractor_name") -> DataFrame:
    """Records under canonical names, with the replaced one as original_name. merge_map: original, canonical."""
    found = records.join(merge_map.select(F.col("original").alias(name), "canonical"), name, "left")
    kept = [F.col(c) for c in records.columns if c != name]
    return found.select(*kept, F.coalesce("canonical", name).alias(name), F.when(F.col("canonical").isNotNull(), F.col(name)).alias("original_name"))


def match_tiers(matches: DataFrame, auto: float = AUTO, review: float = REVIEW) -> DataFrame:
    """a, b, similarity with the tier: merged at once (the longer name stays) or left to a reviewer."""
    canonical = F.when(F.length("a") >= F.length("b"), F.col("a")).otherwise(F.col("b"))
    tier = F.when(F.col("similarity") >= auto, "auto").otherwise("review")
    return matches.where(F.col("similarity") >= review).select("a", "b", "similarity", tier.alias("tier"), F.when(tier == "auto", canonical).alias("canonical"))


def load_nodes(contracts: DataFrame) -> DataFrame:
    """label, id, name, value of the agencies, contractors and contracts of staged rows."""
    named = contracts.where("procuring_entity IS NOT NULL").select(F.lit("Agency").alias("label"), F.col("procuring_entity").alias("id"), F.col("procuring_entity").alias("name"), F.lit(None).cast("double").alias("value"))
    firms = contracts.where("contractor_name IS NOT NULL").select(F.lit("Contractor").alias("label"), F.col("contractor_name").alias("id"), F.col("contractor_name").alias("name"), F.lit(None).cast("double").alias("value"))
    rows = contracts.select(F.lit("Contract").alias("label"), F.col("reference_number").alias("id"), F.col("title").alias("name"), F.col("amount").alias("value"))
    return named.union(firms).distinct().union(rows)


def load_edges(contracts: DataFrame) -> DataFrame:
    """type, source, target: agencies procured contracts, contracts were awarded to contractors."""
    procured = contracts.where("procuring_entity IS NOT NULL").select(F.lit("PROCURED").alias("type"), F.col("procuring_entity").alias("source"), F.col("reference_number").alias("target"))
    awarded = contracts.where("contractor_name IS NOT NULL").select(F.lit("AWARDED_TO").alias("type"), F.col("reference_number").alias("source"), F.col("contractor_name").alias("target"))
    return procured.union(awarded)


def ordered_load(steps: list[tuple[str, DataFrame]]) -> DataFrame:
    """step, label, rows of frames in the order in which a load writes them: nodes before edges."""
    parts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(i).alias("step"), F.lit(label).alias("label"), "n_rows") for i, (label, df) in enumerate(steps, 1)]
    return reduce(DataFrame.unionByName, parts)


def violations(constraints: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """For each uniqueness constraint: keys that several rows have, their rows, and rows without a key."""
    parts = []
    for name, (df, key) in constraints.items():
        counts = df.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("c"))
        parts.append(counts.agg(F.count(F.when(F.col("k").isNotNull() & (F.col("c") > 1), 1)).alias("n_keys"), F.coalesce(F.sum(F.when(F.col("k").isNotNull() & (F.col("c") > 1), F.col("c"))), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("c"))), F.lit(0)).alias("n_null")).select(F.lit(name).alias("constraint_name"), "n_keys", "n_rows", "n_null"))
    return reduce(DataFrame.unionByName, parts)


def vector_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Vectors by entity_id, the new ones first; rows without an id or a vector are left out."""
    usable = lambda df: df.where("entity_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0")
    kept = usable(old).join(usable(new).select("entity_id"), "entity_id", "left_anti")
    return usable(new).unionByName(kept)


def enriched(rows: DataFrame, key: str, required: list[DataFrame], optional: list[DataFrame]) -> DataFrame:
    """Rows with the columns of other frames by a key; a record of a required frame whose key no row has is an error."""
    for records in required:
        lost = records.join(rows.select(key), key, "left_anti").select(key).orderBy(key).limit(5).collect()
        if lost:
            raise ValueError(f"records without a row: {', '.join(str(r[0]) for r in lost)}")
    for records in [*required, *optional]:
        rows = rows.join(records, key, "left")
    return rows
