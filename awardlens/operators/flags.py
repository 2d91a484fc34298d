"""Red-flag detectors. Each gives `flag, severity, entity_type, entity_id, n, val` rows.

A detector takes domain frames, so it runs on any source that has their columns. Joins are on
equal keys; bands of dates or amounts are residual conditions on a key's few rows, and lists of
pairs are aggregated before they are joined again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from awardlens.operators import bands
from awardlens.operators.settle import settled

WEIGHTS = {"critical": 4, "high": 3, "medium": 2, "low": 1}


def flagged(rows: DataFrame, flag: str, severity: str, entity_type: str, entity: Column, n: Column, val: Column) -> DataFrame:
    """Evidence rows in the common schema."""
    return rows.select(
        F.lit(flag).alias("flag"),
        F.lit(severity).alias("severity"),
        F.lit(entity_type).alias("entity_type"),
        entity.cast("string").alias("entity_id"),
        n.cast("long").alias("n"),
        F.round(val.cast("double"), 2).alias("val"),
    )


def single_bidder(bids: DataFrame, contracts: DataFrame, least: int = 3) -> DataFrame:
    """Firms that were the only bidder on at least `least` contracts."""
    alone = bids.groupBy("ref").agg(F.count("*").alias("k"), F.min("firm").alias("firm")).where("k = 1")
    found = alone.join(contracts.select("ref", "amount"), "ref").groupBy("firm").agg(F.count("*").alias("n"), F.sum("amount").alias("v")).where(F.col("n") >= least)
    return flagged(found, "single_bidder", "medium", "firm", F.col("firm"), F.col("n"), F.col("v"))


def identical_bids(bids: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Pairs of bids on a contract that differ by less than a share of the smaller id's bid."""
    x = bids.select("ref", F.col("firm").alias("a"), F.col("bid").alias("bid_a"))
    y = bids.select("ref", F.col("firm").alias("b"), F.col("bid").alias("bid_b"))
    close = F.abs(F.col("bid_a") - F.col("bid_b")).cast("double") < F.col("bid_a").cast("double") * tolerance
    pairs = x.join(y, "ref").where((F.col("a") < F.col("b")) & (F.col("bid_a") > 0) & (F.col("bid_b") > 0) & close)
    return flagged(pairs, "identical_bids", "high", "firm", F.col("a"), F.col("b"), F.col("bid_a"))


def split_contracts(awards: DataFrame, threshold: float, least: int = 3) -> DataFrame:
    """Firms with several awards of an office just under a threshold."""
    near = awards.where((F.col("amount") > 0.7 * threshold) & (F.col("amount") < threshold))
    found = near.groupBy("office", "firm").agg(F.count("*").alias("n"), F.sum("amount").alias("v")).where(F.col("n") >= least)
    return flagged(found, "split_contracts", "high", "firm", F.col("firm"), F.col("n"), F.col("v"))


def concentrated_offices(index: DataFrame, limit: float) -> DataFrame:
    """Offices whose index passes a limit; `index` has office, hhi and val."""
    return flagged(index.where(F.col("hhi") > limit), "concentration", "high", "office", F.col("office"), F.col("n_firms"), F.col("val"))


def rotating_winners(bids: DataFrame, winner_of: DataFrame, least: int = 3) -> DataFrame:
    """Pairs that bid together on `least` contracts and each win some that the other bid on."""
    x, y = bids.select("ref", F.col("firm").alias("a")), bids.select("ref", F.col("firm").alias("b"))
    together = x.join(y, "ref").where("a < b").join(winner_of, "ref", "left")
    wins = together.groupBy("a", "b").agg(
        F.count("*").alias("k"),
        F.count(F.when(F.col("winner") == F.col("a"), 1)).alias("wins_a"),
        F.count(F.when(F.col("winner") == F.col("b"), 1)).alias("wins_b"),
    )
    found = wins.where((F.col("k") >= least) & (F.col("wins_a") > 0) & (F.col("wins_b") > 0))
    return flagged(found, "rotating_winners", "high", "firm", F.col("a"), F.col("k"), F.col("wins_a") + F.col("wins_b"))


def political_connection(owned: DataFrame, persons: DataFrame) -> DataFrame:
    """Firms owned by a relative of others in office, with the number of those: owned(firm, person), persons(person, surname, province).

    Relatives share surname and province. They are counted by family, without pairs of persons: of
    a family with one owner all others count, of one with several everybody does.
    """
    size = persons.groupBy("surname", "province").agg(F.count("*").alias("size"))
    owners = owned.select("firm", "person").distinct().join(persons, "person").groupBy("firm", "surname", "province").agg(F.count("*").alias("k"))
    near = F.when(F.col("k") == 1, F.col("size") - 1).otherwise(F.col("size"))
    found = owners.join(size, ["surname", "province"]).groupBy("firm").agg(F.sum(near).alias("n")).where("n > 0")
    return flagged(found, "political_connection", "high", "firm", F.col("firm"), F.col("n"), F.lit(0.0))


def away_from_home(awards: DataFrame, firms: DataFrame, least: int = 3) -> DataFrame:
    """Firms with several awards outside their home region."""
    away = awards.join(firms.select("firm", "home_region"), "firm").where("region <> home_region")
    found = away.groupBy("firm").agg(F.count("*").alias("n"), F.sum("amount").alias("v")).where(F.col("n") >= least)
    return flagged(found, "geographic_anomaly", "medium", "firm", F.col("firm"), F.col("n"), F.col("v"))


def shell_company(awards: DataFrame, firms: DataFrame, ratio: float = 100) -> DataFrame:
    """Firms whose awards are many times their capital."""
    sums = awards.groupBy("firm").agg(F.count("*").alias("n"), F.sum("amount").alias("v"))
    found = sums.join(firms.select("firm", "capital"), "firm").where((F.col("capital") > 0) & (F.col("v").cast("double") / F.col("capital").cast("double") > ratio))
    return flagged(found, "shell_company", "high", "firm", F.col("firm"), F.col("n"), F.col("v"))


def phoenix(rows: DataFrame, key: str, blacklist: DataFrame) -> DataFrame:
    """Firms that share a `key` with blacklisted ones, themselves not listed, with the number of those; rows: key, firm.

    Firms with equal sets of keys count together and sets meet at their first common key, so no pair of firms is made.
    """
    bad = blacklist.select("firm").distinct()
    own = rows.groupBy("firm").agg(F.sort_array(F.collect_set(key)).alias("keys"))
    free, listed = own.join(bad, "firm", "left_anti"), own.join(bad, "firm", "left_semi").groupBy("keys").agg(F.count("*").alias("c"))
    x = free.select("keys").distinct().select("keys", F.explode("keys").alias("key"))
    y = listed.select(F.col("keys").alias("others"), "c", F.explode("keys").alias("key"))
    met = x.join(y, "key").where(F.get(F.array_intersect("keys", "others"), F.lit(0)) == F.col("key"))
    found = free.join(met.groupBy("keys").agg(F.sum("c").alias("n")), "keys")
    return flagged(found, "phoenix", "high", "firm", F.col("firm"), F.col("n"), F.lit(0.0))


def phoenix_links(rows: DataFrame, key: str, blacklist: DataFrame) -> DataFrame:
    """a, b: a firm off the blacklist and one on it that share a `key`; rows: key, firm. Only the listed side is paired."""
    bad = blacklist.select("firm")
    listed = rows.join(bad, "firm", "left_semi").select(key, F.col("firm").alias("b"))
    return rows.join(bad, "firm", "left_anti").select(key, F.col("firm").alias("a")).join(listed, key).select("a", "b")


def campaign_connection(donations: DataFrame, awards: DataFrame) -> DataFrame:
    """Donors that hold awards in the official's office: donations(firm, office, given)."""
    given = donations.groupBy("firm", "office").agg(F.sum("given").alias("given"))
    won = awards.groupBy("firm", "office").agg(F.count("*").alias("n"), F.sum("amount").alias("v"))
    return flagged(given.join(won, ["firm", "office"]), "campaign_connection", "high", "firm", F.col("firm"), F.col("n"), F.col("v"))


def circular_flow(edges: DataFrame) -> DataFrame:
    """Money that comes back: a -> b -> a, or a -> b -> c -> a, by directed edges(src, dst)."""
    e = edges.select("src", "dst").distinct().where("src <> dst")
    ab = e.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    two = ab.join(e.select(F.col("src").alias("b"), F.col("dst").alias("a")), ["a", "b"]).select("a", F.lit(2).alias("hops"))
    bc = e.select(F.col("src").alias("b"), F.col("dst").alias("c"))
    ca = e.select(F.col("src").alias("c"), F.col("dst").alias("a"))
    three = ab.join(bc, "b").where("c <> a").join(ca, ["c", "a"]).select("a", F.lit(3).alias("hops"))
    found = two.unionByName(three).groupBy("a").agg(F.count("*").alias("n"), F.min("hops").alias("hops"))
    return flagged(found, "circular_flow", "critical", "firm", F.col("a"), F.col("n"), F.col("hops"))


def timing_cluster(awards: DataFrame, days: int = 2, least: int = 3) -> DataFrame:
    """Firms with `least` awards of one office within `days` days of another one.

    A neighbour in time is found by the awards before and after in date order, so no join of
    an office's awards with themselves is needed.
    """
    order = Window.partitionBy("office", "firm").orderBy("award_date", "ref")
    before = F.datediff("award_date", F.lag("award_date").over(order)) <= days
    after = F.datediff(F.lead("award_date").over(order), "award_date") <= days
    close = awards.withColumn("near", F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))).where("near")
    found = close.groupBy("office", "firm").agg(F.count("*").alias("n"), F.sum("amount").alias("v")).where(F.col("n") >= least)
    return flagged(found, "timing_cluster", "high", "firm", F.col("firm"), F.col("n"), F.col("v"))


def shell_network(addresses: DataFrame, directors: DataFrame, size: int = 512) -> DataFrame:
    """Pairs of firms at one address with their number of shared directors: addresses(firm, address), directors(firm, director).

    Every firm carries its directors to its addresses, so no pair of firms with a common director is made, and a pair counts
    only at its first common address, so none is shuffled. The firms of an address meet in blocks of about `size`.
    """
    own = addresses.groupBy("firm").agg(F.sort_array(F.collect_set("address")).alias("at"))
    held = own.join(directors.groupBy("firm").agg(F.collect_set("director").alias("led")), "firm", "left").select("firm", "at", "led", F.explode("at").alias("address"))
    held = settled(held, "address-firms")
    cuts = held.groupBy("address").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    dealt = held.join(cuts, "address").withColumn("block", F.pmod(F.xxhash64("firm"), F.col("blocks")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    x = dealt.select("address", F.col("block").alias("i"), each.alias("j"), F.col("firm").alias("a"), F.col("at").alias("at_a"), F.col("led").alias("led_a"))
    y = dealt.select("address", each.alias("i"), F.col("block").alias("j"), F.col("firm").alias("b"), F.col("at").alias("at_b"), F.col("led").alias("led_b"))
    tasks = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number of our own: the few rows that go in would be put in one task
    met = x.repartition(tasks, "address", "i", "j").join(y, ["address", "i", "j"])
    pairs = met.where((F.col("a") < F.col("b")) & (F.get(F.array_intersect("at_a", "at_b"), F.lit(0)) == F.col("address")))
    shared = F.coalesce(F.size(F.array_intersect("led_a", "led_b")), F.lit(0))
    return flagged(pairs.withColumn("shared", F.greatest(shared, F.lit(0))), "shell_network", "high", "firm", F.col("a"), F.col("b"), F.col("shared"))


def risk_scores(flags: DataFrame) -> DataFrame:
    """Sum of severity weights and number of flags for each entity."""
    weight = F.lit(0)
    for name, w in WEIGHTS.items():
        weight = F.when(F.col("severity") == name, w).otherwise(weight)
    scored = flags.withColumn("weight", weight)
    return scored.groupBy("entity_type", "entity_id").agg(F.sum("weight").cast("long").alias("risk_score"), F.count("*").alias("n_flags"), F.count_distinct("flag").alias("n_kinds"))


def near_threshold(awards: DataFrame, threshold: float) -> DataFrame:
    return awards.where(F.col("amount").between(0.7 * threshold, threshold))


def flagged_entities(flags: DataFrame, severity: str | None = None) -> DataFrame:
    """entity_type, entity_id, risk_score, n_flags, flags (names): entities that have a flag of `severity`, by all their flags."""
    weight = F.lit(1)
    for name, w in WEIGHTS.items():
        weight = F.when(F.col("severity") == name, w).otherwise(weight)
    asked = F.lit(True) if severity is None else F.bool_or(F.col("severity") == severity)
    found = flags.groupBy("entity_type", "entity_id").agg(F.sum(weight).cast("long").alias("risk_score"), F.count("*").alias("n_flags"), F.array_join(F.sort_array(F.collect_set("flag")), ",").alias("flags"), asked.alias("asked") if severity else F.first(asked).alias("asked"))
    return found.where("asked").drop("asked")


def splitting_pairs(awards: DataFrame, threshold: float, days: int = 30) -> DataFrame:
    """Pairs of awards of one office and firm, both in 0.7 to 1 times the threshold, near in time."""
    near = near_threshold(awards, threshold).select("office", "firm", "ref", "award_date", "amount")
    pairs = bands.near_pairs(near, ["office", "firm"], days)
    return pairs.select("office", "firm", "ref_a", "ref_b", F.abs(F.datediff("date_a", "date_b")).alias("days"), (F.col("amount_a") + F.col("amount_b")).cast("double").alias("combined"))


def splitting_undated(awards: DataFrame, threshold: float, least: int = 2) -> DataFrame:
    """Where dates cannot be compared: all awards near the threshold of an office and firm that have two or more, dated or not."""
    near = near_threshold(awards, threshold).select("office", "firm", "ref", "award_date", "amount")
    sums = near.groupBy("office", "firm").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("combined")).where(F.col("n") >= least)
    return near.join(sums, ["office", "firm"]).select("office", "firm", "ref", "award_date", F.col("amount").cast("double").alias("amount"), "n", "combined")


def split_clusters(contracts: DataFrame, threshold: float, days: int = 30) -> DataFrame:
    """For each contract near a threshold: it and the office's later ones within days and 0.5-2 times its amount."""
    near = contracts.where((F.col("amount") >= 0.7 * threshold) & (F.col("amount") < threshold)).select("office", "ref", "award_date", "amount")
    return bands.clusters_after(near, ["office"], days).where("n >= 2")


def round_amounts(contracts: DataFrame, least: float, step: int) -> DataFrame:
    """Contracts over an amount that are whole multiples of a step, by office."""
    whole = F.floor("amount") % step == 0
    return contracts.where(F.col("amount") > least).groupBy("office").agg(F.count("*").alias("n"), F.count(F.when(whole, 1)).alias("n_round"), F.round(100.0 * F.count(F.when(whole, 1)) / F.count("*"), 4).alias("pct"))


def identical_amounts(contracts: DataFrame, least: float) -> DataFrame:
    """Amounts that several contracts share."""
    return contracts.where(F.col("amount") > least).groupBy("amount").agg(F.count("*").alias("n"), F.min("ref").alias("first_ref")).where("n >= 2").select(F.col("amount").cast("double").alias("amount"), "n", "first_ref")


def monthly_surges(contracts: DataFrame, times: float = 2.0) -> DataFrame:
    """Totals by month, and whether a month passes so many times the mean month."""
    months = contracts.groupBy(F.date_format("award_date", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("val"))
    mean = months.agg(F.avg("val").alias("mean"))  # one row
    return months.crossJoin(F.broadcast(mean)).select("month", "n", F.round("val", 2).alias("val"), (F.col("val") > times * F.col("mean")).alias("surge"))


def reported(flags: DataFrame, severities: tuple[str, ...], detected_at: str) -> DataFrame:
    """Flags of some severities with weight, description, evidence (JSON) and the day they were found."""
    weight = F.lit(1)
    for name, w in WEIGHTS.items():
        weight = F.when(F.col("severity") == name, w).otherwise(weight)
    value = F.col("val").cast("decimal(20,2)").cast("string")
    text = F.concat("flag", F.lit(": "), "entity_type", F.lit(" "), "entity_id", F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    evidence = F.to_json(F.struct("n", value.alias("val")))
    return flags.where(F.col("severity").isin(list(severities))).select("flag", "severity", "entity_type", "entity_id", "n", value.alias("val"), weight.alias("weight"), text.alias("description"), evidence.alias("evidence"), F.lit(detected_at).alias("detected_at"))


def audit_topics(findings: DataFrame, topics: dict[str, tuple]) -> DataFrame:
    """Findings and amounts by topic and kind. A topic has words of the kind, words of the text, and a whole kind."""
    found = []
    for topic, (in_kind, in_text, kind) in topics.items():
        hits = [F.col("kind").contains(w) for w in in_kind] + [F.col("description").contains(w) for w in in_text] + ([F.col("kind") == kind] if kind else [])
        found.append(F.when(reduce(lambda x, y: x | y, (F.coalesce(h, F.lit(False)) for h in hits)), F.lit(topic)))
    each = findings.withColumn("topic", F.explode(F.array_compact(F.array(*found))))
    return each.groupBy("topic", "kind").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("val"))
