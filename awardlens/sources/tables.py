"""Contract-domain frames over the driver's tables.

orders are contracts, suppliers are firms, nations are procuring offices, line items are awards
and bids. Money is DECIMAL(18,2), so that sums do not depend on the order of rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from awardlens.operators.settle import settled

FOCUS = "1-URGENT"
MONEY = "decimal(18,2)"
#: Lines of a task.
LINES = 500_000


@dataclass
class Domain:
    """The domain's frames for one folder of tables, each built when asked for."""

    spark: SparkSession
    folder: str
    _held: dict = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def tasks(self) -> int:
        """Tasks for what is as long as the lines, or their pairs: so many that none holds more as the tables grow."""
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-self.table("lineitem").count() // LINES))

    @cached_property
    def places(self) -> DataFrame:
        """nation_key, office, region."""
        n, r = self.table("nation"), self.table("region")
        return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_nationkey").alias("nation_key"), F.col("n_name").alias("office"), F.col("r_name").alias("region"))

    @cached_property
    def contracts(self) -> DataFrame:
        """ref, office, region, category, status, amount, award_date, year, customer."""
        o, c = self.table("orders"), self.table("customer").select("c_custkey", "c_nationkey")
        located = o.join(c, o["o_custkey"] == c["c_custkey"]).join(self.places, F.col("c_nationkey") == F.col("nation_key"))
        return located.select(
            F.col("o_orderkey").alias("ref"),
            "office",
            "region",
            F.col("o_orderpriority").alias("category"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_totalprice").cast(MONEY).alias("amount"),
            F.to_date("o_orderdate").alias("award_date"),
            F.year("o_orderdate").alias("year"),
            F.col("o_custkey").alias("customer"),
        )

    @cached_property
    def winners(self) -> DataFrame:
        """ref, firm: the distinct firms of each contract."""
        return self.table("lineitem").select(F.col("l_orderkey").alias("ref"), F.col("l_suppkey").alias("firm")).repartition(self.tasks, "ref").distinct()

    @cached_property
    def awards(self) -> DataFrame:
        """Contracts with one row for each firm that holds them, valued in full for each."""
        return self.winners.join(self.contracts, "ref")

    @cached_property
    def bids(self) -> DataFrame:
        """ref, firm, bid: the least price of a firm on a contract."""
        line = self.table("lineitem").select(F.col("l_orderkey").alias("ref"), F.col("l_suppkey").alias("firm"), F.col("l_extendedprice").cast(MONEY).alias("bid"))
        return line.repartition(self.tasks, "ref").groupBy("ref", "firm").agg(F.min("bid").alias("bid"))

    @cached_property
    def firms(self) -> DataFrame:
        """firm, name, home, home_region, capital, nation_key."""
        s = self.table("supplier")
        return s.join(self.places, s["s_nationkey"] == F.col("nation_key")).select(F.col("s_suppkey").alias("firm"), F.col("s_name").alias("name"), F.col("office").alias("home"), F.col("region").alias("home_region"), F.col("s_acctbal").cast(MONEY).alias("capital"), "nation_key")

    @cached_property
    def officials(self) -> DataFrame:
        """Persons in office from customers: person, surname, province, position, term dates."""
        c, o = self.table("customer"), self.table("orders")
        terms = o.groupBy(F.col("o_custkey").alias("person")).agg(F.to_date(F.min("o_orderdate")).alias("term_start"), F.to_date(F.max("o_orderdate")).alias("term_end"))
        named = c.join(self.places, c["c_nationkey"] == F.col("nation_key")).select(F.col("c_custkey").alias("person"), F.concat(F.lit("CLAN"), (F.col("c_custkey") % 40).cast("string")).alias("surname"), F.col("office").alias("province"), F.col("c_mktsegment").alias("position"), F.col("c_acctbal").cast(MONEY).alias("net_worth"))
        return named.join(terms, "person", "left")

    @cached_property
    def focus(self) -> DataFrame:
        """Awards of focus contracts: lines meet those contracts alone, and one shuffle serves the join and the distinct firms."""
        lines = self.table("lineitem").select(F.col("l_orderkey").alias("ref"), F.col("l_suppkey").alias("firm"))
        return lines.repartition(self.tasks, "ref").join(self.contracts.where(F.col("category") == FOCUS), "ref").dropDuplicates(["ref", "firm"])

    def keep(self, *names: str) -> None:
        """Write frames that several parts of a query read, once; later parts read the written tables."""
        for name in names:
            if name not in self._held:
                self._held[name] = True
                self.__dict__[name] = settled(getattr(self, name), name)


#: The same frames as common table expressions of the oracle.
CTE = """
places AS (SELECT n_nationkey AS nation_key, n_name AS office, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey),
contracts AS (
  SELECT o_orderkey AS ref, office, region, o_orderpriority AS category, o_orderstatus AS status, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
         CAST(o_orderdate AS DATE) AS award_date, CAST(year(o_orderdate) AS INT) AS year, o_custkey AS customer
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN places ON c_nationkey = nation_key),
winners AS (SELECT DISTINCT l_orderkey AS ref, l_suppkey AS firm FROM lineitem),
awards AS (SELECT w.firm, c.* FROM winners w JOIN contracts c ON w.ref = c.ref),
focus AS (SELECT * FROM awards WHERE category = '1-URGENT'),
bids AS (SELECT l_orderkey AS ref, l_suppkey AS firm, min(CAST(l_extendedprice AS DECIMAL(18,2))) AS bid FROM lineitem GROUP BY 1, 2),
firms AS (
  SELECT s_suppkey AS firm, s_name AS name, office AS home, region AS home_region, CAST(s_acctbal AS DECIMAL(18,2)) AS capital, nation_key
  FROM supplier JOIN places ON s_nationkey = nation_key),
terms AS (SELECT o_custkey AS person, CAST(min(o_orderdate) AS DATE) AS term_start, CAST(max(o_orderdate) AS DATE) AS term_end FROM orders GROUP BY 1),
officials AS (
  SELECT c_custkey AS person, 'CLAN' || (c_custkey % 40) AS surname, office AS province, c_mktsegment AS position, CAST(c_acctbal AS DECIMAL(18,2)) AS net_worth, term_start, term_end
  FROM customer JOIN places ON c_nationkey = nation_key LEFT JOIN terms ON c_custkey = person)
"""


def oracle(body: str, more: str = "") -> str:
    """A query over the domain's expressions and, separated by commas, more of them."""
    return f"WITH RECURSIVE {CTE}{', ' + more if more else ''} {body}"
