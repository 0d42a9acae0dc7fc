"""Bands of LTE and NR channel numbers.

LTE ranges do not overlap. NR channels give a frequency, which may lie in several bands: networks of region 2 (country codes
3.. and 7..) prefer some of them, others leave out those that only region 2 has, unless nothing else is left; then the first
in order counts, and the result is ambiguous if more than one candidate is left that is no renumbering of another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: (band, lowest downlink MHz, first channel, last channel)
LTE = [
    (1, 2110.0, 0, 599), (2, 1930.0, 600, 1199), (3, 1805.0, 1200, 1949), (4, 2110.0, 1950, 2399), (5, 869.0, 2400, 2649), (6, 875.0, 2650, 2749),
    (7, 2620.0, 2750, 3449), (8, 925.0, 3450, 3799), (9, 1844.9, 3800, 4149), (10, 2110.0, 4150, 4749), (11, 1475.9, 4750, 4949), (12, 729.0, 5010, 5179),
    (13, 746.0, 5180, 5279), (14, 758.0, 5280, 5379), (17, 734.0, 5730, 5849), (18, 860.0, 5850, 5999), (19, 875.0, 6000, 6149), (20, 791.0, 6150, 6449),
    (21, 1495.9, 6450, 6599), (22, 3510.0, 6600, 7399), (23, 2180.0, 7500, 7699), (24, 1525.0, 7700, 8039), (25, 1930.0, 8040, 8689), (26, 859.0, 8690, 9039),
    (27, 852.0, 9040, 9209), (28, 758.0, 9210, 9659), (29, 717.0, 9660, 9769), (30, 2350.0, 9770, 9869), (31, 462.5, 9870, 9919), (32, 1452.0, 9920, 10359),
    (33, 1900.0, 36000, 36199), (34, 2010.0, 36200, 36349), (35, 1850.0, 36350, 36949), (36, 1930.0, 36950, 37549), (37, 1910.0, 37550, 37749), (38, 2570.0, 37750, 38249),
    (39, 1880.0, 38250, 38649), (40, 2300.0, 38650, 39649), (41, 2496.0, 39650, 41589), (42, 3400.0, 41590, 43589), (43, 3600.0, 43590, 45589), (44, 703.0, 45590, 46589),
    (45, 1447.0, 46590, 46789), (46, 5150.0, 46790, 54539), (47, 5855.0, 54540, 55239), (48, 3550.0, 55240, 56739), (49, 3550.0, 56740, 58239), (50, 1432.0, 58240, 59089),
    (51, 1427.0, 59090, 59139), (52, 3300.0, 59140, 60139), (53, 2483.5, 60140, 60254), (65, 2110.0, 65536, 66435), (66, 2110.0, 66436, 67335), (67, 738.0, 67336, 67535),
    (68, 753.0, 67536, 67835), (69, 2570.0, 67836, 68335), (70, 1995.0, 68336, 68585), (71, 617.0, 68586, 68935), (72, 461.0, 68936, 68985), (73, 460.0, 68986, 69035),
    (74, 1475.0, 69036, 69465), (75, 1432.0, 69466, 70315), (76, 1427.0, 70316, 70365), (85, 728.0, 70366, 70545), (87, 420.0, 70546, 70595), (88, 422.0, 70596, 70645),
]
# fixed values: (band, lowest MHz, highest MHz), in order of preference
NR = [
    (71, 617.0, 652.0), (105, 612.0, 652.0), (29, 717.0, 728.0), (12, 729.0, 746.0), (85, 728.0, 746.0), (67, 738.0, 758.0), (13, 746.0, 756.0), (14, 758.0, 768.0),
    (28, 758.0, 803.0), (20, 791.0, 821.0), (5, 869.0, 894.0), (26, 859.0, 894.0), (18, 860.0, 875.0), (100, 919.4, 925.0), (8, 925.0, 960.0),
    (51, 1427.0, 1432.0), (76, 1427.0, 1432.0), (91, 1427.0, 1432.0), (93, 1427.0, 1432.0), (75, 1432.0, 1517.0), (50, 1432.0, 1517.0), (92, 1432.0, 1517.0), (94, 1432.0, 1517.0),
    (74, 1475.0, 1518.0), (24, 1525.0, 1559.0), (54, 1670.0, 1675.0), (3, 1805.0, 1880.0), (39, 1880.0, 1920.0), (101, 1900.0, 1910.0), (2, 1930.0, 1990.0), (25, 1930.0, 1995.0),
    (70, 1995.0, 2020.0), (34, 2010.0, 2025.0), (66, 2110.0, 2200.0), (1, 2110.0, 2170.0), (65, 2110.0, 2200.0), (40, 2300.0, 2400.0), (30, 2350.0, 2360.0), (53, 2483.5, 2495.0),
    (41, 2496.0, 2690.0), (90, 2496.0, 2690.0), (38, 2570.0, 2620.0), (7, 2620.0, 2690.0), (48, 3550.0, 3700.0), (78, 3300.0, 3800.0), (77, 3300.0, 4200.0), (79, 4400.0, 5000.0),
    (46, 5150.0, 5925.0), (47, 5855.0, 5925.0), (102, 5925.0, 6425.0), (96, 5925.0, 7125.0), (104, 6425.0, 7125.0), (258, 24250.0, 27500.0), (257, 26500.0, 29500.0),
    (261, 27500.0, 28350.0), (260, 37000.0, 40000.0), (259, 39500.0, 43500.0), (262, 47200.0, 48200.0),
]
REGION2_ONLY = {71, 29, 12, 85, 13, 14, 26, 24, 2, 25, 70, 66, 30, 48, 96, 261, 262}
REGION2_PREFERRED = {77, 66, 25, 12, 14, 30, 71, 48}
RENUMBERING = {90}
#: Spans of NR channels: first and last channel, MHz of the first, step.
NR_STEPS = [(0, 599999, 0.0, 0.005), (600000, 2016666, 3000.0, 0.015), (2016667, 3279165, 24250.08, 0.060)]


def lte_values() -> str:
    return ", ".join(map(str, LTE))


def nr_values() -> str:
    return ", ".join(str((k, b, lo, hi, int(b in REGION2_ONLY), int(b in REGION2_PREFERRED), int(b in RENUMBERING))) for k, (b, lo, hi) in enumerate(NR))


def derive_bands(df: DataFrame, rat: str, channel: str, mcc: str) -> DataFrame:
    """Adds band, mhz and ambiguous. Each distinct (rat, channel, mcc) meets the two reference tables, which are small and
    of fixed size; other technologies and channels outside of all ranges get nulls."""
    spark = df.sparkSession
    keys = df.select(F.col(rat).alias("_rat"), F.col(channel).cast("long").alias("_ch"), F.col(mcc).alias("_mcc")).distinct().where("_ch >= 0")
    lte = spark.sql(f"SELECT * FROM VALUES {lte_values()} AS t(band, low, first, last)").withColumn("low", F.col("low").cast("double"))
    found = keys.where("_rat = 'LTE'").join(F.broadcast(lte), F.col("_ch").between(F.col("first"), F.col("last"))).select("_rat", "_ch", "_mcc", "band", F.round(F.col("low") + 0.1 * (F.col("_ch") - F.col("first")), 2).alias("mhz"), F.lit(False).alias("ambiguous"))
    nr = spark.sql(f"SELECT * FROM VALUES {nr_values()} AS t(place, band, lo, hi, only2, preferred, renumbered)")
    nr = nr.withColumns({c: F.col(c).cast("double") for c in ("lo", "hi")})
    mhz = F.lit(None).cast("double")
    for first, last, start, step in NR_STEPS:
        mhz = F.when(F.col("_ch").between(first, last), start + step * (F.col("_ch") - first)).otherwise(mhz)
    region2 = F.when(F.col("_mcc").rlike("^[0-9]{3}$"), F.col("_mcc").substr(1, 1).isin("3", "7"))
    own = keys.where("_rat = 'NR'").withColumn("_mhz", mhz).join(F.broadcast(nr), F.col("_mhz").between(F.col("lo"), F.col("hi"))).withColumn("_r2", region2)
    usable = F.when(F.col("_r2") == F.lit(False), F.col("only2") == 0).otherwise(True)
    rank = F.struct((~usable).cast("int").alias("a"), F.when(F.col("_r2"), 1 - F.col("preferred")).otherwise(0).alias("b"), "place")
    best = own.groupBy("_rat", "_ch", "_mcc", "_mhz").agg(F.min_by("band", rank).alias("band"), F.count_if(usable).alias("_u"), F.count_if(usable & (F.col("renumbered") == 0)).alias("_un"), F.count_if(F.col("renumbered") == 0).alias("_n"))
    best = best.select("_rat", "_ch", "_mcc", "band", F.round("_mhz", 2).alias("mhz"), (F.when(F.col("_u") > 0, F.col("_un")).otherwise(F.col("_n")) > 1).alias("ambiguous"))
    told = found.union(best)
    match = F.col(rat).eqNullSafe(F.col("_rat")) & (F.col(channel).cast("long") == F.col("_ch")) & F.col(mcc).eqNullSafe(F.col("_mcc"))
    return df.join(told, match, "left").drop("_rat", "_ch", "_mcc")
