"""Within-study adduct and isotope edges, groups, and neutral masses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specmatch.functions.columns import ADDUCTS_NEGATIVE, ADDUCTS_POSITIVE, ISOTOPE, PROTON
from specmatch.operators.bandjoin import band_join
from specmatch.operators.components import connected_components


@dataclass(frozen=True)
class AdductConfig:
    polarity: str = "positive"
    adducts: str = "expanded"
    delta_strategy: str = "base_to_others"
    include_isotope: bool = True
    include_neutral_mass: bool = False
    ppm: float = 10.0
    rt_window: float = 0.05
    max_edges: int = 200

    def masses(self) -> list[tuple[str, float]]:
        if self.polarity not in ("positive", "negative"):
            raise ValueError(f"unsupported polarity: {self.polarity!r}")
        if self.adducts not in ("conservative", "expanded"):
            raise ValueError(f"unsupported adducts mode: {self.adducts!r}")
        wide = self.adducts == "expanded"
        own = (ADDUCTS_POSITIVE if wide else {"H": PROTON}) if self.polarity == "positive" else {"M_H": -PROTON, **(ADDUCTS_NEGATIVE if wide else {})}
        return [("NEUTRAL", 0.0)] * self.include_neutral_mass + list(own.items())

    def deltas(self) -> list[tuple[float, str, str]]:
        """Mass differences by which one ion of a molecule turns into another, distinct to 1e-9 Da, in order."""
        if self.delta_strategy not in ("base_to_others", "all_pairs"):
            raise ValueError(f"unsupported delta_strategy: {self.delta_strategy!r}")
        if self.ppm <= 0 or self.rt_window <= 0:
            raise ValueError("ppm and rt_window must be positive")
        masses = self.masses()
        base = "H" if self.polarity == "positive" else "M_H"
        found = [(m2 - m1, a, b) for a, m1 in masses for b, m2 in masses if a != b and (self.delta_strategy == "all_pairs" or base in (a, b))]
        if self.include_isotope:
            found += [(ISOTOPE, "M", "M_C13"), (-ISOTOPE, "M_C13", "M")]
        out: list[tuple[float, str, str]] = []
        for d in sorted(found, key=lambda d: d[0]):
            if abs(d[0]) > 1e-12 and not (out and abs(d[0] - out[-1][0]) <= 1e-9):
                out.append(d)
        return out


def adduct_edges(features: DataFrame, cfg: AdductConfig = AdductConfig()) -> DataFrame:
    """(id1, id2, delta_da, ppm_error, rt_diff, adduct_from, adduct_to): id1 < id2 features of one study whose masses differ by
    a known delta and that elute together; the closest delta of each pair. ``features``: (id, mz, rt)."""
    deltas = features.sparkSession.createDataFrame(cfg.deltas(), "delta double, adduct_from string, adduct_to string")
    left = features.crossJoin(F.broadcast(deltas))  # a dozen constants
    pairs = band_join(left, features, cfg.ppm, center=F.col("mz1") + F.col("delta1"))
    pairs = pairs.where((F.col("id1") != F.col("id2")) & F.coalesce(F.abs(F.col("rt2") - F.col("rt1")) <= cfg.rt_window, F.lit(False)))
    capped = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("id1").orderBy("delta1", "mz2", "id2"))).where(F.col("_n") <= cfg.max_edges)
    target = F.col("mz1") + F.col("delta1")
    e = capped.select("id1", "id2", F.col("delta1").alias("delta_da"), ((F.col("mz2") - target) / target * 1e6).alias("ppm_error"), (F.col("rt2") - F.col("rt1")).alias("rt_diff"), F.col("adduct_from1").alias("adduct_from"), F.col("adduct_to1").alias("adduct_to"))
    e = e.withColumn("_a", F.least("id1", "id2")).withColumn("_b", F.greatest("id1", "id2"))
    best = e.withColumn("_n", F.row_number().over(Window.partitionBy("_a", "_b").orderBy(F.abs("ppm_error"), "id1", "delta_da"))).where("_n = 1")
    flip = F.col("id1") > F.col("id2")
    return best.select(F.col("_a").alias("id1"), F.col("_b").alias("id2"), F.when(flip, -F.col("delta_da")).otherwise(F.col("delta_da")).alias("delta_da"), F.abs("ppm_error").alias("ppm_error"), F.abs("rt_diff").alias("rt_diff"), F.when(flip, F.col("adduct_to")).otherwise(F.col("adduct_from")).alias("adduct_from"), F.when(flip, F.col("adduct_from")).otherwise(F.col("adduct_to")).alias("adduct_to"))


def adduct_groups(features: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, group_id): connected features; a group is named by its smallest member, singletons by themselves."""
    comp = connected_components(edges.select(F.col("id1").alias("a"), F.col("id2").alias("b")))
    return features.select("id").join(comp, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("group_id"))


def adduct_labels(features: DataFrame, groups: DataFrame, cfg: AdductConfig = AdductConfig()) -> DataFrame:
    """(id, group_id, adduct, neutral_mass, ppm_error) of the features that a group's neutral mass explains.

    Of the neutral masses that a member and an adduct give, a group of two or more takes the one that explains most members, then the one with
    the least median error; it is then the median over what it explains, and errors are against that. Groups with an unknown or
    non-positive mass have none. Candidates meet members within their group, which edges of at most ``max_edges`` a feature make.
    """
    masses = features.sparkSession.createDataFrame(cfg.masses(), "adduct string, mass double")
    member = features.join(groups, "id").select("group_id", "id", "mz")
    big = member.groupBy("group_id").agg(F.count("*").alias("_n"), F.sum((F.coalesce("mz", F.lit(0.0)) <= 0).cast("int")).alias("_bad")).where("_n > 1 AND _bad = 0").select("group_id")
    guess = member.join(big, "group_id").crossJoin(F.broadcast(masses)).select("group_id", "id", "adduct", (F.col("mz") - F.col("mass")).alias("neutral"))
    c = guess.where("neutral > 0").select("group_id", F.col("id").alias("cid"), F.col("adduct").alias("cadduct"), F.col("neutral").alias("c"))
    fit = c.join(guess, "group_id").withColumn("_e", F.abs(F.col("neutral") - F.col("c")) / F.col("c") * 1e6).where(F.col("_e") <= cfg.ppm)
    best = F.min_by(F.struct("adduct", "neutral", "_e"), F.struct("_e", "adduct"))
    each = fit.groupBy("group_id", "cid", "cadduct", "id").agg(best.alias("b")).select("group_id", "cid", "cadduct", "id", "b.*")
    score = each.groupBy("group_id", "cid", "cadduct").agg(F.count("*").alias("n"), F.percentile("_e", 0.5).alias("_m"), F.percentile("neutral", 0.5).alias("neutral_mass"))
    top = score.groupBy("group_id").agg(F.min_by(F.struct("cid", "cadduct", "neutral_mass"), F.struct(-F.col("n"), F.col("_m"), F.col("cid"), F.col("cadduct"))).alias("t")).select("group_id", "t.*")
    out = each.join(top, ["group_id", "cid", "cadduct"])
    return out.select("id", "group_id", "adduct", "neutral_mass", (F.abs(F.col("neutral") - F.col("neutral_mass")) / F.col("neutral_mass") * 1e6).alias("ppm_error"))


def neutral_masses(features: DataFrame, groups: DataFrame, cfg: AdductConfig = AdductConfig()) -> DataFrame:
    """(group_id, neutral_mass, n_assigned) of the groups that have one."""
    return adduct_labels(features, groups, cfg).groupBy("group_id").agg(F.first("neutral_mass").alias("neutral_mass"), F.count("*").alias("n_assigned"))
