"""Records whose rows point to their mother row by its index in the same event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from binloom.session import stage

# Status bits 0, 2, 3 and 4 mark prompt leptons and tau decay products; codes of the
# charged leptons, of the tau and of the Z
PROMPT_BITS = 1 << 0 | 1 << 2 | 1 << 3 | 1 << 4
LEPTONS = (11, 13, 15)
TAU = 15
Z = 23


def mother_pt(particles: DataFrame, key: str, idx: str = "idx", mother: str = "mother") -> DataFrame:
    """Per event the pt of the mother that two final leptons share (``mother_pt``); events without such a pair are left out or null.

    With any Z among the mothers of the final leptons the shared mother must be a Z; without one it must be the first particle.
    The first lepton, in record order, that has a later sibling decides.  ``particles`` is flat with pt, pdgId, flags; a mother below 0 or
    beyond the record is none.  Final leptons are first combined per mother (count, first index), so neither the length of
    a record nor a mother with very many daughters matters.
    """
    final = F.abs("pdgId").isin(*LEPTONS) & (F.col("flags").bitwiseAND(F.lit(PROMPT_BITS)) != 0)
    pairs = particles.where(final & (F.col(mother) >= 0)).groupBy(key, F.col(mother).alias(idx)).agg(
        F.count(F.lit(1)).alias("n"), F.min(idx).alias("first"))
    seen = pairs.join(particles.select(key, idx, "pt", "pdgId"), [key, idx])
    shared = F.col("n") > 1
    out = seen.groupBy(key).agg(
        F.max(F.col("pdgId") == Z).alias("any_z"),
        F.min_by("pt", F.when(shared & (F.col("pdgId") == Z), F.col("first"))).alias("z"),
        F.min_by("pt", F.when(shared & (F.col(idx) == 0), F.col("first"))).alias("zero"))
    return out.select(key, F.when(F.col("any_z"), F.col("z")).otherwise(F.col("zero")).alias("mother_pt"))


def with_ancestor(particles: DataFrame, key: str, test: Column, name: str, idx: str = "idx", mother: str = "mother", of: Column | None = None,
                  staged: bool = False) -> DataFrame:
    """The particles with a flag: does the test hold for the mother, her mother, and so on?  The particle itself does not count.

    Pointer doubling: each round joins every mother with what is known of the particle her pointer has reached and doubles its reach, so
    rounds are the logarithm of the deepest line.  Only particles that have daughters take part.  A pointer below 0 or beyond the record
    ends a line; one in a circle ends once it has seen as many particles as the longest record has.

    With ``of`` only particles for which it holds are flagged and returned; all are their ancestors.  ``staged``: the particles come from files,
    so they are read again instead of being written first.
    """
    particles = particles.drop(name).withColumn("__test", F.coalesce(test, F.lit(False)))
    particles = particles if staged else stage(particles, "particles")
    heads = particles.where(F.col(mother) >= 0).select(key, F.col(mother).alias(idx)).distinct()
    known = stage(particles.join(heads, [key, idx], "left_semi").select(
        F.col(key).alias("k"), F.col(idx).cast("long").alias("i"), F.when((F.col(mother) >= 0) & ~F.col("__test"), F.col(mother)).cast("long").alias("to"),
        F.col("__test").alias("hit")), "ancestry")
    longest = known.agg(F.max("i")).first()[0]
    reach = 1
    # hit: the test held within ``reach`` particles from here; with a hit, or at the end of its line, a particle points nowhere
    while longest is not None and reach <= longest + 1 and not known.where("to IS NOT NULL").isEmpty():
        far = known.where("hit OR to IS NOT NULL").select("k", F.col("i").alias("to"), F.col("to").alias("then"), F.col("hit").alias("there"))
        moved = known.where("to IS NOT NULL").join(far, ["k", "to"], "left").select("k", "i", F.col("then").alias("to"), F.coalesce("there", F.lit(False)).alias("hit"))
        known = stage(known.where("to IS NULL").unionByName(moved), "ancestry")
        reach *= 2
    up = known.select(F.col("k").alias(key), F.col("i").alias(mother), F.col("hit").alias(name))
    asked = particles if of is None else particles.where(of)
    flagged = asked.join(up, [key, mother], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return flagged.select(*[c for c in particles.columns if c != "__test"], name)
