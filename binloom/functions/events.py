"""Event-level quantities from the leading objects (arrays of structs, leading one first)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from binloom.functions.arrays import alt, index_pairs
from binloom.functions.kinematics import MISSING, P4, delta_r2, dr2_objects, wrap_phi

# Fixed value: nominal Z mass in GeV
Z_MASS = 91.1876


def at(arr: Column, i: int) -> Column:
    return F.get(arr, F.lit(i))


def massless(obj: Column) -> P4:
    return P4.ptetaphim(obj["pt"], obj["eta"], obj["phi"])


def sign_sum(lep: Column, n: int = 3) -> Column:
    return reduce(lambda a, b: a + b, [F.signum(at(lep, i)["pdgId"].cast("double")) for i in range(n)])


def good_trilepton(lep: Column) -> Column:
    return (F.size(lep) >= 3) & (F.abs(sign_sum(lep)) <= 1)


def trilepton_charge(lep: Column) -> Column:
    return F.when(good_trilepton(lep), sign_sum(lep)).otherwise(F.lit(MISSING))


def trilepton_mass(lep: Column) -> Column:
    total = massless(at(lep, 0)) + massless(at(lep, 1)) + massless(at(lep, 2))
    return F.when(good_trilepton(lep), total.mass()).otherwise(F.lit(MISSING))


def _pair_values(lep: Column, test, value) -> list[Column]:
    return [F.when(test(at(lep, i), at(lep, j)), value(at(lep, i), at(lep, j))) for i, j in index_pairs(3)]


def z_distance(lep: Column) -> Column:
    """Smallest distance to the Z mass over pairs of one flavour and opposite sign; 9999 if none."""
    dist = _pair_values(lep, lambda a, b: a["pdgId"] + b["pdgId"] == 0,
                        lambda a, b: F.abs((massless(a) + massless(b)).mass() - Z_MASS))
    best = F.least(F.lit(9999.0), *dist)
    return F.when(good_trilepton(lep), best).otherwise(F.lit(9999.0))


def has_ossf(lep: Column) -> Column:
    found = reduce(lambda a, b: a | b, [
        F.coalesce(at(lep, i)["pdgId"] + at(lep, j)["pdgId"] == 0, F.lit(False)) for i, j in index_pairs(3)])
    return good_trilepton(lep) & found


def opposite_sign_masses(lep: Column) -> Column:
    """One value per pair of the three leptons, missing where the pair has one sign."""
    masses = _pair_values(lep, lambda a, b: a["pdgId"] * b["pdgId"] < 0,
                          lambda a, b: (massless(a) + massless(b)).mass())
    ok = good_trilepton(lep)
    return F.array(*[F.when(ok, F.coalesce(m, F.lit(MISSING))).otherwise(F.lit(MISSING)) for m in masses])


def dr_grid(a: Column, b: Column, n: int = 2) -> Column:
    """Distances of the first ``n`` of each collection; the azimuth is deliberately not wrapped."""
    return F.array(*[F.sqrt(delta_r2(at(a, i)["eta"], at(a, i)["phi"], at(b, j)["eta"], at(b, j)["phi"], wrap=False))
                     for i in range(n) for j in range(n)])


def mass_grid(a: Column, b: Column, n: int = 2) -> Column:
    return F.array(*[(massless(at(a, i)) + P4.of(at(b, j))).mass() for i in range(n) for j in range(n)])


def away_jet_dr(lep: Column, jets: Column, min_pt: float, missing: float = -999.0) -> Column:
    """Distance of the leading lepton to the leading jet if that jet is hard and central."""
    j, lead = at(jets, 0), at(lep, 0)
    ok = (F.size(lep) >= 1) & (F.size(jets) >= 1) & (j["pt"] > min_pt) & (F.abs(j["eta"]) < 2.5)
    return F.when(ok, F.sqrt(dr2_objects(j, lead))).otherwise(F.lit(missing))


def proxy_masses(lep: Column, met: Column, met_phi: Column, n: int = 2) -> Column:
    """Mass of each lepton with the missing momentum taken as a massless object at eta 0."""
    miss = P4.ptetaphim(met, F.lit(0.0), met_phi)
    return F.array(*[(massless(at(lep, i)) + miss).mass() for i in range(n)])


def signed_dphi(jets: Column, max_eta: float = 4.7) -> Column:
    """Azimuth of the more forward of the two leading jets minus that of the other."""
    a, b = at(jets, 0), at(jets, 1)
    diff = F.when(a["eta"] > b["eta"], a["phi"] - b["phi"]).otherwise(b["phi"] - a["phi"])
    ok = (F.size(jets) > 1) & (F.abs(a["eta"]) < max_eta) & (F.abs(b["eta"]) < max_eta)
    return F.when(ok, wrap_phi(diff)).otherwise(F.lit(MISSING))


def by_flavour(lep: Column, electrons: Column, muons: Column, missing: float, position) -> Column:
    """Per lepton the value of its own flavour's collection, at the position it points to."""
    return F.transform(lep, lambda x: F.when(F.abs(x["pdgId"]) == 11, alt(electrons, position(x), missing))
                       .when(F.abs(x["pdgId"]) == 13, alt(muons, position(x), missing)).otherwise(F.lit(missing)))


def cone_pt(pt: Column, isolation: Column) -> Column:
    return 0.9 * pt * (1 + isolation)


def zeppenfeld(eta: Column, eta_j1: Column, eta_j2: Column) -> Column:
    """Position relative to the jets' centre in units of their gap; NULL without a gap."""
    return F.try_divide(eta - 0.5 * (eta_j1 + eta_j2), F.abs(eta_j1 - eta_j2))


def centrality(eta1: Column, eta2: Column, eta_j1: Column, eta_j2: Column) -> Column:
    gap = F.abs(eta_j1 - eta_j2)
    spread = F.abs(2 * eta1 - eta_j1 - eta_j2) + F.abs(2 * eta2 - eta_j1 - eta_j2)
    return F.when(gap != 0, F.ln(F.try_divide(spread, gap))).otherwise(F.lit(-1.0))


def pair_mass_massless(a: Column, b: Column) -> Column:
    """Mass of two massless objects from their transverse momenta and angles."""
    return F.sqrt(2.0 * a["pt"] * b["pt"] * (F.cosh(a["eta"] - b["eta"]) - F.cos(a["phi"] - b["phi"])))
