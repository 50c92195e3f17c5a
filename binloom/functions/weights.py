"""Event weights from leading leptons, maps and curves."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, functions as F

from binloom.functions.kinematics import erf, interpol
from binloom.functions.lookup import Curve

ELECTRON, MUON = 11, 13


def is_electron(pdg: Column) -> Column:
    return F.abs(pdg) == ELECTRON


def tight_loose_probability(p: Column, f: Column, tight: Column) -> tuple[Column, Column]:
    """Probabilities that an observed lepton is prompt or fake; NULL where both rates agree."""
    gap = p - f
    prompt = F.try_divide(F.when(tight, p * (1 - f)).otherwise(p * f), gap)
    fake = F.try_divide(F.when(tight, f * (1 - p)).otherwise(f * p), gap)
    return prompt, fake


def fake_combination(prompt: list[Column], fake: list[Column], tight: list[Column]) -> Column:
    """Fake-lepton estimate from per-lepton probabilities, for any number of leptons.

    Sum over all assignments with at least one fake.  The term with k fakes is negative if the
    number of leptons failing the tight selection is even for odd k, or odd for even k.
    """
    n = len(tight)
    n_tight = reduce(lambda a, b: a + b, [t.cast("int") for t in tight])
    loose_odd = F.pmod(F.lit(n) - n_tight, F.lit(2)) == 1
    terms = {0: [], 1: []}
    for pick in product((0, 1), repeat=n):          # 1 means fake
        k = sum(pick)
        if k:
            terms[k % 2].append(reduce(lambda a, b: a * b, [(prompt, fake)[pick[i]][i] for i in range(n)]))
    gap = reduce(lambda a, b: a + b, terms[1]) - reduce(lambda a, b: a + b, terms[0])
    return gap * F.when(loose_odd, F.lit(1.0)).otherwise(F.lit(-1.0))


def ratio_to(varied: Column, nominal: Column) -> Column:
    """Variation relative to its nominal; zero where the nominal is zero, unknown where it is unknown."""
    return F.when(nominal == 0, F.lit(0.0)).otherwise(F.try_divide(varied, nominal))


def efficiency_sf(data: Column, mc: Column, err_data: Column, err_mc: Column) -> tuple[Column, Column]:
    """data / mc with propagated error; 1 with no error where mc is zero."""
    sf = F.when(mc != 0, F.try_divide(data, mc)).otherwise(F.lit(1.0))
    a = F.try_divide(err_data, mc)
    b = F.try_divide(data * err_mc, mc * mc)
    return sf, F.when(mc != 0, F.sqrt(a * a + b * b)).otherwise(F.lit(0.0))


def tag_factor(tagged: Column, sf: Column, eff: Column) -> Column:
    """Per-jet factor of a fixed working point: SF if tagged, else (1 - eff SF) / (1 - eff)."""
    untagged = F.when(eff == 1.0, F.lit(1.0)).otherwise(F.try_divide(1 - eff * sf, 1 - eff))
    return F.when(tagged, sf).otherwise(untagged)


def shape_sf(syst: str, sf: Column, flavour: Column, eta: Column, pt: Column, score: Column,
             min_pt: float = 20.0, max_eta: float = 2.5) -> Column:
    """Shape scale factor of one jet; 1 where the systematic does not concern the jet."""
    skip = (pt < min_pt) | (F.abs(eta) > max_eta) | (score < 0.0) | F.isnan(score) | (score > 19.999)
    if "jes" in syst:
        skip = skip | (flavour != 0)
    if "cferr" in syst:
        skip = skip | (flavour != 4)
    elif "hf" in syst or "lf" in syst:
        skip = skip | (flavour == 4)
    return F.when(skip, F.lit(1.0)).otherwise(sf)


def top_pt_weight(top: Column, antitop: Column) -> Column:
    """Square root of the product of both quarks' factors; 1 unless both momenta are known."""
    # Measured dependence on the top quark's pt
    a, b, c, d = 0.103, -0.0118, -0.000134, 0.973

    def f(pt):
        return a * F.exp(b * pt) + c * pt + d

    return F.when(top * antitop > 0, F.sqrt(F.abs(f(top) * f(antitop)))).otherwise(F.lit(1.0))


# Fixed values per generator order: norm, erf amplitude, erf centre, erf width, slope, plateau; and
# the momentum where the turn-on ends
DY_PTLL = {
    "NLO": (1.062955818914, -0.0775395733886, 14.4141170861, 7.10247643949, -0.00091236718546, 0.853848155607),
    "LO": (1.063362210877, -0.0553940992672, 11.2183081709, 3.87755429192, 0.000493004133573, 0.908504652392),
}
DY_PTLL_END = 40.0


def dy_ptll_weight(gen_pt: Column, n_gen_jets: Column, order: str = "NLO") -> Column:
    """Dilepton-momentum correction for events without generator jets."""
    norm, amp, mid, width, slope, flat = DY_PTLL[order]

    def curve(x):
        return amp * erf((x - mid) / width) + slope * x

    rising = curve(gen_pt) - curve(F.lit(DY_PTLL_END)) + flat
    value = norm * F.when(gen_pt < DY_PTLL_END, rising).otherwise(F.lit(flat))
    return F.when(n_gen_jets == 0, value).otherwise(F.lit(1.0))


def curve_by_category(category: Column, curves: dict[int, Curve], x: Column) -> Column:
    """Interpolated weight from the category's own curve, x capped at its end; 1 without a curve."""
    out = F.lit(1.0)
    for c, curve in curves.items():
        out = F.when(category == c, curve.at(x)).otherwise(out)
    return out


def kfactor(mass: Column, nominal: Curve, ups: list[Curve], downs: list[Curve]) -> tuple[Column, Column, Column]:
    """K-factor at a mass with the relative shifts of its sources added in quadrature."""
    k = nominal.at(mass)

    def total(curves):
        squares = [F.pow(F.try_divide(c.at(mass) - k, k), 2) for c in curves]
        return k * F.sqrt(reduce(lambda a, b: a + b, squares))

    return k, k + total(ups), k - total(downs)


# Gluon-fusion cross-sections by jet bin (pb), and absolute uncertainties (pb) of the
# yield, resummation, 0-1 and 1-2 jet migration sources for 0, 1 and at least 2 jets
GGF_SIGMA = {0: 30.117, 1: 12.928, 2: 5.475 - 0.630}
GGF_SOURCES = {
    "mu": (1.12, 0.66, 0.42),
    "res": (0.03, 0.57, 0.42),
    "mig01": (-1.22, 1.00, 0.21),
    "mig12": (0.0, -0.86, 0.86),
}
GGF_SCALE = 48.52 / 47.4
GGF_VBF2J = {101: 0.200, 102: 0.200}
GGF_VBF3J = {101: -0.320, 102: 0.235}


def ggf_uncertainties(njets: Column, pt: Column, stxs: Column) -> list[Column]:
    """Relative one-sigma shifts of the nine sources, in their fixed order.

    Order: mu, res, mig01, mig12, vbf2j, vbf3j, pT60, pT120, qm_t.
    """
    def by_stxs(table):
        out = F.lit(0.0)
        for code, value in table.items():
            out = F.when(stxs == code, F.lit(value)).otherwise(out)
        return out

    vbf3 = by_stxs(GGF_VBF3J)
    jet_bin = F.least(njets, F.lit(2))
    out = []
    for values in GGF_SOURCES.values():
        shift = F.lit(None).cast("double")
        for b, v in enumerate(values):
            shift = F.when(jet_bin == b, F.lit(v * (GGF_SCALE / GGF_SIGMA[b]))).otherwise(shift)
        # the topology's own sources replace the jet-bin ones
        out.append(F.when(vbf3 != 0, F.lit(0.0)).otherwise(shift))
    out += [by_stxs(GGF_VBF2J), vbf3]
    out.append(F.when(njets == 0, 0.0).when(njets == 1, interpol(pt, 20.0, -0.1, 100.0, 0.1))
               .otherwise(interpol(pt, 0.0, -0.1, 180.0, 0.10)))
    out.append(F.when(njets == 0, 0.0).otherwise(interpol(pt, 90.0, -0.016, 160.0, 0.14)))
    out.append(interpol(pt, 160.0, 0.0, 500.0, 0.37))
    return out


# Names in the order in which the source list is read.  The names after the fourth do
# not follow the order of the sources above; results keep this pairing.
GGF_NAMES = ["ggH_mu", "ggH_res", "ggH_mig01", "ggH_mig12", "ggH_pT60", "ggH_pT120",
             "ggH_VBF2j", "ggH_VBF3j", "ggH_qmtop"]


def ggf_weights(njets: Column, pt: Column, stxs: Column, n_sigma: float = 1.0) -> dict[str, Column]:
    """Weight per named source, ``n_sigma`` standard deviations away."""
    shifts = ggf_uncertainties(njets, pt, stxs)
    return {name: 1.0 + n_sigma * shift for name, shift in zip(GGF_NAMES, shifts)}


def interference_ratio(lo: Column, total: Column, hi: Column, guard: float = 0.0) -> tuple[Column, Column]:
    """((total - lo - hi) / (lo + hi), total / (lo + hi)), guarded where the sum vanishes."""
    s = lo + hi
    return (F.coalesce(F.try_divide(total - lo - hi, s), F.lit(guard)),
            F.coalesce(F.try_divide(total, s), F.lit(1.0)))


def clipped(weight: Column, limit: float, norm: float) -> Column:
    return F.when(weight < limit, weight).otherwise(F.lit(0.0)) / F.lit(norm)


def polarisation_fractions(c1: Column, c2: Column, cosphi: Column, k: Column) -> dict[str, Column]:
    """Shares of longitudinal, transverse and interference terms for left-handed couplings.

    The common coupling factor drops out of every ratio; NULL where the terms cancel.
    """
    s1, s2 = F.sqrt(1 - c1 * c1), F.sqrt(1 - c2 * c2)
    ll = 16 * k * k * s1 * s1 * s2 * s2
    minus, plus = (1 - c1) * (1 - c2), (1 + c1) * (1 + c2)
    tt = 4 * minus * minus + 4 * plus * plus + 8 * s1 * s1 * s2 * s2 * (2 * cosphi * cosphi - 1)
    mixed = -16 * k * (minus + plus) * s1 * s2 * cosphi
    # where the interference cancels everything the shares are not defined
    full = ll + tt + mixed
    total = F.when(full > 1e-9 * (ll + tt), full)
    return {"LL": ll / total, "TT": tt / total, "Int": mixed / total, "TTInt": (tt + mixed) / total}
