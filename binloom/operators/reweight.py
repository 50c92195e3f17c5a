"""Event weights that need several look-ups per lepton, computed in projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from binloom.config import Edges
from binloom.functions.bins import bin_index
from binloom.functions.kinematics import P4
from binloom.functions.lookup import BinnedMap, MapSet
from binloom.functions.weights import (
    ELECTRON, MUON, fake_combination, ratio_to, tight_loose_probability,
)
from binloom.operators.scratch import Scratch

# Fixed value: fake rates are read at most at this pt
FAKE_PT_MAX = 35.0
# Limits of the charge-misidentification map
FLIP_ETA_MAX, FLIP_PT_MIN, FLIP_PT_MAX = 2.49, 10.0, 199.0
# Limits of the lepton scale-factor maps, per flavour (eta low, eta high, pt low, pt high)
SF_LIMITS = {ELECTRON: (-2.5, 2.49, 15.0, 499.0), MUON: (-2.4, 2.39, 10.1, 119.9)}


def _clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(x, F.lit(hi)), F.lit(lo))


def _fields(s: Scratch, lep: str, n: int) -> list[tuple[Column, Column, Column]]:
    """(pt, eta, |pdgId|) of the first n leptons as plain columns."""
    objs = [F.get(F.col(lep), F.lit(i)) for i in range(n)]
    flat = s.put([c for o in objs for c in (o["pt"], o["eta"], F.abs(o["pdgId"]))])
    return [tuple(flat[3 * i:3 * i + 3]) for i in range(n)]


def _bins(s: Scratch, coords: list[tuple[Column, Column]], m: BinnedMap) -> list[tuple[Column, Column]]:
    """Bin numbers of several points on the axes of one map."""
    xy = s.put([c for pair in coords for c in pair])
    axes = (Edges(m.x_edges), Edges(m.y_edges))
    idx = s.put([bin_index(c, axes[i % 2]) for i, c in enumerate(xy)])
    return [(idx[2 * i], idx[2 * i + 1]) for i in range(len(coords))]


def with_rates(s: Scratch, leps, maps: dict[int, BinnedMap], pt_max: float | None, what=("value",)) -> list[list[Column]]:
    """Map content(s) per lepton at (min(pt, pt_max), |eta|), by flavour.

    Without ``pt_max`` the centre of the last pt bin caps pt.
    """
    out: list[list[Column]] = [[F.lit(0.0) for _ in what] for _ in leps]
    for flavour, m in maps.items():
        cap = m.last_centre_x() if pt_max is None else pt_max
        bins = _bins(s, [(F.least(pt, F.lit(cap)), F.abs(eta)) for pt, eta, _ in leps], m)
        for i, (ix, iy) in enumerate(bins):
            out[i] = [F.when(leps[i][2] == flavour, m.at_bins(ix, iy, w)).otherwise(prev)
                      for w, prev in zip(what, out[i])]
    flat = s.put([c for row in out for c in row])
    return [flat[len(what) * i:len(what) * (i + 1)] for i in range(len(leps))]


# Jet-pt thresholds of the fake-rate maps per number of leptons: (electron, muon) of the nominal weight, and what
# the up and down variations read instead
FAKE_JETS = {2: ((35, 25), {"EleUp": (45, 25), "EleDown": (25, 25), "MuUp": (35, 35), "MuDown": (35, 15)}),
             3: ((35, 35), {"EleUp": (45, 35), "EleDown": (25, 35), "MuUp": (35, 45), "MuDown": (35, 25)})}
FAKE_STATS = {"StatEleUp": {ELECTRON: 1}, "StatEleDown": {ELECTRON: -1}, "StatMuUp": {MUON: 1}, "StatMuDown": {MUON: -1}}
FAKE_EWK = ("EWK5Up", "EWK5Down")


def fake_variants(electron: dict, muon: dict, leptons: int) -> dict[str, tuple[dict[int, BinnedMap], dict[int, int]]]:
    """The nominal fake weight and its variations as variants of ``fake_weights``.

    ``electron`` and ``muon`` hold a map per jet-pt threshold, and for the electroweak variations one per (threshold, name).
    """
    (e, m), jets = FAKE_JETS[leptons]
    nominal = {ELECTRON: electron[e], MUON: muon[m]}
    out = {"nominal": (nominal, {})}
    out |= {name: ({ELECTRON: electron[x], MUON: muon[y]}, {}) for name, (x, y) in jets.items()}
    out |= {name: (nominal, shift) for name, shift in FAKE_STATS.items()}
    out |= {name: ({ELECTRON: electron[e, name], MUON: muon[m, name]}, {}) for name in FAKE_EWK if (e, name) in electron and (m, name) in muon}
    return out


def fake_ratios(df: DataFrame, lep: str, tight: list[Column], prompt: dict[int, BinnedMap], electron: dict, muon: dict) -> DataFrame:
    """The nominal fake weight and each variation as its ratio to it, 0 where the nominal weight is 0."""
    variants = fake_variants(electron, muon, len(tight))
    out = fake_weights(df, lep, tight, prompt, variants)
    return out.withColumns({n: ratio_to(F.col(n), F.col("nominal")) for n in variants if n != "nominal"})


def fake_weights(df: DataFrame, lep: str, tight: list[Column], prompt: dict[int, BinnedMap],
                 variants: dict[str, tuple[dict[int, BinnedMap], dict[int, int]]]) -> DataFrame:
    """Fake-lepton weights of the leading leptons, one column per variant.

    A variant is (fake-rate maps, {flavour: errors to add}).  Electrons and muons have their own
    maps; any other flavour counts as prompt for certain.  Maps on the same edges are read together, with one bin search per lepton.
    """
    n = len(tight)
    s = Scratch(df)
    leps = _fields(s, lep, n)
    tights = s.put(tight)
    known = [flav.isin(ELECTRON, MUON) for _, _, flav in leps]
    p = with_rates(s, leps, prompt, None)
    p = s.put([F.when(k, row[0]).otherwise(F.lit(1.0)) for k, row in zip(known, p)])
    # per flavour the distinct maps, by their edges
    sets: dict[tuple, dict[str, BinnedMap]] = {}
    for maps, _ in variants.values():
        for flavour, m in maps.items():
            own = sets.setdefault((flavour, m.x_edges, m.y_edges), {})
            if m not in own.values():
                own[f"m{len(own)}"] = m
    read = {}
    for key, own in sets.items():
        bins = _bins(s, [(F.least(pt, F.lit(FAKE_PT_MAX)), F.abs(eta)) for pt, eta, _ in leps], next(iter(own.values())))
        read[key] = s.put([MapSet(own).at_bins(ix, iy) for ix, iy in bins])
    result = {}
    for name, (maps, shift) in variants.items():
        f = []
        for i in range(n):
            rate = F.lit(0.0)
            for flavour, m in maps.items():
                key = (flavour, m.x_edges, m.y_edges)
                field = next(k for k, v in sets[key].items() if v == m)
                here = read[key][i][field] + F.lit(float(shift.get(flavour, 0))) * read[key][i][f"{field}_error"]
                rate = F.when(leps[i][2] == flavour, F.coalesce(here, F.lit(0.0))).otherwise(rate)
            f.append(rate)
        f = s.put(f)
        probs = s.put([c for i in range(n) for c in tight_loose_probability(p[i], f[i], tights[i])])
        result[name], = s.put([fake_combination(probs[0::2], probs[1::2], tights)])
    return s.done(result)


def charge_flip(df: DataFrame, lep: str, central: BinnedMap, syst: BinnedMap, n: int = 2) -> DataFrame:
    """Probability that exactly one electron has the wrong charge, and its error.

    Columns ``flip`` and ``flip_err``.  Map axes are (|eta|, pt).  One without electrons among the
    first ``n`` (at most two) leptons; muons never flip.
    """
    if n > 2:
        raise ValueError("the exactly-one-flip probability is defined for up to two leptons")
    s = Scratch(df)
    leps = _fields(s, lep, n)
    bins = _bins(s, [(F.least(F.abs(eta), F.lit(FLIP_ETA_MAX)), _clamp(pt, FLIP_PT_MIN, FLIP_PT_MAX))
                     for pt, eta, _ in leps], central)
    is_e = s.put([F.coalesce(flav == ELECTRON, F.lit(False)) for _, _, flav in leps])
    p = s.put([F.when(e, central.at_bins(*b)).otherwise(F.lit(0.0)) for e, b in zip(is_e, bins)])
    d = s.put([F.when(e, syst.at_bins(*b)).otherwise(F.lit(0.0)) for e, b in zip(is_e, bins)])
    # a muon enters as an electron that never flips, which leaves the other one's term alone
    value, var, any_e = p[0], d[0] * d[0], is_e[0]
    if n == 2:
        value = p[0] * (1 - p[1]) + (1 - p[0]) * p[1]
        a, b = s.put([(1 - 2 * p[1]) * d[0], (1 - 2 * p[0]) * d[1]])
        var, any_e = a * a + b * b, is_e[0] | is_e[1]
    return s.done({"flip": F.when(any_e, value).otherwise(F.lit(1.0)),
                   "flip_err": F.when(any_e, F.sqrt(var)).otherwise(F.lit(0.0))})


def lepton_sf(df: DataFrame, lep: str, maps: dict[int, tuple[BinnedMap, BinnedMap, BinnedMap]], n: int = 2) -> DataFrame:
    """Product of lepton scale factors and its per-flavour variations relative to it.

    Columns nominal, eleUp, eleDown, muUp, muDown.  ``maps`` gives per flavour (value, statistical,
    systematic) on (eta, pt), all on the same edges.
    """
    s = Scratch(df)
    leps = _fields(s, lep, n)
    sf, err = [F.lit(1.0)] * n, [F.lit(0.0)] * n
    for flavour, (value, stat, syst) in maps.items():
        lo, hi, pt_lo, pt_hi = SF_LIMITS[flavour]
        bins = _bins(s, [(_clamp(eta, lo, hi), _clamp(pt, pt_lo, pt_hi)) for pt, eta, _ in leps], value)
        parts = s.put([m.at_bins(*b) for b in bins for m in (value, stat, syst)])
        for i in range(n):
            here = leps[i][2] == flavour
            v, a, b = parts[3 * i:3 * i + 3]
            sf[i] = F.when(here, v).otherwise(sf[i])
            err[i] = F.when(here, F.sqrt(a * a + b * b)).otherwise(err[i])
    sf = s.put(sf)
    rel = s.put([e / F.when(v == 0, F.lit(1.0)).otherwise(v) for e, v in zip(err, sf)])
    out = {"nominal": F.lit(1.0)}
    for v in sf:
        out["nominal"] = out["nominal"] * v
    for name, flavour in (("ele", ELECTRON), ("mu", MUON)):
        for side, sign in (("Up", 1.0), ("Down", -1.0)):
            total = F.lit(1.0)
            for i in range(n):
                total = total * F.when(leps[i][2] == flavour, 1.0 + sign * rel[i]).otherwise(F.lit(1.0))
            out[name + side] = total
    return s.done(out)


def _dot(a: P4, b: P4) -> Column:
    return a.e * b.e - a.px * b.px - a.py * b.py - a.pz * b.pz


def decay_angles(df: DataFrame, a1: P4, b1: P4, a2: P4, b2: P4) -> DataFrame:
    """Columns cos1, cos2, cosphi, kappa of two bosons decaying to (a, b).

    cos_i is the angle of a_i in its boson's rest frame to the boson's flight direction in the
    frame where the pair is at rest; cosphi lies between the decay planes; kappa measures how far
    the pair is above threshold.  All follow from products of four-vectors, so no boosts or
    rotations are carried out.  NULL where a boson has no mass.
    """
    s = Scratch(df)

    def hold(*vs: P4) -> list[P4]:
        flat = s.put([c for v in vs for c in (v.px, v.py, v.pz, v.e)])
        return [P4(*flat[4 * i:4 * i + 4]) for i in range(len(vs))]

    def root(c: Column) -> Column:
        return F.sqrt(F.greatest(c, F.lit(0.0)))

    def unit(c: Column) -> Column:
        return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(1.0)), F.lit(-1.0)))

    a1, b1, a2, b2 = hold(a1, b1, a2, b2)
    w1, w2 = hold(a1 + b1, a2 + b2)
    h, = hold(w1 + w2)
    # collinear massless products leave no boson mass, hence no rest frame
    mh, m1, m2 = s.put([F.when(_dot(v, v) > 1e-12 * v.e * v.e, F.sqrt(F.abs(_dot(v, v)))) for v in (h, w1, w2)])
    # energies in the pair's rest frame
    ea1, ea2, ew1, ew2 = s.put([F.try_divide(_dot(v, h), mh) for v in (a1, a2, w1, w2)])

    def cosine(a, w, m, e_a, e_w):
        e_star, p_w = s.put([F.try_divide(_dot(a, w), m), root(e_w * e_w - m * m)])
        p_star, = s.put([root(e_star * e_star - _dot(a, a))])
        return unit(F.try_divide(e_a * m - e_w * e_star, p_w * p_star))

    c1, c2 = cosine(a1, w1, m1, ea1, ew1), cosine(a2, w2, m2, ea2, ew2)
    # products of three-vectors in that frame, then their parts across the flight axis
    a11, a22, a12, a1w, a2w, ww = s.put([
        ea1 * ea1 - _dot(a1, a1), ea2 * ea2 - _dot(a2, a2), ea1 * ea2 - _dot(a1, a2),
        ea1 * ew1 - _dot(a1, w1), ea2 * ew1 - _dot(a2, w1), ew1 * ew1 - _dot(w1, w1)])
    x11, x22, x12 = s.put([u - F.try_divide(v, ww) for u, v in ((a11, a1w * a1w), (a22, a2w * a2w), (a12, a1w * a2w))])
    cosphi = unit(F.try_divide(x12, F.sqrt(F.abs(x11 * x22))))
    return s.done({"cos1": c1, "cos2": c2, "cosphi": cosphi,
                   "kappa": F.try_divide(mh * mh - m1 * m1 - m2 * m2, 2 * m1 * m2)})
