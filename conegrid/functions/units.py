"""Units of measure: families with exact factors to their anchor, mostly made from SI prefixes by rule."""

from __future__ import annotations

import re
from fractions import Fraction

# Powers of ten of the SI prefixes, and definitions of the units.
PREFIXES = {"p": -12, "f": -15, "n": -9, "u": -6, "m": -3, "c": -2, "d": -1, "": 0, "h": 2, "k": 3, "M": 6, "G": 9, "T": 12, "P": 15, "E": 18}
#: family, anchor; base=factor with its prefixes (_ is none); further units in terms of those before them.
FAMILIES = """
mass kg; g=1/1000 n,u,m,_,k; t=1000kg lb=0.45359237kg gr=1lb/7000 oz=1lb/16 st=14lb cwt=112lb ust=2000lb lt=2240lb ct=1kg/5000 ozt=0.0311034768kg
length m; m=1 f,p,n,u,m,c,d,_,k; angstrom=1m/10000000000 in=0.0254m mil=1in/1000 ft=12in yd=36in mi=63360in nmi=1852m au=149597870700m ly=9460730472580800m ftm=72in ch=792in fur=7920in
duration s; s=1 n,u,m,_; min=60s h=3600s d=86400s wk=7d a=31557600s
area m2; m2=1 _; mm2=1m2/1000000 cm2=1m2/10000 ha=10000m2 km2=1000000m2 in2=0.00064516m2 ft2=144in2 yd2=9ft2 ac=43560ft2 mi2=640ac
volume m3; m3=1 _; L=1m3/1000 mL=1L/1000 uL=1mL/1000 in3=0.000016387064m3 ft3=1728in3 gal=231in3 floz=1gal/128 pt=1gal/8 qt=1gal/4 igal=0.00454609m3 ifloz=1igal/160 ipt=1igal/8 iqt=1igal/4 tsp=1gal/768 tbsp=1gal/256 cup=1gal/16 bbl=42gal bu=2150.42in3
speed mps; mps=1 _; kmh=5mps/18 mph=0.44704mps kn=463mps/900 fps=0.3048mps c=299792458mps
pressure Pa; Pa=1 _,h,k,M; mbar=100Pa bar=100000Pa atm=101325Pa mmHg=133.322387415Pa Torr=101325Pa/760 inHg=25.4mmHg psi=44482216152605Pa/6451600000
force N; N=1 u,m,_,k; lbf=4.4482216152605N
energy J; J=1 _,k,M,G; Wh=3600J kWh=1000Wh cal=4.184J kcal=1000cal BTU=1055.05585262J thm=105505585.262J eV=0.0000000000000000001602176634J keV=1000eV MeV=1000keV GeV=1000MeV TeV=1000GeV
power W; W=1 u,m,_,k,M,G; hp=745.69987158227022W PS=735.49875W
frequency Hz; Hz=1 u,m,_,k,M,G; rpm=1Hz/60
temperature K; K=1 u,m,_; Ra=5K/9
current A; A=1 p,n,u,m,_,k;
charge coulomb; coulomb=1 _; pC=1coulomb/1000000000000 nC=1000pC uC=1000nC mC=1000uC mAh=3.6coulomb Ah=1000mAh
voltage V; V=1 u,m,_,k,M;
resistance ohm; ohm=1 u,m,_,k,M;
capacitance farad; farad=1 _; pF=1farad/1000000000000 nF=1000pF uF=1000nF mF=1000uF
inductance H; H=1 n,u,m,_;
conductance sie; sie=1 u,m,_;
magnetic-flux Wb; Wb=1 n,u,m,_;
flux-density T; T=1 u,m,_;
luminous-intensity cd; cd=1 u,m,_;
luminous-flux lm; lm=1 u,m,_;
illuminance lx; lx=1 u,m,_;
amount mol; mol=1 p,n,u,m,_;
catalytic-activity kat; kat=1 n,u,m,_;
radioactivity Bq; Bq=1 _,k,M,G; Ci=37000000000Bq
absorbed-dose Gy; Gy=1 u,m,_;
dose-equivalent Sv; Sv=1 u,m,_; rem=1Sv/100
optical-power dpt; dpt=1 _;
angle deg; deg=1 _; mas=1deg/3600000 arcsec=1000mas arcmin=60arcsec grad=9deg/10 turn=360deg
information bit; bit=1 _,k,M,G,T; b=1bit B=8bit kB=1000B MB=1000kB GB=1000MB TB=1000GB PB=1000TB EB=1000PB KiB=1024B MiB=1024KiB GiB=1024MiB TiB=1024GiB PiB=1024TiB EiB=1024PiB
data-rate bps; bps=1 _,k,M,G,T; Bps=8bps kBps=1000Bps MBps=1000kBps GBps=1000MBps
compute-rate FLOPS; FLOPS=1 _,M,G,T,P,E;
count ; =1 _; pct=1/100 ppm=1/1000000 bp=1/10000 dz=12
"""
#: Scales with an offset: unit to (family, factor, offset).
AFFINE = {u: ("temperature", Fraction(1), Fraction(27315, 100)) for u in ("C", "degC")} | {u: ("temperature", Fraction(5, 9), Fraction(45967, 180)) for u in ("F", "degF")}
_DEFINED = re.compile(r"(\d+(?:\.\d+)?)([A-Za-z]\w*)?(?:/(\d+))?")

Units = dict[str, tuple[str, Fraction]]


def amount_of(text: str, units: Units) -> tuple[str, Fraction] | None:
    """(family, factor) of a definition such as 12in or 1lb/7000; None if it names no known unit."""
    m = _DEFINED.fullmatch(text)
    base = units.get(m[2] or "", ("count", Fraction(1)) if m and not m[2] else None) if m else None
    return base and (base[0], Fraction(m[1]) * base[1] / int(m[3] or 1))


def _built() -> tuple[Units, dict[str, str]]:
    units: Units = {}
    anchors: dict[str, str] = {}
    for line in FAMILIES.strip().splitlines():
        named, made, more = (x.strip() for x in line.split(";"))
        family, _, anchor = named.partition(" ")
        anchors[family] = anchor
        base, _, prefixes = made.partition(" ")
        unit, factor = base.split("=")
        for p in prefixes.split(","):
            p = p.strip("_")
            units[p + unit] = (family, Fraction(factor) * Fraction(10) ** PREFIXES[p])
        for definition in more.split():
            unit, value = definition.split("=")
            units[unit] = (family, amount_of(value, units)[1])
    return units, anchors


UNITS, ANCHORS = _built()


def resolve(names: list[str], units: Units = UNITS) -> tuple[Units, dict[str, str]]:
    """The units with those that a graph declares by unit-family(NAME) and unit(SPELL=AMOUNT), chains of
    declarations followed; and, by spelling, what is wrong with those that cannot be had."""
    out, todo, wrong = dict(units), [], {}
    for n in names:
        kind, _, body = n.rstrip(")").partition("(")
        if kind == "unit-family":
            out.setdefault(body, (body, Fraction(1)))
        elif kind == "unit" and "=" in body:
            todo.append(tuple(body.split("=", 1)))
    while todo:
        known = [(spell, amount_of(value, out)) for spell, value in todo]
        done = [(spell, found) for spell, found in known if found]
        if not done:
            return out, wrong | {spell: f"unit {spell}={value} is never resolved" for spell, value in todo}
        for spell, found in done:
            if out.setdefault(spell, found) != found:
                wrong[spell] = f"unit {spell} is defined twice"
        todo = [t for t, (_, found) in zip(todo, known, strict=True) if not found]
    return out, wrong


def declared(names: list[str], units: Units = UNITS) -> Units:
    """The units with those that a graph declares. ValueError for one that is never resolved or that redefines a unit."""
    out, wrong = resolve(names, units)
    if wrong:
        raise ValueError("; ".join(wrong[spell] for spell in sorted(wrong)))
    return out
