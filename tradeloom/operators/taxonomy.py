"""Categories of a trailer's bill of materials, and which of them a supplier's words show."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Category(NamedTuple):
    key: str
    label: str
    group: str
    tier: str
    include: tuple[str, ...]
    exclude: tuple[str, ...] = ()

    @property
    def target(self) -> int:
        return TARGETS[self.tier]

    @property
    def strong(self) -> tuple[str, ...]:
        """Words that count even beside an excluding one."""
        return tuple(t for t in self.include if not any(e in t for e in self.exclude))


#: Suppliers wanted per tier.
TARGETS = {"A": 60, "B": 40, "C": 25}

#: Key, label, group, tier, words that show the category, words that veto it unless a strong word stands beside them.
CATEGORIES = (
    Category("axles", "Axles (braked/unbraked)", "Running gear", "A", ("axle", "stub axle", "beam axle", "torsion axle")),
    Category("suspension", "Suspension & springs", "Running gear", "A", ("leaf spring", "suspension", "rubber torsion", "spring seat", "u-bolt", "shackle", "spring bolt", "spring bush"), ("air spring", "air suspension")),
    Category("brakes", "Brakes & drums", "Running gear", "A", ("brake", "drum", "brake shoe", "brake lining", "autoreverse", "brake cable"), ("air brake", "disc brake caliper", "ebs", "abs module")),
    Category("hubs_bearings", "Hubs & bearings", "Running gear", "B", ("hub", "bearing", "wheel bearing", "hub unit", "grease cap")),
    Category("wheels_tyres", "Wheels & tyres", "Running gear", "B", ("wheel rim", "steel wheel", "tyre", "tire", "wheel nut", "road wheel")),
    Category("couplings", "Couplings & hitches", "Drawgear", "A", ("coupling", "hitch", "towing eye", "drawbar eye", "ball hitch", "overrun", "tow ball", "r55"), ("fifth-wheel", "fifth wheel", "kingpin")),
    Category("jockey_props", "Jockey wheels & props", "Drawgear", "B", ("jockey", "prop stand", "corner steady", "support leg", "landing leg")),
    Category("breakaway", "Breakaway cables & chains", "Drawgear", "C", ("breakaway", "safety chain", "break-away")),
    Category("drawbars", "Drawbars & A-frames", "Drawgear", "B", ("drawbar", "a-frame", "towing frame", "chassis beam")),
    Category("chassis_steel", "Chassis steel & sections", "Body", "B", ("chassis", "steel section", "rhs", "channel section", "hot rolled", "galvanised steel")),
    Category("flooring", "Flooring & decking", "Body", "B", ("floor", "phenolic", "plywood", "decking", "aluminium plank", "chequer plate", "checker plate")),
    Category("panels_mesh", "Side panels, mesh & gates", "Body", "B", ("mesh", "side panel", "gate", "sheeting", "louvre", "aluminium panel", "sideboard")),
    Category("ramps", "Ramps & tailgates", "Body", "A", ("ramp", "tailgate", "tail lift", "loading ramp", "ramp spring", "gas strut")),
    Category("mudguards", "Mudguards & wings", "Body", "C", ("mudguard", "mudflap", "wing", "fender", "splash guard")),
    Category("canopy", "Canopies, hoops & covers", "Body", "B", ("canopy", "tarpaulin", "cover", "hoop", "curtain", "roof bow", "pvc fabric")),
    Category("hinges", "Hinges", "Hardware", "B", ("hinge", "butt hinge", "weld-on hinge", "pivot")),
    Category("locks_catches", "Locks, catches & latches", "Hardware", "B", ("lock", "latch", "catch", "over-centre", "overcentre", "fastener clamp", "toggle clamp", "hasp", "padlock")),
    Category("lashing", "Lashing rings & load restraint", "Hardware", "B", ("lashing", "load restraint", "tie down", "tie-down", "ratchet strap", "d-ring", "anchor point", "rope hook")),
    Category("fasteners", "Fasteners & fixings", "Hardware", "C", ("bolt", "nut", "rivet", "screw", "washer", "fastener")),
    Category("winches", "Winches & recovery", "Hardware", "C", ("winch", "hand winch", "recovery strap", "snatch block")),
    Category("handles", "Handles & grab rails", "Hardware", "C", ("handle", "grab rail", "grab handle", "step", "footplate")),
    Category("lighting", "Lighting (rear, marker, LED)", "Electrical", "A", ("lamp", "light", "led", "indicator", "reflector", "turn signal", "tail light")),
    Category("wiring", "Wiring looms & connectors", "Electrical", "B", ("wiring", "loom", "harness", "connector", "7-pin", "13-pin", "junction box", "socket", "plug")),
    Category("hydraulics", "Hydraulic rams & power packs", "Hydraulics", "B", ("hydraulic", "cylinder", "ram", "power pack", "tipping gear", "hydraulic pump")),
    Category("hoses", "Hoses & fittings", "Hydraulics", "C", ("hose", "hydraulic fitting", "coupler", "quick release")),
    Category("coatings", "Paint, coatings & galvanising", "Finishing", "C", ("paint", "coating", "galvanis", "galvaniz", "powder coat", "zinc plating", "e-coat")),
    Category("rubber_seals", "Rubber & seals", "Finishing", "C", ("rubber", "seal", "gasket", "grommet", "buffer", "bump stop")),
    Category("plastics", "Plastic mouldings", "Finishing", "C", ("moulding", "molding", "injection", "rotational mould", "plastic component")),
)


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(map(re.escape, words))) if words else F.lit(False)


def shows(text: Column, category: Category) -> Column:
    """Whether a lower-case text shows a category; null text gives null."""
    if not category.exclude:
        return _any(text, category.include)
    return F.when(_any(text, category.exclude), _any(text, category.strong)).otherwise(_any(text, category.include))


def categories_of(text: Column) -> Column:
    """Keys of the categories that a lower-case text shows, in fixed order; null text gives none."""
    return F.array_compact(F.array(*[F.when(shows(text, c), F.lit(c.key)) for c in CATEGORIES]))


def haystack(*arrays_and_name: str) -> Column:
    """The words of array columns and, last, a name column as one lower-case text, parts kept apart."""
    *arrays, name = arrays_and_name
    return F.lower(F.concat_ws(" || ", *[F.coalesce(a, F.array().cast("array<string>")) for a in arrays], name))


def status(total: Column, target: Column) -> Column:
    return F.when(total == 0, "EMPTY").when(total >= target, "OK").when(total >= target * 0.5, "THIN").otherwise("CRITICAL")
