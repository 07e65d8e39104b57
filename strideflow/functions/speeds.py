"""Speeds and travel times of links as Column expressions, parameterised by a profile."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

PATHS = ("cycleway", "path", "track", "bridleway", "footway", "pedestrian", "steps", "elevator")
CARS = ("motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "unclassified", "residential", "living_street", "service", "road")

# Fixed values, as they are published: kilometres an hour by highway, factors by
# surface, the road classes' and facilities' costs a kilometre, waits and
# penalties in seconds.
WALK_HIGHWAY = {
    "steps": 1.2, "elevator": 1.0, "path": 4.3, "track": 4.3, "bridleway": 4.0, "corridor": 4.5, "footway": 4.8, "pedestrian": 4.8, "living_street": 4.8,
    "residential": 4.8, "service": 4.8, "cycleway": 4.8, "unclassified": 4.8, "tertiary": 4.8, "tertiary_link": 4.8, "secondary": 4.8, "secondary_link": 4.8,
    "primary": 4.7, "primary_link": 4.7, "trunk": 4.5, "trunk_link": 4.5,
}
WALK_SURFACE = {
    "asphalt": 1.0, "concrete": 1.0, "paved": 1.0, "paving_stones": 0.98, "compacted": 0.98, "fine_gravel": 0.97, "wood": 0.95, "gravel": 0.92, "cobblestone": 0.90,
    "sett": 0.90, "unpaved": 0.92, "ground": 0.88, "dirt": 0.88, "earth": 0.88, "grass": 0.85, "snow": 0.80, "ice": 0.75, "sand": 0.75, "mud": 0.70,
}
BIKE_HIGHWAY = {
    "steps": 1.2, "elevator": 1.0, "cycleway": 18.0, "path": 11.0, "track": 10.0, "bridleway": 8.0, "footway": 4.0, "pedestrian": 6.0, "corridor": 5.0,
    "living_street": 13.0, "residential": 18.0, "service": 16.0, "unclassified": 18.0, "tertiary": 18.0, "tertiary_link": 16.0, "secondary": 18.0, "secondary_link": 16.0,
    "primary": 18.0, "primary_link": 16.0, "trunk": 18.0, "trunk_link": 16.0,
}
BIKE_SURFACE = {
    "asphalt": 1.0, "concrete": 1.0, "paved": 1.0, "paving_stones": 0.90, "compacted": 0.87, "fine_gravel": 0.87, "wood": 0.80, "gravel": 0.70, "unpaved": 0.70,
    "cobblestone": 0.65, "sett": 0.65, "ground": 0.60, "dirt": 0.60, "earth": 0.60, "grass": 0.50, "snow": 0.45, "sand": 0.40, "mud": 0.40, "ice": 0.35,
}
ROAD_BETA = {"living_street": 4.96, "residential": 4.96, "tertiary": 4.96, "tertiary_link": 4.96, "secondary": 4.14, "secondary_link": 4.14, "primary": 4.05, "primary_link": 4.05}
SEPARATED_BETA, TRACK, LANE, MIXED, REFERENCE_COST = 2.61, 0.966, 1.142, 1.927, 7.57
TRAFFIC, ROUTE_KM, SHARED_PATH, SIDEPATH = 0.014, 5.6, 0.95, 2.0
SIGNAL_WAITS = (0.0, 15.0, 15.0, 8.0, 15.0, 19.0, 14.0, 10.0, 7.0)
YIELD_S = 2.0
GRADE_MAX, GRADE_STEEP, STEEP_FACTOR, GRADE_FACTOR = 0.20, 0.05, 4.4928, 5.5044
DEFAULT_CARS = {
    "primary": 500.0, "primary_link": 500.0, "secondary": 100.0, "secondary_link": 100.0, "tertiary": 25.0, "tertiary_link": 25.0, "service": 25.0, "unclassified": 25.0,
    "residential": 25.0, "living_street": 25.0,
}


@dataclass(frozen=True)
class Profile:
    """What a mode's speeds are made of; calibration varies these."""

    mode: str
    base: float
    least: float
    most: float
    highway: dict = field(default_factory=dict)
    surface: dict = field(default_factory=dict)
    traffic: float = TRAFFIC


WALK = Profile("walk", 4.8, 0.8, 6.0, WALK_HIGHWAY, WALK_SURFACE)
BIKE = Profile("bike", 14.0, 1.0, 30.0, BIKE_HIGHWAY, BIKE_SURFACE)


def lookup(table: dict, key: Column, default: float | None) -> Column:
    """The table's value of a key, ``default`` where it has none."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    return found if default is None else F.coalesce(found, F.lit(float(default)))


def names(packed: Column, value: str) -> Column:
    """Whether one of the ``;``-parts of a tag is ``value``; not where the tag is missing."""
    return F.coalesce(F.array_contains(F.transform(F.split(packed, ";"), lambda p: F.trim(p)), value), F.lit(False))


def facility(cycleway: Column | None) -> Column:
    """The factor of the best cycling facility named in a ``;``-joined value."""
    if cycleway is None:
        return F.lit(MIXED)
    return F.when(names(cycleway, "track"), TRACK).when(names(cycleway, "lane"), LANE).otherwise(MIXED)


def disutility(highway: Column, cycleway: Column | None = None) -> Column:
    """Cost a kilometre of the road's class and facility, before traffic."""
    return F.coalesce(lookup(ROAD_BETA, highway, None) + SEPARATED_BETA * facility(cycleway), F.lit(REFERENCE_COST))


def traffic_factor(cost: Column, cars: Column, coefficient: float = TRAFFIC) -> Column:
    """What car traffic leaves of the speed; 1 where the volume is missing."""
    known = cars.isNotNull() & ~F.isnan(cars)
    return F.when(known, cost / (cost + coefficient * cars / ROUTE_KM)).otherwise(1.0)


def shared_path(highway: Column, segregated: Column) -> Column:
    return F.when(highway.isin("cycleway", "path") & (segregated == "no"), SHARED_PATH).otherwise(1.0)


def speed(p: Profile, highway: Column, surface: Column, segregated: Column, cars: Column, cycleway: Column | None = None) -> Column:
    """Kilometres an hour of a link in one direction."""
    v = lookup(p.highway, highway, p.base) * lookup(p.surface, surface, 1.0)
    if p.mode == "bike":
        cost = disutility(highway, cycleway)
        v = v / F.greatest(cost / REFERENCE_COST, F.lit(1.0)) * shared_path(highway, segregated) * traffic_factor(cost, cars, p.traffic)
    return F.least(F.greatest(v, F.lit(p.least)), F.lit(p.most))


def signal_wait(code: Column) -> Column:
    """Seconds of a signal code from 0 to 8; others and NULL count as 0."""
    return F.when(code.between(0, 8), F.element_at(F.array(*[F.lit(w) for w in SIGNAL_WAITS]), (code + 1).cast("int"))).otherwise(0.0)


def grade_penalty(climb: Column, length: Column) -> Column:
    """Seconds that a climb adds; nothing from a grade of a fifth on, where the heights must be wrong."""
    up = F.greatest(climb, F.lit(0.0))
    g = F.coalesce(F.try_divide(up, length), F.lit(0.0))
    return F.when(g >= GRADE_MAX, 0.0).when(g > GRADE_STEEP, STEEP_FACTOR * up).otherwise(GRADE_FACTOR * up)


def crossing_yield(highway: Column, crossing: Column, share: Column | None = None) -> Column:
    """Seconds that a bike yields at an unsignalled crossing way."""
    unsignalled = crossing.isNotNull() & ~crossing.isin("", "traffic_signals", "no")
    return F.when(highway.isin(*PATHS) & unsignalled, YIELD_S * (share if share is not None else F.lit(1.0))).otherwise(0.0)


def travel_time(length: Column, kmh: Column) -> Column:
    return length / (kmh / 3.6)


def car_volume(matched: Column, override: Column | None = None, adjacent: Column | None = None) -> Column:
    """The hand-set volume, else the matched, else the adjacent road's."""
    clean = [F.when(~F.isnan(c), c) for c in (override, matched, adjacent) if c is not None]
    return F.coalesce(*clean)


def effective_oneway(mode: str, oneway: Column, oneway_bicycle: Column) -> Column:
    return F.coalesce(oneway_bicycle, oneway) if mode == "bike" else F.lit(None).cast("string")


def directions(mode: str, oneway: Column, oneway_bicycle: Column, junction: Column) -> Column:
    """The directions of travel, 1 along and -1 against the digitised one."""
    if mode == "walk":
        return F.array(F.lit(1), F.lit(-1))
    o = effective_oneway(mode, oneway, oneway_bicycle)
    back = F.coalesce(o.isin("-1", "T"), F.lit(False))
    one = F.coalesce(o.isin("yes", "true", "1", "F"), F.lit(False)) | F.coalesce(junction == "roundabout", F.lit(False))
    return F.when(back, F.array(F.lit(-1))).when(one, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(-1)))
