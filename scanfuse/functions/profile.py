"""Sensor profiles."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SensorProfile:
    """Beams, columns and angles (degrees) of a spinning sensor; `beams` where they are not evenly spread."""

    rows: int
    cols: int
    res_x: float
    res_y: float
    bottom: float
    beams: tuple[float, ...] = ()
    scan_period: float = 0.1


#: Fixed values of the supported sensors.
PROFILES = {
    "vlp16": SensorProfile(16, 1800, 0.2, 2.0, 15.1),
    "hdl32": SensorProfile(32, 1800, 0.2, 41.33 / 31, 30.67),
    "hdl64": SensorProfile(64, 1800, 0.2, 26.9 / 63, 24.9),
    "os1_16": SensorProfile(16, 1024, 360 / 1024, 33.2 / 15, 16.7),
    "os1_64": SensorProfile(64, 1024, 360 / 1024, 33.2 / 63, 16.7),
    "rs16": SensorProfile(16, 1800, 0.2, 2.0, 15.1),
    "rs32": SensorProfile(32, 1800, 0.2, 40 / 31, 25.1, tuple(round(-25 + 40 / 31 * k, 4) for k in range(32))),
    "pandar40": SensorProfile(40, 1800, 0.2, 23 / 39, 16.1),
    #: The room scene derived from `lineitem`.
    "room": SensorProfile(16, 180, 2.0, 2.0, 15.1, tuple(-15.0 + 2.0 * k for k in range(16))),
}
