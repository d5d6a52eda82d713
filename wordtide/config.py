"""Named parameters with the production defaults; tests and small tables pass their own."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    ingest_years: tuple[int, int] = (1979, 2022)
    years: tuple[int, int] = (1988, 2021)
    min_records: int = 10  # a word's records over all years and genres
    min_entity_years: int = 40
    ratio_add: float = 5.0
    ratio_from: int = 2000
    emerge: float = 0.10
    takeoff: float = 0.25
    min_users: int = 5
    window: int = 8
    pool_records: int = 20
    name_records: int = 30
    top_k: int = 200
    gap: int = 5
    offsets: tuple[int, int] = (-8, 8)
    min_support: int = 15
    buckets: int = 200  # of the tables that steps share; all the same, and no fewer than shuffle partitions, or Spark shuffles them anew
    decade: int = 10  # years of a folder
    cohorts: tuple[tuple[int, int], ...] = ((1992, 1999), (2000, 2006), (2007, 2012), (2013, 2018))


DEFAULT = Config()
