"""Distances between coordinates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres."""
    half_dlat = F.radians(lat2 - lat1) / 2.0
    half_dlon = F.radians(lon2 - lon1) / 2.0
    a = (F.sin(half_dlat) * F.sin(half_dlat)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_dlon) * F.sin(half_dlon))
    return 2.0 * EARTH_RADIUS_KM * F.atan2(F.sqrt(a), F.sqrt(1.0 - a))


def haversine_km_numpy(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """The same for arrays, inside tasks."""
    a = (np.sin(np.radians(lat2 - lat1) / 2) ** 2
         + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lon2 - lon1) / 2) ** 2)
    return 2 * EARTH_RADIUS_KM * np.arctan2(np.sqrt(a), np.sqrt(1 - a))


def planar_sq(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Squared distance in degrees; used only to order neighbours."""
    dlat, dlon = lat1 - lat2, lon1 - lon2
    return dlat * dlat + dlon * dlon


def located(lat: Column, lon: Column) -> Column:
    """Both coordinates present; 0.0 counts as missing."""
    return F.coalesce((lat != 0.0) & (lon != 0.0), F.lit(False))
