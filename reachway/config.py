"""Parameters of the access model. Values that results depend on stand here as plain text."""

from __future__ import annotations

# Category codes, spelling variants, thresholds, speeds and weights of the access model.
SURGICAL_CATEGORIES = ("II-1", "II-2", "II-E", "III-1", "III-2", "III-E")
CATEGORY_VARIANTS = {"II-1 ": "II-1", "ii-1": "II-1", "II–1": "II-1", "II_1": "II-1"}
UPGRADABLE_CATEGORIES = ("I-3", "I-4")
CAPACITY_BY_CATEGORY = {"I-1": 2, "I-2": 3, "I-3": 5, "I-4": 8, "II-1": 15, "II-2": 25, "II-E": 20, "III-1": 40, "III-2": 60, "III-E": 50}
SETTLEMENT_WEIGHTS = {
    "CIUDAD": 20, "VILLA": 10, "PUEBLO": 8, "PUEBLO JOVEN": 8, "BARRIO O CUARTEL": 6, "URBANIZACION": 6, "ASOCIACION DE VIVIENDA": 5, "CONJTO.HABITACIONAL": 5,
    "COOPERATIVA DE VIVIENDA": 5, "COOP. AGRARIA": 3, "COMUNIDAD": 3, "CASERÍO": 2, "ANEXO": 2, "CAMPO MINERO": 2,
}
DEFAULT_WEIGHT, CAPITAL_BONUS = 1, 3
COUNTRY_BBOX = {"lon_min": -81.4, "lon_max": -68.6, "lat_min": -18.4, "lat_max": -0.04}
DEPARTMENTS = {
    "costa": {"nombre": "TUMBES", "north": -3.35, "south": -4.05, "east": -80.10, "west": -80.65},
    "andino": {"nombre": "HUANCAVELICA", "north": -11.80, "south": -13.75, "east": -74.35, "west": -75.80},
    "amazonico": {"nombre": "MADRE DE DIOS", "north": -9.90, "south": -13.50, "east": -68.65, "west": -72.50},
}
THRESHOLDS_MIN = (30, 60, 120)
URBAN_POPULATION = 2000
SFCA_THRESHOLD_MIN = 60
SNAP_MAX_M = 500
MAX_DEMAND_POINTS = 5000
PROFILES = ("drive", "walk", "bike")
PROFILE_SPEED_KMH = {"drive": 30.0, "walk": 5.0, "bike": 15.0}
HIGHWAY_SPEED_KMH = {
    "motorway": 100, "motorway_link": 60, "trunk": 80, "trunk_link": 50, "primary": 60, "primary_link": 40, "secondary": 50, "secondary_link": 35, "tertiary": 40, "tertiary_link": 30,
    "unclassified": 30, "residential": 25, "living_street": 15, "service": 20, "track": 20, "road": 30,
}
DRIVE_HIGHWAYS = ("motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "unclassified", "residential", "living_street", "service", "road")
NO_WALK_HIGHWAYS = ("motorway", "motorway_link")
DEFAULT_DRIVE_KMH = 30.0
MPH_IN_KMH = 1.60934
DETOUR_SPEED_KMH, DEFAULT_DETOUR = 30.0, 1.3
BAND_LABELS = ("<= 30 min", "<= 60 min", "<= 120 min", "> 120 min")
NO_ROUTE = "Sin ruta (sin facility en el departamento)"
